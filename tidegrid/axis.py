"""The panel axis: which columns name a series and which one orders it.

Every operator works on a *daily* panel, one row per ``(keys, ts)`` with ``ts`` a DATE. Raw
rows are first reduced to that grain with partial aggregation (``operators.bars``), so however
skewed the raw table is, one series never holds more rows than the calendar has days. That bound
is what makes ``partitionBy(keys)`` safe; tick-grain series go through ``operators.scan`` instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window, WindowSpec


@dataclass(frozen=True)
class Axis:
    keys: tuple[str, ...] = ("series_id",)
    ts: str = "ts"

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.ts)

    def trailing(self, k: int) -> WindowSpec:
        """The last ``k`` rows, current row included."""
        return self.ordered().rowsBetween(-(k - 1), 0)

    def prior(self, k: int) -> WindowSpec:
        """The ``k`` rows before the current one."""
        return self.ordered().rowsBetween(-k, -1)

    def upto(self, lag: int = 0) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, -lag)

    def ahead(self) -> WindowSpec:
        return self.ordered().rowsBetween(1, Window.unboundedFollowing)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def frame(self, first: int | None, last: int | None) -> str:
        """``OVER (...)`` text of a row frame; ``None`` is unbounded, negative is preceding."""

        def edge(k: int | None, side: str) -> str:
            if k is None:
                return f"UNBOUNDED {side}"
            return "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"

        rows = f"ROWS BETWEEN {edge(first, 'PRECEDING')} AND {edge(last, 'FOLLOWING')}"
        return f"OVER (PARTITION BY {', '.join(self.keys)} ORDER BY {self.ts} {rows})"

    @property
    def over(self) -> str:
        return f"OVER (PARTITION BY {', '.join(self.keys)} ORDER BY {self.ts})"

    def by(self, *more: str) -> "Axis":
        return Axis(self.keys + more, self.ts)

    @property
    def id_cols(self) -> tuple[str, ...]:
        return self.keys + (self.ts,)
