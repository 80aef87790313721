"""Building blocks of the oracle SQL (DuckDB dialect), written apart from the Spark code."""

from __future__ import annotations

PART = "series_id"


def frame(k: int, part: str | None = None) -> str:
    return f"OVER (PARTITION BY {part or PART} ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def over(part: str | None = None) -> str:
    return f"OVER (PARTITION BY {part or PART} ORDER BY ts)"


def upto(part: str | None = None) -> str:
    return f"OVER (PARTITION BY {part or PART} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def guard(x, k, value, mp=None):
    return f"(CASE WHEN count({x}) {frame(k)} >= {max(k if mp is None else mp, 1)} THEN {value} END)"


def lag(x, k):
    return f"lag({x}, {k}) {over()}"


def lead(x, k):
    return f"lead({x}, {k}) {over()}"


def diff(x, k):
    return f"({x} - lag({x}, {k}) {over()})"


def pct(x, k):
    w = "PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return (
        f"(last_value({x} IGNORE NULLS) OVER ({w} CURRENT ROW)"
        f" / nullif(last_value({x} IGNORE NULLS) OVER ({w} {k} PRECEDING), 0) - 1)"
    )


def mean(x, k, mp=None):
    return guard(x, k, f"avg({x}) {frame(k)}", mp)


def total(x, k, mp=None):
    return guard(x, k, f"sum({x}) {frame(k)}", mp)


def std(x, k, mp=None):
    return guard(x, k, f"stddev_samp({x}) {frame(k)}", mp)


def rvol(x, k):
    return f"({std(x, k)} * sqrt(252.0) * 100.0)"


def quantile(x, q, k, mp=None):
    return guard(x, k, f"quantile_cont({x}, {q}) {frame(k)}", mp)


def zscore(x, k):
    return f"(({x} - {mean(x, k)}) / greatest({std(x, k)}, 1e-8))"


def zscore_null(x, k, mp=None):
    """z-score with min_periods and null for zero deviation."""
    mp = k if mp is None else mp
    return f"(({x} - {mean(x, k, mp)}) / nullif({std(x, k, mp)}, 0))"


def zguard(x, k):
    """z-score whose floor does not turn a missing deviation into the floor."""
    return (
        f"(CASE WHEN count({x}) {frame(k)} >= {k} THEN ({x} - avg({x}) {frame(k)})"
        f" / greatest(stddev_samp({x}) {frame(k)}, 1e-8) END)"
    )


def rank_pct(x, k, mp=None):
    need = max(k if mp is None else mp, 1)
    vals = f"list({x}) FILTER ({x} IS NOT NULL) {frame(k)}"
    return (
        f"(CASE WHEN {x} IS NOT NULL AND count({x}) {frame(k)} >= {need} THEN"
        f" (len(list_filter({vals}, lambda v: v < {x})) + (len(list_filter({vals}, lambda v: v = {x})) + 1) / 2.0)"
        f" / count({x}) {frame(k)} END)"
    )


def pct_below(x, k):
    vals = f"list({x}) FILTER ({x} IS NOT NULL) {frame(k + 1)}"
    return (
        f"(CASE WHEN {x} IS NOT NULL AND count({x}) {frame(k + 1)} >= {k + 1} THEN"
        f" len(list_filter({vals}, lambda v: v < {x})) * 100.0 / count({x}) {frame(k + 1)} END)"
    )


def full_rank(x):
    return (
        f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY series_id ORDER BY {x} NULLS LAST)"
        f" + (count({x}) OVER (PARTITION BY series_id, {x}) - 1) / 2.0)"
        f" / count({x}) OVER (PARTITION BY series_id) END)"
    )


def corr(x, y, k, mp=None):
    xm, ym = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    need = max(k if mp is None else mp, 2)
    return (
        f"(CASE WHEN count({xm}) {frame(k)} >= {need} THEN covar_samp({xm}, {ym}) {frame(k)}"
        f" / nullif(stddev_samp({xm}) {frame(k)} * stddev_samp({ym}) {frame(k)}, 0) END)"
    )


def clip(x, lo=None, hi=None):
    out = f"{x}"
    if lo is not None:
        out = f"greatest({out}, {lo})"
    if hi is not None:
        out = f"least({out}, {hi})"
    return f"(CASE WHEN {x} IS NOT NULL THEN {out} END)"


def flag(cond):
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def cut(x, edges, labels=None, lowest=False):
    labels = list(range(len(edges) - 1)) if labels is None else labels
    arms = []
    for i, lab in enumerate(labels):
        op = ">=" if (lowest and i == 0) else ">"
        arms.append(f"WHEN {x} {op} {edges[i]} AND {x} <= {edges[i + 1]} THEN {lab}")
    return "(CASE " + " ".join(arms) + " END)"


def checked_regime(x, edges, labels=None):
    whole = "OVER (PARTITION BY series_id)"
    return (
        f"(CASE WHEN count({x}) {whole} * 1.0 / count(*) {whole} < 0.5 THEN 0"
        f" WHEN max({x}) {whole} - min({x}) {whole} < 1e-6 THEN 0"
        f" ELSE coalesce({cut(x, edges, labels)}, 0) END)"
    )


def nanmean(cols):
    n = " + ".join(f"({c} IS NOT NULL)::INT" for c in cols)
    s = " + ".join(f"coalesce({c}, 0)" for c in cols)
    return f"(({s}) / nullif({n}, 0))"


def nanstd(cols):
    n = "(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in cols) + ")"
    s = "(" + " + ".join(f"coalesce({c}, 0)" for c in cols) + ")"
    m = f"({s} / nullif({n}, 0))"
    ss = " + ".join(f"coalesce(({c} - {m}) * ({c} - {m}), 0)" for c in cols)
    return f"(CASE WHEN {n} > 1 THEN sqrt(({ss}) / nullif({n} - 1, 0)) END)"


def r(x, digits=6):
    return f"(round({x}, {digits}) + 0.0)"


def day(c):
    return f"strftime({c}, '%Y-%m-%d')"


class Steps:
    """A chain of CTEs; each stage may use every column of the one before it."""

    def __init__(self, base: str, name: str = "s0"):
        self.ctes = [(name, base)]

    @property
    def last(self) -> str:
        return self.ctes[-1][0]

    def add(self, **exprs: str) -> "Steps":
        body = ", ".join(f'{v} AS "{k}"' for k, v in exprs.items())
        self.ctes.append((f"s{len(self.ctes)}", f"SELECT *, {body} FROM {self.last}"))
        return self

    def raw(self, body: str) -> "Steps":
        """``body`` may name the previous step as ``{prev}``."""
        self.ctes.append((f"s{len(self.ctes)}", body.replace("{prev}", self.last)))
        return self

    def done(self, select: str) -> str:
        chain = ", ".join(f"{n} AS ({b})" for n, b in self.ctes)
        return f"WITH {chain} {select.replace('{prev}', self.last)}"

    def out(self, doubles: list[str], ints: list[str] = (), keys=("series_id",), ts="ts", texts=(), digits: int = 6, fine=()) -> str:
        cols = list(keys) + ([f"{day(ts)} AS {ts}"] if ts else [])
        cols += [f'{r(chr(34) + c + chr(34), 9 if c in fine else digits)} AS "{c}"' for c in doubles]
        cols += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints]
        cols += [f'"{c}"' for c in texts]
        return self.done(f"SELECT {', '.join(cols)} FROM {{prev}}")
