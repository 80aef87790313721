"""Row-frame window expressions over a panel axis.

Each helper takes a column name (or any SQL expression) and returns a Column. A frame of ``k`` rows
yields a value only when at least ``min_periods`` (default ``k``) of them are non-null. Frames of one
axis share one sort, so a stage of many features costs one shuffle; features that feed other frames
go to a later stage. Expressions are written as SQL text: a feature is then one call into the JVM
instead of dozens, which matters when hundreds are planned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions.ordered import Ask, ask, with_columns
from tidegrid.functions.scalar import clip, nonzero


def known(x: str, k: int, ax: Axis) -> str:
    """Non-null values among the last ``k`` rows, as the difference of two running counts: constant
    work per row where a sliding count would revisit the frame."""
    return f"(count({x}) {ax.frame(None, 0)} - count({x}) {ax.frame(None, -k)})"


def _guard(x: str, ax: Axis, k: int, value: str, min_periods: int | None) -> str:
    need = max(k if min_periods is None else min_periods, 1)
    return f"CASE WHEN {known(x, k, ax)} >= {need} THEN {value} END"


def lag(c: str, k: int, ax: Axis) -> Column:
    return F.expr(f"lag({c}, {k}) {ax.over}")


def lead(c: str, k: int, ax: Axis) -> Column:
    return F.expr(f"lead({c}, {k}) {ax.over}")


def diff(c: str, k: int, ax: Axis) -> Column:
    return F.expr(f"{c} - lag({c}, {k}) {ax.over}")


def pct_change(c: str, k: int, ax: Axis, pad: bool = True) -> Column:
    """Fractional change over ``k`` rows; ``pad`` carries the last known value over nulls."""
    if not pad:
        return F.expr(f"{c} / nullif(lag({c}, {k}) {ax.over}, 0) - 1")
    now, was = f"last({c}, true) {ax.frame(None, 0)}", f"last({c}, true) {ax.frame(None, -k)}"
    return F.expr(f"{now} / nullif({was}, 0) - 1")


def _mean(c: str, k: int, ax: Axis) -> str:
    return f"avg({c}) {ax.frame(1 - k, 0)}"


def _std(c: str, k: int, ax: Axis) -> str:
    return f"stddev_samp({c}) {ax.frame(1 - k, 0)}"


def mean(c: str, k: int, ax: Axis, min_periods: int | None = None) -> Column:
    return F.expr(_guard(c, ax, k, _mean(c, k, ax), min_periods))


def total(c: str, k: int, ax: Axis, min_periods: int | None = None) -> Column:
    return F.expr(_guard(c, ax, k, f"sum({c}) {ax.frame(1 - k, 0)}", min_periods))


def std(c: str, k: int, ax: Axis, min_periods: int | None = None) -> Column:
    return F.expr(_guard(c, ax, k, _std(c, k, ax), min_periods))


def quantile(c: str, q: float, k: int, ax: Axis, min_periods: int | None = None) -> Column:
    """Linearly interpolated quantile of the frame. A placeholder, as all ranks and quantiles: see ``with_columns``."""
    return ask(Ask("quantile", c, 1 - k, 0, (q, k if min_periods is None else min_periods)), ax)


def prior_quantile(c: str, q: float, k: int, ax: Axis, min_periods: int | None = None) -> Column:
    """Quantile of the ``k`` rows before this one: a threshold that cannot see the current row."""
    return ask(Ask("quantile", c, -k, -1, (q, k if min_periods is None else min_periods)), ax)


def skew(c: str, k: int, ax: Axis) -> Column:
    """Bias-corrected sample skewness; null without spread."""
    n, w = float(k), ax.frame(1 - k, 0)
    scale = math.sqrt(n * (n - 1)) / (n - 2)
    return F.expr(_guard(c, ax, k, f"CASE WHEN {_std(c, k, ax)} > 0 THEN skewness({c}) {w} * {scale!r}D END", None))


def kurt(c: str, k: int, ax: Axis) -> Column:
    """Bias-corrected excess kurtosis; null without spread."""
    n, w = float(k), ax.frame(1 - k, 0)
    scale = (n - 1) / ((n - 2) * (n - 3))
    return F.expr(_guard(c, ax, k, f"CASE WHEN {_std(c, k, ax)} > 0 THEN {scale!r}D * ({n + 1}D * kurtosis({c}) {w} + 6) END", None))


def corr(a: str, b: str, k: int, ax: Axis, min_periods: int | None = None) -> Column:
    """Pearson correlation over rows where both sides are present; null without spread."""
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    need = max(k if min_periods is None else min_periods, 2)
    scale = f"nullif({_std(x, k, ax)} * {_std(y, k, ax)}, 0)"
    return F.expr(f"CASE WHEN {known(x, k, ax)} >= {need} THEN covar_samp({x}, {y}) {ax.frame(1 - k, 0)} / {scale} END")


def zscore(c: str, k: int, ax: Axis, min_periods: int | None = None, floor: float | None = 1e-8) -> Column:
    """(x - mean) / std of the frame. ``floor`` bounds the deviation from below; ``None`` gives
    null when the frame has no spread."""
    s = _std(c, k, ax)
    s = f"nullif({s}, 0)" if floor is None else f"CASE WHEN {s} < {floor!r}D THEN {floor!r}D ELSE {s} END"
    return F.expr(_guard(c, ax, k, f"({c} - {_mean(c, k, ax)}) / {s}", min_periods))


def moments(c: str, windows, ax: Axis, half: bool = False, deviation: bool = True) -> dict[str, Column]:
    """Rolling means and deviations as named columns (``_m{w}_c``, ``_s{w}_c``), for packs that use
    the same frame in several features: Spark does not merge equal window expressions itself."""
    out = {f"_m{w}_{c}": mean(c, w, ax, w // 2 if half else None) for w in windows}
    if deviation:
        out.update({f"_s{w}_{c}": std(c, w, ax, w // 2 if half else None) for w in windows})
    return out


def z_of(c: str, w: int, floor: float | None = 1e-8) -> Column:
    """z-score from ``moments`` columns."""
    s = F.col(f"_s{w}_{c}")
    return (F.col(c) - F.col(f"_m{w}_{c}")) / (nonzero(s) if floor is None else clip(s, lo=floor))


def gap_of(c: str, w: int) -> Column:
    """Percent gap to the mean from ``moments`` columns."""
    m = F.col(f"_m{w}_{c}")
    return (F.col(c) - m) / nonzero(m) * 100


def rank_pct(c: str, k: int, ax: Axis, min_periods: int | None = None) -> Column:
    """Average rank of the current value within its frame, as a share of the non-null count."""
    return ask(Ask("rank", c, 1 - k, 0, (max(k if min_periods is None else min_periods, 1),)), ax)


def pct_below(c: str, k: int, ax: Axis, min_valid: int | None = None) -> Column:
    """Share of the ``k + 1`` row frame strictly below the current value, times 100.

    The default asks for a full frame, as the reference's outer rolling does; ``min_valid`` gives
    the looser rule it states (70 % of the window)."""
    return ask(Ask("below", c, -k, 0, (k + 1 if min_valid is None else min_valid, 100.0)), ax)


def prior_rank(c: str, k: int, ax: Axis, min_rows: int) -> Column:
    """Share of the values before the current one, in a ``k`` row frame, that lie below it."""
    return ask(Ask("below", c, 1 - k, -1, (min_rows - 1, 1.0)), ax)


def full_rank_pct(c: str, ax: Axis) -> Column:
    """Average-rank percentile over the whole series. Looks ahead: offline description only."""
    keys = ", ".join(ax.keys)
    lowest, same = f"rank() OVER (PARTITION BY {keys} ORDER BY {c} ASC NULLS LAST)", f"count({c}) OVER (PARTITION BY {keys}, {c})"
    return F.expr(f"CASE WHEN {c} IS NOT NULL THEN ({lowest} + ({same} - 1) / 2) / nullif(count({c}) OVER (PARTITION BY {keys}), 0) END")


def expanding_rank_pct(c: str, ax: Axis) -> Column:
    """The same rank seen from each row's own past: no look-ahead. The series' values so far are held once, sorted."""
    return ask(Ask("rank", c, None, 0, (1,)), ax)


def ewm_means(df: DataFrame, specs: dict[str, tuple[str, float]], ax: Axis) -> DataFrame:
    """Normalised exponentially weighted means, ``{output: (column, span)}``, by the plain recursion over the series.

    Weights of missing rows still decay, which changes nothing until the next value: all weights shrink
    alike, so a missing row has the mean of the last value's row, however far back."""
    return with_columns(df, {name: ask(Ask("ewm", c, None, 0, (float(span),)), ax) for name, (c, span) in specs.items()})


def realized_vol(returns: str, k: int, ax: Axis) -> Column:
    """Annualised deviation of fractional returns, in percent."""
    return std(returns, k, ax) * (math.sqrt(252.0) * 100.0)


def vs_average(c: str, k: int, ax: Axis) -> Column:
    return F.expr(_guard(c, ax, k, f"({c} / nullif({_mean(c, k, ax)}, 0) - 1) * 100", None))


def fill_forward(c: str, limit: int, ax: Axis) -> Column:
    """Fill null values with the last one at most ``limit`` rows back."""
    return F.expr(f"coalesce({c}, last({c}, true) {ax.frame(-limit, 0)})")


def decay_weights(ax: Axis, halflife: float) -> Column:
    """Weights that halve every ``halflife`` rows back from the series end, summing to one."""
    newest_first = ax.whole().orderBy(F.col(ax.ts).desc())
    age = F.row_number().over(newest_first) - 1
    n = F.count(F.lit(1)).over(ax.whole()).cast("double")
    r = 0.5 ** (1.0 / halflife)
    norm = (1.0 - F.pow(F.lit(r), n)) / (1.0 - r)
    return F.pow(F.lit(r), age.cast("double")) / norm
