"""Row-wise column expressions: coercion, clipping, safe ratios, binning, row statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Cols = list[Column]
INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c) -> Column:
    """Text or number to DOUBLE; what cannot be read becomes null, and so does NaN."""
    v = col(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def finite(c, fill: float | None = None) -> Column:
    """Drop NaN and +-inf to null, or to ``fill`` (which also replaces nulls)."""
    v = col(c)
    kept = F.when(~F.isnan(v) & (F.abs(v) != F.lit(INF)), v)
    return kept if fill is None else F.coalesce(kept, F.lit(fill))


def clip(c, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip that keeps nulls (plain greatest/least would skip them)."""
    v = col(c)
    out = v
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(v.isNotNull(), out)


def nonzero(c) -> Column:
    v = col(c)
    return F.when(v != 0, v)


def ratio(num, den) -> Column:
    """num / den with a zero denominator giving null."""
    return col(num) / nonzero(den)


def safe_divide(num, den, fill: float | None = None, min_den: float = 1e-10, signed: bool = True) -> Column:
    """Division guarded by the size of the denominator.

    ``signed=False`` divides by the absolute denominator, the behaviour of the column form the
    reference uses; the scalar form keeps the sign.
    """
    d = col(den)
    base = d if signed else F.abs(d)
    out = F.when(F.abs(d) >= min_den, col(num) / F.when(F.abs(d) >= min_den, base))
    return out if fill is None else F.coalesce(out, F.lit(float(fill)))


def cut(c, edges: list[float], labels: list | None = None, closed: str = "right", include_lowest: bool = False) -> Column:
    """Bin index of a value. ``closed='right'`` is (a, b], ``'left'`` is [a, b). Outside is null."""
    v = col(c)
    labels = list(range(len(edges) - 1)) if labels is None else labels
    out = None
    for i, label in enumerate(labels):
        lo, hi = float(edges[i]), float(edges[i + 1])
        if closed == "right":
            above = v >= lo if (include_lowest and i == 0) else v > lo
            cond = above & (v <= hi)
        else:
            cond = (v >= lo) & (v < hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def step_class(c, inner: list[float], labels: list | None = None) -> Column:
    """Left-closed classes open at both ends: v < inner[0] is the first, else-branch the last."""
    v = col(c)
    labels = list(range(len(inner) + 1)) if labels is None else labels
    out = F.when(v.isNull(), F.lit(None))
    for edge, label in zip(inner, labels):
        out = out.when(v < float(edge), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def boundary_distance(c, edges: list[float]) -> Column:
    v = col(c)
    return F.when(v.isNotNull(), F.least(*[F.abs(v - float(e)) for e in edges]))


def flag(cond: Column) -> Column:
    """0/1 with null read as 0, the way a null comparison casts to int."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def sign(c) -> Column:
    return F.signum(col(c))


def row_count(cols: Cols) -> Column:
    return reduce(lambda a, b: a + b, [col(c).isNotNull().cast("int") for c in cols])


def row_sum(cols: Cols) -> Column:
    """Sum skipping nulls; a row of nulls sums to 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(col(c), F.lit(0.0)) for c in cols])


def row_mean(cols: Cols) -> Column:
    n = row_count(cols)
    return F.when(n > 0, row_sum(cols) / nonzero(n))


def row_std(cols: Cols) -> Column:
    """Sample deviation across columns, nulls skipped; null below two values."""
    n = row_count(cols)
    mean = row_mean(cols)
    ss = reduce(lambda a, b: a + b, [F.coalesce((col(c) - mean) * (col(c) - mean), F.lit(0.0)) for c in cols])
    return F.when(n > 1, F.sqrt(ss / F.when(n > 1, n - 1)))


def one_hot(c, values: list) -> dict[object, Column]:
    return {v: flag(col(c) == F.lit(v)) for v in values}


def lookup(c, table: dict) -> Column:
    """A fixed value per key as a CASE ladder; unknown keys give null."""
    v = col(c)
    out = None
    for k, val in table.items():
        out = F.when(v == F.lit(k), F.lit(val)) if out is None else out.when(v == F.lit(k), F.lit(val))
    return out


def first_match(name, patterns: list[tuple[str, str]]) -> Column:
    """The label of the first regular expression that matches, case-insensitive."""
    low = F.lower(col(name))
    out = None
    for pattern, label in patterns:
        out = F.when(low.rlike(pattern), F.lit(label)) if out is None else out.when(low.rlike(pattern), F.lit(label))
    return out


def time_decay(days, rate: float, unit: float = 30.0) -> Column:
    return F.exp(F.lit(-rate) * (col(days) / unit))
