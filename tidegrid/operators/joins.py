"""As-of, bounded and event joins, all as equi-joins or a single sorted pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions.scalar import col


def asof_join(
    target: DataFrame,
    source: DataFrame,
    ax: Axis,
    values: list[str],
    limit: int | None = None,
    direction: str = "backward",
    matched: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Give each target row the source row with the closest label at or before it (``backward``)
    or at or after it (``forward``); ``strict`` leaves out the equal label.

    Matching is on labels, so a null at the matched label stays null. ``limit`` bounds how many
    target rows in a row may reuse a label they do not equal. Source and target are united and
    sorted once: one shuffle, linear work. Both sides are daily panels, at most one row per series
    and day; reduce ticks with ``bars.normalise_index`` first.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    rest = [c for c in target.columns if c not in ax.id_cols and c not in values]
    carried = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_"))
    hit = F.struct(F.col(ax.ts).alias("at"), *values)
    src_side, tgt_side = (1, 0) if strict else (0, 1)
    t = target.select(*ax.id_cols, F.lit(tgt_side).alias("_side"), carried.alias("_t"))
    s = source.select(*ax.id_cols, F.lit(src_side).alias("_side"), hit.alias("_s"))
    both = s.unionByName(t, allowMissingColumns=True)
    by_ts = F.col(ax.ts).asc() if direction == "backward" else F.col(ax.ts).desc()
    w = Window.partitionBy(*ax.keys).orderBy(by_ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_hit", F.last("_s", ignorenulls=True).over(w)).filter(F.col("_side") == tgt_side)
    if limit is not None:
        since = Window.partitionBy(*ax.keys, "_hit.at").orderBy(by_ts).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("_reuse", F.sum(F.when(F.col("_hit.at") != F.col(ax.ts), 1).otherwise(0)).over(since))
        out = out.withColumn("_hit", F.when(F.col("_reuse") <= limit, F.col("_hit")))
    cols = [*ax.id_cols, *[F.col(f"_t.{c}").alias(c) for c in rest], *[F.col(f"_hit.{v}").alias(v) for v in values]]
    if matched:
        cols.append(F.col("_hit.at").alias(matched))
    return out.select(*cols)


def nearest_join(target: DataFrame, source: DataFrame, ax: Axis, values: list[str], matched: str = "matched_ts") -> DataFrame:
    """The source row nearest in time; on a tie the later label wins."""
    back, fwd = [f"_b_{v}" for v in values], [f"_f_{v}" for v in values]
    s_back = source.select(*ax.id_cols, *[F.col(v).alias(b) for v, b in zip(values, back)])
    s_fwd = source.select(*ax.id_cols, *[F.col(v).alias(f) for v, f in zip(values, fwd)])
    out = asof_join(target, s_back, ax, back, matched="_b_at")
    out = asof_join(out, s_fwd, ax, fwd, direction="forward", matched="_f_at")
    use_fwd = F.col("_f_at").isNotNull() & (
        F.col("_b_at").isNull() | (F.datediff("_f_at", ax.ts) <= F.datediff(ax.ts, "_b_at"))
    )
    picked = [F.when(use_fwd, F.col(f)).otherwise(F.col(b)).alias(v) for v, b, f in zip(values, back, fwd)]
    keep = [c for c in target.columns if c not in values]
    return out.select(*keep, *picked, F.when(use_fwd, F.col("_f_at")).otherwise(F.col("_b_at")).alias(matched))


def first_within(target: DataFrame, source: DataFrame, ax: Axis, start: str | Column, days: int, values: list[str], matched: str = "found_ts") -> DataFrame:
    """The first source day in ``start .. start + days``.

    Each source row is spread over the start days it answers for (those after the previous source
    row, at most ``days`` back), which makes the probe one equi-join with unique right-hand keys."""
    prev = F.lag(ax.ts).over(ax.ordered())
    opens = F.greatest(F.date_sub(F.col(ax.ts), days), F.date_add(F.col("_prev"), 1))
    served = (
        source.select(*ax.id_cols, *values).withColumn("_prev", prev)
        .select(*ax.keys, F.col(ax.ts).alias(matched), *values, F.explode(F.sequence(opens, F.col(ax.ts), F.expr("interval 1 day"))).alias("_day"))
    )
    return target.withColumn("_day", col(start)).join(served, [*ax.keys, "_day"], "left").select(*target.columns, *values, matched)


def signed_days_to_next(dates: DataFrame, events: DataFrame, ts: str, event_date: str, out: str) -> DataFrame:
    """Days to the next event on or after each date, as a number <= 0 (0 on the day).

    ``dates`` holds distinct days and ``events`` a calendar, both bounded by the calendar."""
    ax = Axis(("_one",), ts)
    t = dates.withColumn("_one", F.lit(1))
    s = events.select(F.lit(1).alias("_one"), F.col(event_date).alias(ts), F.lit(1).alias("_e")).distinct()
    hit = asof_join(t, s, ax, ["_e"], direction="forward", matched="_next")
    return hit.withColumn(out, -F.datediff("_next", ts)).drop("_one", "_e", "_next")


def near_any_event(dates: DataFrame, events: DataFrame, ts: str, event_date: str, offset: int, window: int, out: str) -> DataFrame:
    """1 when any event moved by ``offset`` days lies within ``window`` days."""
    around = F.sequence(F.lit(offset - window), F.lit(offset + window))
    days = events.select(F.explode(F.transform(around, lambda k: F.date_add(F.col(event_date), k))).alias(ts)).distinct()
    return dates.join(days.withColumn("_near", F.lit(1)), ts, "left").withColumn(out, F.coalesce("_near", F.lit(0))).drop("_near")


def similar_states(history: DataFrame, ax: Axis, score: str, band: float) -> DataFrame:
    """History rows whose score is within ``band`` of the series' latest score.

    The latest score is one row per series, joined back on the series key."""
    latest = history.filter(F.col(score).isNotNull()).groupBy(*ax.keys).agg(F.max_by(score, ax.ts).alias("current_score"))
    return history.join(latest, list(ax.keys)).filter(F.abs(F.col(score) - F.col("current_score")) <= band)


def attach_lookup(df: DataFrame, dim: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """Left join to a literal dimension (a handful of rows); unmatched rows take the defaults."""
    out = df.join(dim, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def align_long_to_wide(long: DataFrame, ax: Axis, name: str, value: str, names: list[str]) -> DataFrame:
    """Named series as columns on a shared date; the name list is given, so no extra pass."""
    picks = [F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names]
    return long.groupBy(*ax.keys, ax.ts).agg(*picks)
