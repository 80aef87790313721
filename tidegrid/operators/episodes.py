"""State runs, streaks, transitions and episode statistics (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import rolling as R
from tidegrid.operators import ranks as RK


def with_runs(df: DataFrame, state: str, ax: Axis, run: str = "run_id") -> DataFrame:
    """Number the runs of equal state; the first row opens run 1."""
    prev = R.lag(state, 1, ax)
    opens = F.when(prev.isNull() | (F.col(state) != prev), 1).otherwise(0)
    return df.withColumn("_open", opens).withColumn(run, F.sum("_open").over(ax.upto())).drop("_open")


def episodes(df: DataFrame, state: str, value: str, ax: Axis) -> DataFrame:
    """One row per run: state, first and last day, length, largest absolute value, mean value."""
    runs = with_runs(df, state, ax)
    return runs.groupBy(*ax.keys, "run_id").agg(
        F.first(state).alias(state), F.min(ax.ts).alias("start"), F.max(ax.ts).alias("end"), F.count(F.lit(1)).alias("days"),
        F.max(F.abs(value)).alias("peak_abs"), F.avg(value).alias("mean"),
    )


def episode_stats(eps: DataFrame, by: list[str], state: str, short: int = 10, long: int = 30, bounded: bool = False) -> DataFrame:
    """Per state: number of episodes, their durations and peaks, share of days, length buckets.
    ``bounded``: ``by`` names single series."""
    d, keys = F.col("days"), [*by, state]
    agg = eps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_episodes"), F.sum("days").alias("total_days"), F.avg("days").alias("mean_days"), F.max("days").alias("max_days"), F.min("days").alias("min_days"), F.max("peak_abs").alias("max_peak"),
        F.sum((d <= short).cast("int")).alias("n_short"), F.sum(((d > short) & (d <= long)).cast("int")).alias("n_medium"), F.sum((d > long).cast("int")).alias("n_long"),
    )
    agg = RK.attach_quantiles(agg, eps, keys, "days", {"median_days": 0.5}, bounded)
    agg = RK.attach_quantiles(agg, eps, keys, "peak_abs", {"median_peak": 0.5}, bounded)
    if not by:
        return agg.withColumn("pct_days", F.col("total_days") / eps.agg(F.sum("days")).scalar() * 100)
    total = eps.groupBy(*by).agg(F.sum("days").alias("_all"))
    return agg.join(total, by).withColumn("pct_days", F.col("total_days") / F.col("_all") * 100).drop("_all")


def current_versus_history(eps: DataFrame, by: list[str], state: str, top: int = 3) -> DataFrame:
    """Each series' open episode beside the ``top`` longest earlier ones of its state that outlast it."""
    now = eps.groupBy(*by).agg(F.max_by(F.struct(F.col(state).alias("s"), F.col("days").alias("d"), F.col("run_id").alias("r")), "run_id").alias("_now"))
    longer = eps.join(now, by).filter((F.col(state) == F.col("_now.s")) & (F.col("days") > F.col("_now.d")) & (F.col("run_id") != F.col("_now.r")))
    w = Window.partitionBy(*by).orderBy(F.desc("days"), F.asc("start"))
    ranked = longer.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.select(*by, state, F.col("_now.d").alias("current_days"), "rank", "start", "end", "days")


def with_true_streak(df: DataFrame, cond: str, ax: Axis, out: str = "streak") -> DataFrame:
    """Length of the run of true rows ending at each row (0 when false or null)."""
    c = F.coalesce(F.col(cond), F.lit(False))
    d = df.withColumn("_p", F.row_number().over(ax.ordered()))
    last_false = F.coalesce(F.last(F.when(~c, F.col("_p")), ignorenulls=True).over(ax.upto()), F.lit(0))
    return d.withColumn(out, (F.col("_p") - last_false).cast("int")).drop("_p")


def streak_lengths(df: DataFrame, cond: str, ax: Axis) -> DataFrame:
    """Every run of true rows with its first and last day, length, and whether it is still open."""
    d = df.withColumn("_c", F.coalesce(F.col(cond), F.lit(False)).cast("int"))
    d = with_runs(d, "_c", ax).withColumn("_last", F.max(ax.ts).over(ax.whole()))
    runs = d.filter("_c = 1").groupBy(*ax.keys, "run_id").agg(
        F.min(ax.ts).alias("start"), F.max(ax.ts).alias("end"), F.count(F.lit(1)).alias("days"), (F.max(ax.ts) == F.max("_last")).cast("int").alias("is_open"),
    )
    return runs


def persistence_stats(df: DataFrame, cond: str, ax: Axis) -> DataFrame:
    """Current streak, durations of closed streaks, number of episodes and rate of true rows. The
    open streak is left out of the durations."""
    runs = streak_lengths(df, cond, ax)
    closed = F.when(F.col("is_open") == 0, F.col("days"))
    per_run = runs.groupBy(*ax.keys).agg(
        F.coalesce(F.max(F.when(F.col("is_open") == 1, F.col("days"))), F.lit(0)).alias("current_streak"), F.coalesce(F.avg(closed), F.lit(0.0)).alias("mean_duration"),
        F.coalesce(F.max(closed), F.lit(0)).alias("max_duration"), F.coalesce(F.percentile(closed, F.lit(0.5)), F.lit(0.0)).alias("median_duration"), F.count(closed).alias("num_episodes"),
    )
    rate = df.groupBy(*ax.keys).agg(F.sum(F.coalesce(F.col(cond), F.lit(False)).cast("long")).alias("total_days"), F.avg(F.coalesce(F.col(cond), F.lit(False)).cast("double")).alias("rate"))
    fills = {"current_streak": 0, "mean_duration": 0.0, "max_duration": 0, "median_duration": 0.0, "num_episodes": 0}
    return rate.join(per_run, list(ax.keys), "left").fillna(fills)


def transitions(df: DataFrame, cond: str, ax: Axis, out: str = "left_state") -> DataFrame:
    """Marks rows where the condition was true on the row before and is false now."""
    prev = R.lag(cond, 1, ax)
    return df.withColumn(out, F.coalesce(prev & ~F.col(cond), F.lit(False)))


def since_last_true(df: DataFrame, cond: str, ax: Axis) -> DataFrame:
    """Last day the condition held, up to each row, and the calendar days since (9999 if never)."""
    d = df.withColumn("last_true", F.last(F.when(F.col(cond), F.col(ax.ts)), ignorenulls=True).over(ax.upto()))
    return d.withColumn("days_since_true", F.coalesce(F.datediff(ax.ts, "last_true"), F.lit(9999)))


def until_next_true(df: DataFrame, cond: str, ax: Axis, price: str | None = None) -> DataFrame:
    """Rows until the condition next holds, and the log return in percent over that span.

    Read from the newest row backwards, so the nearest later hit is a running ``last``."""
    back = Window.partitionBy(*ax.keys).orderBy(F.col(ax.ts).desc()).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("_p", F.row_number().over(ax.ordered()))
    hit = F.struct(F.col("_p").alias("p"), *([F.col(price).alias("v")] if price else []))
    d = d.withColumn("_next", F.last(F.when(F.col(cond), hit), ignorenulls=True).over(back))
    d = d.withColumn("rows_until", F.col("_next.p") - F.col("_p"))
    if price:
        d = d.withColumn("return_until", F.ln(F.col("_next.v") / F.col(price)) * 100)
    return d.drop("_p", "_next")
