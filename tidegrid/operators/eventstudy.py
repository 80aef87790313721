"""Returns around events, by group, horizon and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import rolling as R
from tidegrid.operators import ranks as RK


def horizon_returns(price: str, ax: Axis, ahead: list[int], back: list[int] = (), log: bool = True) -> dict[str, Column]:
    """Returns in percent from each row to ``h`` rows later, and from ``h`` rows earlier to it."""
    p = F.col(price)

    def ret(now: Column, was: Column) -> Column:
        return F.ln(now / was) * 100 if log else (now / was - 1) * 100

    out = {f"fwd_{h}d": ret(R.lead(price, h, ax), p) for h in ahead}
    out.update({f"bwd_{h}d": ret(p, R.lag(price, h, ax)) for h in back})
    return out


def study(df: DataFrame, by: list[str], cols: list[str], min_n: int = 5, bounded: bool = False) -> DataFrame:
    """Mean, median and share positive per group and horizon; statistics of fewer than ``min_n``
    returns are null. ``bounded``: the groups are within one series."""
    long = df.select(*by, *cols).unpivot(by, cols, "horizon", "ret").filter(F.col("ret").isNotNull())
    keys = [*by, "horizon"]
    agg = long.groupBy(*keys).agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), (F.avg((F.col("ret") > 0).cast("double")) * 100).alias("pct_pos"))
    agg = RK.attach_quantiles(agg, long, keys, "ret", {"median": 0.5}, bounded)
    enough = F.col("n") >= min_n
    return agg.select(*keys, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("mean", "median", "pct_pos")])


def label_groups(df: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """One copy of a row per group it belongs to."""
    tags = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in groups.items()]), lambda t: t.isNotNull())
    return df.withColumn("day_group", F.explode(tags))


def rows_at_events(df: DataFrame, events: DataFrame, ax: Axis, event_date: str = "event_date", group: str | None = None) -> DataFrame:
    """Rows of every series that are the first on or after some event day.

    A row answers for the days since the series' previous row, so each series row is matched by an
    equi-join on days instead of pairing events with series. The event side holds one row per day
    (and group), which bounds what is broadcast."""
    d = df.withColumn("_prev", R.lag(ax.ts, 1, ax))
    days = F.sequence(F.coalesce(F.date_add("_prev", 1), F.col(ax.ts)), F.col(ax.ts), F.expr("interval 1 day"))
    spread = d.withColumn(event_date, F.explode(days)).drop("_prev")
    tags = [group] if group else []
    hit = spread.join(events.select(event_date, *tags).distinct(), event_date).drop(event_date)
    return hit.dropDuplicates([*ax.keys, ax.ts, *tags])
