"""Fill limits, staleness and coverage of stored series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import dates as D
from tidegrid.operators.calendar import days_between
from tidegrid.operators.joins import asof_join

# How many rows a value may be carried forward, by frequency.
FILL_LIMITS = {"daily": 5, "weekly": 7, "monthly": 35, "quarterly": 135}


def fill_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FILL_LIMITS.items()), "frequency string, max_fill int")


def attach_fill_limit(series: DataFrame, default: str = "daily") -> DataFrame:
    """Series metadata (series_id, frequency) with its fill limit; unknown frequencies are daily."""
    out = series.join(F.broadcast(fill_limits(series.sparkSession)), "frequency", "left")
    return out.withColumn("max_fill", F.coalesce("max_fill", F.lit(FILL_LIMITS[default])))


def should_update(frequency: str | Column, last: str | Column, now: str | Column) -> Column:
    """Whether a series of this frequency may have a newer release.

    Quarterly: 35 days after the end of the quarter of the last value, once a later quarter of the
    year runs. Monthly: from day 12 of the following month, always when older. Weekly: more than two
    business days. Daily: more than one. Others: more than two days.
    """
    f = F.col(frequency) if isinstance(frequency, str) else frequency
    last, now = (F.col(c) if isinstance(c, str) else c for c in (last, now))
    gap = D.business_lag(last, now)
    quarter_month = F.floor(F.month(last) / 3).cast("int") * 3
    release = F.date_add(F.add_months(F.make_date(F.year(last), F.greatest(quarter_month, F.lit(1)), F.lit(1)), 1), 35)
    quarterly = (F.month(now) > quarter_month) & (now >= release)
    months = (F.year(now) - F.year(last)) * 12 + F.month(now) - F.month(last)
    monthly = F.when(months == 0, False).when(months == 1, F.dayofmonth(now) >= 12).otherwise(True)
    rule = F.when(f == "quarterly", quarterly).when(f == "monthly", monthly).when(f == "weekly", gap > 2).when(f == "daily", gap > 1)
    return F.coalesce(rule.otherwise(F.datediff(now, last) > 2), F.lit(True)).cast("int")


def is_stale(last: str | Column, now: str | Column, close_hour: int = 16) -> Column:
    """No stored day, or a business day missing; before the closing hour yesterday still counts."""
    last, now = (F.col(c) if isinstance(c, str) else c for c in (last, now))
    gap = D.business_lag(last, F.to_date(now))
    early = (gap <= 1) & (F.hour(now) < close_hour)
    return F.when(last.isNull(), 1).when(early, 0).otherwise((gap > 0).cast("int"))


def refetch_windows(df: DataFrame, ax: Axis, lookback: int = 5) -> DataFrame:
    """Where to read again from: ``lookback`` days before the last stored day, on a weekday. The
    overlap is settled by ``bars.merge_new_rows``."""
    return df.groupBy(*ax.keys).agg(F.max(ax.ts).alias("last_day")).withColumn("fetch_from", D.refetch_start("last_day", lookback))


def expand_to_days(df: DataFrame, ax: Axis, values: list[str], limit: int) -> DataFrame:
    """Low-frequency rows on every calendar day between the first and last, carried at most
    ``limit`` days."""
    span = df.groupBy(*ax.keys).agg(F.min(ax.ts).alias("_a"), F.max(ax.ts).alias("_b"))
    days = days_between(span, "_a", "_b", ax.ts).select(*ax.id_cols)
    return asof_join(days, df, ax, values, limit)


def coverage(df: DataFrame, ax: Axis, value: str, as_of: Column) -> DataFrame:
    """First and last known day, span, age and business-day lag behind the freshest series."""
    known = F.when(F.col(value).isNotNull(), F.col(ax.ts))
    per = df.groupBy(*ax.keys).agg(F.min(known).alias("first_day"), F.max(known).alias("last_day"), F.count(value).alias("known_rows"), F.count(F.lit(1)).alias("rows"))
    lead, behind = per.agg(F.max("last_day")).scalar(), per.agg(F.min("last_day")).scalar()
    return per.select(
        *ax.keys, "first_day", "last_day", "rows", "known_rows", F.datediff("last_day", "first_day").alias("span_days"), F.datediff(as_of, "last_day").alias("age_days"),
        D.business_lag(F.col("last_day"), lead).alias("lag_business_days"), (F.col("last_day") == behind).cast("int").alias("is_stalest"),
    )
