"""Reduce raw rows to the daily grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions.scalar import col


def daily_bars(df: DataFrame, ax: Axis, price: str, sequence: str | Column, volume: str | Column | None = None) -> DataFrame:
    """Open, high, low, close and volume per series and day.

    All five combine map-side, so a series holding most of the raw rows still shuffles one row
    per day and task."""
    size = F.count(F.lit(1)).cast("double") if volume is None else F.sum(col(volume)).cast("double")
    return df.groupBy(*ax.keys, ax.ts).agg(
        F.min_by(price, col(sequence)).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, col(sequence)).alias("close"),
        size.alias("volume"),
    )


def spread_series(df: DataFrame, ax: Axis) -> DataFrame:
    """Hash the panel by series into the session's shuffle partitions.

    Window work per byte is heavy, so letting AQE merge small partitions by size would idle most
    cores. The windows that follow reuse this exchange."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *ax.keys)


def normalise_index(df: DataFrame, ax: Axis, raw_ts: str, arrival: str | Column, values: list[str], min_rows: int = 10) -> DataFrame:
    """One row per series and day: the time is cut to a date, the row that arrived last wins, and
    series with fewer than ``min_rows`` days are dropped.

    ``max_by`` combines map-side, so repeated labels do not pile up in one task. A value that is
    null in the winning row stays null."""
    last = F.max_by(F.struct(*values), col(arrival)).alias("_row")
    daily = (
        df.withColumn(ax.ts, F.to_date(F.col(raw_ts)))
        .filter(F.col(ax.ts).isNotNull())
        .groupBy(*ax.keys, ax.ts)
        .agg(last)
        .select(*ax.keys, ax.ts, *[F.col(f"_row.{v}").alias(v) for v in values])
    )
    n = F.count(F.lit(1)).over(ax.whole())
    return daily.withColumn("_n", n).filter(F.col("_n") >= min_rows).drop("_n")


def merge_new_rows(stored: DataFrame, fresh: DataFrame, ax: Axis, values: list[str]) -> DataFrame:
    """Stored and fresh daily rows with the fresh one winning; keys combine map-side."""
    both = stored.withColumn("_gen", F.lit(0)).unionByName(fresh.withColumn("_gen", F.lit(1)))
    return (
        both.groupBy(*ax.keys, ax.ts)
        .agg(F.max_by(F.struct(*values), "_gen").alias("_row"))
        .select(*ax.keys, ax.ts, *[F.col(f"_row.{v}").alias(v) for v in values])
    )


def newer_rows(stored: DataFrame, fresh: DataFrame, ax: Axis) -> DataFrame:
    """The fresh rows dated after each series' last stored day (all rows of a new series)."""
    last = stored.groupBy(*ax.keys).agg(F.max(ax.ts).alias("_last"))
    joined = fresh.join(last, list(ax.keys), "left")
    return joined.filter(F.col("_last").isNull() | (F.col(ax.ts) > F.col("_last"))).drop("_last")


def append_newer(stored: DataFrame, fresh: DataFrame, ax: Axis) -> DataFrame:
    return stored.unionByName(newer_rows(stored, fresh, ax))
