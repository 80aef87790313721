"""Ordering, top-k, duplicates and seeded subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.axis import Axis


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Per-task top-n merged by the driver plan (TakeOrdered), no full sort."""
    return df.orderBy(*order).limit(n)


def top_n_per_group(df: DataFrame, by: list[str], order: dict[str, str], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per group. Spark's window group limit keeps ``n`` rows per task and group
    before the shuffle, so a dominant group does not travel whole."""
    keys = [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in order.items()]
    w = Window.partitionBy(*by).orderBy(*keys)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def drop_warmup(df: DataFrame, ax: Axis, rows: int) -> DataFrame:
    return df.withColumn("_pos", F.row_number().over(ax.ordered())).filter(F.col("_pos") > rows).drop("_pos")


def mark_tail(df: DataFrame, ax: Axis, rows: int, out: str = "in_tail") -> DataFrame:
    newest = Window.partitionBy(*ax.keys).orderBy(F.col(ax.ts).desc())
    return df.withColumn(out, (F.row_number().over(newest) <= rows).cast("int"))


def keep_last(df: DataFrame, key: list[str], arrival: str, values: list[str]) -> DataFrame:
    """The row that arrived last per key; combines map-side."""
    out = df.groupBy(*key).agg(F.max_by(F.struct(*values), arrival).alias("_row"))
    return out.select(*key, *[F.col(f"_row.{v}").alias(v) for v in values])


def keep_first(df: DataFrame, key: list[str], arrival: str, values: list[str]) -> DataFrame:
    out = df.groupBy(*key).agg(F.min_by(F.struct(*values), arrival).alias("_row"))
    return out.select(*key, *[F.col(f"_row.{v}").alias(v) for v in values])


def duplicated_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """Every row whose key occurs more than once."""
    many = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return df.join(many, key, "left_semi")


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, by the MD5 of id and seed: the same whatever the partitioning or engine."""
    return df.withColumn("_h", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))).orderBy("_h", id_col).limit(n).drop("_h")
