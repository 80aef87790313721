"""Writers: partitioned panels, appends and published documents. Upserts: see ``versions``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.operators.bars import newer_rows


def write_panel(df: DataFrame, path: str, ax: Axis, mode: str = "overwrite") -> None:
    """Parquet by year. Rows are gathered by year and series first, so a year is written by many
    tasks but into few files."""
    out = df.withColumn("year", F.year(ax.ts))
    out.repartition("year", *ax.keys).write.mode(mode).partitionBy("year").parquet(path)


def read_written(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("year")


def append_newer_rows(stored_path: str, fresh: DataFrame, ax: Axis) -> None:
    """Append only rows dated after each series' last stored day."""
    stored = fresh.sparkSession.read.parquet(stored_path)
    write_panel(newer_rows(stored, fresh, ax), stored_path, ax, mode="append")


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A small report as JSON or CSV; a cluster reads back the folder."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.json(path)
