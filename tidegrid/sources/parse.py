"""Text to typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import col, to_double

OBSERVATIONS = "struct<observations:array<struct<date:string,value:string>>>"


def number_text(c) -> Column:
    """Thousands-separated text to DOUBLE."""
    return to_double(F.regexp_replace(F.trim(col(c)), ",", ""))


def parse_day(c) -> Column:
    """The day of a date or timestamp text, whatever its time part; unreadable text is null."""
    return F.coalesce(col(c).try_cast("timestamp_ntz").cast("date"), col(c).try_cast("date"))


def explode_observations(df: DataFrame, doc: str, keys: list[str], missing: str = ".") -> DataFrame:
    """``{"observations": [{"date", "value"}]}`` text to (keys, ts, value) rows; the missing mark
    and unreadable numbers are dropped."""
    rows = df.select(*keys, F.explode(F.from_json(F.col(doc), OBSERVATIONS)["observations"]).alias("o"))
    out = rows.filter(F.col("o.value") != missing).select(*keys, parse_day("o.date").alias("ts"), to_double("o.value").alias("value"))
    return out.filter(F.col("ts").isNotNull() & F.col("value").isNotNull())
