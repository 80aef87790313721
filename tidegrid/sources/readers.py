"""Readers with declared schemas; anything unreadable in a cell becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.scalar import to_double
from tidegrid.sources.parse import number_text, parse_day

BAR_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()), T.StructField("ts", T.DateType()), T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()), T.StructField("volume", T.DoubleType()),
])

OBSERVATION_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("observations", T.ArrayType(T.StructType([T.StructField("date", T.StringType()), T.StructField("value", T.StringType())]))),
])

# Contract file header and the names it is given.
CONTRACT_HEADER = {
    "Trade Date": "ts", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Settle": "settle", "Total Volume": "volume", "Open Interest": "open_interest",
}


def read_panel(spark: SparkSession, path: str, columns: list[str] | None = None, start: str | None = None, end: str | None = None, schema: T.StructType = BAR_SCHEMA) -> DataFrame:
    """Stored daily rows of a date range. The range and the columns reach the Parquet scan, and
    partition folders by ``year`` are skipped when present."""
    df = spark.read.schema(schema).parquet(path)
    if start:
        df = df.filter(F.col("ts") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("ts") <= F.lit(end).cast("date"))
    return df.select("series_id", "ts", *columns) if columns else df


def covers(df: DataFrame, start: str, end: str) -> DataFrame:
    """Per series, whether the stored rows span the requested range."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    return df.groupBy("series_id").agg(((F.min("ts") <= a) & (F.max("ts") >= b)).alias("covered"))


def read_series_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV whose first column is the date and the rest numbers; ``columns`` names the rest."""
    schema = T.StructType([T.StructField("_day", T.StringType())] + [T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE")
    return raw.select(parse_day("_day").alias("ts"), *[number_text(c).alias(c) for c in columns]).filter(F.col("ts").isNotNull())


def read_observations(spark: SparkSession, path: str, missing: str = ".") -> DataFrame:
    """JSON documents of dated observations as text."""
    o = spark.read.schema(OBSERVATION_SCHEMA).option("multiLine", False).json(path).select("series_id", F.explode("observations").alias("o"))
    out = o.filter(F.col("o.value") != missing).select("series_id", parse_day("o.date").alias("ts"), to_double("o.value").alias("value"))
    return out.filter(F.col("ts").isNotNull() & F.col("value").isNotNull())


def read_contract_files(spark: SparkSession, folder: str, root: str = "VX") -> DataFrame:
    """Every ``{root}_{code}_{expiry}.csv`` of a folder in one scan, be it a file or, as Spark writes it, a folder of
    parts (``contract={root}_{code}_{expiry}.csv``); code and expiry come from that name. Other files give no rows."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in CONTRACT_HEADER])
    raw = spark.read.csv(folder, schema=schema, header=True, mode="PERMISSIVE", pathGlobFilter="*.csv", recursiveFileLookup=True)
    name = F.col("_metadata.file_path")
    pattern = rf"[/=]{root}_([A-Z]\d)_(\d{{4}}-\d{{2}}-\d{{2}})\.csv(?:/[^/]+\.csv)?$"
    cols = [number_text(f"`{h}`").alias(n) for h, n in CONTRACT_HEADER.items() if n != "ts"]
    out = raw.select(F.regexp_extract(name, pattern, 1).alias("contract_code"), F.regexp_extract(name, pattern, 2).try_cast("date").alias("expiry_date"), parse_day("`Trade Date`").alias("ts"), *cols)
    return out.filter(F.col("ts").isNotNull() & F.col("expiry_date").isNotNull())


def read_event_calendar(spark: SparkSession, path: str, first_year: int, last_year: int, required: tuple[str, ...] = ("date", "meeting_type")) -> DataFrame:
    """An event calendar CSV; refuses a file without the required columns."""
    raw = spark.read.csv(path, header=True)
    lacking = [c for c in required if c not in raw.columns]
    if lacking:
        raise ValueError(f"event calendar {path} lacks columns {lacking}")
    out = raw.select(parse_day("date").alias("event_date"), *[c for c in required if c != "date"])
    return out.filter(F.year("event_date").between(first_year, last_year)).dropDuplicates(["event_date"])
