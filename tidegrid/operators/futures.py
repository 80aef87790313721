"""Contract cleaning and continuous futures series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import dates as D
from tidegrid.functions import rolling as R
from tidegrid.operators.joins import asof_join

MIN_SETTLE, MAX_SETTLE = 3.0, 300.0


def clean_contracts(df: DataFrame) -> DataFrame:
    """Repair raw contract rows.

    A missing settle takes the close; rows without a positive settle go. Missing open, high and low
    take the settle, a swapped high and low are put right and stretched to contain the settle, the
    close becomes the settle, volumes below zero become 0, and settles outside 3..300 are dropped.
    """
    def bad(c: str):
        return F.col(c).isNull() | (F.col(c) <= 0)

    s = F.col("settle")
    df = df.withColumn("settle", F.when(s.isNull() | (s == 0), F.col("close")).otherwise(s)).filter(F.col("settle") > 0)
    no_range = bad("high") | bad("low")
    df = df.withColumns({
        "open": F.when(bad("open"), s).otherwise(F.col("open")),
        "high": F.when(no_range, s).otherwise(F.col("high")),
        "low": F.when(no_range, s).otherwise(F.col("low")),
    })
    df = df.withColumns({"high": F.greatest("high", "low", "settle"), "low": F.least("high", "low", "settle"), "close": s})
    for c in ("volume", "open_interest"):
        if c in df.columns:
            df = df.withColumn(c, F.when(F.col(c) >= 0, F.col(c)).otherwise(0.0))
    return df.filter(s.between(MIN_SETTLE, MAX_SETTLE))


def _for_each(keys: DataFrame, expiries: DataFrame) -> DataFrame:
    """Every expiry for every key: the expiry table goes along as one array, a row per month."""
    months = expiries.agg(F.sort_array(F.collect_set("expiry_date")).alias("m")).select("m").scalar()
    return keys.withColumn("expiry_date", F.explode(months))


def continuous_positions(contracts: DataFrame, expiries: DataFrame, keys: list[str], positions: int = 6) -> DataFrame:
    """Continuous series 1..``positions``: on each business day, the contracts still alive in
    expiry order.

    ``contracts`` has (keys, contract_code, expiry_date, ts, ...), ``expiries`` (keys or not, expiry_date);
    each key has its own order of contracts. The rank of a contract in the
    expiry table less the rank of the day's first live contract gives the position, so no contract
    is paired with every day. Roll flag and segment number follow per position; prices are not
    back-adjusted.
    """
    named = set(keys) <= set(expiries.columns)  # else the expiry table holds for all keys
    held = expiries.select(*keys, "expiry_date").distinct() if named else _for_each(contracts.select(*keys).distinct(), expiries)
    order = Window.partitionBy(*keys).orderBy("expiry_date")  # a row per key and month
    ranks = held.select(*keys, "expiry_date").withColumn("_rank", F.row_number().over(order))
    days = contracts.select(*keys, "ts").distinct()
    live = ranks.select(*keys, F.col("expiry_date").alias("ts"), F.col("_rank").alias("_front"))
    front = asof_join(days, live, Axis(tuple(keys), "ts"), ["_front"], direction="forward", strict=True)
    d = contracts.filter(D.is_business_day("ts")).join(ranks, [*keys, "expiry_date"]).join(front, [*keys, "ts"])
    d = d.withColumn("position", (F.col("_rank") - F.col("_front") + 1).cast("int")).filter(F.col("position").between(1, positions))
    d = d.withColumn("days_to_expiry", F.datediff("expiry_date", "ts")).drop("_rank", "_front")
    return tag_rolls(d, Axis((*keys, "position"), "ts"))


def tag_rolls(df: DataFrame, ax: Axis, contract: str = "expiry_date") -> DataFrame:
    """Roll flag (the first row counts as one) and running segment number per position."""
    prev = R.lag(contract, 1, ax)
    df = df.withColumn("roll_indicator", F.when(prev.isNull() | (prev != F.col(contract)), 1).otherwise(0))
    return df.withColumn("contract_id", F.sum("roll_indicator").over(ax.upto()))


def position_columns(cont: DataFrame, keys: list[str], fields: dict[str, str], positions: list[int]) -> DataFrame:
    """Positions side by side per day: field ``f`` of position ``p`` becomes ``{prefix}{p}``."""
    picks = [F.max(F.when(F.col("position") == p, F.col(f))).alias(f"{prefix}{p}") for f, prefix in fields.items() for p in positions]
    return cont.groupBy(*keys, "ts").agg(*picks)
