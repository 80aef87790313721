"""Panels derived from the driver tables, each with the SQL that derives the same rows.

* ``bars``: one series per order priority, daily open/high/low/close/volume of order totals.
* ``market``: one entity per return flag; every named input a feature pack wants (levels of two
  volatility indices, a curve, yields, spreads, commodities) is a price-weighted daily average of
  some slice of lineitem. Inputs are rounded to four places so both engines rank equal values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.operators.bars import daily_bars, spread_series

AX = Axis(("series_id",), "ts")
DIVISOR = 371.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- orders -------------------------------------------------------------------------------
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"),
        F.to_date("o_orderdate").alias("ts"),
        (F.col("o_totalprice") / DIVISOR).alias("price"),
        "o_orderkey",
    )
    b = daily_bars(o, AX, price="price", sequence="o_orderkey")
    b = b.select("series_id", "ts", *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")], "volume")
    return spread_series(b, AX)


BARS_SQL = f"""
SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ts,
       round(arg_min(o_totalprice / {DIVISOR}, o_orderkey), 4) AS open,
       round(max(o_totalprice / {DIVISOR}), 4) AS high,
       round(min(o_totalprice / {DIVISOR}), 4) AS low,
       round(arg_max(o_totalprice / {DIVISOR}, o_orderkey), 4) AS close,
       CAST(count(*) AS DOUBLE) AS volume
FROM orders GROUP BY 1, 2
"""

# --- lineitem -----------------------------------------------------------------------------
# name -> (value, condition, scale, shift): shift + scale * sum(value * price) / sum(price)
MARKET = {
    "vix": ("l_quantity", None, 1.0, 0.0),
    "vix3m": ("l_quantity", "l_linestatus = 'O'", 1.0, 0.0),
    "vix6m": ("l_quantity", "l_linestatus = 'F'", 1.0, 0.0),
    "skew": ("l_discount", None, 500.0, 100.0),
    "vvix": ("l_tax", None, 1000.0, 60.0),
    "vxth": ("l_quantity", "l_linenumber IN (1, 2)", 1.0, 5.0),
    "vxtlt": ("l_quantity", "l_linenumber IN (3, 4)", 0.5, 0.0),
    "ovx": ("l_quantity", "l_linenumber IN (1, 3, 5)", 1.0, 0.0),
    "gvz": ("l_quantity", "l_linenumber IN (2, 4, 6)", 1.0, 0.0),
    "y3m": ("l_tax", "l_linenumber IN (1, 4)", 100.0, 0.0),
    "y6m": ("l_tax", "l_linenumber IN (1, 2)", 100.0, 0.0),
    "y2y": ("l_tax", "l_linenumber IN (2, 5)", 100.0, 0.0),
    "y5y": ("l_tax", "l_linenumber IN (3, 6)", 100.0, 0.0),
    "y10y": ("l_tax", "l_linenumber IN (4, 7)", 100.0, 0.0),
    "y30y": ("l_tax", "l_linenumber IN (5, 6, 7)", 100.0, 0.0),
    "hy": ("l_discount", None, 100.0, 0.0),
    "hy_bb": ("l_discount", "l_linenumber <= 3", 80.0, 0.0),
    "hy_b": ("l_discount", "l_linenumber IN (3, 4, 5)", 100.0, 0.0),
    "hy_ccc": ("l_discount", "l_linenumber >= 4", 160.0, 0.0),
    "ig": ("l_discount", "l_linestatus = 'O'", 40.0, 0.0),
    "stress": ("l_discount", None, 100.0, -5.0),
    "gold": ("l_extendedprice", "l_linenumber IN (1, 2)", 1 / DIVISOR, 0.0),
    "crude": ("l_extendedprice", "l_linenumber IN (2, 3)", 1 / DIVISOR, 0.0),
    "natgas": ("l_extendedprice", "l_linenumber IN (3, 4)", 1 / DIVISOR, 0.0),
    "copper": ("l_extendedprice", "l_linenumber IN (4, 5)", 1 / DIVISOR, 0.0),
    "dxy": ("l_extendedprice", "l_linenumber IN (5, 6, 7)", 1 / DIVISOR, 0.0),
}


def _weighted(value: str, cond: str | None) -> F.Column:
    price, v = F.col("l_extendedprice"), F.col(value)
    ok = F.expr(cond) if cond else F.lit(True)
    den = F.sum(F.when(ok, price))
    return F.sum(F.when(ok, v * price)) / F.when(den != 0, den)


def market(spark: SparkSession, sf_dir: str, only: list[str] | None = None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    wanted = {k: v for k, v in MARKET.items() if only is None or k in only}
    aggs = [F.round(_weighted(v, c) * s + a, 4).alias(n) for n, (v, c, s, a) in wanted.items()]
    price = F.col("l_extendedprice")
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    aggs += [
        F.round(F.min_by(price, seq) / DIVISOR, 4).alias("open"),
        F.round(F.max(price) / DIVISOR, 4).alias("high"),
        F.round(F.min(price) / DIVISOR, 4).alias("low"),
        F.round(F.max_by(price, seq) / DIVISOR, 4).alias("close"),
        F.round(F.sum(price), 2).alias("claims"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    ]
    daily = li.groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("ts")).agg(*aggs)
    return spread_series(daily, AX)


def market_sql(only: list[str] | None = None) -> str:
    parts = []
    for n, (v, c, s, a) in MARKET.items():
        if only is not None and n not in only:
            continue
        flt = f" FILTER ({c})" if c else ""
        parts.append(f"round(sum({v} * l_extendedprice){flt} / nullif(sum(l_extendedprice){flt}, 0) * {s!r}::DOUBLE + {a!r}::DOUBLE, 4) AS {n}")
    seq = "{'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_extendedprice}"
    parts += [
        f"round((min({seq})).e / {DIVISOR}, 4) AS open",
        f"round(max(l_extendedprice) / {DIVISOR}, 4) AS high",
        f"round(min(l_extendedprice) / {DIVISOR}, 4) AS low",
        f"round((max({seq})).e / {DIVISOR}, 4) AS close",
        "round(sum(l_extendedprice), 2) AS claims",
        "CAST(count(*) AS DOUBLE) AS volume",
    ]
    return f"SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS ts, {', '.join(parts)} FROM lineitem GROUP BY 1, 2"
