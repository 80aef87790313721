"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import stage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node of its component, for every node that has a link.

    Each round is two partial aggregations and two equi-joins; a hub's links stay spread, because minima
    are folded before the shuffle and, being tables, are joined in a way whose skewed side Spark can split. Nulls, self links and
    repeated links add nothing; no links give no rows. Rounds are written to the shared folder."""
    now = stage(_down(edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))), "links")
    was = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == was:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        was, now = mark, stage(_small_star(_large_star(now)), "links")


def _down(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour is linked to the smallest of the neighbourhood."""
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return _down(both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")))


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = stage(e.groupBy("hi").agg(F.min("lo").alias("m")), "least")
    met = e.join(least, "hi")
    return _down(met.select(F.col("lo").alias("x"), F.col("m").alias("y")).unionAll(least.select(F.col("hi").alias("x"), F.col("m").alias("y"))))
