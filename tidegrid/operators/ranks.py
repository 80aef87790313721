"""Exact quantiles and empirical distributions over any number of rows, columns and groups.

A single-partition sort or an in-memory ``percentile`` holds every distinct value of a group in one
task. Quantiles are found here by radix refinement: a double is read as an integer that orders as it does, rows
are counted per group and leading 22 bits (sign, exponent and ten of the mantissa), and only the rows under the
prefixes that hold a wanted place are counted by the next 21, twice. Counts are folded map-side, and a window sees at
most a few million of them, whatever the rows. Distributions are running sums over values in sampled ranges."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.scan import running_weight
from tidegrid.session import stored

SHIFTS = (42, 21, 0)  # bits that a step leaves undecided


def ordered_bits(value: str) -> Column:
    """The double as a long that orders as it does: sign, exponent and mantissa of its IEEE form. No two doubles share
    one, but for 0 and -0; infinities come outside all finite values and NaN after them, as Spark orders them."""
    a = f"abs({value})"
    near = f"CAST(floor(log2({a})) AS INT)"  # may be off by one next to a power of two
    e = f"({near} + CASE WHEN pow(2D, {near}) > {a} THEN -1 WHEN pow(2D, {near} + 1) <= {a} THEN 1 ELSE 0 END)"
    normal = f"shiftleft(CAST({e} + 1023 AS BIGINT), 52) + CAST(({a} / pow(2D, {e}) - 1) * 4503599627370496D AS BIGINT)"
    tiny = f"CAST({a} / pow(2D, -1074) AS BIGINT)"
    size = f"CASE WHEN {a} = double('infinity') THEN shiftleft(2047L, 52) WHEN {a} >= pow(2D, -1022) THEN {normal} ELSE {tiny} END"
    return F.expr(f"CASE WHEN isnan({value}) THEN shiftleft(2047L, 52) + 1 WHEN {value} = 0 THEN 0L ELSE CAST(signum({value}) AS BIGINT) * ({size}) END")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of each group, one column each; groups without values are left out.

    Null keys are groups. Values are stored once with their bits, so ``df`` is read once; the places still wanted are a
    stored table with a row per group and prefix, so Spark knows its size when it chooses the join. Where the
    prefixes of all of them hold one value each, the rest of the bits need no step."""
    rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    rows = stored(rows.withColumn("_bits", ordered_bits("_v")), "quantile_bits")
    ks = [f"_k{i}" for i in range(len(keys))]
    places = F.array(*[F.struct(F.lit(f"{n}_{part}").alias("name"), fn((F.col("_total") - 1) * F.lit(float(q))).alias("at")) for n, q in qs.items() for part, fn in (("lo", F.floor), ("hi", F.ceil))])
    wanted = None
    for was, left in zip((64, *SHIFTS), SHIFTS):
        prefix = F.shiftright("_bits", left)
        if wanted is None:
            per = rows.groupBy(*ks, prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_v"), F.max("_v").alias("_top"))
            group = Window.partitionBy(*ks)
            before = F.sum("_n").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
            per = per.withColumns({"_total": F.sum("_n").over(group), "_before": F.coalesce(before, F.lit(0))}).withColumn("_places", places)
        else:
            parent = F.shiftright("_bits", was)
            w = wanted.select(*[F.col(k).alias(f"_w{k}") for k in ks], F.col("_p").alias("_wp"), "_total", "_places")
            cond = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_w{k}")) for k in ks], parent == F.col("_wp"))
            met = rows.join(w, cond).groupBy(*ks, F.col("_wp"), prefix.alias("_p"))
            per = met.agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_v"), F.max("_v").alias("_top"), F.first("_total").alias("_total"), F.first("_places").alias("_places"))
            before = F.sum("_n").over(Window.partitionBy(*ks, "_wp").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
            per = per.withColumn("_before", F.coalesce(before, F.lit(0)))
        here = F.filter("_places", lambda x: (x["at"] >= F.col("_before")) & (x["at"] < F.col("_before") + F.col("_n")))
        moved = F.transform(here, lambda x: F.struct(x["name"].alias("name"), (x["at"] - F.col("_before")).alias("at")))
        wanted = stored(per.withColumn("_places", moved).filter(F.size("_places") > 0).select(*ks, "_p", "_v", "_top", "_total", "_places"), "quantile_places")
        if left and not wanted.filter("_v < _top").limit(1).count():
            break
    found = wanted.select(*ks, "_v", "_total", F.explode("_places.name").alias("_name"))
    value_at = lambda name: F.max(F.when(F.col("_name") == name, F.col("_v")))
    per = found.groupBy(*ks).agg(F.max("_total").alias("_total"), *[value_at(f"{n}_{part}").alias(f"_{n}_{part}") for n in qs for part in ("lo", "hi")])
    out = []
    for n, q in qs.items():
        at = (F.col("_total") - 1) * F.lit(float(q))
        out.append((F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * (at - F.floor(at))).alias(n))
    return per.select(*[F.col(a).alias(k) for a, k in zip(ks, keys)], *out)


def column_quantiles(df: DataFrame, by: list[str], columns: list[str], qs: dict[str, float], name: str = "column") -> DataFrame:
    """(by, column, quantiles): many columns in the same three steps, a row's values being told apart by their column's name."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*by, F.inline(pairs).alias(name, "_value"))
    return exact_quantiles(long, [*by, name], "_value", qs)


def cumulative_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per group with their count, the rows below them and the rows in all.

    Needs at least one key; for an ungrouped distribution pass a constant column."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running_weight(per, keys, [value], "n", "below", "total").select(*keys, value, "n", "below", "total")


def quantiles_from_counts(counts: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles, one column each, from ``cumulative_counts``: one pass, folded map-side."""
    aggs, out = [], []
    for name, q in qs.items():
        at = (F.col("total") - 1) * F.lit(float(q))
        for part, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (F.col("below") <= k) & (F.col("below") + F.col("n") > k)
            aggs.append(F.max(F.when(holds, F.col(value))).alias(f"_{name}_{part}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_{name}_w"))
        out.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_w")).alias(name))
    return counts.groupBy(*keys).agg(*aggs).select(*keys, *out)


def count_at_or_below(train: DataFrame, probes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each distinct probe value, how many training values are at or below it, and of how many.

    Training values (or their ``cumulative_counts``) and probes are merged and summed once in order; probes weigh
    nothing and come after equal values."""
    return _probed(train, probes, keys, value, 1).select(*keys, value, F.col("before").alias("at_or_below"), "total")


def count_below(train: DataFrame, probes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each distinct probe value, how many training values are strictly below it, and of how many."""
    return _probed(train, probes, keys, value, -1).select(*keys, value, F.col("before").alias("below"), "total")


def _probed(train: DataFrame, probes: DataFrame, keys: list[str], value: str, side: int) -> DataFrame:
    folded = train if {"n", "below"} <= set(train.columns) else train.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    t = folded.select(*keys, value, "n", F.lit(0).alias("_probe"))
    p = probes.filter(F.col(value).isNotNull()).select(*keys, value).distinct().withColumns({"n": F.lit(0).cast("long"), "_probe": F.lit(side)})
    return running_weight(t.unionByName(p), keys, [value, "_probe"], "n", "before", "total").filter("_probe <> 0 AND total > 0")


def constant_key(df: DataFrame, name: str = "_all") -> DataFrame:
    return df.withColumn(name, F.lit(1))


def group_quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float], bounded: bool = False) -> DataFrame:
    """Quantiles per group (``by`` may be empty).

    ``bounded`` states that a group holds no more rows than the calendar has days (series-level
    groups of a panel); only then is the in-memory ``percentile`` used."""
    if bounded:
        arr = F.percentile(value, F.array(*[F.lit(q) for q in qs.values()]))
        out = df.groupBy(*by).agg(arr.alias("_q"))
        return out.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(qs)])
    if by:
        return exact_quantiles(df, by, value, qs)
    return exact_quantiles(constant_key(df), ["_all"], value, qs).drop("_all")


def attach_quantiles(agg: DataFrame, df: DataFrame, by: list[str], value: str, qs: dict[str, float], bounded: bool = False) -> DataFrame:
    """Add group quantiles to an aggregate of the same groups."""
    q = group_quantiles(df, by, value, qs, bounded)
    if not by:
        return agg.withColumns({n: q.select(n).scalar() for n in qs})
    right = [F.col(b).alias(f"_k_{b}") for b in by]
    cond = [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by]
    return agg.join(q.select(*right, *qs), cond, "left").drop(*[f"_k_{b}" for b in by])


def attach_rollup_quantiles(agg: DataFrame, df: DataFrame, cols: list[str], value: str, qs: dict[str, float], level: str = "_level") -> DataFrame:
    """The same for a ROLLUP over ``cols``; ``agg`` has a ``level`` column counting the columns a
    row is grouped by. The level is part of the key, so all levels are refined together."""
    each = df.select(*cols, value, F.explode(F.sequence(F.lit(0), F.lit(len(cols)))).alias(level))
    keyed = each.withColumns({c: F.when(F.col(level) > i, F.col(c)) for i, c in enumerate(cols)})
    keys = [*cols, level]
    parts = exact_quantiles(keyed, keys, value, qs)
    right = [F.col(k).alias(f"_k_{k}") for k in keys]
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return agg.join(parts.select(*right, *qs), cond, "left").drop(level, *[f"_k_{k}" for k in keys])
