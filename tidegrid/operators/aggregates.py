"""Summary, quality and distribution aggregates, each a single map-side-combined pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions.scalar import col, nonzero
from tidegrid.operators import ranks as RK


def summary_stats(df: DataFrame, by: list[str], c: str, bounded: bool = False) -> DataFrame:
    agg = df.groupBy(*by).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    return RK.attach_quantiles(agg, df, by, c, {"median": 0.5, "q25": 0.25, "q75": 0.75}, bounded)


def unpivot_columns(df: DataFrame, ids: list[str], cols: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(ids, cols, name, value)


def column_profile(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows, nulls, zeros, distinct count, deviation and range of every column, one row each.

    Long form keeps the plan small for hundreds of columns. Distinct values are first reduced per
    (column, value), so a column of few values never piles up in one task."""
    by = by or []
    long = unpivot_columns(df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]), by, cols)
    per_value = long.groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    v, n = F.col("value"), F.col("n").cast("double")
    known = F.when(v.isNotNull(), n)
    sums = per_value.groupBy(*by, "feature").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(v.isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(v == 0, F.col("n"))), F.lit(0)).alias("zeros"),
        F.count("value").alias("uniques"),
        (F.sum(v * n) / nonzero(F.sum(known))).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    dev = long.groupBy(*by, "feature").agg(F.stddev_samp("value").alias("std"))
    return sums.join(dev, [*by, "feature"])


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    w = F.when(col(value).isNotNull(), col(weight))
    return F.sum(col(value) * col(weight)) / nonzero(F.sum(w))


def value_shares(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """Count and share of each value inside its group."""
    per = df.groupBy(*by, c).agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return per.withColumn("share", F.col("n") / per.agg(F.sum("n")).scalar())
    total = per.groupBy(*by).agg(F.sum("n").alias("_total"))
    return per.join(total, by).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def pass_rates(df: DataFrame, by: list[str], predicates: dict[str, Column]) -> DataFrame:
    """Percent of rows passing each predicate (null is a fail), one row per predicate."""
    aggs = [(F.avg(F.coalesce(p, F.lit(False)).cast("double")) * 100).alias(n) for n, p in predicates.items()]
    return df.groupBy(*by).agg(*aggs).unpivot(by, list(predicates), "condition", "pass_pct")


def annual_rate(df: DataFrame, ax: Axis, cond: str, min_rows: int = 5) -> DataFrame:
    out = df.groupBy(*ax.keys, F.year(ax.ts).alias("year")).agg(
        F.sum(F.when(F.col(cond), 1).otherwise(0)).alias("open_days"), F.count(cond).alias("total_days")
    )
    return out.filter(F.col("total_days") >= min_rows).withColumn("open_pct", F.col("open_days") / F.col("total_days") * 100)


def latest_percentile(df: DataFrame, ax: Axis, c: str) -> DataFrame:
    """Share of the history below (and at or below) each series' latest value, times 100."""
    latest = df.filter(F.col(c).isNotNull()).groupBy(*ax.keys).agg(F.max_by(c, ax.ts).alias("current"))
    j = df.filter(F.col(c).isNotNull()).join(latest, list(ax.keys))
    return j.groupBy(*ax.keys).agg(
        F.first("current").alias("current"),
        (F.avg((F.col(c) < F.col("current")).cast("double")) * 100).alias("pct_below"),
        (F.avg((F.col(c) <= F.col("current")).cast("double")) * 100).alias("pct_at_or_below"),
    )


def fixed_histogram(df: DataFrame, by: list[str], c: str, width: float, top: float) -> DataFrame:
    """Counts per bin of ``width`` over [0, top)."""
    b = F.floor(F.col(c) / width).cast("long")
    inside = df.withColumn("bin", b).filter((F.col("bin") >= 0) & (F.col("bin") < int(top / width)))
    return inside.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("bin_start", F.col("bin") * width)


def dynamic_histogram(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """Histogram with max(20, min(50, ceil(range / 0.5))) equal bins per group."""
    known = df.filter(F.col(c).isNotNull())
    span = known.groupBy(*by).agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    span = span.withColumn("bins", F.greatest(F.lit(20), F.least(F.lit(50), F.ceil((F.col("hi") - F.col("lo")) / 0.5))).cast("int"))
    j = known.join(span, by)
    frac = (F.col(c) - F.col("lo")) / nonzero(F.col("hi") - F.col("lo"))
    b = F.least(F.floor(F.coalesce(frac, F.lit(0.0)) * F.col("bins")), F.col("bins") - 1).cast("int")
    return j.withColumn("bin", b).groupBy(*by, "bins", "bin").agg(F.count(F.lit(1)).alias("n"))


def kernel_density(df: DataFrame, by: list[str], c: str, points: int = 50, bandwidth: float = 0.05) -> DataFrame:
    """Gaussian density on a grid of ``points + 1`` positions from min to max.

    Values are first counted per distinct value; each then adds to every position of the grid, folded
    map-side.
    """
    known = df.filter(F.col(c).isNotNull())
    per = known.groupBy(*by, c).agg(F.count(F.lit(1)).alias("w"))
    span = known.groupBy(*by).agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(F.lit(1)).alias("n"))
    j = per.join(span, by)
    gap = (F.col("hi") - F.col("lo")) / points
    spread = j.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points))))
    u = (F.col("lo") + gap * F.col("i") - F.col(c)) / bandwidth
    dens = F.sum(F.col("w") * F.exp(-0.5 * u * u)) / (F.sqrt(F.lit(2 * 3.141592653589793)) * F.first("n") * bandwidth)
    return spread.groupBy(*by, "i", "lo", "hi").agg(dens.alias("density")).select(*by, "i", (F.col("lo") + (F.col("hi") - F.col("lo")) / points * F.col("i")).alias("x"), "density")


def return_profile(df: DataFrame, by: list[str], c: str, min_n: int = 5, bounded: bool = False) -> DataFrame:
    """Mean, median, population deviation, shares above and below zero, range; groups under
    ``min_n`` are left out."""
    x, known = F.col(c), df.filter(F.col(c).isNotNull())
    out = known.groupBy(*by).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std_pop"), F.avg((x > 0).cast("double")).alias("share_pos"), F.avg((x < 0).cast("double")).alias("share_neg"),
        F.min(c).alias("min"), F.max(c).alias("max"),
    )
    return RK.attach_quantiles(out.filter(F.col("n") >= min_n), known, by, c, {"median": 0.5}, bounded)


def direction_scores(df: DataFrame, by: list[str], predicted: str, actual: str, confidence: str | None = None, magnitude: str | None = None, none_label: str = "NO_DECISION") -> DataFrame:
    """Three-way decision scores: decision rate, accuracy overall and per side, mean confidence
    and size per side."""
    p, a = F.col(predicted), F.col(actual)
    made, hit = p != none_label, (p == a).cast("double")
    aggs = [
        F.count(F.lit(1)).alias("total_samples"),
        F.sum(made.cast("int")).alias("made_decision"),
        F.sum((~made).cast("int")).alias("no_decision"),
        F.avg((~made).cast("double")).alias("no_decision_pct"),
        F.coalesce(F.avg(F.when(made, hit)), F.lit(0.0)).alias("overall_accuracy"),
    ]
    for side in ("UP", "DOWN"):
        on, s = p == side, side.lower()
        aggs += [F.sum(on.cast("int")).alias(f"{s}_count"), F.coalesce(F.avg(F.when(on, hit)), F.lit(0.0)).alias(f"{s}_accuracy")]
        if confidence:
            aggs.append(F.coalesce(F.avg(F.when(on, F.col(confidence))), F.lit(0.0)).alias(f"{s}_confidence"))
        if magnitude:
            aggs.append(F.coalesce(F.avg(F.when(on, F.col(magnitude))), F.lit(0.0)).alias(f"{s}_magnitude"))
    return df.groupBy(*by).agg(*aggs)


def size_errors(df: DataFrame, cohort: str, forecast: str, actual: str, keys: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, bias and median error by cohort and in total (ROLLUP)."""
    cols = [*(keys or []), cohort]
    d = df.withColumn("_e", F.col(forecast) - F.col(actual)).withColumn("_ae", F.abs("_e"))
    agg = d.rollup(*cols).agg(
        F.count("_e").alias("n"), F.avg("_ae").alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg("_e").alias("bias"),
        F.grouping(cohort).cast("int").alias("is_total"), (F.lit(len(cols)) - F.bit_count(F.grouping_id())).cast("int").alias("_level"),
    )
    return RK.attach_rollup_quantiles(agg, d, cols, "_ae", {"median_error": 0.5})


def binary_scores(df: DataFrame, by: list[str], prob: str, label: str, cut: float = 0.5) -> DataFrame:
    """Precision, recall, F1, accuracy and the area under the ROC curve.

    The area is counted from (group, probability) totals with running sums over the distinct
    probabilities, so equal scores cost one row."""
    y, yes = F.col(label), F.col(prob) >= cut
    tp = F.sum((yes & (y == 1)).cast("long"))
    fp = F.sum((yes & (y == 0)).cast("long"))
    fn = F.sum((~yes & (y == 1)).cast("long"))
    base = df.groupBy(*by).agg(
        F.coalesce(tp / nonzero(tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(tp / nonzero(tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(2 * tp / nonzero(2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        F.avg((yes.cast("int") == y).cast("double")).alias("accuracy"),
    )
    per = df.groupBy(*by, prob).agg(F.sum((y == 1).cast("long")).alias("_p"), F.sum((y == 0).cast("long")).alias("_n"))
    below = Axis(tuple(by), prob).upto(1)
    won = per.withColumn("_w", F.col("_p") * (F.coalesce(F.sum("_n").over(below), F.lit(0)) + F.col("_n") * 0.5))
    auc = won.groupBy(*by).agg((F.sum("_w") / nonzero(F.sum("_p").cast("double") * F.sum("_n"))).alias("auc"))
    return base.join(auc, by)


def feature_frequency(df: DataFrame, runs: int, feature: str = "feature", share: float = 0.8) -> DataFrame:
    """How often a feature occurs across runs, with those at or above ``share`` marked stable."""
    per = df.groupBy(feature).agg(F.countDistinct("run").alias("n_runs"))
    return per.withColumn("frequency", F.col("n_runs") / runs).withColumn("stable", (F.col("frequency") >= share).cast("int"))


def nan_share(c: str) -> Column:
    return F.avg(F.col(c).isNotNull().cast("double"))


def sum_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)
