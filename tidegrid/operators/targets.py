"""Forward targets, splits, folds and filters."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import rolling as R
from tidegrid.functions.technical import stage

HORIZON = 5


def forward_targets(df: DataFrame, ax: Axis, level: str = "vix", horizon: int = HORIZON, label_null_policy: str = "drop") -> DataFrame:
    """Log change to ``horizon`` rows ahead, its percent form, direction and the future level.

    The last ``horizon`` rows have no target. Their direction is null under ``drop`` and 0 under
    ``zero`` (the reference's behaviour, which feeds unlabeled rows to classifiers)."""
    if label_null_policy not in ("drop", "zero"):
        raise ValueError(label_null_policy)
    now = F.col(level)
    fut = R.lead(level, horizon, ax)
    df = stage(df, {"future_vix": fut})
    log = F.when((F.col("future_vix") > 0) & (now > 0), F.ln("future_vix") - F.ln(now))
    df = stage(df, {"target_log_vix_change": log})
    up = (F.col("target_log_vix_change") > 0).cast("int")
    direction = F.coalesce(up, F.lit(0)) if label_null_policy == "zero" else up
    return stage(df, {"target_direction": direction, "target_vix_pct_change": (F.exp("target_log_vix_change") - 1) * 100})


def target_warnings(df: DataFrame, by: list[str], target: str = "target_log_vix_change", direction: str = "target_direction") -> DataFrame:
    """Counts behind the target checks, and one flag per check."""
    t = F.col(target)
    out = df.groupBy(*by).agg(
        F.count(target).alias("valid_targets"), F.sum((t < -2.0).cast("long")).alias("extreme_low"), F.sum((t > 2.0).cast("long")).alias("extreme_high"), F.avg(direction).alias("up_share"),
    )
    return out.withColumns({
        "few_targets": (F.col("valid_targets") < 100).cast("int"), "has_extremes": (F.coalesce("extreme_low", F.lit(0)) + F.coalesce("extreme_high", F.lit(0)) > 0).cast("int"),
        "imbalanced": (~F.col("up_share").between(0.3, 0.7)).cast("int"),
    })


def time_split(ts: str, train_end: str, val_end: str) -> Column:
    d = F.col(ts)
    return F.when(d <= F.lit(train_end).cast("date"), "train").when(d <= F.lit(val_end).cast("date"), "val").otherwise("test")


def expanding_folds(df: DataFrame, ax: Axis, n_splits: int = 5, out: str = "block") -> DataFrame:
    """Time-ordered block 0..n per row: fold ``k`` validates on block ``k`` (1..n) and trains on all
    earlier blocks. Validation blocks have ``n // (n_splits + 1)`` rows, the first block the rest."""
    n = F.count(F.lit(1)).over(ax.whole())
    size = F.floor(n / (n_splits + 1))
    first = n - size * n_splits
    pos = F.row_number().over(ax.ordered()) - 1
    df = stage(df, {"_pos": pos, "_size": size, "_first": first})
    block = F.when(F.col("_pos") < F.col("_first"), 0).when(F.col("_size") > 0, F.floor((F.col("_pos") - F.col("_first")) / F.when(F.col("_size") > 0, F.col("_size"))) + 1)
    return stage(df, {out: block.cast("int")}).drop("_pos", "_size", "_first")


# Percent of rows lost to the quality filter from which it warns, and fails.
WARN_PCT, ERROR_PCT = 20.0, 50.0


def quality_loss(df: DataFrame, quality: str, thresholds: list[float], warn_pct: float = WARN_PCT, error_pct: float = ERROR_PCT) -> DataFrame:
    """(threshold, rows, lost_pct, verdict): what each threshold would cost, in one pass. An unknown quality is lost."""
    lost = [F.avg((F.coalesce(F.col(quality), F.lit(0.0)) < t).cast("double")) * 100 for t in thresholds]
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*lost).alias("lost"))
    each = row.select("rows", F.explode(F.arrays_zip(F.array(*[F.lit(float(t)) for t in thresholds]).alias("threshold"), F.col("lost"))).alias("x"))
    p = F.col("x.lost")
    return each.select(F.col("x.threshold").alias("threshold"), "rows", p.alias("lost_pct"), F.when(p > error_pct, "error").when(p > warn_pct, "warn").otherwise("ok").alias("verdict"))


def quality_filter(df: DataFrame, quality: str, threshold: float, warn_pct: float = WARN_PCT, error_pct: float = ERROR_PCT, strategy: str = "raise") -> DataFrame:
    """Rows at or above the quality threshold. Losing more than ``error_pct`` of them is an error under ``raise`` and a
    warning otherwise; losing more than ``warn_pct`` is a warning."""
    got = quality_loss(df, quality, [threshold], warn_pct, error_pct).first()
    told = f"{got['lost_pct'] or 0:.1f}% of rows fall below quality {threshold}"
    if got["verdict"] == "error" and strategy == "raise":
        raise ValueError(told)
    if got["verdict"] != "ok":
        warnings.warn(told, stacklevel=2)
    return df.filter(F.col(quality) >= threshold)


def domain_rows(df: DataFrame, domain: str) -> DataFrame:
    """Rows a model learns from: ``expansion`` up moves, ``compression`` down moves, ``up``/``down``
    every labeled row; the label column is ``label``."""
    d, t = F.col("target_direction"), F.col("target_log_vix_change")
    known = df.filter(t.isNotNull())
    if domain == "expansion":
        return known.filter(d == 1).withColumn("label", t)
    if domain == "compression":
        return known.filter(d == 0).withColumn("label", t)
    if domain == "up":
        return known.withColumn("label", d.cast("double"))
    if domain == "down":
        return known.withColumn("label", (1 - d).cast("double"))
    raise ValueError(domain)
