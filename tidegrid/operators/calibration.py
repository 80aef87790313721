"""Bias calibration of stored forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import dates as D
from tidegrid.functions.scalar import time_decay
from tidegrid.plans import regimes as RG

# Calibration window in business days, monthly decay, least samples.
WINDOW_DAYS, DECAY, MIN_SAMPLES = 700, 0.125, 50


def bias_levels(df: DataFrame, first: str, second: str, error: str, weight: str, min_samples: int, names=("regime_cohort", "regime", "cohort", "global")) -> DataFrame:
    """Weighted mean error for (first, second), first, second and overall, in one GROUPING SETS
    pass; groups under ``min_samples`` are left out."""
    both, one, two, none = names
    g1, g2 = F.grouping(first), F.grouping(second)
    level = F.when((g1 == 0) & (g2 == 0), both).when(g1 == 0, one).when(g2 == 0, two).otherwise(none)
    sets = df.groupingSets([[first, second], [first], [second], []], first, second)
    out = sets.agg(level.alias("level"), (F.sum(F.col(weight) * F.col(error)) / F.sum(weight)).alias("bias"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") >= min_samples)


def fit_calibration(forecasts: DataFrame, window_days: int = WINDOW_DAYS, decay: float = DECAY, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Correction table ``(level, regime, calendar_cohort, bias, n)`` from decided forecasts whose
    outcome is known, over the last ``window_days`` business days. With too few forecasts in all,
    every level is too small and the table is empty."""
    done = forecasts.filter(F.col("actual_vix_change").isNotNull() & F.col("direction_prediction").isin("UP", "DOWN"))
    done = done.withColumn("_last", done.agg(F.max("forecast_date")).scalar())
    start = D.from_business_index(D.business_index(F.date_add("_last", 1)) - window_days)
    recent = done.filter(F.col("forecast_date") >= start)
    scored = recent.select(
        RG.level_label(RG.level_regime("current_vix", "left")).alias("regime"), "calendar_cohort",
        (F.col("actual_vix_change") - F.col("magnitude_forecast")).alias("_err"),
        time_decay(F.datediff("_last", "forecast_date"), decay).alias("_w"),
    )
    return bias_levels(scored, "regime", "calendar_cohort", "_err", "_w", min_samples)


def apply_calibration(df: DataFrame, corrections: DataFrame, forecast: str = "magnitude_forecast") -> DataFrame:
    """Add the most specific correction on record: regime and cohort, regime, cohort, overall.

    The table holds at most regimes x cohorts rows, so each level is a broadcast lookup."""
    df = df.withColumn("regime", RG.level_label(RG.level_regime("current_vix", "left")))

    def level(name: str, keys: list[str], out: str) -> DataFrame:
        return corrections.filter(F.col("level") == name).select(*keys, F.col("bias").alias(out))

    out = df.join(level("regime_cohort", ["regime", "calendar_cohort"], "_rc"), ["regime", "calendar_cohort"], "left")
    out = out.join(level("regime", ["regime"], "_r"), ["regime"], "left")
    out = out.join(level("cohort", ["calendar_cohort"], "_c"), ["calendar_cohort"], "left")
    out = out.withColumn("_g", corrections.filter(F.col("level") == "global").select("bias").scalar())
    kind = F.when(F.col("_rc").isNotNull(), "regime_cohort").when(F.col("_r").isNotNull(), "regime").when(F.col("_c").isNotNull(), "cohort")
    adj = F.coalesce("_rc", "_r", "_c", "_g", F.lit(0.0))
    out = out.withColumns({
        "adjustment": adj, "correction_type": kind.when(F.col("_g").isNotNull(), "global").otherwise("not_fitted"),
        "calibrated_forecast": F.col(forecast) + adj,
    })
    return out.drop("_rc", "_r", "_c", "_g")
