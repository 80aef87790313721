"""The forecast table: schema, idempotent insert, range queries, outcomes and performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.axis import Axis
from tidegrid.functions import dates as D
from tidegrid.functions.scalar import nonzero
from tidegrid.operators import ranks as RK
from tidegrid.operators.joins import first_within

_S, _D, _I, _TS, _DT = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampType(), T.DateType()

# Columns of the forecast table.
FORECAST_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("prediction_id", _S), ("timestamp", _TS), ("observation_date", _DT), ("forecast_date", _DT), ("horizon", _I), ("calendar_cohort", _S), ("cohort_weight", _D), ("prob_up", _D), ("prob_down", _D),
    ("magnitude_forecast", _D), ("expected_vix", _D), ("feature_quality", _D), ("num_features_used", _I), ("current_vix", _D), ("actual_vix_change", _D), ("actual_direction", _I), ("direction_correct", _I),
    ("magnitude_error", _D), ("correction_type", _S), ("features_used", _S), ("model_version", _S), ("created_at", _TS), ("direction_probability", _D), ("direction_prediction", _S), ("direction_confidence", _D),
]])


def conform(df: DataFrame, keys: list[str] = (), schema: T.StructType = FORECAST_SCHEMA) -> DataFrame:
    """Cast to the declared columns; columns an older table lacks are added as null."""
    have = set(df.columns)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*keys, *cols)


def insert_new(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh forecasts whose (keys, forecast_date, horizon) is not stored; of a batch the one
    created first wins, by id where times are equal."""
    unique = [*keys, "forecast_date", "horizon"]
    rest = [c for c in fresh.columns if c not in unique]
    came = [c for c in ("created_at", "prediction_id") if c in fresh.columns]
    first = fresh.groupBy(*unique).agg(F.min_by(F.struct(*rest), F.struct(*came)).alias("_r"))
    first = first.select(*unique, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*fresh.columns)
    return first.join(stored.select(*unique), unique, "left_anti").select(*fresh.columns)


def query_forecasts(df: DataFrame, keys: list[str], start: str | None = None, end: str | None = None, cohort: str | None = None, with_actuals: bool = False) -> DataFrame:
    """Forecasts of a date range, the last per (keys, forecast_date, horizon)."""
    if start:
        df = df.filter(F.col("forecast_date") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("forecast_date") <= F.lit(end).cast("date"))
    if cohort:
        df = df.filter(F.col("calendar_cohort") == cohort)
    if with_actuals:
        df = df.filter(F.col("actual_vix_change").isNotNull())
    unique = [*keys, "forecast_date", "horizon"]
    rest = [c for c in df.columns if c not in unique]
    last = df.groupBy(*unique).agg(F.max_by(F.struct(*rest), "prediction_id").alias("_r"))
    return last.select(*unique, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def outcome_day(base: str = "forecast_date", horizon: str = "horizon", unit: str = "business") -> Column:
    """The day a forecast comes due, counted in business or calendar days from ``base``."""
    return D.add_business_days(base, F.col(horizon)) if unit == "business" else F.date_add(F.col(base), F.col(horizon))


def backfill_outcomes(forecasts: DataFrame, levels: DataFrame, keys: list[str], level: str, slack_days: int = 3, base: str = "forecast_date", unit: str = "business") -> DataFrame:
    """Outcome columns for decided forecasts without one: the level on the due day or the first of
    the ``slack_days`` after it, the change, direction, hit and size error. One equi-join."""
    open_ = forecasts.filter(F.col("actual_vix_change").isNull() & (F.coalesce(F.col("direction_prediction"), F.lit("")) != "NO_DECISION"))
    due = open_.withColumn("_due", outcome_day(base, "horizon", unit))
    src = levels.filter(F.col(level).isNotNull()).select(*keys, "ts", F.col(level).alias("_actual"))
    j = first_within(due, src, Axis(tuple(keys), "ts"), "_due", slack_days, ["_actual"], "_found").filter(F.col("_actual").isNotNull())
    change = (F.col("_actual") - F.col("current_vix")) / nonzero("current_vix") * 100
    up = (F.col("actual_vix_change") > 0).cast("int")
    said_up = F.when(F.col("direction_prediction").isNotNull(), F.col("direction_prediction") == "UP").otherwise(F.col("direction_probability") > 0.5).cast("int")
    j = j.withColumn("actual_vix_change", change)
    j = j.withColumns({"actual_direction": up, "direction_correct": (up == said_up).cast("int"), "magnitude_error": F.abs(F.col("actual_vix_change") - F.col("magnitude_forecast"))})
    return j.select(*[c for c in forecasts.columns])


def performance_summary(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Decision rate, accuracy and size errors, in total and by cohort (ROLLUP).

    Precision and recall are of the UP call; ``accuracy_on_actual_up`` is the one number the
    reference reports under both names."""
    decided = F.col("direction_prediction").isin("UP", "DOWN")
    hit, up = F.when(decided, F.col("direction_correct").cast("double")), F.col("actual_direction") == 1
    said = F.col("direction_prediction") == "UP"
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    known = df.filter(F.col("actual_vix_change").isNotNull()).withColumn("_e", F.when(decided, F.col("magnitude_forecast") - F.col("actual_vix_change")))
    known = known.withColumn("_ae", F.abs("_e"))
    cols = [*keys, "calendar_cohort"]
    agg = known.rollup(*cols).agg(
        F.count(F.lit(1)).alias("n_total"), n(decided).alias("n_decided"), (1 - F.avg(decided.cast("double"))).alias("no_decision_rate"), F.avg(hit).alias("accuracy"),
        (n(said & up) / nonzero(n(said))).alias("precision"), (n(said & up) / nonzero(n(decided & up))).alias("recall"), F.avg(F.when(up, hit)).alias("accuracy_on_actual_up"),
        F.avg("_ae").alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg("_e").alias("bias"), F.grouping("calendar_cohort").cast("int").alias("is_total"),
        (F.lit(len(cols)) - F.bit_count(F.grouping_id())).cast("int").alias("_level"),
    )
    return RK.attach_rollup_quantiles(agg, known, cols, "_ae", {"median_error": 0.5})


def days_to_forecast(features: DataFrame, stored: DataFrame, keys: list[str], ts: str, start: str, end: str) -> DataFrame:
    """Feature rows of a window whose observation day has no stored forecast."""
    window = features.filter(F.col(ts).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    seen = stored.select(*keys, F.col("observation_date").alias(ts)).distinct()
    return window.join(seen, [*keys, ts], "left_anti")
