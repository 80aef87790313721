"""Calendars, event dates, cohorts and gap audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import dates as D
from tidegrid.functions.scalar import clip, flag, lookup
from tidegrid.operators.joins import near_any_event, signed_days_to_next

# Cohort order, day windows and weights.
COHORT_WEIGHTS = {"fomc_period": 1.0, "opex_week": 1.0, "earnings_heavy": 1.0, "mid_cycle": 1.0}
EVENT_RANGE = (-7, 2)
EXPIRY_RANGE = (-7, 0)
EARNINGS_RANGE = (0.15, 1.0)
CPI_DAY, CPI_WINDOW = 12, 2
PCE_DAY, PCE_WINDOW = 28, 3
MINUTES_OFFSET, MINUTES_WINDOW = 21, 2


def days_between(df: DataFrame, first: str | Column, last: str | Column, out: str, business: bool = False) -> DataFrame:
    """Explode each row into every (business) day of its own range."""
    span = F.sequence(F.col(first) if isinstance(first, str) else first, F.col(last) if isinstance(last, str) else last, F.expr("interval 1 day"))
    d = df.withColumn(out, F.explode(span))
    return d.filter(D.is_business_day(out)) if business else d


def series_calendar(df: DataFrame, ax: Axis, business: bool = False) -> DataFrame:
    """Every (business) day between each series' first and last row."""
    span = df.groupBy(*ax.keys).agg(F.min(ax.ts).alias("_a"), F.max(ax.ts).alias("_b"))
    return days_between(span, "_a", "_b", ax.ts, business).select(*ax.id_cols)


# Recorded contract expiries that a holiday moved off the rule, by year and month.
MOVED_EXPIRIES = {
    201403: "2014-03-18", 201903: "2019-03-19", 202203: "2022-03-15", 202406: "2024-06-18", 202503: "2025-03-18", 202605: "2026-05-19",
}


def months_between(df: DataFrame, ts: str, years_after: int = 1) -> DataFrame:
    """One row per month, from January of the first year to December ``years_after`` past the last."""
    span = df.agg(F.min(F.year(ts)).alias("a"), F.max(F.year(ts)).alias("b"))
    y = span.select(F.explode(F.sequence(F.col("a"), F.col("b") + years_after)).alias("year"))
    return y.select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))


def option_expiries(months: DataFrame) -> DataFrame:
    return months.select("year", "month", D.third_friday("year", "month").alias("event_date"))


def futures_expiries(months: DataFrame) -> DataFrame:
    opex = option_expiries(months)
    return opex.select("year", "month", D.expiry_wednesday("event_date").alias("event_date"))


def expiry_table(months: DataFrame, anchor: DataFrame | None = None) -> DataFrame:
    """Contract expiries by rule and the known moved dates, with recorded (year, month, expiry_date)
    rows taking precedence."""
    moved = lookup(F.col("year") * 100 + F.col("month"), MOVED_EXPIRIES).cast("date")
    rule = months.select("year", "month", F.coalesce(moved, D.contract_expiry("year", "month")).alias("expiry_date"))
    full = rule
    if anchor is not None:
        full = anchor.select("year", "month", "expiry_date").unionByName(rule.join(anchor, ["year", "month"], "left_anti"))
    return full.withColumn("contract_code", D.contract_code("year", "month"))


def event_distances(days: DataFrame, ts: str, meetings: DataFrame, opex: DataFrame, futures: DataFrame, event_date: str = "event_date") -> DataFrame:
    """Signed days to the next meeting, option expiry and futures expiry, plus release-day flags."""
    d = signed_days_to_next(days.select(ts).distinct(), meetings, ts, event_date, "days_to_meeting")
    d = signed_days_to_next(d, opex, ts, event_date, "days_to_opex")
    d = signed_days_to_next(d, futures, ts, event_date, "days_to_futures")
    d = near_any_event(d, meetings, ts, event_date, MINUTES_OFFSET, MINUTES_WINDOW, "is_minutes")
    return d.withColumns({
        "is_cpi": flag(D.near_month_day(ts, CPI_DAY, CPI_WINDOW)),
        "is_pce": flag(D.near_month_day(ts, PCE_DAY, PCE_WINDOW)),
        "earnings_intensity": D.earnings_intensity(ts),
    })


def cohort_weight(cohort: Column, weights: dict[str, float] | None = None) -> Column:
    """Training weight of a cohort; unknown cohorts weigh 1."""
    return F.coalesce(lookup(cohort, weights or COHORT_WEIGHTS), F.lit(1.0))


def cohort_columns(weights: dict[str, float] | None = None) -> dict[str, Column]:
    """Calendar cohort by priority, its weight and 0/1 flags, from ``event_distances`` columns."""
    between = lambda c, r: F.coalesce(F.col(c).between(*r), F.lit(False))
    macro = between("days_to_meeting", EVENT_RANGE) | (F.col("is_cpi") + F.col("is_pce") + F.col("is_minutes") > 0)
    expiry = between("days_to_opex", EXPIRY_RANGE) | between("days_to_futures", EXPIRY_RANGE)
    earnings = between("earnings_intensity", EARNINGS_RANGE)
    cohort = F.when(macro, "fomc_period").when(expiry, "opex_week").when(earnings, "earnings_heavy").otherwise("mid_cycle")
    return {
        "calendar_cohort": cohort, "cohort_weight": cohort_weight(cohort, weights), "is_fomc_period": flag(cohort == "fomc_period"),
        "is_opex_week": flag(cohort == "opex_week"), "is_earnings_heavy": flag(cohort == "earnings_heavy"),
    }


def _decay(days: str, reach: float) -> Column:
    return F.coalesce(clip(1.0 - F.abs(F.col(days)) / reach, 0, 1), F.lit(0.0))


def proximity_columns(df: DataFrame) -> DataFrame:
    """Continuous event-proximity features from ``event_distances`` columns, all in 0..1."""
    m, o = F.col("days_to_meeting"), F.col("days_to_opex")
    df = df.withColumns({
        "fomc_proximity": _decay("days_to_meeting", 14.0),
        "fomc_pre_period": F.when(m < 0, clip(1.0 + m / 7.0, 0, 1)).otherwise(0.0),
        "fomc_post_period": F.when(m >= 0, clip(1.0 - m / 3.0, 0, 1)).otherwise(0.0),
        "opex_proximity": _decay("days_to_opex", 10.0),
        "opex_week_intensity": F.when((o >= -7) & (o <= 0), clip(1.0 + o / 7.0, 0, 1)).otherwise(0.0),
        "vix_expiry_proximity": _decay("days_to_futures", 10.0),
        "earnings_intensity_norm": (F.col("earnings_intensity") - 0.05) / 0.20,
        "cpi_week": F.col("is_cpi").cast("double"),
        "pce_week": F.col("is_pce").cast("double"),
    })
    many = (F.col("fomc_proximity") > 0.3).cast("double") + (F.col("opex_proximity") > 0.3).cast("double") + (F.col("earnings_intensity_norm") > 0.5).cast("double")
    return df.withColumns({
        "macro_event_intensity": clip(F.col("fomc_proximity") + F.col("cpi_week") * 0.5 + F.col("pce_week") * 0.5, 0, 1),
        "multi_event_stress": many / 3.0,
    })


def missing_days(df: DataFrame, ax: Axis, closures: DataFrame | None = None) -> DataFrame:
    """Expected business days inside each series' span that have no row; listed closures are not
    expected."""
    expected = series_calendar(df, ax, business=True)
    if closures is not None:
        expected = expected.join(closures.select(ax.ts).distinct(), ax.ts, "left_anti")
    return expected.join(df.select(*ax.id_cols), list(ax.id_cols), "left_anti")


def lag_then_align(target: DataFrame, source: DataFrame, ax: Axis, value: str, lag_rows: int, limit: int | None) -> DataFrame:
    """Move a source by its publication lag on its own rows, then align it as-of."""
    from tidegrid.operators.joins import asof_join

    shifted = source.withColumn(value, F.lag(value, lag_rows).over(ax.ordered())) if lag_rows else source
    return asof_join(target, shifted, ax, [value], limit)


def meetings_from_rows(df: DataFrame, date_col: str) -> DataFrame:
    return df.select(F.to_date(date_col).alias("event_date")).filter(F.col("event_date").isNotNull()).distinct()


def literal_dates(spark: SparkSession, days: list[str], name: str = "ts") -> DataFrame:
    return spark.createDataFrame([(d,) for d in days], f"{name} string").select(F.col(name).cast("date").alias(name))
