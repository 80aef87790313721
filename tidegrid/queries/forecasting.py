"""Targets, decisions, forecast store, calibration and search queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidegrid.functions import dates as D
from tidegrid.functions import rolling as R
from tidegrid.operators import calibration as CB
from tidegrid.operators import decision as DC
from tidegrid.operators import store as ST
from tidegrid.operators import targets as TG
from tidegrid.queries import sqlgen as S
from tidegrid.queries.frames import AX, market, market_sql
from tidegrid.queries.registry import query, shaped
from tidegrid.queries.tables import rr

ID = ["series_id", "ts"]
MD = S.day("ts")

_TG = S.Steps(market_sql(["vix"])).add(future_vix=S.lead("vix", 5)).add(target_log_vix_change="ln(future_vix) - ln(vix)").add(target_direction="(target_log_vix_change > 0)::INT", target_vix_pct_change="(exp(target_log_vix_change) - 1) * 100")


@query("M1 N16 W1", _TG.add(zero_label="coalesce(target_direction, 0)").out(["future_vix", "target_log_vix_change", "target_vix_pct_change"], ["zero_label"]))
def forward_targets(spark, sf_dir):
    df = TG.forward_targets(market(spark, sf_dir, ["vix"]), AX, label_null_policy="zero")
    return shaped(df.withColumnRenamed("target_direction", "zero_label"), ID + ["future_vix", "target_log_vix_change", "target_vix_pct_change", "zero_label"])


@query(
    "M2 A1",
    _TG.done(
        "SELECT series_id, count(target_log_vix_change) AS valid_targets, count(*) FILTER (target_log_vix_change < -2) AS extreme_low, count(*) FILTER (target_log_vix_change > 2) AS extreme_high, " + S.r("avg(target_direction)") + " AS up_share,"
        " (count(target_log_vix_change) < 100)::INT AS few_targets, (count(*) FILTER (abs(target_log_vix_change) > 2) > 0)::INT AS has_extremes, (NOT avg(target_direction) BETWEEN 0.3 AND 0.7)::INT AS imbalanced FROM {prev} GROUP BY 1"
    ),
)
def target_validation(spark, sf_dir):
    return shaped(TG.target_warnings(TG.forward_targets(market(spark, sf_dir, ["vix"]), AX), ["series_id"]))


@query(
    "M3 M4 M6",
    S.Steps(market_sql(["vix"])).add(future_vix=S.lead("vix", 5), n="count(*) OVER (PARTITION BY series_id)", pos=f"row_number() {S.over()} - 1").add(t="ln(future_vix) - ln(vix)", sz="n // 6").add(first="n - sz * 5").add(block="CASE WHEN pos < first THEN 0 ELSE (pos - first) // sz + 1 END", split="CASE WHEN ts <= DATE '1999-12-31' THEN 'train' WHEN ts <= DATE '2000-12-31' THEN 'val' ELSE 'test' END").done(
        "SELECT series_id, split, CAST(block AS INT) AS block, count(*) AS rows, count(*) FILTER (t > 0) AS up_rows, count(*) FILTER (t <= 0) AS down_rows FROM {prev} GROUP BY 1, 2, 3"
    ),
)
def splits_and_folds(spark, sf_dir):
    df = TG.expanding_folds(TG.forward_targets(market(spark, sf_dir, ["vix"]), AX), AX)
    df = df.withColumn("split", TG.time_split("ts", "1999-12-31", "2000-12-31"))
    up, down = (TG.domain_rows(df, d).select("series_id", "split", "block", F.lit(d).alias("d")) for d in ("expansion", "compression"))
    per = df.select("series_id", "split", "block", F.lit("all").alias("d")).unionByName(up).unionByName(down).groupBy("series_id", "split", "block")
    n = lambda v: F.sum((F.col("d") == v).cast("long"))
    return per.agg(n("all").alias("rows"), n("expansion").alias("up_rows"), n("compression").alias("down_rows"))


# Model outputs stand in: ranks of two indices as probabilities, scaled levels as sizes.
_C = ["vix", "skew", "vvix", "gvz"]
_OUT = S.Steps(market_sql(_C)).add(p_up_raw=S.rank_pct("vix", 63), p_down_raw=S.rank_pct("skew", 63), expansion_log="(vvix - 60) / 500", compression_log="(0 - gvz) / 200", fut=S.lead("vix", 5)).raw(
    "SELECT * FROM {prev} WHERE p_up_raw IS NOT NULL AND p_down_raw IS NOT NULL AND gvz IS NOT NULL"
).add(actual="CASE WHEN fut > vix THEN 'UP' ELSE 'DOWN' END", p_up="p_up_raw / nullif(p_up_raw + p_down_raw, 0)", p_down="p_down_raw / nullif(p_up_raw + p_down_raw, 0)", ep="least(greatest((exp(least(greatest(expansion_log, -2), 2)) - 1) * 100, -50), 100)", cp="least(greatest((exp(least(greatest(compression_log, -2), 2)) - 1) * 100, -50), 100)")


def model_outputs(spark, sf_dir):
    df = R.with_columns(market(spark, sf_dir, _C), {
        "p_up_raw": R.rank_pct("vix", 63, AX), "p_down_raw": R.rank_pct("skew", 63, AX), "expansion_log": (F.col("vvix") - 60) / 500, "compression_log": (0 - F.col("gvz")) / 200, "fut": R.lead("vix", 5, AX),
    })
    df = df.filter("p_up_raw IS NOT NULL AND p_down_raw IS NOT NULL AND gvz IS NOT NULL")
    return df.withColumn("actual", F.when(F.col("fut") > F.col("vix"), "UP").otherwise("DOWN"))


def _decide(st: S.Steps) -> S.Steps:
    st.add(up="NOT (p_down > p_up + (-0.0452))")
    st.add(size="CASE WHEN up THEN ep ELSE cp END", direction_probability="CASE WHEN up THEN p_up ELSE p_down END")
    st.add(direction_confidence="least(greatest(CASE WHEN up THEN 0.6011 * direction_probability + 0.3989 * least(abs(size) / 9.9973::DOUBLE, 1) ELSE 0.6624 * direction_probability + 0.3376 * least(abs(size) / 9.2031::DOUBLE, 1) END, 0), 1)")
    st.add(direction="CASE WHEN direction_confidence < 0.684 THEN 'NO_DECISION' WHEN up THEN 'UP' ELSE 'DOWN' END", magnitude_pct="CASE WHEN direction_confidence < 0.684 THEN 0 ELSE size END")
    st.add(expected_vix="vix * (1 + magnitude_pct / 100)")
    lab = lambda x: f"CASE WHEN {x} < 15.57 THEN 'low_vol' WHEN {x} < 23.36 THEN 'normal' WHEN {x} < 31.16 THEN 'elevated' ELSE 'crisis' END"
    return st.add(current_regime=lab("vix"), expected_regime=lab("expected_vix")).add(regime_change="(current_regime <> expected_regime)::INT")


_DECIDED = _decide(S.Steps("SELECT * FROM (" + _OUT.done("SELECT * FROM {prev}") + ")"))
_DECIDED_SQL = _DECIDED.done("SELECT * FROM {prev}")
_MC = ["p_up", "p_down", "direction_probability", "direction_confidence", "magnitude_pct", "expected_vix"]


@query("M10 M11", _DECIDED.out(_MC, ["regime_change"], texts=["direction", "current_regime", "expected_regime"]))
def three_way_decision(spark, sf_dir):
    return shaped(DC.decide(model_outputs(spark, sf_dir)), ID + _MC + ["regime_change", "direction", "current_regime", "expected_regime"])


_RANGES = {"threshold": (0.45, 0.75)}
_LATTICE = ", ".join(
    f"round({lo!r}::DOUBLE + ({hi!r}::DOUBLE - {lo!r}::DOUBLE) * (w * {step} - floor(w * {step})), 4) AS {name}"
    for name, lo, hi, step in (
        ("r_up_advantage", -0.10, 0.10, "(sqrt(2) - 1)"), ("r_up_classifier", 0.55, 0.75, "(sqrt(3) - 1)"), ("r_down_classifier", 0.65, 0.85, "(sqrt(5) - 2)"),
        ("r_up_large", 9.0, 13.0, "(sqrt(7) - 2)"), ("r_down_large", 9.0, 14.0, "(sqrt(11) - 3)"),
    )
)
_GRID = (
    "SELECT ((w - 1) * 20 + t)::INT AS candidate, *, round(1 - r_up_classifier, 4) AS r_up_magnitude, round(1 - r_down_classifier, 4) AS r_down_magnitude"
    f" FROM (SELECT w, t, {_LATTICE}, round(0.45::DOUBLE + (0.75::DOUBLE - 0.45::DOUBLE) * t / 19, 4) AS r_threshold FROM range(1, 101) a(w), range(20) b(t))"
)
_SEARCH = (
    S.Steps("SELECT * FROM (" + _OUT.done("SELECT * FROM {prev}") + f") CROSS JOIN ({_GRID})")
    .add(up="NOT (p_down > p_up + r_up_advantage)").add(size="CASE WHEN up THEN ep ELSE cp END", pr="CASE WHEN up THEN p_up ELSE p_down END")
    .add(conf="least(greatest(CASE WHEN up THEN r_up_classifier * pr + r_up_magnitude * least(abs(size) / r_up_large, 1) ELSE r_down_classifier * pr + r_down_magnitude * least(abs(size) / r_down_large, 1) END, 0), 1)")
    .add(direction="CASE WHEN conf < r_threshold THEN 'NO_DECISION' WHEN up THEN 'UP' ELSE 'DOWN' END")
    .raw(
        "SELECT candidate, count(*) AS n, count(*) FILTER (direction <> 'NO_DECISION') AS made, avg((direction = 'NO_DECISION')::INT) AS nd, count(*) FILTER (direction = 'UP') AS nu, count(*) FILTER (direction = 'DOWN') AS ndn,"
        " coalesce(avg((direction = actual)::INT) FILTER (direction = 'UP'), 0) AS ua, coalesce(avg((direction = actual)::INT) FILTER (direction = 'DOWN'), 0) AS da FROM {prev} GROUP BY 1"
    )
    .add(us="coalesce(nu * 1.0 / nullif(made, 0), 0)", ds="coalesce(ndn * 1.0 / nullif(made, 0), 0)")
)
_bal = lambda x: f"(CASE WHEN {x} < 0.4 THEN (0.4 - {x}) * 200 WHEN {x} > 0.6 THEN ({x} - 0.6) * 200 ELSE 0 END)"


@query(
    "M13 M14 A10",
    _SEARCH.done(
        f"SELECT candidate, made AS made_decision, {rr(no_decision_pct='nd', up_accuracy='ua', down_accuracy='da')}, "
        + S.r("CASE WHEN ua < 0.3 OR da < 0.3 OR made < 100 OR nd < 0.05 OR nd > 0.95 THEN 999 ELSE (1 - least(ua, da)) * 100 + (1 - (ua + da) / 2) * 30 + pow(ua - da, 2) * 200 + pow(us - 0.44, 2) * 50 + (CASE WHEN nd < 0.2 THEN (0.2 - nd) * 100 WHEN nd > 0.35 THEN (nd - 0.35) * 100 ELSE -5 END) + (CASE WHEN made < 150 THEN (150 - made) * 0.5 ELSE 0 END) END") + " AS score, "
        + S.r(f"CASE WHEN made < 80 THEN 999 ELSE abs(ua - 0.75) * 3 + (CASE WHEN ua < 0.7 THEN 15 ELSE 0 END) + abs(da - 0.75) * 3 + (CASE WHEN da < 0.7 THEN 15 ELSE 0 END) + {_bal('us')} + {_bal('ds')} + (CASE WHEN us > 0.7 OR ds > 0.7 THEN 50 ELSE 0 END) + (CASE WHEN abs(ua - da) > 0.05 THEN (abs(ua - da) - 0.05) * 100 ELSE 0 END) + (CASE WHEN made < 120 THEN (120 - made) * 0.2 ELSE 0 END) + (CASE WHEN nd > 0.5 THEN (nd - 0.5) * 100 WHEN nd < 0.2 THEN (0.2 - nd) * 50 ELSE 0 END) END") + " AS joint_score FROM {prev}"
    ),
)
def decision_search(spark, sf_dir):
    scores = DC.score_candidates(model_outputs(spark, sf_dir), DC.candidate_rules(ranges=_RANGES))
    out = scores.withColumns({"score": DC.composite_score(0.3, 100, (0.05, 0.95)), "joint_score": DC.unified_score()})
    return shaped(out, ["candidate", "made_decision", "no_decision_pct", "up_accuracy", "down_accuracy", "score", "joint_score"])


# --- forecast table -------------------------------------------------------------------------
_COH = "CASE WHEN day(ts) BETWEEN 10 AND 14 THEN 'fomc_period' WHEN day(ts) BETWEEN 15 AND 21 THEN 'opex_week' ELSE 'mid_cycle' END"
_FC = f"SELECT series_id, series_id || strftime(ts, '%Y%m%d') AS prediction_id, ts AS observation_date, ts + 5 AS forecast_date, 5 AS horizon, {_COH} AS calendar_cohort, magnitude_pct AS magnitude_forecast, vix AS current_vix, direction AS direction_prediction, direction_probability FROM ({_DECIDED_SQL})"


def forecasts(spark, sf_dir):
    d = DC.decide(model_outputs(spark, sf_dir))
    dom = F.dayofmonth("ts")
    f = d.select(
        "series_id", F.concat("series_id", F.date_format("ts", "yyyyMMdd")).alias("prediction_id"), F.col("ts").alias("observation_date"), F.date_add("ts", 5).alias("forecast_date"), F.lit(5).alias("horizon"),
        F.when(dom.between(10, 14), "fomc_period").when(dom.between(15, 21), "opex_week").otherwise("mid_cycle").alias("calendar_cohort"), F.col("p_up").alias("prob_up"), F.col("p_down").alias("prob_down"), F.col("magnitude_pct").alias("magnitude_forecast"),
        "expected_vix", F.col("vix").alias("current_vix"), F.col("direction").alias("direction_prediction"), "direction_probability", "direction_confidence",
    )
    return ST.conform(f, ["series_id"])


@query(
    "M16 M17",
    f"WITH f AS ({_FC}), s AS (SELECT * FROM f WHERE day(observation_date) <= 20), n AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.series_id = f.series_id AND s.forecast_date = f.forecast_date AND s.horizon = f.horizon))"
    f" SELECT series_id, prediction_id, {S.day('forecast_date')} AS forecast_date, direction_prediction FROM n WHERE forecast_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND calendar_cohort = 'mid_cycle'",
)
def forecast_insert_and_query(spark, sf_dir):
    f = forecasts(spark, sf_dir)
    stored = f.filter(F.dayofmonth("observation_date") <= 20)
    new = ST.insert_new(stored, f.unionByName(f), ["series_id"])
    return shaped(ST.query_forecasts(new, ["series_id"], "1997-01-01", "1999-12-31", "mid_cycle"), ["series_id", "prediction_id", "forecast_date", "direction_prediction"])


_CAL = "SELECT x, row_number() OVER (ORDER BY x) AS n FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS x) WHERE isodow(x) <= 5"
_BF = (
    f"f AS ({_FC}), cal AS ({_CAL}), due AS (SELECT f.*, c2.x AS due FROM f JOIN cal c1 ON c1.x = (CASE WHEN isodow(forecast_date) = 6 THEN forecast_date + 2 WHEN isodow(forecast_date) = 7 THEN forecast_date + 1 ELSE forecast_date END) JOIN cal c2 ON c2.n = c1.n + 5 WHERE direction_prediction <> 'NO_DECISION'),"
    f" lv AS (SELECT series_id, ts, vix FROM ({market_sql(['vix'])}) WHERE vix IS NOT NULL), hit AS (SELECT d.series_id, d.prediction_id, arg_min(lv.vix, lv.ts) AS actual FROM due d JOIN lv ON lv.series_id = d.series_id AND lv.ts BETWEEN d.due AND d.due + 3 GROUP BY 1, 2),"
    " bf AS (SELECT d.*, (actual - current_vix) / current_vix * 100 AS actual_vix_change, ((actual - current_vix) / current_vix * 100 > 0)::INT AS actual_direction FROM due d JOIN hit USING (series_id, prediction_id)),"
    " done AS (SELECT *, (actual_direction = (direction_prediction = 'UP')::INT)::INT AS direction_correct, abs(actual_vix_change - magnitude_forecast) AS magnitude_error FROM bf)"
)


def outcomes(spark, sf_dir):
    levels = market(spark, sf_dir, ["vix"]).select("series_id", "ts", "vix")
    return ST.backfill_outcomes(forecasts(spark, sf_dir), levels, ["series_id"], "vix")


@query(
    "M18 N18 T2 J6",
    f"WITH {_BF} SELECT series_id, prediction_id, {rr(actual_vix_change='actual_vix_change', magnitude_error='magnitude_error')}, actual_direction, direction_correct FROM done",
)
def outcome_backfill(spark, sf_dir):
    return shaped(outcomes(spark, sf_dir), ["series_id", "prediction_id", "actual_vix_change", "magnitude_error", "actual_direction", "direction_correct"])


@query(
    "M19 N19 A11",
    f"WITH {_BF} SELECT calendar_cohort, count(*) AS n_total, count(*) AS n_decided, {rr(no_decision_rate='0.0::DOUBLE', accuracy='avg(direction_correct)', precision='count(*) FILTER (direction_prediction = ' + chr(39) + 'UP' + chr(39) + ' AND actual_direction = 1) * 1.0 / count(*) FILTER (direction_prediction = ' + chr(39) + 'UP' + chr(39) + ')', recall='count(*) FILTER (direction_prediction = ' + chr(39) + 'UP' + chr(39) + ' AND actual_direction = 1) * 1.0 / count(*) FILTER (actual_direction = 1)', accuracy_on_actual_up='avg(direction_correct) FILTER (actual_direction = 1)', mae='avg(magnitude_error)', rmse='sqrt(avg(magnitude_error * magnitude_error))', bias='avg(magnitude_forecast - actual_vix_change)', median_error='median(magnitude_error)')}, CAST(grouping(calendar_cohort) AS INT) AS is_total FROM done GROUP BY ROLLUP(calendar_cohort)",
)
def forecast_performance(spark, sf_dir):
    return shaped(ST.performance_summary(stored_outcomes(spark, sf_dir)))


_FIT = (
    f"{_BF}, l AS (SELECT max(forecast_date) AS last FROM done), st AS (SELECT l.last, (SELECT x FROM cal WHERE n = (SELECT max(n) FROM cal WHERE x <= l.last) - 699) AS start FROM l),"
    " w AS (SELECT CASE WHEN current_vix < 15.57 THEN 'low_vol' WHEN current_vix < 23.36 THEN 'normal' WHEN current_vix < 31.16 THEN 'elevated' ELSE 'crisis' END AS regime, calendar_cohort, actual_vix_change - magnitude_forecast AS e, exp(-0.125::DOUBLE * ((st.last - forecast_date) / 30.0::DOUBLE)) AS w FROM done, st WHERE forecast_date >= st.start),"
    " cor AS (SELECT regime, calendar_cohort, CASE WHEN grouping(regime) = 0 AND grouping(calendar_cohort) = 0 THEN 'regime_cohort' WHEN grouping(regime) = 0 THEN 'regime' WHEN grouping(calendar_cohort) = 0 THEN 'cohort' ELSE 'global' END AS level, sum(w * e) / sum(w) AS bias, count(*) AS n FROM w GROUP BY GROUPING SETS ((regime, calendar_cohort), (regime), (calendar_cohort), ()) HAVING count(*) >= 50)"
)


def stored_outcomes(spark, sf_dir):
    """The outcome table as a stored one: calibration reads it more than once."""
    from tidegrid.queries.sourcing import fresh_folder

    path = fresh_folder(spark, "outcomes")
    outcomes(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


@query("M20 A3 J14 P22", f"WITH {_FIT} SELECT level, regime, calendar_cohort, {S.r('bias')} AS bias, n FROM cor")
def calibration_fit(spark, sf_dir):
    return shaped(CB.fit_calibration(stored_outcomes(spark, sf_dir)))


@query(
    "M21",
    f"WITH {_FIT}, x AS (SELECT f.*, CASE WHEN current_vix < 15.57 THEN 'low_vol' WHEN current_vix < 23.36 THEN 'normal' WHEN current_vix < 31.16 THEN 'elevated' ELSE 'crisis' END AS regime FROM f),"
    " j AS (SELECT x.*, (SELECT bias FROM cor WHERE level = 'regime_cohort' AND cor.regime = x.regime AND cor.calendar_cohort = x.calendar_cohort) AS rc, (SELECT bias FROM cor WHERE level = 'regime' AND cor.regime = x.regime) AS r, (SELECT bias FROM cor WHERE level = 'cohort' AND cor.calendar_cohort = x.calendar_cohort) AS c, (SELECT bias FROM cor WHERE level = 'global') AS g FROM x)"
    f" SELECT series_id, prediction_id, {rr(adjustment='coalesce(rc, r, c, g, 0)', calibrated_forecast='magnitude_forecast + coalesce(rc, r, c, g, 0)')}, CASE WHEN rc IS NOT NULL THEN 'regime_cohort' WHEN r IS NOT NULL THEN 'regime' WHEN c IS NOT NULL THEN 'cohort' WHEN g IS NOT NULL THEN 'global' ELSE 'not_fitted' END AS correction_type FROM j",
)
def calibration_apply(spark, sf_dir):
    from tidegrid.queries.sourcing import fresh_folder

    path = fresh_folder(spark, "corrections")
    CB.fit_calibration(stored_outcomes(spark, sf_dir)).write.parquet(path)
    out = CB.apply_calibration(forecasts(spark, sf_dir).drop("correction_type"), spark.read.parquet(path))
    return shaped(out, ["series_id", "prediction_id", "adjustment", "calibrated_forecast", "correction_type"])


@query("M24", f"WITH f AS ({_FC}), s AS (SELECT * FROM f WHERE day(observation_date) <= 20), m AS ({market_sql(['vix'])}) SELECT m.series_id, {S.day('m.ts')} AS ts FROM m WHERE m.ts BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND NOT EXISTS (SELECT 1 FROM s WHERE s.series_id = m.series_id AND s.observation_date = m.ts)")
def unforecast_days(spark, sf_dir):
    stored = forecasts(spark, sf_dir).filter(F.dayofmonth("observation_date") <= 20)
    return shaped(ST.days_to_forecast(market(spark, sf_dir, ["vix"]).select("series_id", "ts"), stored, ["series_id"], "ts", "1998-01-01", "1998-12-31"))
