import numpy as np
from pyspark.sql import functions as F

from helpers import AX, frame, got, same
from tidegrid.plans import assembly as AS
from tidegrid.plans import gates as GT
from tidegrid.plans import macro as MA
from tidegrid.plans import price as PR
from tidegrid.plans import regimes as RG
from tidegrid.plans.draft import together


def market(spark, n=80):
    rng = np.random.default_rng(5)
    c = 100 + rng.normal(0, 1, n).cumsum()
    return frame(spark, {"a": {"vix": 20 + rng.normal(0, 5, n), "open": c - 0.5, "high": c + 1, "low": c - 1, "close": c}})


def test_merged_stages_equal_packs_in_sequence(spark):
    d = market(spark)
    packs = [lambda x: PR.price_features(PR.level_features(x, AX), AX), lambda x: PR.candle_features(x, AX), lambda x: RG.regime_pack(x, AX)]
    one, seq = together(d, packs), d
    for p in packs:
        seq = p(seq)
    cols = [c for c in one.columns if c not in ("series_id", "ts")]
    assert not [c for c in one.columns if c.startswith("_")] and len(cols) > 80
    some = ["vix_zscore_21d", "spx_realized_vol_21d", "macd_signal", "adx_14", "rsi_14", "spx_range_expansion", "days_in_regime", "vix_bb_position_20d"]
    a, b = (x.orderBy("ts").select(*some).toPandas() for x in (one, seq))
    for c in some:
        same(a[c], b[c], 1e-12)


def test_missing_inputs_are_not_planned(spark):
    out = AS.market_features(market(spark), AX)
    assert "vix_term_curvature" not in out.columns and "vix_vel_spx_rv_ratio" in out.columns
    assert MA.yields(market(spark), AX).columns == market(spark).columns


def test_feature_matrix_has_quality_and_events(spark):
    meetings = spark.createDataFrame([("2020-01-29",)], "d string").select(F.col("d").cast("date").alias("event_date"))
    out = AS.feature_matrix(market(spark, 40), AX, meetings)
    rows = out.select("ts", "calendar_cohort", "fomc_proximity", "vix_vel_x_fomc_prox", "vix_velocity_5d", "feature_quality").collect()
    row = next(r for r in rows if str(r["ts"]) == "2020-01-28")
    assert row["calendar_cohort"] == "fomc_period" and abs(row["fomc_proximity"] - (1 - 1 / 14)) < 1e-12
    assert abs(row["vix_vel_x_fomc_prox"] - row["vix_velocity_5d"] * row["fomc_proximity"]) < 1e-12
    assert all(0 <= r["feature_quality"] <= 1 for r in rows)


def test_regime_change_and_age(spark):
    d = RG.regime_pack(frame(spark, {"a": {"vix": [10, 11, 20, 21, 10]}}), AX)
    assert got(d, "days_in_regime").tolist() == [1, 2, 1, 2, 1]
    assert got(d, "regime_change_flag").tolist() == [0, 0, 1, 0, 1]
    same(got(d, "time_in_regime_pct"), [1 / 3, 2 / 3, 0.5, 1.0, 1 / 3])


def test_verdict_fails_on_unknown_condition(spark):
    d = spark.createDataFrame([(True, True), (True, None), (True, False)], "a boolean, b boolean")
    out = d.select(GT.gate_verdict({"a": F.col("a"), "b": F.col("b")}).alias("v")).toPandas()["v"].tolist()
    assert out == [True, False, False]


def test_premium_score_bands(spark):
    d = spark.createDataFrame([(-2.5, 40, 110.0, 100.0, 100.0, 100.0, 20.0, 25.0, 80.0), (0.5, 0, 90.0, 100.0, 100.0, 100.0, 40.0, 30.0, 130.0)], "sp double, streak int, c double, m20 double, m50 double, m200 double, vix double, v3 double, vv double")
    p = d.select(*[e.alias(n) for n, e in GT.premium_score("sp", "streak", "c", "m20", "m50", "m200", "vix", "v3", "vv").items()]).toPandas()
    assert p.score.tolist() == [100, 0] and p.rating.tolist() == ["EXCELLENT", "AVOID"]
    assert p.curve_points.tolist() == [30, -10] and p.term_points.tolist() == [10, 0]
