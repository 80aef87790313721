import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import AX, days, frame, got, same
from tidegrid.operators import aggregates as A
from tidegrid.operators import anomaly as AN
from tidegrid.operators import calibration as CB
from tidegrid.operators import decision as DC
from tidegrid.operators import models as M
from tidegrid.operators import quality as Q
from tidegrid.operators import ranks as RK
from tidegrid.operators import store as ST
from tidegrid.operators import targets as TG
from tidegrid.operators.correlation import pairwise_correlation, prune_correlated


def test_targets_and_null_policy(spark):
    x = [10.0, 11, 12, 11, 10, 9, 12, None]
    d = frame(spark, {"a": {"vix": x}})
    drop = TG.forward_targets(d, AX, horizon=2)
    same(got(drop, "target_log_vix_change"), np.log(pd.Series(x, dtype=float).shift(-2)) - np.log(pd.Series(x, dtype=float)))
    assert drop.filter("target_direction IS NULL").count() == drop.filter("target_log_vix_change IS NULL").count() > 0
    assert TG.forward_targets(d, AX, horizon=2, label_null_policy="zero").filter("target_direction IS NULL").count() == 0


def test_folds_follow_expanding_split(spark):
    d = TG.expanding_folds(frame(spark, {"a": {"x": list(range(20))}}), AX)
    assert got(d, "block").tolist() == [0] * 5 + [k for k in range(1, 6) for _ in range(3)]


def test_quality_filter_raises(spark):
    d = spark.createDataFrame([(0.1,), (0.2,), (0.9,)], "q double")
    with pytest.raises(ValueError):
        TG.quality_filter(d, "q", 0.5)
    assert TG.quality_filter(d, "q", 0.5, strategy="warn").count() == 1


def test_decision_sides_and_threshold(spark):
    rows = [(20.0, 0.9, 0.1, 0.3, -0.1), (20.0, 0.1, 0.9, 0.3, -0.2), (20.0, 0.5, 0.5, 0.01, -0.01), (20.0, 0.9, 0.1, 5.0, 0.0)]
    d = spark.createDataFrame(rows, "vix double, p_up_raw double, p_down_raw double, expansion_log double, compression_log double")
    p = DC.decide(d).toPandas()
    assert p.direction.tolist() == ["UP", "DOWN", "NO_DECISION", "UP"]
    assert p.magnitude_pct[2] == 0.0 and p.magnitude_pct[3] == 100.0
    assert abs(p.direction_confidence[0] - (0.6011 * 0.9 + 0.3989)) < 1e-12
    assert p.regime_change[3] == 1


def _forecast(spark, rows):
    d = spark.createDataFrame(rows, "prediction_id string, forecast_date date, current_vix double, magnitude_forecast double, direction_prediction string, calendar_cohort string")
    return ST.conform(d.withColumn("horizon", F.lit(5)).withColumn("k", F.lit("m")), ["k"])


def test_insert_is_idempotent_and_first_wins(spark):
    day = dt.date(2024, 1, 5)
    stored = _forecast(spark, [("p1", day, 20.0, 1.0, "UP", "c")])
    fresh = _forecast(spark, [("p2", day, 20.0, 1.0, "UP", "c"), ("p4", dt.date(2024, 1, 8), 20.0, 2.0, "UP", "c"), ("p3", dt.date(2024, 1, 8), 20.0, 1.0, "UP", "c")])
    new = ST.insert_new(stored, fresh, ["k"])
    assert [r["prediction_id"] for r in new.collect()] == ["p3"]
    assert ST.query_forecasts(stored.unionByName(new), ["k"], "2024-01-06").count() == 1
    assert new.columns == ["k"] + ST.FORECAST_SCHEMA.fieldNames()


def test_backfill_skips_and_probes(spark):
    f = _forecast(spark, [("up", dt.date(2024, 1, 5), 20.0, 5.0, "UP", "c"), ("skip", dt.date(2024, 1, 8), 20.0, 5.0, "NO_DECISION", "c"), ("late", dt.date(2024, 1, 10), 20.0, 5.0, "DOWN", "c"), ("none", dt.date(2024, 3, 1), 20.0, 5.0, "UP", "c")])
    lv = spark.createDataFrame([("m", dt.date(2024, 1, 12), 22.0), ("m", dt.date(2024, 1, 20), 18.0)], "k string, ts date, vix double")
    out = {r["prediction_id"]: r for r in ST.backfill_outcomes(f, lv, ["k"], "vix").collect()}
    assert set(out) == {"up", "late"}
    assert out["up"]["direction_correct"] == 1 and abs(out["up"]["actual_vix_change"] - 10.0) < 1e-9 and abs(out["up"]["magnitude_error"] - 5.0) < 1e-9
    assert out["late"]["actual_direction"] == 0 and out["late"]["direction_correct"] == 1


def test_calibration_falls_back_by_level(spark):
    rows = [(f"p{i}", days(200)[i], 12.0 if i % 2 else 20.0, 1.0, "UP", "c1" if i % 20 else "rare") for i in range(200)]
    f = _forecast(spark, rows).withColumn("actual_vix_change", F.when(F.col("current_vix") < 15, 3.0).otherwise(2.0))
    cor = CB.fit_calibration(f, min_samples=20)
    probe = _forecast(spark, [("a", dt.date(2024, 1, 5), 12.0, 1.0, "UP", "c1"), ("b", dt.date(2024, 1, 5), 12.0, 1.0, "UP", "rare"), ("c", dt.date(2024, 1, 5), 50.0, 1.0, "UP", "c1"), ("d", dt.date(2024, 1, 5), 50.0, 1.0, "UP", "x")]).drop("correction_type")
    out = {r["prediction_id"]: (r["correction_type"], round(r["calibrated_forecast"], 6)) for r in CB.apply_calibration(probe, cor).collect()}
    assert out["a"] == ("regime_cohort", 3.0) and out["b"] == ("regime", 3.0) and out["c"][0] == "cohort" and out["d"][0] == "global"
    assert CB.fit_calibration(f, min_samples=500).count() == 0


def test_row_quality_and_screen(spark):
    d = spark.createDataFrame([(1.0, None, 0.0), (None, 2.0, 0.0)], "vix double, skew double, z double")
    q = d.select(Q.feature_quality(d, ["vix", "absent"], ["skew"], ["opt"]).alias("q")).toPandas()["q"].tolist()
    assert q == [(1 + 0 + 0.5 + 0.9) / 4, (0 + 0 + 1 + 0.9) / 4]
    s = {r["feature"]: r["status"] for r in Q.screen_features(d, ["vix", "skew", "z"], ["gone"]).collect()}
    assert s["z"] == "constant_zero" and s["gone"] == "missing"


def test_exact_quantiles_with_hot_value(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(0, 1, 3000), np.zeros(2000)])
    d = spark.createDataFrame([("g", float(x)) for x in v], "g string, x double")
    r = RK.exact_quantiles(d, ["g"], "x", {"a": 0.05, "b": 0.5, "c": 0.93}).first()
    same([r["a"], r["b"], r["c"]], np.quantile(v, [0.05, 0.5, 0.93]), 1e-12)
    probes = spark.createDataFrame([("g", -9.0), ("g", 0.0), ("g", 9.0)], "g string, x double")
    c = {r["x"]: r["at_or_below"] for r in RK.count_at_or_below(d, probes, ["g"], "x").collect()}
    assert c == {-9.0: 0, 0.0: int((v <= 0).sum()), 9.0: len(v)}


def test_candidates_read_off_their_steps(spark):
    """2,000 candidates in a hundred sets of weights score as each would by itself."""
    rng = np.random.default_rng(8)
    rows = [(float(a), float(b), float(c), float(e), x) for a, b, c, e, x in zip(rng.random(300), rng.random(300), rng.normal(0, 0.2, 300), rng.normal(0, 0.2, 300), rng.choice(["UP", "DOWN", None], 300))]
    d = spark.createDataFrame([*rows, (None, 0.5, 0.1, 0.1, "UP")], "p_up_raw double, p_down_raw double, expansion_log double, compression_log double, actual string")
    rules = DC.candidate_rules(ranges={"threshold": (0.3, 0.9)})
    assert len(set(rules)) == 2000
    some = [rules[k] for k in (0, 19, 20, 777, 1234, 1999)] + [DC.DecisionRule(), DC.DecisionRule(threshold=0.5)]
    got_ = DC.score_candidates(d, some).toPandas().set_index("candidate").sort_index()
    assert got_.index.tolist() == list(range(len(some)))
    for i, rule in enumerate(some):
        want = A.direction_scores(DC.decide(d, rule, level=None).withColumn("k", F.lit(1)), ["k"], "direction", "actual", "direction_confidence", "magnitude_pct").toPandas().iloc[0].drop("k")
        same(got_.loc[i, want.index].astype(float), want.astype(float), 1e-12)
    whole = DC.score_candidates(d, rules)
    assert whole.count() == 2000


def test_ordered_bits_order_as_doubles_do(spark):
    x = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 1.0000000000000002, 0.9999999999999999, 2.0, 1.9999999999999998, 3.0, 1e308, -1e308, 1.7976931348623157e308, float("inf"), float("-inf"), 1e-300, 1024.0, 1023.9999999999999]
    x += np.random.default_rng(3).normal(0, 1, 300).tolist() + (10.0 ** np.random.default_rng(4).uniform(-300, 300, 300)).tolist() + (2.0 ** np.arange(-1074, 1024)).tolist() + np.nextafter(2.0 ** np.arange(-1000, 1000), 0).tolist()
    rows = spark.createDataFrame([(v,) for v in x], "v double").select("v", RK.ordered_bits("v").alias("b")).collect()
    by_bits = sorted(rows, key=lambda r: r["b"])
    assert [r["v"] for r in by_bits] == sorted(x) and len({r["b"] for r in rows}) == len(set(x))


def test_quantiles_of_many_columns_and_levels(spark):
    rng = np.random.default_rng(5)
    n = 4000
    p = pd.DataFrame({"g": rng.choice(["a", "b"], n), "h": rng.choice(["x", None], n), "u": rng.normal(1000, 0.01, n), "v": np.where(rng.random(n) < 0.4, 7.0, rng.lognormal(0, 20, n)), "w": np.nan})
    p.loc[:9, "u"] = np.nan
    d = spark.createDataFrame(p.astype(object).where(p.notna(), None), "g string, h string, u double, v double, w double")
    qs = {"a": 0.0, "b": 0.123, "c": 0.5, "d": 1.0}
    got_ = {(r["g"], r["column"]): [r[k] for k in qs] for r in RK.column_quantiles(d, ["g"], ["u", "v", "w"], qs).collect()}
    assert set(got_) == {(g, c) for g in "ab" for c in "uv"}
    for (g, c), v in got_.items():
        same(v, np.quantile(p[p.g == g][c].dropna(), list(qs.values())), 1e-12)
    agg = d.groupBy("g", "h").count().withColumn("_level", F.lit(2)).unionByName(d.groupBy("g").count().withColumns({"h": F.lit(None).cast("string"), "_level": F.lit(1)}))
    out = RK.attach_rollup_quantiles(agg, d, ["g", "h"], "v", {"m": 0.5}).toPandas()
    want = [*p.fillna({"h": "-"}).groupby(["g", "h"]).v.median(), *p.groupby("g").v.median()]
    same(sorted(out.m), sorted(want), 1e-12)


def _cloud(spark, parts):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (400, 3))
    x[0] = 12.0
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double").repartition(parts)


def test_detectors_learn_from_screened_features(spark):
    d = _cloud(spark, 3).withColumns({"zero": F.lit(0.0), "flat": F.lit(2.0), "thin": F.when(F.col("id") < 20, F.col("a"))})
    groups = {"all": ["a", "b", "c", "zero", "flat", "thin", "absent"], "poor": ["a", "b", "zero", "flat"], "none": ["absent"]}
    got_ = AN.fit_detectors(d, groups, "id", trees=5)
    assert list(got_) == ["all"] and got_["all"][0].features == ["a", "b", "c"] and abs(got_["all"][1] - 3 / 7) < 1e-12
    cov = {r["detector"]: (r["n_features"], r["fitted"]) for r in AN.detector_coverage(d, groups).collect()}
    assert cov == {"all": (3, 1), "poor": (2, 0), "none": (0, 0)}
    assert AN.fit_detectors(d, {"none": ["absent"]}, "id") == {}


def test_quality_filter_levels(spark):
    d = spark.createDataFrame([(0.9,), (0.9,), (0.8,), (0.6,), (None,)], "q double")
    assert [(r["threshold"], r["verdict"]) for r in TG.quality_loss(d, "q", [0.0, 0.7, 0.85]).orderBy("threshold").collect()] == [(0.0, "ok"), (0.7, "warn"), (0.85, "error")]
    assert TG.quality_filter(d, "q", 0.0).count() == 4
    with pytest.warns(UserWarning):
        assert TG.quality_filter(d, "q", 0.7).count() == 3
    with pytest.warns(UserWarning):
        assert TG.quality_filter(d, "q", 0.85, strategy="warn").count() == 2
    with pytest.raises(ValueError):
        TG.quality_filter(d, "q", 0.85)


def test_forest_finds_outlier_and_ignores_partitioning(spark):
    scores = []
    for parts in (2, 5):
        d = _cloud(spark, parts)
        f = AN.fit_forest(d, ["a", "b", "c"], "id", trees=30, sample=64)
        p = AN.score_rows(d, f).select("id", "raw").toPandas().sort_values("id")
        assert p.loc[p.raw.idxmin(), "id"] == 0
        scores.append(p.raw.to_numpy())
    same(*scores, 1e-12)


def test_ensemble_levels(spark):
    d = spark.createDataFrame([(i, "x", i / 100, 1.0) for i in range(101)] + [(i, "y", i / 100, 0.35) for i in range(101)], "id int, detector string, score double, coverage double")
    e = AN.ensemble(d, ["id"])
    assert e.filter("n_detectors != 1").count() == 0 and e.agg(F.max("ensemble_score")).first()[0] == 0.95
    lv = AN.classify(e, e).groupBy("level").count().toPandas().set_index("level")["count"].to_dict()
    assert lv["CRITICAL"] >= 2 and lv["NORMAL"] == 85


def test_pairwise_correlation_matches_pandas(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame(rng.normal(1e4, 1, (300, 3)), columns=["a", "b", "c"])
    p["c"] = p["a"] + rng.normal(0, 0.1, 300)
    p.loc[::7, "b"] = np.nan
    d = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in p.to_numpy()], "a double, b double, c double").repartition(3)
    want = p.corr().abs()
    for r in pairwise_correlation(d, ["a", "b", "c"]).collect():
        assert abs(r["corr"] - want.loc[r["a"], r["b"]]) < 1e-8


def test_pruning_order():
    imp = {"a": 0.5, "b": 0.3, "c": 0.3, "d": 0.1}
    assert prune_correlated([("a", "b", 0.99), ("b", "c", 0.95), ("c", "d", 0.92)], imp, 0.9) == {"b", "d"}
    assert prune_correlated([("b", "c", 0.95)], imp, 0.9) == {"c"}
    assert prune_correlated([("a", "b", 0.5)], imp, 0.9) == set()


def test_auc_and_scores(spark):
    rows = [(0.9, 1), (0.8, 1), (0.7, 0), (0.4, 1), (0.4, 0), (0.1, 0)]
    d = spark.createDataFrame([(1, p, y) for p, y in rows], "g int, p double, y int")
    r = A.binary_scores(d, ["g"], "p", "y").first()
    assert abs(r["auc"] - 7.5 / 9) < 1e-12 and abs(r["precision"] - 2 / 3) < 1e-12 and abs(r["recall"] - 2 / 3) < 1e-12


def test_forecaster_learns_and_reloads(spark, tmp_path):
    rng = np.random.default_rng(2)
    f1 = rng.normal(0, 1, 400)
    rows = [(float(a), float(rng.normal()), float(0.1 * a), int(a > 0)) for a in f1]
    d = spark.createDataFrame(rows, "f1 double, f2 double, target_log_vix_change double, target_direction int")
    small = {k: {"maxIter": 3, "maxDepth": 2} for k in M.DOMAINS}
    m = M.Forecaster.fit(d, {k: ["f1", "f2"] for k in M.DOMAINS}, small)
    s = m.score(d)
    assert s.columns == d.columns + ["p_up_raw", "p_down_raw", "expansion_log", "compression_log"]
    acc = s.select(F.avg(((F.col("p_up_raw") > F.col("p_down_raw")).cast("int") == F.col("target_direction")).cast("double"))).first()[0]
    assert acc > 0.95
    m.save(str(tmp_path / "m"))
    again = M.Forecaster.load(str(tmp_path / "m"), m.features).score(d)
    same(s.orderBy("f1").toPandas()["p_up_raw"], again.orderBy("f1").toPandas()["p_up_raw"])


def test_p_values_of_unseen_scores(spark):
    train = spark.createDataFrame([(i / 100,) for i in range(100)], "ensemble_score double")
    fresh = spark.createDataFrame([(0.505,), (1.5,), (-1.0,), (0.5,), (None,)], "ensemble_score double")
    got = {r["ensemble_score"]: r["p_value"] for r in AN.classify(fresh, train).collect()}
    assert {k: round(v, 9) for k, v in got.items() if k is not None} == {0.505: 0.49, 1.5: 0.0, -1.0: 1.0, 0.5: 0.5} and got[None] is None
    assert [r["level"] for r in AN.classify(spark.createDataFrame([(0.71,)], "ensemble_score double"), train.limit(0)).collect()] == ["MODERATE"]


def test_tree_samples_go_alike_at_any_size(spark):
    from pyspark.sql import functions as F

    for n in (1000, 100_000):
        df = spark.range(n).withColumnRenamed("id", "k").withColumn("x", F.array(F.lit(0.0)))
        per = AN.tree_samples(df, "k", 20, 64, 1, n).groupBy("tree").count().toPandas()["count"]
        assert len(per) == 20 and per.between(50, 64).all()


def test_importance_uses_all_rows(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 3))
    v[:30, 0] += 8
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "id long, a double, b double, c double")
    forest = AN.fit_forest(d, ["a", "b", "c"], "id", trees=20)
    imp = {r["feature"]: r["importance"] for r in AN.permutation_importance(d, forest, "id", repeats=2, bucket=500).collect()}
    assert set(imp) == {"a", "b", "c"} and abs(sum(imp.values()) - 1) < 1e-9
