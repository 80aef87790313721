"""Model queries: selection, training, search. Outcomes of boosted trees have no SQL equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import rolling as R
from tidegrid.operators import decision as DC
from tidegrid.operators import models as M
from tidegrid.operators import targets as TG
from tidegrid.operators.aggregates import direction_scores
from tidegrid.plans import price as PR
from tidegrid.queries.frames import AX, market
from tidegrid.queries.registry import query, shaped
from tidegrid.queries.sourcing import fresh_folder

FEATURES = [
    "vix_velocity_5d", "vix_velocity_10d", "vix_velocity_21d", "vix_zscore_21d", "vix_zscore_63d", "vix_vs_ma10", "vix_vs_ma21", "vix_vs_ma63", "vix_stretch_ma21", "vix_bb_position_20d",
    "vix_vol_10d", "vix_vol_21d", "vix_accel_5d", "vix_momentum_z_10d", "skew", "vvix",
]
SMALL = {"maxDepth": 3, "maxIter": 5, "stepSize": 0.1}


def training_frame(spark, sf_dir):
    df = PR.level_features(market(spark, sf_dir, ["vix", "skew", "vvix"]), AX)
    df = TG.expanding_folds(TG.forward_targets(df, AX), AX).withColumn("split", TG.time_split("ts", "1999-12-31", "2000-12-31"))
    path = fresh_folder(spark, "training")
    df.select("series_id", "ts", "vix", "block", "split", "target_log_vix_change", "target_direction", *FEATURES).write.parquet(path)
    return spark.read.parquet(path)


@query("M4 M7 M8 O2")
def feature_selection(spark, sf_dir):
    s = M.select_features(training_frame(spark, sf_dir).filter("split <> 'test'"), FEATURES, "up", top_n=8, settings=SMALL)
    rows = [(i + 1, f, float(s.importance[f])) for i, f in enumerate(s.features)]
    return shaped(spark.createDataFrame(rows, "rank int, feature string, importance double"))


@query("M9 M10 M12")
def forecaster_scorecard(spark, sf_dir):
    df = training_frame(spark, sf_dir)
    model = M.Forecaster.fit(df.filter("split = 'train'"), {d: FEATURES for d in M.DOMAINS}, {d: SMALL for d in M.DOMAINS})
    scored = DC.decide(model.score(df.filter("target_log_vix_change IS NOT NULL")), DC.DecisionRule(threshold=0.55))
    scored = scored.withColumn("actual", F.when(F.col("target_direction") == 1, "UP").otherwise("DOWN"))
    return shaped(direction_scores(scored, ["series_id", "split"], "direction", "actual", "direction_confidence", "magnitude_pct"))


@query("M25 M14")
def classifier_refit_search(spark, sf_dir):
    grid = [{"maxDepth": d, "maxIter": n, "stepSize": 0.1} for d in (2, 4) for n in (3, 6)]
    return shaped(M.refit_search(training_frame(spark, sf_dir), FEATURES, grid))


@query("M22")
def volatility_exceedance(spark, sf_dir):
    df = market(spark, sf_dir, ["vix", "vvix", "skew"]).withColumn("ret", R.pct_change("close", 1, AX))
    df = df.withColumns({"rv21": R.realized_vol("ret", 21, AX), "m21": R.mean("vix", 21, AX)})
    df = df.withColumn("next", R.lead("rv21", 5, AX)).withColumn("exceeds", (F.col("next") > F.col("rv21")).cast("int"))
    _, scores = M.exceedance_classifier(df, ["vix", "vvix", "skew", "rv21", "m21"], "exceeds", "ts")
    return shaped(scores)


@query("M15 A16")
def selection_stability(spark, sf_dir):
    from tidegrid.operators.aggregates import feature_frequency

    df = training_frame(spark, sf_dir).filter("split <> 'test'")
    picks = []
    for run in range(2):
        s = M.select_features(df, FEATURES, "expansion", top_n=6, settings={**SMALL, "maxIter": 3, "subsamplingRate": 0.8}, seed=run)
        picks += [(run, f) for f in s.features]
    return shaped(feature_frequency(spark.createDataFrame(picks, "run int, feature string"), 2))
