"""Feature selection and the four-model direction and size forecaster, on Spark ML."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import clip, finite
from tidegrid.operators.aggregates import binary_scores
from tidegrid.operators.correlation import pairwise_correlation, prune_correlated
from tidegrid.operators.targets import domain_rows

DOMAINS = ("expansion", "compression", "up", "down")
# How many features each model keeps, and the correlation limit.
TOP_N = {"expansion": 35, "compression": 42, "up": 30, "down": 31}
CORRELATION_LIMIT = 0.90
# Tree settings per model, as far as Spark's boosted trees have them.
TREE_SETTINGS = {
    "expansion": {"maxDepth": 3, "stepSize": 0.0324, "maxIter": 333, "subsamplingRate": 0.7978, "minInstancesPerNode": 10},
    "compression": {"maxDepth": 6, "stepSize": 0.0485, "maxIter": 814, "subsamplingRate": 0.8100, "minInstancesPerNode": 7},
    "up": {"maxDepth": 4, "stepSize": 0.0407, "maxIter": 222, "subsamplingRate": 0.8815, "minInstancesPerNode": 15},
    "down": {"maxDepth": 4, "stepSize": 0.0538, "maxIter": 248, "subsamplingRate": 0.7543, "minInstancesPerNode": 13},
    "selection": {"maxDepth": 4, "stepSize": 0.05, "maxIter": 200, "subsamplingRate": 0.85},
}


def _clean(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing features count as 0, the policy the reference applies when scoring."""
    return df.withColumns({c: finite(F.col(c).cast("double"), 0.0) for c in features})


def _pipeline(features: list[str], classifier: bool, settings: dict, weight: str | None, seed: int) -> Pipeline:
    algo = GBTClassifier if classifier else GBTRegressor
    model = algo(featuresCol="_x", labelCol="label", seed=seed, **settings)
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), model])


def fold_importance(df: DataFrame, features: list[str], domain: str, folds: int = 5, settings: dict | None = None, seed: int = 42) -> dict[str, float]:
    """Mean boosted-tree importance over expanding folds. ``df`` has targets and a ``block`` column
    from ``targets.expanding_folds``; fold k trains on the blocks before k."""
    rows = _clean(domain_rows(df, domain).select("label", "block", *features), features).persist()
    classifier = domain in ("up", "down")
    total = dict.fromkeys(features, 0.0)
    try:
        for k in range(1, folds + 1):
            fitted = _pipeline(features, classifier, settings or TREE_SETTINGS["selection"], None, seed).fit(rows.filter(F.col("block") < k))
            for name, v in zip(features, fitted.stages[-1].featureImportances.toArray()):
                total[name] += float(v) / folds
    finally:
        rows.unpersist()
    return total


@dataclass
class Selection:
    domain: str
    features: list[str]
    removed: list[str]
    importance: dict[str, float]


def select_features(df: DataFrame, features: list[str], domain: str, top_n: int | None = None, threshold: float = CORRELATION_LIMIT, settings: dict | None = None, seed: int = 42) -> Selection:
    """Rank by importance, take half again as many as wanted, drop the weaker of each strongly
    correlated pair (measured on the given rows, so pass training rows only), keep the best."""
    top_n = top_n or TOP_N[domain]
    imp = fold_importance(df, sorted(features), domain, settings=settings, seed=seed)
    ranked = sorted(imp, key=lambda f: (-imp[f], f))
    candidates = ranked[: int(top_n * 1.5)]
    pairs = pairwise_correlation(df, candidates).filter(F.col("corr") > threshold).collect()  # at most candidates squared
    gone = prune_correlated([(p["a"], p["b"], p["corr"]) for p in pairs], imp, threshold)
    return Selection(domain, [f for f in candidates if f not in gone][:top_n], sorted(gone), imp)


@dataclass
class Forecaster:
    """Size of up moves, size of down moves, chance of up, chance of down."""

    features: dict[str, list[str]]
    models: dict[str, PipelineModel]

    @classmethod
    def fit(cls, train: DataFrame, features: dict[str, list[str]], settings: dict[str, dict] | None = None, weight: str | None = None, seed: int = 42, parallelism: int = 2) -> "Forecaster":
        """``train`` carries targets; the regressors learn from their own side's rows only."""
        settings = settings or TREE_SETTINGS

        def one(domain: str) -> tuple[str, PipelineModel]:
            rows = _clean(domain_rows(train, domain), features[domain])
            return domain, _pipeline(features[domain], domain in ("up", "down"), settings[domain], weight, seed).fit(rows)

        with ThreadPoolExecutor(parallelism) as pool:
            return cls(features, dict(pool.map(one, DOMAINS)))

    def score(self, df: DataFrame) -> DataFrame:
        """Adds p_up_raw, p_down_raw, expansion_log and compression_log."""
        names = sorted({f for fs in self.features.values() for f in fs})
        kept = df.columns
        out = df.withColumns({f"_keep_{n}": F.col(n) for n in names})
        out = _clean(out, names)
        for domain, col in (("up", "p_up_raw"), ("down", "p_down_raw"), ("expansion", "expansion_log"), ("compression", "compression_log")):
            out = self.models[domain].transform(out)
            if domain in ("up", "down"):
                out = out.withColumn(col, vector_to_array("probability")[1]).drop("rawPrediction", "probability")
            else:
                out = out.withColumn(col, clip("prediction", -2, 2))
            out = out.drop("_x", "prediction")
        back = [F.col(f"_keep_{c}").alias(c) if c in names else F.col(c) for c in kept]
        return out.select(*back, "p_up_raw", "p_down_raw", "expansion_log", "compression_log")

    def save(self, path: str) -> None:
        for d, m in self.models.items():
            m.write().overwrite().save(f"{path}/{d}")

    @classmethod
    def load(cls, path: str, features: dict[str, list[str]]) -> "Forecaster":
        return cls(features, {d: PipelineModel.load(f"{path}/{d}") for d in DOMAINS})


def regression_report(scored: DataFrame, by: list[str]) -> DataFrame:
    """Log and percent errors of the two regressors on their own side's rows."""
    own = F.when(F.col("target_direction") == 1, F.col("expansion_log")).otherwise(F.col("compression_log"))
    e = F.col("_own") - F.col("target_log_vix_change")
    pe = (F.exp("_own") - F.exp("target_log_vix_change")) * 100
    rows = scored.filter(F.col("target_log_vix_change").isNotNull()).withColumn("_own", own)
    return rows.groupBy(*by, "target_direction").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae_log"), F.sqrt(F.avg(e * e)).alias("rmse_log"), F.avg(F.abs(pe)).alias("mae_pct"), F.avg(pe).alias("bias_pct"),
    )


def refit_search(df: DataFrame, features: list[str], candidates: list[dict], domain: str = "up", split: str = "split", parallelism: int = 2, seed: int = 42) -> DataFrame:
    """One fit per settings row, scored by validation accuracy less half of any train lead over it
    beyond ten points. Fits run on the cluster, a few at a time."""
    rows = _clean(domain_rows(df, domain).select("label", split, *features), features).persist()

    def one(item: tuple[int, dict]) -> tuple:
        i, settings = item
        fitted = _pipeline(features, True, settings, None, seed).fit(rows.filter(F.col(split) == "train"))
        acc = fitted.transform(rows).groupBy(split).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a"))
        got = {r[split]: r["a"] for r in acc.collect()}  # one row per split
        tr, va = float(got.get("train", 0.0)), float(got.get("val", 0.0))
        return i, tr, va, va - max(0.0, (tr - va - 0.10) * 0.5)

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            out = list(pool.map(one, enumerate(candidates)))
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(out, "candidate int, train_accuracy double, val_accuracy double, score double")


def exceedance_classifier(df: DataFrame, features: list[str], label: str, ts: str, share: float = 0.8) -> tuple[PipelineModel, DataFrame]:
    """Scaled logistic regression on the first ``share`` of the days, with scores on the rest."""
    days = df.select(ts).distinct()  # one row per calendar day
    cut = days.agg(F.percentile(F.datediff(ts, F.lit("1970-01-01")), F.lit(share)).alias("c")).first()["c"]
    day = F.datediff(ts, F.lit("1970-01-01"))
    rows = _clean(df.filter(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double")), features)
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol="label"),
    ])
    model = pipe.fit(rows.filter(day <= cut))
    test = model.transform(rows.filter(day > cut)).withColumn("p", vector_to_array("probability")[1])
    return model, binary_scores(test.withColumn("_all", F.lit(1)), ["_all"], "p", "label").drop("_all")
