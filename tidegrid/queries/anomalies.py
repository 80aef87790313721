"""Anomaly queries on embeddings and on a market panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import rolling as R
from tidegrid.operators import anomaly as AN
from tidegrid.operators import ranks as RK
from tidegrid.operators import sets as U
from tidegrid.queries import sqlgen as S
from tidegrid.queries.frames import AX, market, market_sql, table
from tidegrid.queries.registry import query, shaped
from tidegrid.queries.tables import rr

DIMS = 64


def vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(DIMS)])


@query("D2 D3")
def isolation_scores(spark, sf_dir):
    v = vectors(spark, sf_dir)
    forest = AN.fit_forest(v, [f"d{i}" for i in range(DIMS)], "vec_id")
    return shaped(AN.score_rows(v, forest).select("vec_id", "raw"))


def _groups():
    dims = [f"d{i}" for i in range(DIMS)]
    domain = {f"block_{k}": dims[16 * k:16 * k + 16] for k in range(3)} | {"partial": dims[48:56] + ["absent_1", "absent_2"]}
    return domain | AN.random_subspaces(dims)


@query("D3 D4 D5 D6 D7 U4")
def anomaly_ensemble(spark, sf_dir):
    v = vectors(spark, sf_dir)
    long = AN.detector_scores(v, AN.fit_detectors(v, _groups(), "vec_id"), ["vec_id"])
    from tidegrid.queries.sourcing import fresh_folder

    path = fresh_folder(spark, "raw-scores")  # the raw scores feed several passes
    long.write.parquet(path)
    stored = spark.read.parquet(path)
    return shaped(AN.ensemble(AN.calibrated_scores(stored, stored, ["detector"]), ["vec_id"]))


_DIMS_LONG = "SELECT vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings"


@query("D2", f"WITH l AS ({_DIMS_LONG}) SELECT 'd' || d AS feature, {rr(9, q1='quantile_cont(coalesce(v, 0), 0.25)', median='quantile_cont(coalesce(v, 0), 0.5)', q3='quantile_cont(coalesce(v, 0), 0.75)')} FROM l GROUP BY 1")
def exact_scaler(spark, sf_dir):
    """Centre and spread that the forests scale by."""
    return shaped(AN.scaler_table(vectors(spark, sf_dir), [f"d{i}" for i in range(DIMS)]), digits=9)


# Groups of vector parts, some of which are constant, sparse or absent.
_SCREENED = {"plain": list(range(0, 10)), "spoilt": list(range(8, 20)), "thin": [16, 17, 40], "gone": [12, 13, 70, 71]}


@query(
    "D1 D4",
    f"WITH l AS ({_DIMS_LONG}), s AS (SELECT d, CASE WHEN d IN (12, 13) THEN 0 WHEN d = 14 THEN 3.5 WHEN d = 15 THEN sign(v) WHEN d IN (16, 17) THEN CASE WHEN vec_id % 10 = 0 THEN v END ELSE v END AS v FROM l),"
    " g AS (SELECT d, count(*) AS n, count(v) AS k, count(*) FILTER (v = 0) AS z, count(DISTINCT v) AS u, stddev_samp(v) AS sd FROM s GROUP BY 1),"
    " ok AS (SELECT d FROM g WHERE z * 1.0 / n <= 0.95 AND (n - k) * 1.0 / n <= 0.8 AND sd >= 1e-6 AND NOT (u * 1.0 / k < 0.05 AND u < 3)),"
    " m AS (" + " UNION ALL ".join(f"SELECT '{name}' AS detector, unnest({parts}) AS d" for name, parts in _SCREENED.items()) + ")"
    f" SELECT detector, count(ok.d)::INT AS n_features, {S.r('count(ok.d) * 1.0 / count(*)')} AS coverage, (count(ok.d) >= 3)::INT AS fitted FROM m LEFT JOIN ok USING (d) GROUP BY 1",
)
def detector_screen(spark, sf_dir):
    """Coverage of detector groups after the feature screen."""
    v = vectors(spark, sf_dir)
    sparse = lambda c: F.when(F.col("vec_id") % 10 == 0, F.col(c))
    v = v.withColumns({"d12": F.lit(0.0), "d13": F.lit(0.0), "d14": F.lit(3.5), "d15": F.signum("d15"), "d16": sparse("d16"), "d17": sparse("d17")})
    return shaped(AN.detector_coverage(v, {n: [f"d{i}" for i in parts] for n, parts in _SCREENED.items()}))


@query("D11")
def anomaly_importance(spark, sf_dir):
    v = vectors(spark, sf_dir)
    forest = AN.fit_forest(v, [f"d{i}" for i in range(DIMS)], "vec_id")
    return shaped(AN.permutation_importance(v, forest, "vec_id"))


# Scores below come from ranks, so that calibration and thresholds can be checked in SQL.
_RAW = S.Steps(market_sql(["vix", "skew", "vvix"])).add(a=f"{S.rank_pct('vix', 63)} - 1.2", b=f"{S.rank_pct('skew', 63)} - 1.2", c=f"{S.rank_pct('vvix', 63)} - 1.2").raw(
    "SELECT series_id, ts, 'a' AS detector, a AS raw, 1.0::DOUBLE AS coverage FROM {prev} WHERE a IS NOT NULL UNION ALL SELECT series_id, ts, 'b', b, 0.6 FROM {prev} WHERE b IS NOT NULL UNION ALL SELECT series_id, ts, 'c', c, 0.4 FROM {prev} WHERE c IS NOT NULL"
).raw("SELECT *, quantile_cont(raw, 0.05) OVER (PARTITION BY detector) AS p5, quantile_cont(raw, 0.95) OVER (PARTITION BY detector) AS p95 FROM {prev}").add(v="greatest(p5 - (p95 - p5) * 0.1, least(p95 + (p95 - p5) * 0.1, raw))")
_RAW.raw(
    "SELECT p.*, least(greatest(1 - (SELECT count(*) FROM {prev} t WHERE t.detector = d.detector AND t.raw <= d.v) * 1.0 / (SELECT count(*) FROM {prev} t WHERE t.detector = d.detector), 0), 0.95) AS score FROM (SELECT DISTINCT detector, v FROM {prev}) d JOIN {prev} p ON p.detector = d.detector AND p.v = d.v"
)
_CAL_SQL = _RAW.done("SELECT * FROM {prev}")


def rank_detectors(spark, sf_dir):
    df = market(spark, sf_dir, ["vix", "skew", "vvix"])
    cols = {"a": "vix", "b": "skew", "c": "vvix"}
    df = R.with_columns(df, {n: R.rank_pct(c, 63, AX) - 1.2 for n, c in cols.items()}).select("series_id", "ts", *cols)
    long = df.unpivot(["series_id", "ts"], list(cols), "detector", "raw").filter("raw IS NOT NULL")
    return long.withColumn("coverage", F.when(F.col("detector") == "a", 1.0).when(F.col("detector") == "b", 0.6).otherwise(0.4))


@query("D5 A7 A8", f"SELECT series_id, {S.day('ts')} AS ts, detector, {S.r('score')} AS score FROM ({_CAL_SQL})")
def calibrated_detector_scores(spark, sf_dir):
    long = rank_detectors(spark, sf_dir)
    return shaped(AN.calibrated_scores(long, long, ["detector"]), ["series_id", "ts", "detector", "score"])


_ENS = (
    f"WITH cal AS ({_CAL_SQL}), p AS (SELECT *, CASE WHEN coverage >= 0.7 THEN 1 ELSE greatest(pow(coverage / 0.7::DOUBLE, 2), 0.1) END AS pen FROM cal WHERE coverage >= 0.5),"
    " e AS (SELECT series_id, ts, least(sum(score * pen * coverage * pen) / sum(coverage * pen), 0.95) AS ensemble_score, stddev_pop(score * pen) AS score_std, max(score * pen) AS max_anomaly, min(score * pen) AS min_anomaly, count(*) AS n_detectors, avg(coverage * pen) AS mean_weight FROM p GROUP BY 1, 2)"
)


@query(
    "D6 D7",
    _ENS + f" SELECT series_id, {S.day('ts')} AS ts, n_detectors, {rr(ensemble_score='ensemble_score', score_std='score_std', max_anomaly='max_anomaly', min_anomaly='min_anomaly', mean_weight='mean_weight')} FROM e",
)
def weighted_ensemble(spark, sf_dir):
    long = rank_detectors(spark, sf_dir)
    return shaped(AN.ensemble(AN.calibrated_scores(long, long, ["detector"]), ["series_id", "ts"]))


_SC = S.Steps(market_sql(["vix"])).add(score=f"round({S.rank_pct('vix', 63)}, 4)").raw("SELECT * FROM {prev} WHERE score IS NOT NULL")


def rank_scores(spark, sf_dir):
    df = R.with_columns(market(spark, sf_dir, ["vix"]), {"ensemble_score": F.round(R.rank_pct("vix", 63, AX), 4)})
    return df.filter("ensemble_score IS NOT NULL").select("series_id", "ts", "ensemble_score")


@query(
    "D8 D9",
    _SC.done(
        "SELECT p.series_id, strftime(p.ts, '%Y-%m-%d') AS ts, CASE WHEN score >= q98 THEN 'CRITICAL' WHEN score >= q92 THEN 'HIGH' WHEN score >= q85 THEN 'MODERATE' ELSE 'NORMAL' END AS level, " + rr(p_value="pv", confidence="1 - pv")
        + " FROM {prev} p, (SELECT quantile_cont(score, 0.85) AS q85, quantile_cont(score, 0.92) AS q92, quantile_cont(score, 0.98) AS q98 FROM {prev}) JOIN (SELECT d.score AS ds, (SELECT avg((t.score >= d.score)::INT) FROM {prev} t) AS pv FROM (SELECT DISTINCT score FROM {prev}) d) ON ds = score"
    ),
)
def anomaly_levels(spark, sf_dir):
    s = rank_scores(spark, sf_dir)
    return shaped(AN.classify(s, s), ["series_id", "ts", "level", "p_value", "confidence"])


_LATE = "DATE '1996-01-01'"  # scores before it are the training scores


@query(
    "D8 D9",
    S.Steps(_SC.done("SELECT *, score + 0.00003 AS shifted FROM {prev}")).done(
        f"SELECT series_id, strftime(ts, '%Y-%m-%d') AS ts, CASE WHEN shifted >= q98 THEN 'CRITICAL' WHEN shifted >= q92 THEN 'HIGH' WHEN shifted >= q85 THEN 'MODERATE' ELSE 'NORMAL' END AS level, " + rr(p_value="pv", confidence="1 - pv")
        + f" FROM (SELECT * FROM {{prev}} WHERE ts >= {_LATE}) p, (SELECT quantile_cont(score, 0.85) AS q85, quantile_cont(score, 0.92) AS q92, quantile_cont(score, 0.98) AS q98 FROM {{prev}} WHERE ts < {_LATE})"
        f" JOIN (SELECT d.s AS ds, (SELECT avg((t.score >= d.s)::INT) FROM {{prev}} t WHERE t.ts < {_LATE}) AS pv FROM (SELECT DISTINCT shifted AS s FROM {{prev}}) d) ON ds = shifted"
    ),
)
def unseen_score_levels(spark, sf_dir):
    """Later scores, none of which occurs among the earlier ones that they are judged by."""
    s = rank_scores(spark, sf_dir)
    late = s.filter(f"ts >= {_LATE}").withColumn("ensemble_score", F.col("ensemble_score") + 0.00003)
    return shaped(AN.classify(late, s.filter(f"ts < {_LATE}")), ["series_id", "ts", "level", "p_value", "confidence"])


@query(
    "O3 D7",
    f"WITH cal AS ({_CAL_SQL}), k AS (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY score DESC, detector) AS rank FROM cal) SELECT series_id, {S.day('ts')} AS ts, detector, {S.r('score')} AS score, rank FROM k WHERE rank <= 2",
)
def top_detectors(spark, sf_dir):
    long = rank_detectors(spark, sf_dir)
    return shaped(U.top_n_per_group(AN.calibrated_scores(long, long, ["detector"]).select("series_id", "ts", "detector", "score"), ["series_id", "ts"], {"score": "desc", "detector": "asc"}, 2))


@query(
    "A8 N8",
    f"SELECT l_returnflag AS g, {rr(q05='quantile_cont(l_extendedprice / 371, 0.05)', q25='quantile_cont(l_extendedprice / 371, 0.25)', median='quantile_cont(l_extendedprice / 371, 0.5)', q98='quantile_cont(l_extendedprice / 371, 0.98)')} FROM lineitem GROUP BY 1",
)
def exact_group_quantiles(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_extendedprice") / 371).alias("v"))
    return shaped(RK.exact_quantiles(li, ["g"], "v", {"q05": 0.05, "q25": 0.25, "median": 0.5, "q98": 0.98}))
