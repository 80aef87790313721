"""Isolation-forest ensemble: scaling, growing, scoring, thresholds and importance.

Trees follow Liu, Ting and Zhou (2008). Each tree is grown in its own task from at most 256 sampled
rows; the grown trees are a few thousand nodes whatever the data size, and score rows in Arrow
batches on the executors."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import clip, nonzero
from tidegrid.operators import ranks as RK
from tidegrid.operators.quality import screen_features
from tidegrid.session import stored

TREES, SAMPLE = 100, 256
SCORE_CAP = 0.95
# Level names and their score quantiles.
LEVELS = {"moderate": 0.85, "high": 0.92, "critical": 0.98}
#: Thresholds where there are no training scores.
DEFAULT_LEVELS = dict(zip(LEVELS, (0.70, 0.78, 0.88)))


@dataclass
class Scaler:
    center: dict[str, float]
    scale: dict[str, float]


@dataclass
class Forest:
    features: list[str]
    scaler: Scaler
    sample: int
    trees: list[dict[str, np.ndarray]] = field(repr=False)


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def scaler_table(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, q1, median, q3), exact, of all features in the same few passes. Nulls count as 0, as they do when scoring."""
    known = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    return RK.column_quantiles(known, [], features, {"q1": 0.25, "median": 0.5, "q3": 0.75}, "feature")


def fit_scaler(df: DataFrame, features: list[str]) -> Scaler:
    """Median and interquartile range per feature; a feature without spread keeps scale 1, as does any without rows."""
    found = {r["feature"]: r for r in scaler_table(df, features).collect()}  # one row per feature
    center = {c: found[c]["median"] if c in found else 0.0 for c in features}
    return Scaler(center, {c: (found[c]["q3"] - found[c]["q1"]) or 1.0 if c in found else 1.0 for c in features})


def scaled(features: list[str], scaler: Scaler) -> Column:
    return F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - scaler.center[c]) / scaler.scale[c] for c in features])


def tree_samples(df: DataFrame, id_col: str, trees: int, sample: int, seed: int, n: int) -> DataFrame:
    """(tree, row) pairs, about ``sample`` rows per tree, chosen by hashing the row id with the tree.

    Every row is offered to every tree, at any size of the table; the offers are weighed inside the row,
    so only about ``1.3 * trees * sample`` pairs are made and shuffled."""
    unit = lambda t: (F.pmod(F.xxhash64(F.col(id_col), t, F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    keep = min(1.0, 1.3 * sample / max(n, 1))
    taken = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: unit(t) <= keep)
    picked = df.withColumn("tree", F.explode(taken)).withColumn("_u", unit(F.col("tree")))
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("tree").orderBy("_u", id_col))
    return picked.withColumn("_k", first).filter(F.col("_k") <= sample).select("tree", id_col, "x")


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list, list, list, list, list]:
    feat, cut, left, right, size = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(feat)
        for store, v in ((feat, -1), (cut, 0.0), (left, -1), (right, -1), (size, len(rows))):
            store.append(v)
        if depth >= limit or len(rows) <= 1:
            return me
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if len(usable) == 0:
            return me
        f = int(rng.choice(usable))
        c = float(rng.uniform(lo[f], hi[f]))
        goes_left = part[:, f] <= c
        feat[me], cut[me] = f, c
        left[me] = node(rows[goes_left], depth + 1)
        right[me] = node(rows[~goes_left], depth + 1)
        return me

    node(np.arange(len(x)), 0)
    return feat, cut, left, right, size


def fit_forests(df: DataFrame, groups: dict[str, list[str]], id_col: str, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> dict[str, Forest]:
    """One forest per named feature group, in three passes over the rows however many groups: the
    scaler, the row count, and the samples, from which every group grows its trees side by side.
    Only tree nodes come back to the driver."""
    names = sorted(groups)
    features = sorted({f for g in groups.values() for f in g})
    at = {n: [features.index(f) for f in groups[n]] for n in names}
    scaler = fit_scaler(df, features)
    n = df.count()
    rows = df.select(id_col, scaled(features, scaler).alias("x"))
    size = min(sample, n)
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        tree, x = int(pdf["tree"].iloc[0]), np.stack(pdf["x"].to_numpy())
        out = []
        for k, name in enumerate(names):
            f, c, lt, rt, sz = _grow(x[:, at[name]], np.random.default_rng([seed, k, tree]), limit)
            out.append((name, tree, f, c, lt, rt, sz))
        return pd.DataFrame(out, columns=["name", "tree", "f", "c", "l", "r", "n"])

    schema = "name string, tree int, f array<int>, c array<double>, l array<int>, r array<int>, n array<int>"
    grown = tree_samples(rows, id_col, trees, sample, seed, n).groupBy("tree").applyInPandas(grow, schema)
    out = {k: Forest(groups[k], scaler, size, []) for k in names}
    for t in sorted(grown.collect(), key=lambda r: (r["name"], r["tree"])):  # groups x trees rows of < 2 * sample nodes
        path = np.array([average_path(k) for k in t["n"]])
        out[t["name"]].trees.append({"f": np.array(t["f"]), "c": np.array(t["c"]), "l": np.array(t["l"]), "r": np.array(t["r"]), "p": path})
    return out


def fit_forest(df: DataFrame, features: list[str], id_col: str, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> Forest:
    return fit_forests(df, {"forest": features}, id_col, trees, sample, seed)["forest"]


def path_scores(x: np.ndarray, forest: Forest) -> np.ndarray:
    """-2^(-mean path / expected path): lower is more anomalous."""
    depth = np.zeros(len(x))
    for t in forest.trees:
        at = np.zeros(len(x), dtype=np.int64)
        steps = np.zeros(len(x))
        live = t["f"][at] >= 0
        while live.any():
            idx = np.flatnonzero(live)
            f, here = t["f"][at[idx]], at[idx]
            at[idx] = np.where(x[idx, f] <= t["c"][here], t["l"][here], t["r"][here])
            steps[idx] += 1
            live[idx] = t["f"][at[idx]] >= 0
        depth += steps + t["p"][at]
    return -np.power(2.0, -depth / len(forest.trees) / max(average_path(forest.sample), 1e-12))


def score_udf(forest: Forest):
    """A column function ``scaled features -> raw score``, usable on batch and streaming frames."""

    @F.pandas_udf("double")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(path_scores(np.stack(x.to_numpy()), forest)) if len(x) else pd.Series([], dtype=float)

    return lambda: raw(scaled(forest.features, forest.scaler))


def score_rows(df: DataFrame, forest: Forest, out: str = "raw") -> DataFrame:
    return df.withColumn(out, score_udf(forest)())


def coverage_penalty(c: str | Column, least: float = 0.7) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x >= least, 1.0).otherwise(F.greatest(F.pow(x / least, 2), F.lit(0.1)))


def clip_bounds(counts: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Clip range of raw scores per detector, from their distribution: the 5 to 95 % range widened by a tenth on each side."""
    q = RK.quantiles_from_counts(counts, keys, raw, {"p5": 0.05, "p95": 0.95})
    pad = (F.col("p95") - F.col("p5")) * 0.1
    return q.select(*keys, (F.col("p5") - pad).alias("_lo"), (F.col("p95") + pad).alias("_hi"))


def calibrated_scores(train: DataFrame, rows: DataFrame, keys: list[str], raw: str = "raw", out: str = "score") -> DataFrame:
    """1 - share of training scores at or below the clipped raw score, capped at 0.95.

    The distribution of the training scores is made once and stored; the bounds, a row per detector, and the shares
    are read off it."""
    counts = stored(RK.cumulative_counts(train, keys, raw), "score_counts")
    bounds = stored(clip_bounds(counts, keys, raw), "score_bounds")
    clipped = rows.join(bounds, keys).withColumn("_v", F.greatest("_lo", F.least("_hi", F.col(raw)))).drop("_lo", "_hi")
    probes = clipped.select(*keys, F.col("_v").alias(raw))
    cdf = RK.count_at_or_below(counts, probes, keys, raw).withColumnRenamed(raw, "_v")
    scored = clipped.join(cdf, [*keys, "_v"])
    return scored.withColumn(out, clip(1.0 - F.col("at_or_below") / F.col("total"), 0.0, SCORE_CAP)).drop("_v", "at_or_below", "total")


def ensemble(long: DataFrame, ids: list[str], score: str = "score", coverage: str = "coverage") -> DataFrame:
    """Coverage-weighted mean of detector scores, with spread; detectors under half coverage are
    left out. One grouped aggregate."""
    pen = coverage_penalty(coverage)
    d = long.filter(F.col(coverage) >= 0.5).withColumns({"_adj": F.col(score) * pen, "_w": F.col(coverage) * pen})
    agg = d.groupBy(*ids).agg(
        (F.sum(F.col("_adj") * F.col("_w")) / nonzero(F.sum("_w"))).alias("_e"), F.stddev_pop("_adj").alias("score_std"), F.max("_adj").alias("max_anomaly"), F.min("_adj").alias("min_anomaly"),
        F.count(F.lit(1)).alias("n_detectors"), F.avg("_w").alias("mean_weight"),
    )
    return agg.withColumn("ensemble_score", F.least("_e", F.lit(SCORE_CAP))).drop("_e")


def score_thresholds(scores: DataFrame, score: str = "ensemble_score") -> DataFrame:
    """One row of level thresholds: exact quantiles of the training scores; none without scores."""
    return RK.exact_quantiles(RK.constant_key(scores), ["_all"], score, LEVELS).drop("_all")


def level_of(score: str | Column, moderate: Column, high: Column, critical: Column) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= critical, "CRITICAL").when(s >= high, "HIGH").when(s >= moderate, "MODERATE").otherwise("NORMAL")


def classify(scores: DataFrame, train: DataFrame, score: str = "ensemble_score") -> DataFrame:
    """Level, empirical p-value (share of training scores at or above) and confidence of any score.

    Levels fall back to fixed thresholds where there are no training scores; the p-value is null then."""
    cuts = score_thresholds(train, score)
    moderate, high, critical = (F.coalesce(cuts.select(n).scalar(), F.lit(DEFAULT_LEVELS[n])) for n in LEVELS)
    counts = RK.count_below(RK.constant_key(train), RK.constant_key(scores.select(score)), ["_all"], score)
    counts = counts.select(F.col(score).alias("_score"), "below", "total")
    out = scores.withColumn("level", level_of(score, moderate, high, critical))
    out = out.join(counts, F.col(score) == F.col("_score"), "left")
    p = (F.col("total") - F.col("below")) / nonzero("total")
    return out.withColumns({"p_value": p, "confidence": 1 - p}).drop("below", "total", "_score")


def permutation_importance(df: DataFrame, forest: Forest, id_col: str, repeats: int = 1, seed: int = 42, bucket: int = 4096) -> DataFrame:
    """Share of each feature in the mean score shift when its values are shuffled, over all rows.

    Rows fall into random buckets of about ``bucket`` rows by hashing their id; each bucket shuffles one
    feature after the other among its rows and scores them in batches. The mean shift over ``repeats``
    shuffles is a sum over buckets, so it grows with the table in tasks, not in size."""
    n = df.count()
    parts = max(1, math.ceil(n / bucket))
    rows = df.select(id_col, scaled(forest.features, forest.scaler).alias("x"), F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(parts)).alias("_part"))
    k = len(forest.features)

    def shift(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        part = int(pdf["_part"].iloc[0])
        x = np.stack(pdf["x"].to_numpy())
        base = path_scores(x, forest).sum()
        out = []
        for r in range(repeats):
            for i in range(k):
                mixed = x.copy()
                mixed[:, i] = np.random.default_rng([seed, part, r, i]).permutation(mixed[:, i])
                out.append((r, i, base - path_scores(mixed, forest).sum()))
        return pd.DataFrame(out, columns=["r", "i", "gap"])

    gaps = rows.groupBy("_part").applyInPandas(shift, "r int, i int, gap double")
    moved = gaps.groupBy("r", "i").agg(F.abs(F.sum("gap")).alias("shift")).groupBy("i").agg(F.avg("shift").alias("shift"))
    total = F.sum("shift").over(_everything())
    names = F.array(*[F.lit(f) for f in forest.features])
    imp = F.when(total > 0, F.col("shift") / nonzero(total)).otherwise(1.0 / k)
    return moved.select(names[F.col("i")].alias("feature"), imp.alias("importance"))


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # one row per feature


def random_subspaces(features: list[str], count: int = 5, low: int = 8, high: int = 14, seed: int = 42) -> dict[str, list[str]]:
    """Seeded feature subsets without replacement."""
    out = {}
    for i in range(count):
        rng = np.random.default_rng(seed + i)
        size = min(int(rng.integers(low, high + 1)), len(features))
        out[f"random_{i + 1}"] = sorted(rng.choice(sorted(features), size=size, replace=False).tolist())
    return out


def usable_features(df: DataFrame, groups: dict[str, list[str]]) -> dict[str, list[str]]:
    """Per named group, the present features that pass the quality screen; each feature is profiled once for all groups."""
    present = sorted({f for feats in groups.values() for f in feats if f in df.columns})
    if not present:
        return {n: [] for n in groups}
    good = {r["feature"] for r in screen_features(df, present).filter("status = 'valid'").collect()}  # one row per feature
    return {n: [f for f in feats if f in good] for n, feats in groups.items()}


def detector_coverage(df: DataFrame, groups: dict[str, list[str]], least: int = 3) -> DataFrame:
    """(detector, n_features, coverage, fitted) as ``fit_detectors`` takes them."""
    rows = [(n, len(fs), len(fs) / len(groups[n]), int(len(fs) >= least)) for n, fs in usable_features(df, groups).items()]
    return df.sparkSession.createDataFrame(rows, "detector string, n_features int, coverage double, fitted int")


def fit_detectors(df: DataFrame, groups: dict[str, list[str]], id_col: str, trees: int = TREES, seed: int = 42, least: int = 3) -> dict[str, tuple[Forest, float]]:
    """A forest and its feature coverage per named group. Features that are absent, constant, sparse or have too few
    values are screened out first and count against the coverage; groups with fewer than ``least`` left are skipped."""
    usable = {n: fs for n, fs in usable_features(df, groups).items() if len(fs) >= least}
    if not usable:
        return {}
    forests = fit_forests(df, usable, id_col, trees, seed=seed)
    return {n: (f, len(usable[n]) / len(groups[n])) for n, f in forests.items()}


def detector_scores(df: DataFrame, detectors: dict[str, tuple[Forest, float]], ids: list[str]) -> DataFrame:
    """Long table (ids, detector, raw, coverage): all detectors in one pass over the rows."""
    wide = df.select(*ids, *[score_udf(f)().alias(n) for n, (f, _) in detectors.items()])
    long = wide.unpivot(ids, list(detectors), "detector", "raw")
    cov = None
    for n, (_, c) in detectors.items():
        cov = F.when(F.col("detector") == n, F.lit(float(c))) if cov is None else cov.when(F.col("detector") == n, F.lit(float(c)))
    return long.withColumn("coverage", cov)
