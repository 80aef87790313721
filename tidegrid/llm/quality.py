"""Quality rules: base limits and robust multivariate outliers per language and source. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import stage

#: Fixed values of the contract.
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW, MIN_WORDS, MAX_REPEAT_PCT = 5, 10, 20

DIM = 4
KEEP = 0.75  # share of a group that a minimum-covariance-determinant estimate rests on
STEPS = 6  # concentration steps; each lowers the determinant or leaves it
PRIOR = 50.0  # documents' worth of the pooled estimate that every group starts with
SHRINK = 20.0  # words of a text of average make-up that rates start with, so that short texts are not outliers by chance
RIDGE = (0.25, 0.04, 0.3, 0.5)  # variance that each statistic has besides its own: a constant one rejects nothing small
GRID = 64.0  # bins per unit of ln(1 + squared distance) in which a group's cut is found


def _chi2_cdf4(x: float) -> float:
    return 1 - math.exp(-x / 2) * (1 + x / 2)


def _chi2_cdf6(x: float) -> float:
    return 1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8)


def chi2_quantile4(p: float) -> float:
    """Quantile of chi-squared with four degrees of freedom, by bisection."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf4(mid) < p else (lo, mid)
    return lo


#: Makes the covariance of the innermost KEEP of normal data that of all of it.
CONSISTENCY = KEEP / _chi2_cdf6(chi2_quantile4(KEEP))
LIMIT = chi2_quantile4(1 - 1e-6)


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text, beside the id and ``keep``.

    A null text has none of each. ``n_repeat_words`` counts the words covered by five-word windows that
    occur twice or more in the text; windows are compared by 64-bit hash within one text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), *keep, t.alias("t"))
    own = own.withColumn("w", F.array_remove(F.split("t", BLANK_RUN, -1), ""))
    n = F.size("w")
    own = own.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.array_join("w", "")).cast("long"),
            "n_symbols": F.regexp_count("t", F.lit(SYMBOLS)).cast("long"),
            "lines": F.filter(F.split("t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0),
            "h": F.when(n >= WINDOW, F.transform(F.arrays_zip(F.slice("w", 1, n - WINDOW + 1).alias("a"), *(F.slice("w", 1 + i, n - WINDOW + 1).alias(x) for i, x in enumerate("bcde", 1))), lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop("t", "w")
    own = own.withColumns({"n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), "u": F.size(F.array_distinct("h"))}).drop("lines")
    return _repeat_words(own).drop("h", "u")


def _repeat_words(own: DataFrame) -> DataFrame:
    """Words under windows whose hash occurs again. Only texts with a repeated hash get past the count of
    distinct ones: their hashes are sorted with their positions, those with an equal neighbour go back into
    the order of the text, and each covers what the one before it doesn't."""
    s = F.when(F.col("u") < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    own = own.withColumn("s", s)
    nx, pv = F.expr("slice(s, 2, size(s))").alias("nx"), F.expr("concat(array(cast(null AS struct<x: bigint, i: int>)), slice(s, 1, size(s) - 1))").alias("pv")
    near = F.filter(F.arrays_zip("s", nx, pv), lambda z: F.coalesce(z["s"]["x"] == z["nx"]["x"], F.lit(False)) | F.coalesce(z["s"]["x"] == z["pv"]["x"], F.lit(False)))
    own = own.withColumn("at", F.array_sort(F.transform(near, lambda z: z["s"]["i"])))
    gain = F.expr(f"aggregate(transform(at, (i, k) -> least({WINDOW}, i - if(k = 0, -{WINDOW}, at[k - 1]))), 0L, (a, g) -> a + g)")
    return own.withColumn("n_repeat_words", F.coalesce(gain, F.lit(0)).cast("long")).drop("s", "at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def transformed(stats: DataFrame) -> DataFrame:
    """The four statistics as x0..x3, on scales where plain prose is near normal."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "x0": F.log(n),
            "x1": (F.col("word_chars") + 5.0 * SHRINK) / (n + SHRINK),
            "x2": F.log1p(100 * F.col("n_symbols") / (n + SHRINK)),
            "x3": F.log1p(100 * F.col("n_repeat_words") / (n + SHRINK)) + F.log1p(F.col("n_dup_lines").cast("double")),
        }
    )


_PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]
_MOMENTS = ["n", *(f"s{i}" for i in range(DIM)), *(f"q{i}{j}" for i, j in _PAIRS)]
_GROUP = ["start", "lang", "source"]


def _with_factor(params: DataFrame) -> DataFrame:
    """Cholesky factor l of the covariance c."""
    for i, j in _PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return params


def _first(rows: DataFrame) -> DataFrame:
    """Starts: 0 from medians and quartiles (a mergeable sketch; only a start), 1 from plain moments."""
    by = rows.groupBy("lang", "source").agg(*(F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(f"p{i}") for i in range(DIM)))
    spread = {f"c{i}{j}": (F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2) + RIDGE[i]) if i == j else F.lit(0.0) for i, j in _PAIRS}
    robust = by.withColumns({"start": F.lit(0)} | {f"m{i}": F.col(f"p{i}")[1] for i in range(DIM)} | spread).drop(*(f"p{i}" for i in range(DIM)))
    plain = _estimate(rows.withColumn("start", F.lit(1)).groupBy(*_GROUP).agg(*_sums()))
    return stage(_with_factor(robust).unionByName(plain), "starts")


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS)]


def _estimate(sums: DataFrame) -> DataFrame:
    """Mean and covariance of each group, drawn towards the pooled ones by PRIOR documents' worth."""
    pool = {r["start"]: r for r in sums.groupBy("start").agg(*(F.sum(c).alias(c) for c in _MOMENTS)).collect()}  # a row per start

    def pooled(f) -> Column:
        out = F.lit(0.0)
        for k, r in pool.items():
            out = F.when(F.col("start") == k, F.lit(float(f(r)))).otherwise(out)
        return out

    w = F.col("n") + PRIOR
    cols = {f"m{i}": (F.col(f"s{i}") + PRIOR * pooled(lambda r, i=i: r[f"s{i}"] / r["n"])) / w for i in range(DIM)}
    for i, j in _PAIRS:
        own = F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")
        all_ = pooled(lambda r, i=i, j=j: r[f"q{i}{j}"] / r["n"] - r[f"s{i}"] * r[f"s{j}"] / r["n"] ** 2)
        cols[f"c{i}{j}"] = (own + PRIOR * all_) / w + (RIDGE[i] if i == j else 0.0)
    return _with_factor(sums.withColumns(cols).drop(*_MOMENTS))


def _distance(rows: DataFrame) -> DataFrame:
    """d2: squared Mahalanobis distance from m under l."""
    for i in range(DIM):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIM)), F.lit(0.0)))


def _at_group(rows: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    p = params.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    return rows.join(p, rows["lang"].eqNullSafe(p["__lang"]) & rows["source"].eqNullSafe(p["__source"]), how).drop("__lang", "__source")


def _concentrate(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One step: moments of the KEEP nearest of each group. Distances are folded by bin, map-side, so a
    group of any size comes down to its bins; the bin that holds the cut is taken whole."""
    binned = _distance(_at_group(rows, params)).withColumn("bin", F.floor(GRID * F.log1p("d2")).cast("int")).groupBy(*_GROUP, "bin").agg(*_sums())
    by = Window.partitionBy(*_GROUP)
    upto = binned.withColumns({"before": F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "all": F.sum("n").over(by)})
    kept = upto.filter(F.col("before") < KEEP * F.col("all"))
    return stage(_estimate(stage(kept.groupBy(*_GROUP).agg(*(F.sum(c).alias(c) for c in _MOMENTS)), "moments")), "estimates")


def robust_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """(lang, source, m, c, l): the start whose covariance ends with the smaller determinant, per group.

    Groups are tables, never collected; a null language or source is a group of its own."""
    params = _first(rows)
    for _ in range(steps):
        params = _concentrate(rows, params)
    det = sum((F.log(f"l{i}{i}") for i in range(DIM)), F.lit(0.0))
    return params.groupBy("lang", "source").agg(F.min_by(F.struct(*(c for c in params.columns if c not in _GROUP)), F.struct(det, F.col("start"))).alias("p")).select("lang", "source", "p.*")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", limit: float = LIMIT) -> DataFrame:
    """doc_id, lang, source, the base statistics, base_failed, d2 and kept, one row per row of docs.

    A document is kept if it passes the base limits and its squared distance, under the estimates of its
    language and source, is no more than ``limit``. Estimates rest on documents that pass the base limits.
    Rows with a null id are judged like any other; no docs give no rows."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    stats = stage(transformed(base_statistics(own, "doc_id", "t", ("lang", "source"))).withColumn("base_failed", base_failed()), "statistics")
    fit = robust_estimates(stats.filter(~F.col("base_failed")).select("lang", "source", *(f"x{i}" for i in range(DIM))))
    out = _distance(_at_group(stats, fit, "left")).withColumn("d2", F.col("d2") / CONSISTENCY)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(True)))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows of docs that are kept, with their columns as they are. Rows that share an id go if one of them must."""
    bad = judge(docs, id_col, text_col, lang_col, source_col).filter(~F.col("kept")).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad"]), "left_anti")
