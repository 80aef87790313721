import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import AX, frame, got, nulls, same
from tidegrid.axis import Axis
from tidegrid.functions import rolling as R
from tidegrid.functions import technical as TI
from tidegrid.operators import scan as SC

X = nulls()
Y = nulls(seed=1)
S, T = pd.Series(X), pd.Series(Y)


@pytest.fixture(scope="module")
def df(spark):
    return frame(spark, {"a": {"x": X, "y": Y}}).cache()


CASES = {
    "mean": (lambda: R.mean("x", 10, AX), lambda: S.rolling(10).mean()),
    "mean_min": (lambda: R.mean("x", 10, AX, 1), lambda: S.rolling(10, min_periods=1).mean()),
    "std": (lambda: R.std("x", 10, AX), lambda: S.rolling(10).std()),
    "sum": (lambda: R.total("x", 5, AX), lambda: S.rolling(5).sum()),
    "quantile": (lambda: R.quantile("x", 0.85, 21, AX), lambda: S.rolling(21).quantile(0.85)),
    "prior_quantile": (lambda: R.prior_quantile("x", 0.85, 21, AX, 10), lambda: S.rolling(21, min_periods=10).quantile(0.85).shift(1)),
    "skew": (lambda: R.skew("x", 21, AX), lambda: S.rolling(21).skew()),
    "kurt": (lambda: R.kurt("x", 21, AX), lambda: S.rolling(21).kurt()),
    "corr": (lambda: R.corr("x", "y", 21, AX), lambda: S.rolling(21).corr(T)),
    "diff": (lambda: R.diff("x", 5, AX), lambda: S.diff(5)),
    "pct_pad": (lambda: R.pct_change("x", 5, AX), lambda: S.ffill().pct_change(5, fill_method=None)),
    "pct_plain": (lambda: R.pct_change("x", 5, AX, pad=False), lambda: S.pct_change(5, fill_method=None)),
    "zscore": (lambda: R.zscore("x", 21, AX), lambda: (S - S.rolling(21).mean()) / S.rolling(21).std().clip(lower=1e-8)),
    "zscore_half": (lambda: R.zscore("x", 20, AX, 10, None), lambda: (S - S.rolling(20, min_periods=10).mean()) / S.rolling(20, min_periods=10).std().replace(0, np.nan)),
    "rank": (lambda: R.rank_pct("x", 21, AX), lambda: S.rolling(21).rank(pct=True)),
    "rank_any": (lambda: R.rank_pct("x", 21, AX, 1), lambda: S.rolling(21, min_periods=1).rank(pct=True)),
    "below": (lambda: R.pct_below("x", 20, AX), lambda: S.rolling(21).apply(lambda w: (w < w[-1]).sum() / len(w) * 100, raw=True)),
    "fill": (lambda: R.fill_forward("x", 1, AX), lambda: S.ffill(limit=1)),
    "full_rank": (lambda: R.full_rank_pct("x", AX), lambda: S.rank(pct=True)),
    "expanding_rank": (lambda: R.expanding_rank_pct("x", AX), lambda: S.expanding(1).rank(pct=True)),
}


@pytest.mark.parametrize("name", CASES)
def test_matches_pandas(df, name):
    ours, theirs = CASES[name]
    same(got(R.with_columns(df, {"o": ours()}), "o"), theirs().to_numpy())


def test_average_rank_on_ties(spark):
    x = nulls(ties=True)
    same(got(R.with_columns(frame(spark, {"a": {"x": x}}), {"o": R.rank_pct("x", 21, AX)}), "o"), pd.Series(x).rolling(21).rank(pct=True))


@pytest.mark.parametrize("span", [3, 12, 26])
def test_ewm_blocks_match_pandas(spark, span):
    x = nulls(700)
    d = frame(spark, {"a": {"x": x}, "b": {"x": x[::-1]}})
    out = R.ewm_means(d, {"o": ("x", span)}, AX)
    want = np.concatenate([pd.Series(v).ewm(span=span).mean() for v in (x, x[::-1])])
    same(got(out, "o"), want, 1e-8)


def test_constant_series_floor_and_null(spark):
    d = frame(spark, {"a": {"x": [5.0] * 30}})
    assert got(d.withColumn("o", R.zscore("x", 10, AX)), "o")[-1] == 0.0
    assert np.isnan(got(d.withColumn("o", R.zscore("x", 10, AX, floor=None)), "o")[-1])
    assert np.isnan(got(d.withColumn("o", R.skew("x", 10, AX)), "o")[-1])


@pytest.mark.parametrize("n", [1, 4])
def test_short_series_give_null(spark, n):
    d = frame(spark, {"a": {"x": list(range(n))}})
    d = R.with_columns(d, {"m": R.mean("x", 5, AX), "q": R.quantile("x", 0.5, 5, AX), "r": R.rank_pct("x", 5, AX), "b": R.pct_below("x", 5, AX)})
    assert d.select("m", "q", "r", "b").dropna("all").count() == 0


def _features(d):
    d = TI.macd(TI.adx(TI.rsi(d, "close", AX), AX), "close", AX)
    return R.with_columns(d, {"z": R.zscore("close", 21, AX), "k": R.pct_below("close", 10, AX), "e": R.expanding_rank_pct("close", AX)})


def test_future_rows_do_not_change_past_features(spark):
    rng = np.random.default_rng(3)
    c = rng.normal(100, 5, 150)
    d = frame(spark, {"a": {"close": c, "high": c + 2, "low": c - 2}})
    cut = d.filter("ts <= DATE '2020-04-09'")
    cols = ["rsi_14", "adx_14", "macd_signal", "z", "k", "e"]
    full = _features(d).filter("ts <= DATE '2020-04-09'")
    part = _features(cut)
    for c_ in cols:
        same(got(full, c_), got(part, c_), 1e-12)


def test_chunked_equals_whole(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", i // 50, i, float(v)) for i, v in enumerate(rng.normal(0, 1, 2000))] + [("cold", 0, i, float(i)) for i in range(7)]
    d = spark.createDataFrame(rows, "series_id string, day int, seq int, x double")
    pos = SC.number_rows(d, ["series_id"], ["day", "seq"])
    assert pos.filter("series_id = 'hot' AND _pos != seq").count() == 0
    out = SC.halo_frames(pos, ["series_id"], 30, lambda ax: {"m": R.mean("x", 31, ax)}, chunk_rows=100).filter("series_id = 'hot'").orderBy("seq").toPandas()
    same(out["m"], pd.Series([r[3] for r in rows[:2000]]).rolling(31).mean())
    run = SC.running_streak(pos.withColumn("up", F.col("x") > -1.5), ["series_id"], "up", "s", chunk_rows=100)
    run = SC.running_sum(run, ["series_id"], "x", "t", chunk_rows=100).filter("series_id = 'hot'").orderBy("seq").toPandas()
    up, k, want = run["x"] > -1.5, 0, []
    for u in up:
        k = k + 1 if u else 0
        want.append(k)
    assert run["s"].tolist() == want
    same(run["t"], run["x"].cumsum(), 1e-8)
    with pytest.raises(ValueError):
        SC.halo_frames(pos, ["series_id"], 200, lambda ax: {}, chunk_rows=100)


def test_streak_over_chunk_without_false_row(spark):
    rows = [("a", 0, i, i != 3) for i in range(40)]
    pos = SC.number_rows(spark.createDataFrame(rows, "series_id string, day int, seq int, ok boolean"), ["series_id"], ["day", "seq"])
    out = SC.running_streak(pos, ["series_id"], "ok", "s", chunk_rows=8).orderBy("seq").toPandas()["s"].tolist()
    assert out == [1, 2, 3, 0] + list(range(1, 37))


def test_ewm_of_span_one_and_after_a_long_gap(spark):
    x = np.full(900, np.nan)
    x[[0, 1, 5]] = [1.0, 2.0, 4.0]
    d = frame(spark, {"a": {"x": x}})
    out = R.ewm_means(d, {"one": ("x", 1), "o": ("x", 5)}, AX)
    same(got(out, "o"), pd.Series(x).ewm(span=5).mean())
    same(got(out, "one"), pd.Series(x).ffill())


def test_ranks_and_quantiles_of_a_long_window(spark):
    """A frame of 50,000 rows: no list per row, and all columns in one pass."""
    n, w = 60_000, 50_000
    x = np.round(np.random.default_rng(0).normal(size=n), 3)
    d = spark.createDataFrame(pd.DataFrame({"series_id": "a", "ts": np.arange(n), "x": x}))
    d = R.with_columns(d, {"r": R.rank_pct("x", w, AX, 1), "b": R.pct_below("x", w, AX, 1), "q": R.quantile("x", 0.9, w, AX, 1), "p": R.prior_rank("x", w, AX, 1), "e": R.expanding_rank_pct("x", AX)})
    assert "collect_list" not in d._jdf.queryExecution().toString() and d._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    out = d.filter("ts % 997 = 0 OR ts = 59999").orderBy("ts").toPandas()
    for r in out.itertuples():
        v = x[max(0, r.ts - w + 1) : r.ts + 1]
        less, same_ = (v < r.x).sum(), (v == r.x).sum()
        assert abs(r.r - (less + (same_ + 1) / 2) / len(v)) < 1e-12 and abs(r.q - np.quantile(v, 0.9)) < 1e-12
        v = x[max(0, r.ts - w) : r.ts + 1]
        assert abs(r.b - (v < r.x).mean() * 100) < 1e-9
        past = x[: r.ts + 1]
        assert abs(r.e - ((past < r.x).sum() + ((past == r.x).sum() + 1) / 2) / len(past)) < 1e-12


def test_growth_of_an_expanding_rank_is_linear_log():
    """Steps counted, not timed: blocks looked at and values moved per row grow with the logarithm, not the rows."""
    from tidegrid.functions import ordered

    looked = {}
    for n in (4_000, 64_000):
        w, x = ordered.OrderWindow(), np.random.default_rng(1).normal(size=n).tolist()
        for v in x:
            w.add(v)
        assert max(map(len, w.blocks)) <= w.most and [w.kth(k) for k in (0, n // 2, n - 1)] == [sorted(x)[k] for k in (0, n // 2, n - 1)]
        looked[n] = math.log2(len(w.tree)) + w.most
    assert looked[64_000] < 1.02 * looked[4_000]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=90), st.integers(1, 30))
def test_order_window_against_a_sorted_list(values, size):
    from tidegrid.functions.ordered import OrderWindow

    w, held = OrderWindow(most=4), []
    for v in map(float, values):
        w.add(v)
        held.append(v)
        if len(held) > size:
            w.remove(held.pop(0))
        s = sorted(held)
        assert [w.kth(k) for k in range(len(s))] == s
        for probe in (-5.0, v, 0.5, 5.0):
            assert w.below(probe) == sum(e < probe for e in s) and w.upto(probe) == sum(e <= probe for e in s)


def test_walked_columns_in_small_batches_and_inside_expressions(spark):
    """Series go over batch ends, several axes meet in one call, and a placeholder may stand anywhere."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = frame(spark, {"a": {"x": X, "y": Y}, "b": {"x": X[::-1], "y": Y}})
        one = F.when(R.rank_pct("x", 9, AX) > R.rank_pct("y", 9, AX), R.quantile("x + y", 0.5, 9, AX, 1)).otherwise(-R.expanding_rank_pct("y", AX))
        out = R.with_columns(d, {"o": one, "back": R.rank_pct("x", 9, Axis(("series_id",), "y"), 1)})
        assert out.columns == ["series_id", "ts", "x", "y", "o", "back"]
        out = got(out, "o")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for x in (X, X[::-1]):
        x, y = pd.Series(x), pd.Series(Y)
        up = x.rolling(9).rank(pct=True) > y.rolling(9).rank(pct=True)
        want.append(np.where(up, (x + y).rolling(9, min_periods=1).median(), -y.expanding(1).rank(pct=True)))
    same(out, np.concatenate(want))


def test_numbers_of_a_hot_day_come_from_many_tasks(spark):
    """A third of the rows on one day, half of those alike: numbers stay whole and no range holds twice the usual."""
    n = 6000
    d = spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot").alias("series_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("int").alias("day"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("seq"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = SC.number_rows(d, ["series_id"], ["day", "seq"]).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for _, x in out.groupby("series_id", dropna=False):
        x = x.sort_values("_pos")
        assert x._pos.tolist() == list(range(n // 2))
        assert x[["day", "seq"]].apply(tuple, axis=1).is_monotonic_increasing
    import glob
    import os

    from tidegrid.session import shared_dir

    newest = max(glob.glob(shared_dir(spark) + "/numbered-*"), key=os.path.getmtime)
    sizes = [len(pd.read_parquet(f)) for f in glob.glob(newest + "/*.parquet")]
    assert len(sizes) == 4 and max(sizes) < 2 * sorted(sizes)[1]


def test_numbers_by_few_series_deal_the_rows_once(spark):
    """The columns asked for alone are written, and the written rows meet their ranges without being dealt again."""
    d = spark.createDataFrame([("a" if i % 3 else None, i * 37 % 50, i, f"x{i}") for i in range(300)], "series_id string, day int, seq int, rest string")
    want = {r["seq"]: r["_pos"] for r in SC.number_rows(d, ["series_id"], ["day", "seq"]).collect()}
    got = SC.number_rows(d, ["series_id"], ["day", "seq"], keep=["series_id", "seq"], few=True)
    assert got.columns == ["series_id", "seq", "_pos"]
    assert {r["seq"]: r["_pos"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "rest" not in plan
