import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import dates as D
from tidegrid.functions import scalar as X
from tidegrid.operators import calendar as C
from tidegrid.plans import regimes as RG


def values(spark, xs, **exprs):
    d = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], "i int, x double")
    out = d.select("i", *[e.alias(n) for n, e in exprs.items()]).orderBy("i").toPandas()
    return {n: [None if pd.isna(v) else v for v in out[n]] for n in exprs}


def test_bin_closure_on_edges(spark):
    xs = [0, 15.57, 15.58, 23.36, 31.16, 100, 101, -1, None]
    v = values(spark, xs, right=RG.level_regime("x"), left=RG.level_regime("x", "left"), open_=X.cut("x", [0, 15.57, 100]))
    assert v["right"] == [0, 0, 1, 1, 2, 3, None, None, None]
    assert v["left"] == [0, 1, 1, 2, 3, 3, 3, 0, None]
    assert v["open_"][:3] == [None, 0, 1]


def test_known_regimes(spark):
    assert values(spark, [12, 20, 30, 45], r=RG.level_regime("x"))["r"] == [0, 1, 2, 3]


def test_clip_keeps_null_and_division_guards(spark):
    v = values(spark, [None, -5, 50], c=X.clip("x", 0, 10), z=X.ratio(F.lit(1.0), "x"))
    assert v["c"] == [None, 0, 10]
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 0.0), (3.0, 1.0), (4.0, -2.0)], "n double, d double")
    filled = d.select(X.safe_divide("n", "d", fill=0).alias("v"), X.safe_divide("n", "d", signed=False).alias("u")).toPandas()
    assert filled["v"].tolist() == [0.5, 0.0, 3.0, -2.0]
    assert filled["u"].tolist()[3] == 2.0 and pd.isna(filled["u"][1])


def test_scrub_and_row_statistics(spark):
    d = spark.createDataFrame([(1.0, float("inf"), None), (None, None, None), (1.0, 3.0, 5.0)], "a double, b double, c double")
    p = d.select(X.finite("b").alias("b"), X.finite("b", 0.0).alias("z"), X.row_mean(["a", "c"]).alias("m"), X.row_std(["a", "b", "c"]).alias("s"), X.row_sum(["a", "c"]).alias("t")).toPandas()
    assert pd.isna(p["b"][0]) and p["z"].tolist() == [0.0, 0.0, 3.0]
    assert p["m"].tolist()[2] == 3.0 and pd.isna(p["m"][1]) and p["t"].tolist() == [1.0, 0.0, 6.0]
    assert p["s"][2] == 2.0


def test_regime_with_validation(spark):
    rows = [("ok", i, float(i)) for i in range(10)] + [("flat", i, 5.0) for i in range(10)] + [("sparse", i, float(i) if i < 3 else None) for i in range(10)]
    d = spark.createDataFrame(rows, "series_id string, ts int, x double")
    out = d.withColumn("r", RG.checked_regime("x", [-1, 4, 20], Axis(("series_id",), "ts"))).toPandas()
    assert out[out.series_id == "ok"].r.sum() == 5
    assert out[out.series_id != "ok"].r.sum() == 0


def test_business_days_match_pandas(spark):
    ds = [d.date() for d in pd.date_range("2021-12-20", periods=40)]
    d = spark.createDataFrame([(x,) for x in ds], "d date")
    end = dt.date(2022, 3, 1)
    p = d.select("d", D.add_business_days("d", 5).alias("a"), D.business_days_between("d", F.lit(end)).alias("n")).toPandas()
    for r in p.itertuples():
        assert r.a == pd.bdate_range(start=r.d, periods=6)[-1].date()
        assert r.n == len(pd.bdate_range(r.d, end))


def test_expiry_rules(spark):
    d = spark.createDataFrame([(2024, 1), (2024, 3), (2024, 12), (2013, 1)], "year int, month int")
    p = d.select(D.third_friday("year", "month").alias("f"), D.contract_expiry("year", "month").alias("x"), D.contract_code("year", "month").alias("c")).toPandas()
    assert [str(v) for v in p.f] == ["2024-01-19", "2024-03-15", "2024-12-20", "2013-01-18"]
    assert [str(v) for v in p.x] == ["2024-01-17", "2024-03-20", "2024-12-18", "2013-01-16"]
    assert p.c.tolist() == ["F4", "H4", "Z4", "F3"]


def test_anchor_rows_take_precedence(spark):
    months = spark.createDataFrame([(2024, 3), (2024, 4)], "year int, month int")
    moved = spark.createDataFrame([(2024, 6), (2022, 3)], "year int, month int")
    assert sorted(str(r["expiry_date"]) for r in C.expiry_table(moved).collect()) == ["2022-03-15", "2024-06-18"]
    anchor = spark.createDataFrame([(2024, 3, dt.date(2024, 3, 19))], "year int, month int, expiry_date date")
    got = {r["month"]: str(r["expiry_date"]) for r in C.expiry_table(months, anchor).collect()}
    assert got == {3: "2024-03-19", 4: "2024-04-17"}


def test_cohort_without_events(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 9),), (dt.date(2024, 2, 7),), (dt.date(2024, 2, 12),)], "ts date")
    none = spark.createDataFrame([], "event_date date")
    d = C.event_distances(days, "ts", none, none, none).withColumns(C.cohort_columns())
    got = {str(r["ts"]): r["calendar_cohort"] for r in d.collect()}
    assert got == {"2024-01-09": "earnings_heavy", "2024-02-07": "mid_cycle", "2024-02-12": "fomc_period"}
    p = C.proximity_columns(d).toPandas()
    assert p["fomc_proximity"].tolist() == [0.0, 0.0, 0.0]


def test_weekend_moves_back(spark):
    d = spark.createDataFrame([(dt.date(2024, 6, d),) for d in (7, 8, 9, 10)], "d date")
    assert [str(r[0]) for r in d.select(D.back_to_weekday("d")).collect()] == ["2024-06-07", "2024-06-07", "2024-06-07", "2024-06-10"]
