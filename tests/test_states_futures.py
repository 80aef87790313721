import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from helpers import AX, days
from tidegrid.operators import calendar as C
from tidegrid.operators import episodes as E
from tidegrid.operators import futures as FU


def states(spark, flags):
    rows = [("a", d, f, float(i)) for i, (d, f) in enumerate(zip(days(len(flags)), flags))]
    return spark.createDataFrame(rows, "series_id string, ts date, ok boolean, v double")


FLAGS = [True, True, False, True, False, False, True]


def test_streaks_and_open_run(spark):
    d = states(spark, FLAGS)
    assert [r["streak"] for r in E.with_true_streak(d, "ok", AX).orderBy("ts").collect()] == [1, 2, 0, 1, 0, 0, 1]
    runs = E.streak_lengths(d, "ok", AX).orderBy("start").collect()
    assert [(r["days"], r["is_open"]) for r in runs] == [(2, 0), (1, 0), (1, 1)]
    p = E.persistence_stats(d, "ok", AX).first()
    assert (p["current_streak"], p["max_duration"], p["num_episodes"], p["total_days"], p["mean_duration"]) == (1, 2, 2, 4, 1.5)


def test_transitions_and_next_true(spark):
    d = states(spark, FLAGS)
    assert [r["left_state"] for r in E.transitions(d, "ok", AX).orderBy("ts").collect()] == [False, False, True, False, True, False, False]
    assert [r["rows_until"] for r in E.until_next_true(d, "ok", AX).orderBy("ts").collect()] == [1, 2, 1, 3, 2, 1, None]
    assert [r["days_since_true"] for r in E.since_last_true(states(spark, [False, True, False]), "ok", AX).orderBy("ts").collect()] == [9999, 0, 1]


def test_never_true_series(spark):
    p = E.persistence_stats(states(spark, [False, False]), "ok", AX).first()
    assert (p["current_streak"], p["num_episodes"], p["rate"]) == (0, 0, 0.0)


def test_episodes(spark):
    d = states(spark, FLAGS).withColumn("s", F.when(F.col("ok"), "up").otherwise("down"))
    e = E.episodes(d, "s", "v", AX).orderBy("start").collect()
    assert [(r["s"], r["days"], r["peak_abs"], r["mean"]) for r in e] == [("up", 2, 1.0, 0.5), ("down", 1, 2.0, 2.0), ("up", 1, 3.0, 3.0), ("down", 2, 5.0, 4.5), ("up", 1, 6.0, 6.0)]


def _raw(spark, rows):
    return spark.createDataFrame(rows, "ts date, open double, high double, low double, close double, settle double, volume double, open_interest double")


def test_cleaning_rules(spark):
    d = dt.date(2024, 1, 2)
    rows = [
        (d, 15.0, 16.0, 14.0, 15.5, 0.0, 10.0, 5.0),     # settle from close
        (d, None, None, 14.0, 15.0, 15.0, -1.0, None),   # open and range from settle, volumes to 0
        (d, 15.0, 14.0, 16.0, 15.0, 15.0, 1.0, 1.0),     # inverted range
        (d, 15.0, 16.0, 14.0, 15.0, 17.0, 1.0, 1.0),     # settle above the high
        (d, 15.0, 16.0, 14.0, 15.0, 350.0, 1.0, 1.0),    # dropped
        (d, 2.0, 2.5, 1.0, 2.0, 2.0, 1.0, 1.0),          # dropped
        (d, 15.0, 16.0, 14.0, None, None, 1.0, 1.0),     # dropped: no settle and no close
    ]
    p = FU.clean_contracts(_raw(spark, rows)).toPandas()
    assert p.settle.tolist() == [15.5, 15.0, 15.0, 17.0]
    assert p.close.tolist() == p.settle.tolist()
    assert p.high.tolist() == [16.0, 15.0, 16.0, 17.0] and p.low.tolist() == [14.0, 15.0, 14.0, 14.0]
    assert p.open.tolist()[1] == 15.0 and p.volume.tolist()[1] == 0.0 and p.open_interest.tolist()[1] == 0.0


def test_stitching_with_a_missing_day(spark):
    exp = [dt.date(2024, 1, 4), dt.date(2024, 1, 10), dt.date(2024, 2, 14)]
    biz = [d.date() for d in pd.bdate_range("2024-01-02", "2024-01-11")]
    rows = [(e, d, float(10 * i + d.day)) for i, e in enumerate(exp) for d in biz if d <= e and not (i == 1 and d == dt.date(2024, 1, 5))]
    con = spark.createDataFrame(rows, "expiry_date date, ts date, settle double").withColumn("root", F.lit("VX"))
    table = spark.createDataFrame([(e,) for e in exp], "expiry_date date")
    out = FU.continuous_positions(con, table, ["root"], 2)
    front = out.filter("position = 1").orderBy("ts").collect()
    assert [str(r["ts"])[-2:] for r in front] == ["02", "03", "04", "08", "09", "10", "11"]
    assert [r["roll_indicator"] for r in front] == [1, 0, 1, 0, 0, 1, 0]
    assert [r["contract_id"] for r in front] == [1, 1, 2, 2, 2, 3, 3]
    assert front[0]["days_to_expiry"] == 2


def test_each_root_has_its_own_positions(spark):
    exp = {"A": [dt.date(2024, 1, 10), dt.date(2024, 2, 14)], "B": [dt.date(2024, 1, 17), dt.date(2024, 2, 21)]}
    biz = [d.date() for d in pd.bdate_range("2024-01-02", "2024-01-05")]
    con = spark.createDataFrame([(r, e, d, 1.0) for r, es in exp.items() for e in es for d in biz], "root string, expiry_date date, ts date, settle double")
    table = spark.createDataFrame([(r, e) for r, es in exp.items() for e in es], "root string, expiry_date date")
    got = {(r["root"], r["expiry_date"], r["position"]) for r in FU.continuous_positions(con, table, ["root"], 6).collect()}
    assert got == {(r, e, k + 1) for r, es in exp.items() for k, e in enumerate(es)}


def test_missing_trading_days(spark):
    d = spark.createDataFrame([("a", dt.date(2024, 1, x)) for x in (1, 2, 4, 8)], "series_id string, ts date")
    closed = C.literal_dates(spark, ["2024-01-05"])
    assert [str(r["ts"]) for r in C.missing_days(d, AX, closed).collect()] == ["2024-01-03"]
