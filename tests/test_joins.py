import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import AX
from tidegrid.operators import joins as J
from tidegrid.operators.bars import append_newer, merge_new_rows, normalise_index

BASE = dt.date(2024, 1, 1)


def day(i):
    return BASE + dt.timedelta(days=int(i))


def source(spark, pairs):
    return spark.createDataFrame([("a", day(i), v) for i, v in pairs], "series_id string, ts date, v double")


def target(spark, idx):
    return spark.createDataFrame([("a", day(i)) for i in idx], "series_id string, ts date")


def values(df, col="v"):
    p = df.orderBy("ts").toPandas()[col]
    return [None if pd.isna(v) else float(v) for v in p]


@pytest.mark.parametrize("seed", range(4))
def test_asof_limit_matches_reindex(spark, seed):
    rng = np.random.default_rng(seed)
    idx = np.sort(rng.choice(40, 12, replace=False))
    vals = [None if rng.random() < 0.25 else float(i) for i in idx]
    tgt = np.sort(rng.choice(40, 25, replace=False))
    limit = int(rng.integers(1, 5))
    want = pd.Series([np.nan if v is None else v for v in vals], index=idx).reindex(tgt, method="ffill", limit=limit)
    got = values(J.asof_join(target(spark, tgt), source(spark, zip(idx, vals)), AX, ["v"], limit))
    assert got == [None if pd.isna(v) else v for v in want]


def test_null_label_stays_null(spark):
    got = values(J.asof_join(target(spark, range(12)), source(spark, [(0, 1.0), (4, None), (20, 2.0)]), AX, ["v"], 3))
    assert got == [1.0, 1.0, 1.0, 1.0] + [None] * 8


def test_forward_and_nearest(spark):
    s = source(spark, [(2, 2.0), (6, 6.0)])
    assert values(J.asof_join(target(spark, [0, 2, 3, 7]), s, AX, ["v"], direction="forward")) == [2.0, 2.0, 6.0, None]
    assert values(J.asof_join(target(spark, [2]), s, AX, ["v"], direction="forward", strict=True)) == [6.0]
    assert values(J.nearest_join(target(spark, [0, 3, 4, 5, 9]), s, AX, ["v"])) == [2.0, 2.0, 6.0, 6.0, 6.0]


def test_first_within(spark):
    s = source(spark, [(3, 3.0), (4, 4.0), (20, 20.0)])
    t = target(spark, [0, 1, 2, 3, 4, 5, 18])
    assert values(J.first_within(t, s, AX, F.col("ts"), 3, ["v"])) == [3.0, 3.0, 3.0, 3.0, 4.0, None, 20.0]


def test_other_columns_survive_asof(spark):
    t = target(spark, [1, 2]).withColumn("tag", F.lit("x"))
    out = J.asof_join(t, source(spark, [(0, 5.0)]), AX, ["v"], matched="m").orderBy("ts").collect()
    assert [(r["tag"], r["v"], r["m"]) for r in out] == [("x", 5.0, BASE), ("x", 5.0, BASE)]


def test_duplicates_keep_last_and_short_series_drop(spark):
    rows = [("a", dt.datetime(2024, 1, 1, h), h, float(h)) for h in range(3)] + [("a", dt.datetime(2024, 1, 1 + d), 9, 9.0) for d in range(1, 10)] + [("b", dt.datetime(2024, 1, 1), 0, 1.0)]
    d = spark.createDataFrame(rows, "series_id string, raw timestamp, n int, v double")
    out = normalise_index(d, AX, "raw", "n", ["v"], 10)
    assert out.count() == 10 and out.filter(F.col("ts") == BASE).first()["v"] == 2.0


def test_merge_and_append(spark):
    a, b = source(spark, [(0, 1.0), (1, 2.0)]), source(spark, [(1, 9.0), (2, 3.0)])
    assert values(merge_new_rows(a, b, AX, ["v"])) == [1.0, 9.0, 3.0]
    assert values(append_newer(a, b, AX)) == [1.0, 2.0, 3.0]


def test_events_between_rows_count_once(spark):
    from tidegrid.operators.eventstudy import rows_at_events

    rows = target(spark, [0, 3, 4, 9])
    ev = spark.createDataFrame([(day(1),), (day(2),), (day(4),), (day(11),)], "event_date date")
    assert [r["ts"] for r in rows_at_events(rows, ev, AX).orderBy("ts").collect()] == [day(3), day(4)]


def test_similar_states(spark):
    h = spark.createDataFrame([("a", day(i), s) for i, s in enumerate([0.1, 0.5, 0.65, 0.6])], "series_id string, ts date, s double")
    assert sorted(r["s"] for r in J.similar_states(h, AX, "s", 0.1000001).collect()) == [0.5, 0.6, 0.65]
