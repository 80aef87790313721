"""The cross-asset query on rows of its own."""

import datetime

import numpy as np
import pandas as pd

from tidegrid.queries.packs import pack_cross_asset


def test_currency_percentile_of_the_cross_asset_query(spark, tmp_path):
    """Ranks are placeholders until ``with_columns`` works them out: the query must run, and rank as pandas does."""
    rng = np.random.default_rng(5)
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(days=k) for k in range(300)]
    rows = [("R", d, 10 * k + n, n, 1, 1, float(rng.integers(1, 50)), float(rng.integers(100, 10_000)), 0.01 * n, 0.01, "O") for k, d in enumerate(days) for n in range(1, 8)]
    names = ["l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"]
    data = pd.DataFrame(rows, columns=names)
    spark.createDataFrame(data, "l_returnflag string, l_shipdate date, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = pack_cross_asset(spark, str(tmp_path)).orderBy("ts").toPandas()
    some = data[data.l_linenumber >= 5]
    dxy = some.groupby("l_shipdate").l_extendedprice.apply(lambda p: round((p * p).sum() / p.sum() / 371, 4))
    pct = dxy.rolling(252, min_periods=126).rank(pct=True) * 100
    want = pd.cut(pct, [0, 25, 75, 100], labels=False).to_numpy(float)
    assert np.isfinite(want).sum() == 175
    np.testing.assert_array_equal(out.dxy_regime_numeric.to_numpy(float), want)
