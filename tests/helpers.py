import numpy as np
import pandas as pd

from tidegrid.axis import Axis

AX = Axis(("series_id",), "ts")


def days(n, start="2020-01-01"):
    return [d.date() for d in pd.date_range(start, periods=n)]


def frame(spark, series: dict, start="2020-01-01"):
    """{"name": {"col": values}} -> panel; NaN becomes null."""
    rows, cols = [], list(next(iter(series.values())))
    for name, data in series.items():
        n = len(data[cols[0]])
        for i, d in enumerate(days(n, start)):
            rows.append((name, d, *[None if data[c][i] is None or data[c][i] != data[c][i] else float(data[c][i]) for c in cols]))
    return spark.createDataFrame(rows, "series_id string, ts date, " + ", ".join(f"{c} double" for c in cols))


def got(df, col):
    pdf = df.orderBy("series_id", "ts").toPandas()
    return pdf[col].astype(float).to_numpy()


def same(a, b, tol=1e-9):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=tol, atol=tol, equal_nan=True)


def nulls(n=120, seed=0, ties=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(20, 5, n)
    if ties:
        x = np.round(x)
    x[[5, 40]] = np.nan
    return x
