"""Indicators that need more than one window stage; each takes and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import rolling as R
from tidegrid.functions.scalar import clip, flag, nonzero


def stage(df: DataFrame, exprs: dict) -> DataFrame:
    """Add a set of columns in one projection; what must walk the series comes before it, in one pass."""
    return R.with_columns(df, exprs)


def bollinger(c: str, ax: Axis, out: str, k: int = 20, width: float = 2.0, staged: bool = False) -> dict:
    """Position inside the band (0..1) and band width in percent of the mean. ``staged`` reads the
    moments from columns made by ``rolling.moments``."""
    m, s = (F.col(f"_m{k}_{c}"), F.col(f"_s{k}_{c}")) if staged else (R.mean(c, k, ax), R.std(c, k, ax))
    lo, hi = m - width * s, m + width * s
    return {
        f"{out}_position": clip((F.col(c) - lo) / nonzero(hi - lo), 0, 1),
        f"{out}_width": (hi - lo) / nonzero(m) * 100,
    }


def rsi(df: DataFrame, c: str, ax: Axis, out: str = "rsi_14", k: int = 14) -> DataFrame:
    """Relative strength with simple means of gains and losses."""
    df = stage(df, {"_d": R.diff(c, 1, ax)})
    df = stage(df, {"_gain": clip("_d", lo=0), "_loss": -clip("_d", hi=0)})
    rs = R.mean("_gain", k, ax) / nonzero(R.mean("_loss", k, ax))
    return stage(df, {out: 100 - 100 / (1 + rs)}).drop("_d", "_gain", "_loss")


def macd(df: DataFrame, c: str, ax: Axis, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = R.ewm_means(df, {"_fast": (c, fast), "_slow": (c, slow)}, ax)
    df = stage(df, {"macd": F.col("_fast") - F.col("_slow")}).drop("_fast", "_slow")
    df = R.ewm_means(df, {"macd_signal": ("macd", signal)}, ax)
    return stage(df, {"macd_histogram": F.col("macd") - F.col("macd_signal")})


def adx(df: DataFrame, ax: Axis, high: str = "high", low: str = "low", close: str = "close", out: str = "adx_14", k: int = 14) -> DataFrame:
    """Directional index with simple means. The down move is the negated change of the low,
    negative moves count as zero."""
    prev = R.lag(close, 1, ax)
    h, low_ = F.col(high), F.col(low)
    df = stage(
        df,
        {
            "_up": clip(R.diff(high, 1, ax), lo=0),
            "_dn": clip(-R.diff(low, 1, ax), lo=0),
            "_tr": F.greatest(h - low_, F.abs(h - prev), F.abs(low_ - prev)),
        },
    )
    atr = nonzero(R.mean("_tr", k, ax))
    df = stage(df, {"_pdi": 100 * R.mean("_up", k, ax) / atr, "_mdi": 100 * R.mean("_dn", k, ax) / atr})
    df = stage(df, {"_dx": 100 * F.abs(F.col("_pdi") - F.col("_mdi")) / nonzero(F.col("_pdi") + F.col("_mdi"))})
    return stage(df, {out: R.mean("_dx", k, ax)}).drop("_up", "_dn", "_tr", "_pdi", "_mdi", "_dx")


def extreme_flag(c: str, q: float, k: int, ax: Axis, absolute: bool = False, low: bool = False):
    x = F.abs(F.col(c)) if absolute else F.col(c)
    limit = R.quantile(c, q, k, ax)
    return flag(x < limit if low else x > limit)


def velocity_asymmetry(fast: str, slow: str, k: int, ax: Axis):
    """Gap between the mean absolute size of two change series."""
    return F.abs(R.mean(f"abs({fast})", k, ax) - R.mean(f"abs({slow})", k, ax))


def normalised_volatility(df: DataFrame, c: str, k: int, ax: Axis, out: str) -> DataFrame:
    """Rolling deviation as a share of the series' largest."""
    df = stage(df, {"_s": R.std(c, k, ax)})
    return stage(df, {out: F.col("_s") / nonzero(F.max("_s").over(ax.whole()))}).drop("_s")


def lag_autocorrelation(c: str, ax: Axis) -> tuple:
    """Per-series lag-one pair for ``corr``; the pair must be staged before aggregation."""
    return F.col(c), R.lag(c, 1, ax)


def group_zscore(c: str, group: str, ax: Axis, expanding: bool = True):
    """z-score of a value among the rows of its own group and series.

    ``expanding`` uses only rows up to the current one; the whole-history form looks ahead."""
    part = ax.by(group)
    w = part.upto() if expanding else part.whole()
    s = F.stddev_samp(c).over(w)
    return F.when(s > 0, (F.col(c) - F.avg(c).over(w)) / nonzero(s)).when(s == 0, F.lit(0.0))
