"""Rule gates, volatility state and the premium score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import rolling as R
from tidegrid.functions.scalar import clip, cut, flag, nonzero, ratio
from tidegrid.functions.technical import stage


def in_intervals(df: DataFrame, ts: str, spans: list[tuple[str, str]], out: str) -> DataFrame:
    """1 on days inside any of a short list of closed intervals."""
    hits = [F.col(ts).between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in spans]
    return df.withColumn(out, flag(reduce(lambda a, b: a | b, hits)))


def gate_features(df: DataFrame, ax: Axis, stress_lag: int = 5, credit_lag: int = 1) -> DataFrame:
    """Gate inputs from a wide daily frame with close, vix, vvix, vx1..vx4, stress, hy_bb, hy_ccc.

    Slow series are lagged by their publication delay; adaptive thresholds end on the row before.
    """
    df = stage(df, {
        "ret": R.pct_change("close", 1, ax), "stress_raw": R.lag("stress", stress_lag, ax),
        "quality_spread": R.lag("hy_ccc", credit_lag, ax) - R.lag("hy_bb", credit_lag, ax),
        "vx_contango_pct": (ratio("vx2", "vx1") - 1) * 100,
    })
    v1, v2, v3, v4 = (F.col(f"vx{i}") for i in (1, 2, 3, 4))
    base = nonzero(v1)
    near = 0.50 * (v2 - v1) / base + 0.30 * (v3 - v2) / base
    return stage(df, {
        "vix_vs_rv_21d": F.col("vix") - R.realized_vol("ret", 21, ax),
        "c3_vvix_threshold": R.prior_quantile("vvix", 0.85, 252, ax, 126),
        "credit_widening_regime": flag(F.col("quality_spread") > R.prior_quantile("quality_spread", 0.8, 63, ax)),
        "stress_regime": cut("stress_raw", [-10, -1, 0, 2, 20]).cast("double"),
        "vvix_vix_ratio": F.col("vvix") / F.when(F.col("vix") >= 5, F.col("vix")),
        "vx_curve_ok": F.when(v3.isNotNull(), flag((v2 > v1) & (v3 > v2)).cast("double")),
        "vx_curve_score": F.when(v4.isNotNull(), near + 0.20 * (v4 - v3) / base).otherwise(near / 0.80),
    })


def gate_conditions() -> dict[str, Column]:
    return {
        "c1": F.col("vx_contango_pct") > 0, "c2": F.col("vix_vs_rv_21d") > 2, "c3": F.col("vvix") < F.col("c3_vvix_threshold"),
        "c4": F.col("credit_widening_regime") == 0, "c5": F.col("stress_regime") <= 1,
    }


def gate_verdict(conditions: dict[str, Column] | None = None) -> Column:
    """All conditions hold; an unknown condition is a fail."""
    conds = (conditions or gate_conditions()).values()
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conds])


def volatility_state(df: DataFrame, ax: Axis, lookback: int = 126, premium_window: int = 252, peak: float = 0.80, trough: float = 0.20, swan: float = 30.0, rich: float = 0.67) -> DataFrame:
    """PEAK / TROUGH / NORMAL per row from the rank of the level among the values before it, the
    premium's rank, and the resulting tilt. Needs vix and close."""
    df = stage(df, {"_ret": R.pct_change("close", 1, ax)})
    df = stage(df, {"_vrp": F.col("vix") - R.realized_vol("_ret", 21, ax)})
    df = stage(df, {"pct_126d": R.prior_rank("vix", lookback, ax, int(lookback * 0.6)), "vrp_pct": R.prior_rank("_vrp", premium_window, ax, 126)})
    p, is_swan = F.col("pct_126d"), F.col("vix") >= swan
    is_rich = F.coalesce(F.col("vrp_pct") >= rich, F.lit(False))
    state = F.when(p.isNull(), F.lit(None)).when(p >= peak, "PEAK").when(p <= trough, "TROUGH").otherwise("NORMAL")
    tilt = (
        F.when(p.isNull(), F.lit(None)).when((p >= peak) & is_swan, "SWAN-WATCH").when((p >= peak) & is_rich, "LEAN-IN-STRONG").when(p >= peak, "LEAN-IN")
        .when(p <= trough, "HOLD-BACK").otherwise("standard")
    )
    return stage(df, {"state": state, "tilt": tilt, "swan": flag(is_swan), "vrp_rich": flag(is_rich)}).drop("_ret", "_vrp")


def _bands(x: Column, steps: list[tuple[float, int]], last: int) -> Column:
    out = None
    for edge, pts in steps:
        out = F.when(x < edge, pts) if out is None else out.when(x < edge, pts)
    return F.when(x.isNotNull(), out.otherwise(last))


def premium_score(spread: str, streak: str, close: str, ma20: str, ma50: str, ma200: str, vix: str, vix3m: str, vvix: str) -> dict[str, Column]:
    """Five banded components, their sum clipped to 0..100, and a rating."""
    s, v, c = F.col(spread), F.col(vix), F.col(close)
    depth = F.when(s < -2.0, 10).when(s < -1.0, 5).otherwise(0)
    fresh = F.when(F.col(streak) < 5, -5).otherwise(0)
    curve = F.when(s < 0, F.lit(20) + depth + fresh).otherwise(-10)
    level = F.when(v.between(15, 25), 25).when((v >= 12) & (v < 15), 10).when((v > 25) & (v <= 35), 15).when(v > 35, 0).otherwise(5)
    calm = _bands(F.col(vvix), [(85, 15), (100, 10), (120, 5)], 0)
    trend = flag(c > F.col(ma200)) * 10 + flag(c > F.col(ma50)) * 5 + flag(c > F.col(ma20)) * 5
    term = _bands(F.coalesce(v / nonzero(vix3m), F.lit(1.0)), [(0.90, 10), (1.00, 7), (1.05, 3)], 0)
    total = clip(curve + level + F.coalesce(calm, F.lit(0)) + trend + term, 0, 100).cast("int")
    rating = F.when(total >= 80, "EXCELLENT").when(total >= 65, "FAVORABLE").when(total >= 50, "NEUTRAL").when(total >= 35, "CAUTIOUS").otherwise("AVOID")
    return {"curve_points": curve, "level_points": level, "calm_points": calm, "trend_points": trend, "term_points": term, "score": total, "rating": rating}
