"""Labour, stress, credit, yield, macro and commodity-spread features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import rolling as R
from tidegrid.functions import technical as TI
from tidegrid.functions.scalar import clip, flag, row_mean, row_std
from tidegrid.functions.technical import stage
from tidegrid.plans.regimes import checked_regime


def labour(df: DataFrame, ax: Axis, c: str = "claims") -> DataFrame:
    df = stage(df, {
        "initial_claims": F.col(c), "claims_4wk_ma": R.mean(c, 20, ax), "claims_velocity_4w": R.diff(c, 20, ax), "claims_zscore_52w": R.zscore(c, 252, ax),
        "claims_percentile_52w": R.pct_below(c, 252, ax), "claims_regime": checked_regime(c, [0, 250000, 350000, 500000, 1000000], ax),
    })
    return stage(df, {"claims_velocity_zscore": R.zscore("claims_velocity_4w", 63, ax)})


def stress(df: DataFrame, ax: Axis, c: str = "stress") -> DataFrame:
    return stage(df, {
        "fin_stress_index": F.col(c), "stress_velocity_4w": R.diff(c, 20, ax), "stress_zscore_52w": R.zscore(c, 252, ax), "stress_extreme": TI.extreme_flag(c, 0.9, 252, ax),
        "stress_regime": checked_regime(c, [-5, -1, 0, 2, 10], ax),
    })


def credit(df: DataFrame, ax: Axis) -> DataFrame:
    """Spread levels and changes, quality spread with a widening flag, composite; each part is
    planned only when its inputs exist."""
    have = set(df.columns)
    out: dict[str, Column] = {}
    for c, name in (("hy", "hy_spread"), ("hy_bb", "hy_bb_spread"), ("hy_b", "hy_b_spread"), ("hy_ccc", "hy_ccc_spread")):
        if c in have:
            out[name] = F.col(c)
            out[name.replace("_spread", "_velocity_21d")] = R.diff(c, 21, ax)
    if "hy" in have:
        out["hy_zscore_252d"] = R.zscore("hy", 252, ax)
    if {"hy_bb", "hy_ccc"} <= have:
        out["credit_quality_spread"] = F.col("hy_ccc") - F.col("hy_bb")
    if {"hy", "ig"} <= have:
        out["ig_hy_spread"] = F.col("hy") - F.col("ig")
    df = stage(df, out)
    more = {}
    if "credit_quality_spread" in df.columns:
        more["credit_widening_regime"] = TI.extreme_flag("credit_quality_spread", 0.8, 63, ax)
    if "ig_hy_spread" in df.columns:
        more["credit_stress_composite"] = R.pct_below("ig_hy_spread", 252, ax)
    return stage(df, more)


def pick_source(primary: str, secondary: str, ax: Axis, least: float = 0.5) -> Column:
    """The primary column, or the secondary one for series where the primary is too sparse."""
    covered = F.avg(F.col(primary).isNotNull().cast("double")).over(ax.whole())
    return F.when(covered < least, F.col(secondary)).otherwise(F.col(primary))


def yields(df: DataFrame, ax: Axis) -> DataFrame:
    """Curve spreads, their dynamics, inversion, level, curvature and rate volatility from y3m,
    y2y, y5y, y10y, y30y (y6m optional)."""
    need = {"y3m", "y2y", "y10y"}
    if not need <= set(df.columns):
        return df
    y = F.col
    spreads = {"yield_10y2y": y("y10y") - y("y2y"), "yield_10y3m": y("y10y") - y("y3m"), "yield_2y3m": y("y2y") - y("y3m")}
    if "y5y" in df.columns:
        spreads.update({"yield_5y2y": y("y5y") - y("y2y"), "yield_curve_curvature": 2 * y("y5y") - y("y2y") - y("y10y")})
    if "y30y" in df.columns:
        spreads["yield_30y10y"] = y("y30y") - y("y10y")
    levels = [c for c in ("y3m", "y2y", "y5y", "y10y", "y30y") if c in df.columns]
    tenors = [c for c in ("y6m", "y10y", "y30y") if c in df.columns]
    df = stage(df, {**spreads, "yield_curve_level": row_mean(levels), **{f"_d_{c}": R.diff(c, 1, ax) for c in tenors}})
    out = {"yield_10y2y_zscore": R.zscore("yield_10y2y", 252, ax), "yield_curve_level_zscore": R.zscore("yield_curve_level", 252, ax)}
    if "yield_curve_curvature" in df.columns:
        out["yield_curve_curvature_zscore"] = R.zscore("yield_curve_curvature", 252, ax)
    for s in ("yield_10y2y", "yield_10y3m", "yield_2y3m"):
        out.update({f"{s}_velocity_{w}d": R.diff(s, w, ax) for w in (10, 21, 63)})
        out[f"{s}_vs_ma63"] = F.col(s) - R.mean(s, 63, ax)
        out[f"{s}_percentile_252d"] = R.pct_below(s, 252, ax)
    for s in ("yield_10y2y", "yield_10y3m"):
        out[f"{s}_inversion_depth"] = F.abs(clip(s, hi=0))
    vols = {f"{c[1:]}_vol_63d": R.std(f"_d_{c}", 63, ax) * (252.0 ** 0.5) for c in tenors}
    df = stage(df, {**out, **vols})
    accel = {f"{s}_acceleration": R.diff(f"{s}_velocity_10d", 10, ax) for s in ("yield_10y2y", "yield_10y3m", "yield_2y3m")}
    df = stage(df, {**accel, "yield_curve_vol_avg": row_mean(list(vols)), "yield_curve_vol_dispersion": row_std(list(vols))})
    return df.drop(*[f"_d_{c}" for c in tenors])


def macro_level(df: DataFrame, ax: Axis, c: str, name: str, windows: tuple[int, ...] = (10, 21, 63), relative: bool = True) -> DataFrame:
    """Lagged level, z-score and changes (percent, or differences when not ``relative``)."""
    ch = {f"{name}_ret_{w}d": R.pct_change(c, w, ax) * 100 for w in windows} if relative else {f"{name}_change_{w}d": R.diff(c, w, ax) for w in windows}
    return stage(df, {f"{name}_lag1": R.lag(c, 1, ax), f"{name}_zscore_63d": R.zscore(c, 63, ax), **ch})


def commodity_spread(df: DataFrame, ax: Axis, spread: str = "cl_spread", price: str = "crude") -> DataFrame:
    df = stage(df, {
        "cl1_cl2_velocity_5d": R.diff(spread, 5, ax), "cl1_cl2_zscore_63d": R.zscore(spread, 63, ax), "oil_term_regime": checked_regime(spread, [-10, -1, 0, 2, 20], ax),
        **{f"crude_oil_ret_{w}d": R.pct_change(price, w, ax) * 100 for w in (10, 21, 63)}, "crude_oil_zscore_63d": R.zscore(price, 63, ax), f"_r_{price}": R.pct_change(price, 1, ax),
    })
    return stage(df, {"crude_oil_vol_21d": R.realized_vol(f"_r_{price}", 21, ax)}).drop(f"_r_{price}")
