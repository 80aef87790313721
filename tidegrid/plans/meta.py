"""Features of features: regime indicators, cross-asset relations, rates of change, percentiles,
and products with event proximity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import rolling as R
from tidegrid.functions.scalar import clip, flag, nonzero, row_mean, sign
from tidegrid.functions.technical import stage
from tidegrid.plans.regimes import checked_regime


def regime_indicators(df: DataFrame, ax: Axis) -> DataFrame:
    v, rv = F.col("vix"), F.col("spx_realized_vol_21d")
    parts = [clip((v - 15) / 25, 0, 1), clip((rv - 15) / 20, 0, 1)]
    if "skew" in df.columns:
        parts.insert(0, clip((F.col("skew") - 130) / 30, 0, 1))
    df = stage(df, {"_rp": v - rv, "liquidity_stress_composite": row_mean(parts)})
    return stage(df, {
        "vix_regime_micro": checked_regime("vix", [0, 12, 16, 20, 100], ax), "regime_transition_risk": clip(F.abs("vix_velocity_5d") / nonzero("vix") * 100, 0, 100),
        "vol_regime": checked_regime("spx_realized_vol_21d", [0, 10, 15, 25, 100], ax), "risk_premium_regime": checked_regime("_rp", [-100, 0, 5, 10, 100], ax),
        "trend_regime": checked_regime("spx_vs_ma200", [-100, -5, 0, 5, 100], ax), "trend_strength_avg": (F.abs("spx_vs_ma200") + F.abs("spx_vs_ma50")) / 2,
        "liquidity_regime": checked_regime("liquidity_stress_composite", [0, 0.25, 0.5, 0.75, 1], ax),
        "correlation_regime": checked_regime("spx_vix_corr_21d", [-1, -0.8, -0.5, 0, 1], ax),
    })


def cross_relations(df: DataFrame, ax: Axis, leak_free: bool = True) -> DataFrame:
    """``leak_free`` ranks against the past only; otherwise against the whole history."""
    rank = R.expanding_rank_pct if leak_free else R.full_rank_pct
    ranked = ["spx_ret_21d", "vix_velocity_21d"]
    if "gold" in df.columns:
        df = stage(df, {"_g21": R.pct_change("gold", 21, ax) * 100})
        ranked.append("_g21")
    for names in ([ranked] if leak_free else [[c] for c in ranked]):  # whole-history ranks each need their own sort
        df = stage(df, {f"_k_{c}": rank(c, ax) for c in names})
    out = {
        "equity_vol_divergence": F.abs(F.col("_k_spx_ret_21d") + F.col("_k_vix_velocity_21d") - 1),
        "equity_vol_corr_breakdown": F.abs(F.col("spx_vix_corr_21d") - R.mean("spx_vix_corr_21d", 63, ax)),
        "risk_premium_ma21": R.mean("_rp", 21, ax), "risk_premium_velocity": R.diff("_rp", 10, ax), "risk_premium_zscore": R.zscore("_rp", 63, ax),
    }
    if "gold" in df.columns:
        out["gold_spx_divergence"] = F.abs(F.col("_k__g21") - F.col("_k_spx_ret_21d"))
    return stage(df, out)


def rates_of_change(df: DataFrame, ax: Axis, leak_free: bool = True) -> DataFrame:
    rank = R.expanding_rank_pct if leak_free else R.full_rank_pct
    rv = "spx_realized_vol_21d"
    df = stage(df, {
        "vix_velocity_3d_pct": R.pct_change("vix", 3, ax) * 100, "_v5": R.diff("vix", 5, ax), "_s5": R.diff("skew", 5, ax), "_r5": R.diff(rv, 5, ax),
        "_v10": R.diff("vix", 10, ax), "_s10": R.diff("skew", 10, ax), "spx_realized_vol_21d_velocity_3d": R.diff(rv, 3, ax),
    })
    df = stage(df, {
        "_v55": R.diff("_v5", 5, ax), "_s55": R.diff("_s5", 5, ax), "vix_momentum_regime": sign("_v5"), "skew_momentum_regime": sign("_s5"), "spx_realized_vol_21d_acceleration_5d": R.diff("_r5", 5, ax),
    })
    pairs = {"_k10v": "_v10", "_k10s": "_s10"}
    for names in ([list(pairs)] if leak_free else [[k] for k in pairs]):
        df = stage(df, {k: rank(pairs[k], ax) for k in names})
    return stage(df, {"vix_jerk_5d": R.diff("_v55", 5, ax), "skew_jerk_5d": R.diff("_s55", 5, ax), "vix_skew_momentum_divergence": F.abs(F.col("_k10v") - F.col("_k10s"))})


def percentile_rankings(df: DataFrame, ax: Axis) -> DataFrame:
    names = {"vix": "vix", "skew": "skew", "risk_premium": "_rp"}
    if "_rp" not in df.columns:
        df = stage(df, {"_rp": F.col("vix") - F.col("spx_realized_vol_21d")})
    df = stage(df, {f"{n}_percentile_{w}d": R.pct_below(c, w, ax) for n, c in names.items() for w in (21, 63, 126, 252)})
    return stage(df, {
        **{f"{n}_percentile_velocity": R.diff(f"{n}_percentile_63d", 10, ax) for n in names},
        **{f"{n}_extreme_low_{w}d": flag(F.col(f"{n}_percentile_{w}d") < 10) for n in names for w in (63, 252)},
    })


# Which market feature is multiplied by which event-proximity feature.
EVENT_PRODUCTS = {
    "vix_velocity_5d": ("vix_vel", {"fomc_prox": "fomc_proximity", "fomc_pre": "fomc_pre_period", "fomc_post": "fomc_post_period", "opex_prox": "opex_proximity", "earnings": "earnings_intensity_norm", "macro_event": "macro_event_intensity"}),
    "vix": ("vix", {"fomc_prox": "fomc_proximity", "opex_prox": "opex_proximity", "earnings": "earnings_intensity_norm"}),
    "vx1_vx2_spread": ("vx_spread", {"opex_prox": "opex_proximity", "opex_week": "opex_week_intensity", "vix_expiry": "vix_expiry_proximity"}),
    "spx_gap": ("spx_gap", {"fomc_post": "fomc_post_period", "macro_event": "macro_event_intensity"}),
    "spx_realized_vol_21d": ("spx_rv", {"earnings": "earnings_intensity_norm", "fomc_prox": "fomc_proximity"}),
    "risk_premium": ("risk_premium", {"fomc_pre": "fomc_pre_period", "fomc_post": "fomc_post_period", "opex": "opex_proximity"}),
    "skew": ("skew", {"fomc_prox": "fomc_proximity", "fomc_pre": "fomc_pre_period", "macro_event": "macro_event_intensity"}),
    "spx_ret_5d": ("spx_mom", {"earnings": "earnings_intensity_norm", "fomc_post": "fomc_post_period"}),
    "vix_accel_5d": ("vix_accel", {"fomc_prox": "fomc_proximity", "opex_prox": "opex_proximity"}),
    "vix_vol_21d": ("vix_vol", {"opex_week": "opex_week_intensity", "vix_expiry": "vix_expiry_proximity"}),
    "hy_spread": ("hy_spread", {"fomc_prox": "fomc_proximity", "macro_event": "macro_event_intensity"}),
    "vix_regime": ("regime", {"fomc_prox": "fomc_proximity", "opex_prox": "opex_proximity", "earnings": "earnings_intensity_norm"}),
}


def event_products(df: DataFrame) -> DataFrame:
    """Market feature x event proximity; a missing factor gives 0."""
    if {"vix", "spx_realized_vol_21d"} <= set(df.columns) and "risk_premium" not in df.columns:
        df = stage(df, {"risk_premium": F.col("vix") - F.col("spx_realized_vol_21d")})
    out = {}
    for feat, (short, pairs) in EVENT_PRODUCTS.items():
        if feat in df.columns:
            out.update({f"{short}_x_{k}": F.coalesce(F.col(feat) * F.col(p), F.lit(0.0)) for k, p in pairs.items()})
    if "vix_velocity_5d" in df.columns:
        out["vix_vel_abs_x_multi_event"] = F.coalesce(F.abs("vix_velocity_5d") * F.col("multi_event_stress"), F.lit(0.0))
    return stage(df, out)
