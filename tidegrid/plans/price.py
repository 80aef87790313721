"""Base level and price features, and candle anatomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import rolling as R
from tidegrid.functions import technical as TI
from tidegrid.functions.scalar import clip, cut, flag, nonzero, ratio
from tidegrid.functions.technical import stage


def drop_moments(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("_m", "_s")) and c[2:3].isdigit()])


def level_features(df: DataFrame, ax: Axis, level: str = "vix") -> DataFrame:
    """Changes, volatility, deviation and extremes of a volatility level."""
    v = F.col(level)
    df = stage(df, {**R.moments(level, (20, 21, 63, 252), ax), **R.moments(level, (10,), ax, deviation=False)})
    mean = lambda w: F.col(f"_m{w}_{level}")
    df = stage(df, {
        **{f"vix_ret_{w}d": R.pct_change(level, w, ax) * 100 for w in (1, 5, 10, 21)},
        **{f"vix_velocity_{w}d": R.diff(level, w, ax) for w in (5, 10, 21)},
        **{f"vix_vs_ma{w}": R.gap_of(level, w) for w in (10, 21, 63, 252)},
        **{f"vix_zscore_{w}d": R.z_of(level, w) for w in (21, 63, 252)},
        **{f"vix_stretch_ma{w}": F.abs(v - mean(w)) for w in (21, 63)},
        **{f"reversion_strength_{w}d": F.abs(v - mean(w)) / nonzero(mean(w)) for w in (21, 63)},
        "vix_bb_position_20d": TI.bollinger(level, ax, "b", staged=True)["b_position"],
        "vix_extreme_low_21d": TI.extreme_flag(level, 0.1, 21, ax, low=True),
        "_vr": R.pct_change(level, 1, ax),
    })
    df = stage(df, {
        **{f"vix_vol_{w}d": R.realized_vol("_vr", w, ax) for w in (10, 21, 63)},
        **{f"vix_momentum_z_{w}d": R.zscore(f"vix_velocity_{w}d", 63, ax) for w in (10, 21)},
        "vix_accel_5d": R.diff("vix_velocity_5d", 5, ax),
    })
    return drop_moments(df)


def price_features(df: DataFrame, ax: Axis, price: str = "close") -> DataFrame:
    """Returns, trend, realised volatility and shape of an equity price; expects ``level_features``
    to have run (it shares the level's return column)."""
    df = stage(df, R.moments(price, (20,), ax))
    bb = TI.bollinger(price, ax, "b", staged=True)
    df = stage(df, {
        "spx_lag1": R.lag(price, 1, ax),
        **{f"spx_ret_{w}d": R.pct_change(price, w, ax) * 100 for w in (1, 5, 10, 21, 63)},
        "spx_vs_ma20": R.gap_of(price, 20), **{f"spx_vs_ma{w}": R.vs_average(price, w, ax) for w in (50, 200)},
        "bb_position_20d": bb["b_position"], "bb_width_20d": bb["b_width"], "_sr": R.pct_change(price, 1, ax),
    })
    df = stage(df, {
        **{f"spx_realized_vol_{w}d": R.realized_vol("_sr", w, ax) for w in (10, 21, 63)},
        **{f"spx_momentum_z_{w}d": R.zscore(f"spx_ret_{w}d", 63, ax) for w in (10, 21)},
        **{f"spx_vix_corr_{w}d": R.corr("_sr", "_vr", w, ax) for w in (21, 63, 126)},
        "spx_skew_21d": R.skew("_sr", 21, ax), "spx_kurt_21d": R.kurt("_sr", 21, ax),
    })
    df = TI.adx(TI.macd(TI.rsi(drop_moments(df), price, ax), price, ax), ax)
    rv = lambda w: f"spx_realized_vol_{w}d"
    return stage(df, {
        "spx_vol_ratio_10_21": ratio(rv(10), rv(21)), "spx_vol_ratio_10_63": ratio(rv(10), rv(63)),
        **{f"vix_vs_rv_{w}d": F.col("vix") - F.col(rv(w)) for w in (10, 21)},
        **{f"vix_rv_ratio_{w}d": ratio("vix", rv(w)) for w in (10, 21)},
        "rsi_regime": F.coalesce(cut("rsi_14", [0, 30, 70, 100]), F.lit(0)),
        "rsi_divergence": F.col("rsi_14") - R.mean("rsi_14", 21, ax),
        "trend_strength": F.abs("spx_vs_ma200"),
    })


def candle_features(df: DataFrame, ax: Axis) -> DataFrame:
    """Body, range, shadows, gap and rejection of daily bars."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rng, top, bottom = h - lo, F.greatest(o, c), F.least(o, c)
    df = stage(df, {
        "spx_body_size": F.abs(c - o), "spx_range": rng, "spx_range_pct": rng / nonzero(c) * 100, "spx_upper_shadow": h - top, "spx_lower_shadow": bottom - lo,
        "spx_close_position": (c - lo) / nonzero(rng), "spx_body_to_range": F.abs(c - o) / nonzero(rng), "spx_gap": o - R.lag("close", 1, ax),
        "spx_upper_rejection": (h - top) / nonzero(rng), "spx_lower_rejection": (bottom - lo) / nonzero(rng),
    })
    return stage(df, {"spx_gap_magnitude": F.abs("spx_gap"), "spx_range_expansion": F.col("spx_range") / nonzero(R.mean("spx_range", 21, ax))})


def transform_features(df: DataFrame, ax: Axis) -> DataFrame:
    """log1p of non-negative volatilities and flags for values beyond their yearly 95 % quantile."""
    logs = {f"{c}_log": F.log1p(clip(c, lo=0)) for c in ("vix_vol_21d", "spx_realized_vol_21d", "crude_oil_vol_21d") if c in df.columns}
    flags = {f"{c}_extreme_flag": TI.extreme_flag(c, 0.95, 252, ax, absolute=True) for c in ("vix_velocity_5d", "vix_accel_5d", "spx_gap", "spx_gap_magnitude") if c in df.columns}
    return stage(df, {**logs, **flags})


def interaction_features(df: DataFrame, ax: Axis) -> DataFrame:
    """Velocity x volatility, clustering, correlation breakage and credit x volatility."""
    have = set(df.columns)
    vv, rv = "vix_velocity_5d", "spx_realized_vol_63d"
    out = {}
    if {vv, rv} <= have:
        df = stage(df, {"_drv": R.diff(rv, 5, ax)})
        out.update({"vix_vel_spx_rv_ratio": ratio(vv, rv), "vix_spx_velocity_asymmetry": TI.velocity_asymmetry(vv, "_drv", 21, ax)})
    if {vv, "spx_ret_5d"} <= have:
        out["vix_vel_spx_ret_ratio"] = F.abs(vv) / nonzero(F.abs(F.col("spx_ret_5d")))
    if {"vix_zscore_252d", rv} <= have:
        out["vix_z_spx_rv_product"] = F.col("vix_zscore_252d") * F.col(rv)
    df = stage(df, out)
    if {"vix_vol_21d", "spx_realized_vol_21d"} <= have:
        df = stage(df, {"_vz": R.zscore("vix_vol_21d", 63, ax), "_sz": R.zscore("spx_realized_vol_21d", 63, ax)})
        df = stage(df, {
            "cross_asset_vol_cluster": flag((F.col("_vz") > 1) & (F.col("_sz") > 1)), "vol_correlation_breakage": flag(R.corr("_vz", "_sz", 21, ax) < -0.3),
        })
    if {"hy_spread", "vix"} <= have:
        df = stage(df, {"_cz": R.zscore("hy_spread", 252, ax), "_lz": R.zscore("vix", 63, ax)})
        df = stage(df, {
            "credit_vol_stress_composite": clip(F.col("_cz") * F.col("_lz"), -4, 4),
            "credit_vol_divergence": F.abs(R.rank_pct("_cz", 63, ax) - R.rank_pct("_lz", 63, ax)),
        })
    return df


def regime_conditional_features(df: DataFrame, names: list[str], regime: str = "vix_regime", classes: range = range(4)) -> DataFrame:
    """Feature x regime indicator products, and momentum less the regime's expected return."""
    prods = {f"{n}_x_regime_{k}": F.col(n) * flag(F.col(regime) == k) for n in names if n in df.columns for k in classes}
    adj = {f"{n}_regime_adj": F.col(n) - F.col("regime_expected_return_5d") for n in ("spx_ret_5d", "vix_velocity_5d") if n in df.columns and "regime_expected_return_5d" in df.columns}
    return stage(df, {**prods, **adj})
