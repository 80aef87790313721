"""Term-structure, options-flow, vol-of-vol and cross-asset volatility features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import rolling as R
from tidegrid.functions import technical as TI
from tidegrid.functions.scalar import clip, cut, flag, nonzero, ratio, row_mean, row_std
from tidegrid.functions.technical import stage
from tidegrid.plans.regimes import checked_regime


def half_z(c, w: int, ax: Axis) -> Column:
    """z-score that starts at half a window and is null without spread."""
    return R.zscore(c, w, ax, w // 2, floor=None)


def half_rank(c, w: int, ax: Axis) -> Column:
    return R.rank_pct(c, w, ax, w // 2) * 100


def term_structure(df: DataFrame, ax: Axis, near: str = "vix", mid: str = "vix3m", far: str = "vix6m") -> DataFrame:
    n, m, f = F.col(near), F.col(mid), F.col(far)
    df = stage(df, {
        "vix1m_vix3m_ratio": ratio(near, mid), "vix_term_slope_short": (m - n) / 90, "vix3m_vix6m_ratio": ratio(mid, far),
        "vix_term_slope_long": (f - m) / 90, "vix_term_curvature": 2 * m - n - f,
    })
    return stage(df, {
        "vix_term_slope_velocity_21d": R.diff("vix_term_slope_short", 21, ax), "vix_term_ratio_zscore_63d": R.zscore("vix1m_vix3m_ratio", 63, ax),
        "vix_term_curvature_zscore": R.zscore("vix_term_curvature", 63, ax),
    })


def _stress_part(c: str, base: float, width: float) -> Column:
    return clip((F.col(c) - base) / width, 0, 1)


def options_flow(df: DataFrame, ax: Axis) -> DataFrame:
    """Tail-hedge and bond-volatility indices with a stress composite; needs skew, vxth, vxtlt, vix."""
    t = F.col("vxtlt")
    df = stage(df, {
        "VXTH_change_21d": R.diff("vxth", 21, ax), "VXTH_zscore_63d": R.zscore("vxth", 63, ax), "vxth_vix_ratio": ratio("vxth", "vix"),
        "VXTLT_change_21d": R.diff("vxtlt", 21, ax), "VXTLT_zscore_63d": R.zscore("vxtlt", 63, ax), "VXTLT_velocity_10d": R.diff("vxtlt", 10, ax), "_d5_vxtlt": R.diff("vxtlt", 5, ax),
        "bond_vol_regime": checked_regime("vxtlt", [0, 5, 10, 15, 100], ax), "vxtlt_vix_ratio": ratio("vxtlt", "vix"), "vxtlt_vix_spread": t - F.col("vix"),
        **{f"VXTLT_percentile_{w}d": R.pct_below("vxtlt", w, ax) for w in (63, 126, 252)}, **{f"VXTLT_vs_ma{w}": R.vs_average("vxtlt", w, ax) for w in (21, 63)},
        "cboe_stress_composite": row_mean([_stress_part("skew", 130, 30), _stress_part("vxth", 15, 20), _stress_part("vxtlt", 8, 15)]),
    })
    return stage(df, {"VXTLT_acceleration_5d": R.diff("_d5_vxtlt", 5, ax), "cboe_stress_regime": checked_regime("cboe_stress_composite", [0, 0.33, 0.66, 1], ax)}).drop("_d5_vxtlt")


def vol_of_vol(df: DataFrame, ax: Axis, vv: str = "vvix", level: str = "vix") -> DataFrame:
    return stage(df, {
        **{f"vvix_ret_{w}d": R.pct_change(vv, w, ax) * 100 for w in (5, 10, 21)}, **{f"vvix_velocity_{w}d": R.diff(vv, w, ax) for w in (10, 21)},
        **{f"vvix_vs_ma{w}": R.vs_average(vv, w, ax) for w in (21, 63)}, **{f"vvix_zscore_{w}d": R.zscore(vv, w, ax) for w in (21, 63)},
        **{f"vvix_percentile_{w}d": R.pct_below(vv, w, ax) for w in (21, 63)}, "vvix_vix_ratio": ratio(vv, level), "vvix_vix_spread": F.col(vv) - F.col(level),
        "vol_of_vol_regime": checked_regime(vv, [0, 80, 110, 140, 300], ax),
    })


def currency_index(df: DataFrame, ax: Axis, c: str = "dxy") -> DataFrame:
    df = stage(df, {**R.moments(c, (20,), ax), **R.moments(c, (21, 63, 252), ax, half=True)})
    bb = TI.bollinger(c, ax, "b", staged=True)
    df = stage(df, {
        **{f"{c}_ret_{w}d": R.pct_change(c, w, ax) * 100 for w in (1, 5, 10, 21, 63)}, **{f"{c}_velocity_{w}d": R.diff(c, w, ax) for w in (5, 10, 21)},
        **{f"{c}_vs_ma{w}": R.vs_average(c, w, ax) for w in (21, 63, 252)}, **{f"{c}_zscore_{w}d": R.z_of(c, w, None) for w in (21, 63, 252)},
        **{f"{c}_percentile_{w}d": half_rank(c, w, ax) for w in (21, 63, 252)}, f"{c}_bb_position_20d": bb["b_position"], f"{c}_bb_width_20d": bb["b_width"],
        f"{c}_extreme_high": TI.extreme_flag(c, 0.90, 252, ax), f"{c}_extreme_low": TI.extreme_flag(c, 0.10, 252, ax, low=True), f"_r_{c}": R.pct_change(c, 1, ax),
    })
    return stage(df, {
        **{f"{c}_vol_{w}d": R.realized_vol(f"_r_{c}", w, ax) for w in (10, 21, 63)}, **{f"{c}_momentum_z_{w}d": half_z(f"{c}_velocity_{w}d", 63, ax) for w in (5, 10, 21)},
        f"{c}_accel_5d": R.diff(f"{c}_velocity_5d", 5, ax),
    }).drop(f"_r_{c}", *R.moments(c, (20, 21, 63, 252), ax))


def vol_index(df: DataFrame, ax: Axis, c: str, windows: tuple[int, ...], own_vol: tuple[int, ...] = (), averages: tuple[int, ...] = (), regime: list[float] | None = None, level: str | None = None) -> DataFrame:
    out = {
        **{f"{c}_ret_{w}d": R.pct_change(c, w, ax) * 100 for w in (5, 10, 21)}, **{f"{c}_velocity_{w}d": R.diff(c, w, ax) for w in (5, 10, 21)},
        **{f"{c}_zscore_{w}d": half_z(c, w, ax) for w in windows}, **{f"{c}_percentile_{w}d": half_rank(c, w, ax) for w in windows},
        **{f"{c}_vs_ma{w}": R.vs_average(c, w, ax) for w in averages}, f"_r_{c}": R.pct_change(c, 1, ax),
    }
    if regime:
        out[f"{c}_regime"] = cut(c, regime).cast("double")
    if level:
        out.update({f"{c}_vix_ratio": ratio(c, level), f"{c}_vix_spread": F.col(c) - F.col(level)})
    df = stage(df, out)
    more = {f"{c}_vol_{w}d": R.realized_vol(f"_r_{c}", w, ax) for w in own_vol}
    if level:
        more[f"{c}_vix_spread_zscore"] = half_z(f"{c}_vix_spread", 63, ax)
    return stage(df, more).drop(f"_r_{c}")


def commodity(df: DataFrame, ax: Axis, c: str, rets: tuple[int, ...], vols: tuple[int, ...], zs: tuple[int, ...], momentum: tuple[int, str] | None = None) -> DataFrame:
    """Returns, volatility, z-scores and an optional growth flag (window, flag name) of a price."""
    out = {**{f"{c}_ret_{w}d": R.pct_change(c, w, ax) * 100 for w in rets}, **{f"{c}_zscore_{w}d": half_z(c, w, ax) for w in zs}, f"_r_{c}": R.pct_change(c, 1, ax)}
    if momentum:
        out[f"{c}_momentum_{momentum[0]}d"] = R.diff(c, momentum[0], ax)
    df = stage(df, out)
    more = {f"{c}_vol_{w}d": R.realized_vol(f"_r_{c}", w, ax) for w in vols}
    if momentum:
        more[momentum[1]] = flag(F.col(f"{c}_momentum_{momentum[0]}d") > 0)
    return stage(df, more).drop(f"_r_{c}")


def cross_asset(df: DataFrame, ax: Axis, level: str | None = "vix") -> DataFrame:
    """Currency-metal co-movement, implied less realised volatility, growth concern and a
    multi-asset volatility stress; needs dxy, gold, copper, crude, ovx, gvz."""
    df = stage(df, {
        **{f"_{c}1": R.pct_change(c, 1, ax) for c in ("dxy", "gold", "crude")}, **{f"_{c}21": R.pct_change(c, 21, ax) for c in ("dxy", "gold", "copper")},
        **{f"_z_{c}": half_z(c, 63, ax) for c in ("ovx", "gvz", *([level] if level else []))},
    })
    zs = [f"_z_{c}" for c in ("ovx", "gvz", *([level] if level else []))]
    oil, metal = R.realized_vol("_crude1", 21, ax), R.realized_vol("_gold1", 21, ax)
    df = stage(df, {
        **{f"dxy_gold_corr_{w}d": R.corr("_dxy1", "_gold1", w, ax) for w in (21, 63, 126)},
        "dxy_gold_divergence": F.abs(R.rank_pct("_dxy21", 63, ax) - R.rank_pct("_gold21", 63, ax)),
        "dxy_gold_both_rally": flag((F.col("_dxy21") > 0) & (F.col("_gold21") > 0)), "growth_concern_signal": flag((F.col("_copper21") < 0) & (F.col("_dxy21") > 0)),
        "ovx_oil_rv_spread": F.col("ovx") - oil, "ovx_oil_rv_ratio": F.col("ovx") / nonzero(oil), "gvz_gold_rv_spread": F.col("gvz") - metal, "gvz_gold_rv_ratio": F.col("gvz") / nonzero(metal),
        "multi_asset_vol_stress": row_mean(zs), "vol_stress_dispersion": row_std(zs),
    })
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def commodity_regimes(df: DataFrame) -> DataFrame:
    """Currency regime, commodity volatility regime and the share of risk-on signals present."""
    signals = [flag(F.col("dxy_ret_21d") < 0), flag(F.col("copper_ret_21d") > 0), flag(F.col("gold_ret_21d") < 0)]
    return stage(df, {
        "dxy_regime_numeric": cut("dxy_percentile_252d", [0, 25, 75, 100]).cast("double"), "commodity_vol_regime": cut("ovx", [0, 20, 30, 45, 150]).cast("double"),
        "flight_to_safety_active": F.col("dxy_gold_both_rally"), "risk_on_score": (signals[0] + signals[1] + signals[2]) / 3.0,
    })
