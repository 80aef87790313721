"""Feature-pack queries, one per pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.plans import curve as CU
from tidegrid.plans import gates as GT
from tidegrid.plans import macro as MA
from tidegrid.plans import meta as ME
from tidegrid.plans import price as PR
from tidegrid.plans import regimes as RG
from tidegrid.plans import volatility as VO
from tidegrid.queries import sqlgen as S
from tidegrid.queries.events_futures import CONT_SQL, continuous
from tidegrid.queries.frames import AX, market, market_sql
from tidegrid.queries.registry import query, shaped
from tidegrid.queries.rolling import _macd_steps

ID = ["series_id", "ts"]
_RATIOS = ("vx_contango_pct", "vix1m_vix3m_ratio", "vix3m_vix6m_ratio", "cboe_stress_composite", "vx_curve_2_1_ratio", "vx_curve_3_2_ratio", "vx_curve_4_3_ratio", "vx2_vx1_ratio", "vx_curve_score", "vvix_vix_ratio", "vxth_vix_ratio", "vxtlt_vix_ratio")


def div(a, b):
    return f"({a} / nullif({b}, 0))"


def vs_ma(x, w):
    return f"(({x} - {S.mean(x, w)}) / nullif({S.mean(x, w)}, 0) * 100)"


def bb_pos(x):
    m, s = S.mean(x, 20), S.std(x, 20)
    inner = f"(({x} - ({m} - 2 * {s})) / nullif(({m} + 2 * {s}) - ({m} - 2 * {s}), 0))"
    return S.clip(inner, 0, 1)


def bb_width(x):
    m, s = S.mean(x, 20), S.std(x, 20)
    return f"((({m} + 2 * {s}) - ({m} - 2 * {s})) / nullif({m}, 0) * 100)"


def pct100(x, w):
    return f"({S.pct(x, w)} * 100)"


def half_z(x, w):
    return S.zscore_null(x, w, w // 2)


def half_rank(x, w):
    return f"({S.rank_pct(x, w, w // 2)} * 100)"


def expanding_rank(x):
    vals = f"list({x}) FILTER ({x} IS NOT NULL) {S.upto()}"
    return f"(CASE WHEN {x} IS NOT NULL THEN (len(list_filter({vals}, lambda v: v < {x})) + (len(list_filter({vals}, lambda v: v = {x})) + 1) / 2.0) / count({x}) {S.upto()} END)"


# --- F1 level and price ---------------------------------------------------------------------
def level_steps(st: S.Steps) -> S.Steps:
    st.add(
        **{f"vix_ret_{w}d": pct100("vix", w) for w in (1, 5, 10, 21)}, **{f"vix_velocity_{w}d": S.diff("vix", w) for w in (5, 10, 21)},
        **{f"vix_vs_ma{w}": vs_ma("vix", w) for w in (10, 21, 63, 252)}, **{f"vix_zscore_{w}d": S.zscore("vix", w) for w in (21, 63, 252)},
        **{f"vix_stretch_ma{w}": f"abs(vix - {S.mean('vix', w)})" for w in (21, 63)}, **{f"reversion_strength_{w}d": f"abs(vix - {S.mean('vix', w)}) / nullif({S.mean('vix', w)}, 0)" for w in (21, 63)},
        vix_bb_position_20d=bb_pos("vix"), vix_extreme_low_21d=S.flag(f"vix < {S.quantile('vix', 0.1, 21)}"), _vr=S.pct("vix", 1),
    )
    return st.add(**{f"vix_vol_{w}d": S.rvol("_vr", w) for w in (10, 21, 63)}, **{f"vix_momentum_z_{w}d": S.zscore(f"vix_velocity_{w}d", 63) for w in (10, 21)}, vix_accel_5d=S.diff("vix_velocity_5d", 5))


LEVEL = (
    [f"vix_ret_{w}d" for w in (1, 5, 10, 21)] + [f"vix_velocity_{w}d" for w in (5, 10, 21)] + [f"vix_vs_ma{w}" for w in (10, 21, 63, 252)] + [f"vix_zscore_{w}d" for w in (21, 63, 252)]
    + [f"vix_stretch_ma{w}" for w in (21, 63)] + [f"reversion_strength_{w}d" for w in (21, 63)] + ["vix_bb_position_20d"] + [f"vix_vol_{w}d" for w in (10, 21, 63)] + [f"vix_momentum_z_{w}d" for w in (10, 21)] + ["vix_accel_5d"]
)


def price_steps(st: S.Steps) -> S.Steps:
    st.add(
        spx_lag1=S.lag("close", 1), **{f"spx_ret_{w}d": pct100("close", w) for w in (1, 5, 10, 21, 63)}, **{f"spx_vs_ma{w}": vs_ma("close", w) for w in (20, 50, 200)},
        bb_position_20d=bb_pos("close"), bb_width_20d=bb_width("close"), _sr=S.pct("close", 1),
    )
    return st.add(
        **{f"spx_realized_vol_{w}d": S.rvol("_sr", w) for w in (10, 21, 63)}, **{f"spx_momentum_z_{w}d": S.zscore(f"spx_ret_{w}d", 63) for w in (10, 21)},
        **{f"spx_vix_corr_{w}d": S.corr("_sr", "_vr", w) for w in (21, 63, 126)}, spx_skew_21d=S.guard("_sr", 21, f"skewness(_sr) {S.frame(21)}"), spx_kurt_21d=S.guard("_sr", 21, f"kurtosis(_sr) {S.frame(21)}"),
    )


PRICE = (
    ["spx_lag1"] + [f"spx_ret_{w}d" for w in (1, 5, 10, 21, 63)] + [f"spx_vs_ma{w}" for w in (20, 50, 200)] + ["bb_position_20d", "bb_width_20d"] + [f"spx_realized_vol_{w}d" for w in (10, 21, 63)]
    + [f"spx_momentum_z_{w}d" for w in (10, 21)] + [f"spx_vix_corr_{w}d" for w in (21, 63, 126)] + ["spx_skew_21d", "spx_kurt_21d", "spx_vol_ratio_10_21", "spx_vol_ratio_10_63", "vix_vs_rv_10d", "vix_vs_rv_21d", "vix_rv_ratio_10d", "vix_rv_ratio_21d", "trend_strength"]
)


@query("F1", level_steps(S.Steps(market_sql(["vix"]))).out(LEVEL, ["vix_extreme_low_21d"]))
def pack_level(spark, sf_dir):
    return shaped(PR.level_features(market(spark, sf_dir, ["vix"]), AX), ID + LEVEL + ["vix_extreme_low_21d"])


_F1P = price_steps(level_steps(S.Steps(market_sql(["vix"])))).add(
    spx_vol_ratio_10_21=div("spx_realized_vol_10d", "spx_realized_vol_21d"), spx_vol_ratio_10_63=div("spx_realized_vol_10d", "spx_realized_vol_63d"),
    **{f"vix_vs_rv_{w}d": f"vix - spx_realized_vol_{w}d" for w in (10, 21)}, **{f"vix_rv_ratio_{w}d": div("vix", f"spx_realized_vol_{w}d") for w in (10, 21)}, trend_strength="abs(spx_vs_ma200)",
)


@query("F1", _F1P.out(PRICE))
def pack_price(spark, sf_dir):
    return shaped(PR.price_features(PR.level_features(market(spark, sf_dir, ["vix"]), AX), AX), ID + PRICE)


# --- F2 candles -----------------------------------------------------------------------------
_top, _bot = "greatest(open, close)", "least(open, close)"
CANDLE = ["spx_body_size", "spx_range", "spx_range_pct", "spx_upper_shadow", "spx_lower_shadow", "spx_close_position", "spx_body_to_range", "spx_gap", "spx_upper_rejection", "spx_lower_rejection", "spx_gap_magnitude", "spx_range_expansion"]


def candle_steps(st: S.Steps) -> S.Steps:
    return st.add(
        spx_body_size="abs(close - open)", spx_range="high - low", spx_range_pct=div("(high - low)", "close") + " * 100", spx_upper_shadow=f"high - {_top}", spx_lower_shadow=f"{_bot} - low",
        spx_close_position=div("(close - low)", "high - low"), spx_body_to_range=div("abs(close - open)", "high - low"), spx_gap=f"open - {S.lag('close', 1)}",
        spx_upper_rejection=div(f"(high - {_top})", "high - low"), spx_lower_rejection=div(f"({_bot} - low)", "high - low"),
    ).add(spx_gap_magnitude="abs(spx_gap)", spx_range_expansion=div("spx_range", S.mean("spx_range", 21)))


@query("F2", candle_steps(S.Steps(market_sql([]))).out(CANDLE))
def pack_candles(spark, sf_dir):
    return shaped(PR.candle_features(market(spark, sf_dir, []), AX), ID + CANDLE)


# --- F3 - F5 regimes ------------------------------------------------------------------------
_L = [0, 15.57, 23.36, 31.16, 100]
_T = [0, 114.68, 119.61, 127.27, 200]


def by_class(x, vals):
    return f"(CASE {x} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(vals)) + " END)::DOUBLE"


def runs(st: S.Steps, state: str, name: str) -> S.Steps:
    st.add(**{f"{name}_change_flag": f"(CASE WHEN {S.lag(state, 1)} <> {state} THEN 1 ELSE 0 END)"}).add(**{f"{name}_run": f"sum({name}_change_flag) {S.upto()}"})
    return st.add(**{f"days_in_{name}": f"row_number() OVER (PARTITION BY series_id, {name}_run ORDER BY ts)"})


_F3V = {
    "regime_expected_return_5d": [2.331, -0.813, -3.475, -6.487], "regime_median_return_5d": [0.990, -1.750, -3.787, -7.605], "regime_return_std_5d": [12.391, 13.158, 14.130, 16.984],
    "regime_prob_up_5d": [0.541, 0.435, 0.380, 0.335], "regime_vol_of_vol": [5.95, 6.53, 7.44, 10.36], "regime_spike_prob": [0.0700, 0.0578, 0.0437, 0.0605],
    "regime_prob_stay": [0.8726, 0.7365, 0.7320, 0.7209], "regime_prob_crisis": [0.0002, 0.0022, 0.0340, 0.7209], "regime_prob_elevated": [0.0049, 0.1027, 0.7320, 0.2791],
}
_F3 = S.Steps(market_sql(["vix"])).add(vix_regime=S.cut("vix", _L, lowest=True), lr="CASE WHEN vix < 15.57 THEN 0 WHEN vix < 23.36 THEN 1 WHEN vix < 31.16 THEN 2 ELSE 3 END").add(
    regime_distance_to_boundary="least(abs(vix), abs(vix - 15.57), abs(vix - 23.36), abs(vix - 31.16), abs(vix - 100))",
    regime_within_regime_percentile=f"least(greatest((vix - {by_class('lr', [9.14, 16.77, 24.41, 39.68])}) / {by_class('lr', [7.62, 7.63, 15.25, 43.01])}, 0), 1)",
    **{k: by_class("vix_regime", v) for k, v in _F3V.items()},
)
runs(_F3, "vix_regime", "regime").add(time_in_regime_pct=f"days_in_regime / {by_class('vix_regime', [3, 2, 2, 2])}")
_F3D = ["regime_distance_to_boundary", "regime_within_regime_percentile", *_F3V, "time_in_regime_pct"]


@query("F3 J10 P9 P10", _F3.out(_F3D, ["vix_regime", "regime_change_flag", "days_in_regime"]))
def pack_regime(spark, sf_dir):
    return shaped(RG.regime_pack(market(spark, sf_dir, ["vix"]), AX), ID + _F3D + ["vix_regime", "regime_change_flag", "days_in_regime"])


_zg = S.upto("series_id, skew_regime_numeric")
_F4 = S.Steps(market_sql(["vix", "skew"])).add(skew_regime_numeric=S.cut("skew", _T, lowest=True), skew_vix_ratio=div("skew", "vix")).add(
    skew_complacency_flag=S.flag("skew < 114.68"), skew_extreme_tail_flag=S.flag("skew > 127.27"), skew_expected_5d_return=by_class("skew_regime_numeric", [0.878, 0.521, -0.255, -1.110]),
    skew_regime_behavior="CASE skew_regime_numeric WHEN 0 THEN 'MOMENTUM' WHEN 1 THEN 'MOMENTUM' WHEN 2 THEN 'NEUTRAL' WHEN 3 THEN 'MEAN_REVERSION' END",
    skew_distance_to_boundary="least(abs(skew), abs(skew - 114.68), abs(skew - 119.61), abs(skew - 127.27), abs(skew - 200))",
    skew_regime_displacement=f"(skew - {S.mean('skew', 63, 1)}) / nullif({S.mean('skew', 63, 1)}, 0) * 100", skew_percentile_63d=S.rank_pct("skew", 63, 1), skew_percentile_252d=S.rank_pct("skew", 252, 1),
    skew_vix_ratio_percentile_252d=S.rank_pct("skew_vix_ratio", 252, 1), skew_vix_ratio_velocity_10d=S.diff("skew_vix_ratio", 10), skew_vix_ratio_regime=S.cut("skew_vix_ratio", [0, 5.226, 8.968, 100], lowest=True),
    skew_within_regime_zscore=f"CASE WHEN stddev_samp(skew) {_zg} = 0 THEN 0 ELSE (skew - avg(skew) {_zg}) / stddev_samp(skew) {_zg} END",
)
runs(_F4, "skew_regime_numeric", "skew_regime")
_F4D = ["skew_vix_ratio", "skew_expected_5d_return", "skew_distance_to_boundary", "skew_regime_displacement", "skew_percentile_63d", "skew_percentile_252d", "skew_vix_ratio_percentile_252d", "skew_vix_ratio_velocity_10d", "skew_vix_ratio_regime", "skew_within_regime_zscore"]
_F4I = ["skew_regime_numeric", "skew_complacency_flag", "skew_extreme_tail_flag", "days_in_skew_regime", "skew_regime_change_flag"]


@query("F4 W33", _F4.out(_F4D, _F4I, texts=["skew_regime_behavior"]))
def pack_tail_regime(spark, sf_dir):
    return shaped(RG.tail_regime_pack(market(spark, sf_dir, ["vix", "skew"]), AX), ID + _F4D + _F4I + ["skew_regime_behavior"])


_D, _V = "vix_skew_divergence", "vix_skew_velocity_corr_21d"
_F5 = S.Steps(market_sql(["vix", "skew"])).add(lr=S.cut("vix", _L, lowest=True), tr=S.cut("skew", _T, lowest=True), dl=S.diff("vix", 5), dt=S.diff("skew", 5)).add(
    vix_skew_joint_regime="lr * 4 + tr", vix_skew_divergence="abs((vix - 19.82) / 8.39 - (skew - 122.65) / 11.32)", vix_skew_velocity_corr_21d=S.corr("dl", "dt", 21, 1), vix_skew_level_corr_21d=S.corr("vix", "skew", 21, 1),
    vix_boundary_distance="least(abs(vix), abs(vix - 15.57), abs(vix - 23.36), abs(vix - 31.16), abs(vix - 100))", skew_boundary_distance="least(abs(skew), abs(skew - 114.68), abs(skew - 119.61), abs(skew - 127.27), abs(skew - 200))",
    vix_regime_transition_direction=f"coalesce(sign({S.diff('lr', 1)}), 0)", skew_regime_transition_direction=f"coalesce(sign({S.diff('tr', 1)}), 0)",
).add(
    joint_regime_expected_return="coalesce(" + by_class("vix_skew_joint_regime", RG.JOINT_MEAN) + ", 0)", joint_regime_volatility="coalesce(" + by_class("vix_skew_joint_regime", RG.JOINT_STD) + ", 0)",
    joint_regime_frequency="coalesce(" + by_class("vix_skew_joint_regime", RG.JOINT_FREQ) + ", 0)", joint_regime_correlation="coalesce(" + by_class("vix_skew_joint_regime", RG.JOINT_CORR) + ", 0)",
    vix_skew_divergence_zscore_63d=S.zscore_null(_D, 63, 1), vix_skew_divergence_extreme=S.flag(f"{_D} > {S.quantile(_D, 0.85, 252, 1)}"), vix_skew_synchronized=S.flag(f"{_D} < {S.quantile(_D, 0.25, 252, 1)}"),
    vix_skew_correlation_breakdown=S.flag(f"{_V} < {S.quantile(_V, 0.10, 252, 1)}"), vix_skew_correlation_regime=S.cut(_V, [-1, -0.5, 0.5, 1], lowest=True),
    both_near_boundary_flag=S.flag("vix_boundary_distance < 2 AND skew_boundary_distance < 5"), both_regimes_changed_flag=S.flag("vix_regime_transition_direction <> 0 AND skew_regime_transition_direction <> 0"),
)
runs(_F5, "vix_skew_joint_regime", "joint_regime")
_F5D = [_D, _V, "vix_skew_level_corr_21d", "vix_boundary_distance", "skew_boundary_distance", "joint_regime_expected_return", "joint_regime_volatility", "joint_regime_frequency", "joint_regime_correlation", "vix_skew_divergence_zscore_63d"]
_F5I = ["vix_skew_joint_regime", "vix_regime_transition_direction", "skew_regime_transition_direction", "vix_skew_divergence_extreme", "vix_skew_synchronized", "both_near_boundary_flag", "both_regimes_changed_flag", "joint_regime_change_flag", "days_in_joint_regime"]


@query("F5 W27 W37", _F5.out(_F5D, _F5I))
def pack_joint_regime(spark, sf_dir):
    return shaped(RG.joint_pack(market(spark, sf_dir, ["vix", "skew"]), AX), ID + _F5D + _F5I)


# --- F6 - F8 --------------------------------------------------------------------------------
_F6C = ["vix1m_vix3m_ratio", "vix_term_slope_short", "vix3m_vix6m_ratio", "vix_term_slope_long", "vix_term_curvature", "vix_term_slope_velocity_21d", "vix_term_ratio_zscore_63d", "vix_term_curvature_zscore"]


@query(
    "F6",
    S.Steps(market_sql(["vix", "vix3m", "vix6m"])).add(vix1m_vix3m_ratio=div("vix", "vix3m"), vix_term_slope_short="(vix3m - vix) / 90", vix3m_vix6m_ratio=div("vix3m", "vix6m"), vix_term_slope_long="(vix6m - vix3m) / 90", vix_term_curvature="2 * vix3m - vix - vix6m")
    .add(vix_term_slope_velocity_21d=S.diff("vix_term_slope_short", 21), vix_term_ratio_zscore_63d=S.zscore("vix1m_vix3m_ratio", 63), vix_term_curvature_zscore=S.zscore("vix_term_curvature", 63)).out(_F6C, fine=_RATIOS),
)
def pack_term_structure(spark, sf_dir):
    return shaped(VO.term_structure(market(spark, sf_dir, ["vix", "vix3m", "vix6m"]), AX), ID + _F6C, fine=_RATIOS)


def c01(x, a, b):
    return S.clip(f"(({x} - {a}) / {b}::DOUBLE)", 0, 1)


_F7D = ["VXTH_change_21d", "VXTH_zscore_63d", "vxth_vix_ratio", "VXTLT_change_21d", "VXTLT_zscore_63d", "VXTLT_velocity_10d", "vxtlt_vix_ratio", "vxtlt_vix_spread", "VXTLT_percentile_63d", "VXTLT_percentile_126d", "VXTLT_percentile_252d", "VXTLT_vs_ma21", "VXTLT_vs_ma63", "cboe_stress_composite", "VXTLT_acceleration_5d"]
_F7 = S.Steps(market_sql(["vix", "skew", "vxth", "vxtlt"])).add(
    VXTH_change_21d=S.diff("vxth", 21), VXTH_zscore_63d=S.zscore("vxth", 63), vxth_vix_ratio=div("vxth", "vix"), VXTLT_change_21d=S.diff("vxtlt", 21), VXTLT_zscore_63d=S.zscore("vxtlt", 63), VXTLT_velocity_10d=S.diff("vxtlt", 10), d5=S.diff("vxtlt", 5),
    bond_vol_regime=S.checked_regime("vxtlt", [0, 5, 10, 15, 100]), vxtlt_vix_ratio=div("vxtlt", "vix"), vxtlt_vix_spread="vxtlt - vix", **{f"VXTLT_percentile_{w}d": S.pct_below("vxtlt", w) for w in (63, 126, 252)},
    **{f"VXTLT_vs_ma{w}": vs_ma("vxtlt", w) for w in (21, 63)}, cboe_stress_composite=S.nanmean([c01("skew", 130, 30), c01("vxth", 15, 20), c01("vxtlt", 8, 15)]),
).add(VXTLT_acceleration_5d=S.diff("d5", 5), cboe_stress_regime=S.checked_regime("cboe_stress_composite", [0, 0.33, 0.66, 1]))


@query("F7 P12", _F7.out(_F7D, ["bond_vol_regime", "cboe_stress_regime"], fine=_RATIOS))
def pack_options_flow(spark, sf_dir):
    return shaped(VO.options_flow(market(spark, sf_dir, ["vix", "skew", "vxth", "vxtlt"]), AX), ID + _F7D + ["bond_vol_regime", "cboe_stress_regime"], fine=_RATIOS)


_F8D = [f"vvix_ret_{w}d" for w in (5, 10, 21)] + [f"vvix_velocity_{w}d" for w in (10, 21)] + [f"vvix_{k}{w}{d}" for k, d in (("vs_ma", ""), ("zscore_", "d"), ("percentile_", "d")) for w in (21, 63)] + ["vvix_vix_ratio", "vvix_vix_spread"]


@query(
    "F8",
    S.Steps(market_sql(["vix", "vvix"])).add(
        **{f"vvix_ret_{w}d": pct100("vvix", w) for w in (5, 10, 21)}, **{f"vvix_velocity_{w}d": S.diff("vvix", w) for w in (10, 21)}, **{f"vvix_vs_ma{w}": vs_ma("vvix", w) for w in (21, 63)},
        **{f"vvix_zscore_{w}d": S.zscore("vvix", w) for w in (21, 63)}, **{f"vvix_percentile_{w}d": S.pct_below("vvix", w) for w in (21, 63)}, vvix_vix_ratio=div("vvix", "vix"), vvix_vix_spread="vvix - vix",
        vol_of_vol_regime=S.checked_regime("vvix", [0, 80, 110, 140, 300]),
    ).out(_F8D, ["vol_of_vol_regime"]),
)
def pack_vol_of_vol(spark, sf_dir):
    return shaped(VO.vol_of_vol(market(spark, sf_dir, ["vix", "vvix"]), AX), ID + _F8D + ["vol_of_vol_regime"])


# --- F9 - F15 -------------------------------------------------------------------------------
_F9D = ["claims_4wk_ma", "claims_velocity_4w", "claims_zscore_52w", "claims_percentile_52w", "claims_velocity_zscore"]
_F10D = ["fin_stress_index", "stress_velocity_4w", "stress_zscore_52w"]


@query(
    "F9 F10",
    S.Steps(market_sql(["stress"])).add(
        claims_4wk_ma=S.mean("claims", 20), claims_velocity_4w=S.diff("claims", 20), claims_zscore_52w=S.zscore("claims", 252), claims_percentile_52w=S.pct_below("claims", 252), claims_regime=S.checked_regime("claims", [0, 250000, 350000, 500000, 1000000]),
        fin_stress_index="stress", stress_velocity_4w=S.diff("stress", 20), stress_zscore_52w=S.zscore("stress", 252), stress_extreme=S.flag(f"stress > {S.quantile('stress', 0.9, 252)}"), stress_regime=S.checked_regime("stress", [-5, -1, 0, 2, 10]),
    ).add(claims_velocity_zscore=S.zscore("claims_velocity_4w", 63)).out(_F9D + _F10D, ["claims_regime", "stress_extreme", "stress_regime"], digits=4),
)
def pack_labour_and_stress(spark, sf_dir):
    df = MA.stress(MA.labour(market(spark, sf_dir, ["stress"]), AX), AX)
    return shaped(df, ID + _F9D + _F10D + ["claims_regime", "stress_extreme", "stress_regime"], digits=4)


_CR = ["hy", "hy_bb", "hy_b", "hy_ccc", "ig"]
_F11D = ["hy_spread", "hy_bb_spread", "hy_b_spread", "hy_ccc_spread", "hy_velocity_21d", "hy_bb_velocity_21d", "hy_b_velocity_21d", "hy_ccc_velocity_21d", "hy_zscore_252d", "credit_quality_spread", "ig_hy_spread", "credit_stress_composite"]


@query(
    "F11",
    S.Steps(market_sql(_CR)).add(
        hy_spread="hy", hy_bb_spread="hy_bb", hy_b_spread="hy_b", hy_ccc_spread="hy_ccc", hy_velocity_21d=S.diff("hy", 21), hy_bb_velocity_21d=S.diff("hy_bb", 21), hy_b_velocity_21d=S.diff("hy_b", 21), hy_ccc_velocity_21d=S.diff("hy_ccc", 21),
        hy_zscore_252d=S.zscore("hy", 252), credit_quality_spread="hy_ccc - hy_bb", ig_hy_spread="hy - ig",
    ).add(credit_widening_regime=S.flag(f"credit_quality_spread > {S.quantile('credit_quality_spread', 0.8, 63)}"), credit_stress_composite=S.pct_below("ig_hy_spread", 252)).out(_F11D, ["credit_widening_regime"]),
)
def pack_credit(spark, sf_dir):
    return shaped(MA.credit(market(spark, sf_dir, _CR), AX), ID + _F11D + ["credit_widening_regime"])


_Y = ["y3m", "y2y", "y5y", "y10y", "y30y", "y6m"]
_SP = ["yield_10y2y", "yield_10y3m", "yield_2y3m"]
_F12D = (
    _SP + ["yield_5y2y", "yield_30y10y", "yield_curve_level", "yield_curve_curvature", "yield_10y2y_zscore", "yield_curve_level_zscore", "yield_curve_curvature_zscore"]
    + [f"{s}_{k}" for s in _SP for k in ("velocity_10d", "velocity_21d", "velocity_63d", "vs_ma63", "percentile_252d", "acceleration")]
    + ["yield_10y2y_inversion_depth", "yield_10y3m_inversion_depth", "6m_vol_63d", "10y_vol_63d", "30y_vol_63d", "yield_curve_vol_avg", "yield_curve_vol_dispersion"]
)
_vols = ['"6m_vol_63d"', '"10y_vol_63d"', '"30y_vol_63d"']
_F12 = S.Steps(market_sql(_Y)).add(
    yield_10y2y="y10y - y2y", yield_10y3m="y10y - y3m", yield_2y3m="y2y - y3m", yield_5y2y="y5y - y2y", yield_curve_curvature="2 * y5y - y2y - y10y", yield_30y10y="y30y - y10y",
    yield_curve_level=S.nanmean(["y3m", "y2y", "y5y", "y10y", "y30y"]), **{f"d_{c}": S.diff(c, 1) for c in ("y6m", "y10y", "y30y")},
).add(
    yield_10y2y_zscore=S.zscore("yield_10y2y", 252), yield_curve_level_zscore=S.zscore("yield_curve_level", 252), yield_curve_curvature_zscore=S.zscore("yield_curve_curvature", 252),
    **{f"{s}_velocity_{w}d": S.diff(s, w) for s in _SP for w in (10, 21, 63)}, **{f"{s}_vs_ma63": f"{s} - {S.mean(s, 63)}" for s in _SP}, **{f"{s}_percentile_252d": S.pct_below(s, 252) for s in _SP},
    **{f"{s}_inversion_depth": f"CASE WHEN {s} IS NOT NULL THEN abs(least({s}, 0)) END" for s in _SP[:2]}, **{f"{c[1:]}_vol_63d": f"{S.std(f'd_{c}', 63)} * sqrt(252.0)" for c in ("y6m", "y10y", "y30y")},
).add(**{f"{s}_acceleration": S.diff(f"{s}_velocity_10d", 10) for s in _SP}, yield_curve_vol_avg=S.nanmean(_vols), yield_curve_vol_dispersion=S.nanstd(_vols))


@query("F12", _F12.out(_F12D))
def pack_yields(spark, sf_dir):
    return shaped(MA.yields(market(spark, sf_dir, _Y), AX), ID + _F12D)


@query(
    "F13",
    S.Steps(market_sql(["vix3m", "y30y", "y2y", "y10y"])).add(picked="CASE WHEN avg((vix3m IS NOT NULL)::INT) OVER (PARTITION BY series_id) < 0.9999 THEN y2y ELSE vix3m END", kept="CASE WHEN avg((y30y IS NOT NULL)::INT) OVER (PARTITION BY series_id) < 0.5 THEN y10y ELSE y30y END").out(["picked", "kept"]),
)
def yield_source_choice(spark, sf_dir):
    df = market(spark, sf_dir, ["vix3m", "y30y", "y2y", "y10y"])
    return shaped(df.withColumns({"picked": MA.pick_source("vix3m", "y2y", AX, 0.9999), "kept": MA.pick_source("y30y", "y10y", AX)}), ID + ["picked", "kept"])


_F14D = ["gold_lag1", "gold_zscore_63d", "gold_ret_10d", "gold_ret_21d", "gold_ret_63d", "cpi_lag1", "cpi_zscore_63d", "cpi_change_10d", "cpi_change_21d", "cpi_change_63d", "cl1_cl2_velocity_5d", "cl1_cl2_zscore_63d", "crude_oil_ret_10d", "crude_oil_ret_21d", "crude_oil_ret_63d", "crude_oil_zscore_63d", "crude_oil_vol_21d"]
_F14 = S.Steps(market_sql(["gold", "crude", "copper", "hy"])).add(cl_spread="(crude - copper) / 10", _r=S.pct("crude", 1)).add(
    gold_lag1=S.lag("gold", 1), gold_zscore_63d=S.zscore("gold", 63), **{f"gold_ret_{w}d": pct100("gold", w) for w in (10, 21, 63)}, cpi_lag1=S.lag("hy", 1), cpi_zscore_63d=S.zscore("hy", 63), **{f"cpi_change_{w}d": S.diff("hy", w) for w in (10, 21, 63)},
    cl1_cl2_velocity_5d=S.diff("cl_spread", 5), cl1_cl2_zscore_63d=S.zscore("cl_spread", 63), oil_term_regime=S.checked_regime("cl_spread", [-10, -1, 0, 2, 20]), **{f"crude_oil_ret_{w}d": pct100("crude", w) for w in (10, 21, 63)},
    crude_oil_zscore_63d=S.zscore("crude", 63), crude_oil_vol_21d=S.rvol("_r", 21),
)


@query("F14 F15 W4", _F14.out(_F14D, ["oil_term_regime"]))
def pack_macro_and_spread(spark, sf_dir):
    df = market(spark, sf_dir, ["gold", "crude", "copper", "hy"]).withColumn("cl_spread", (F.col("crude") - F.col("copper")) / 10)
    df = MA.macro_level(MA.macro_level(df, AX, "gold", "gold"), AX, "hy", "cpi", relative=False)
    return shaped(MA.commodity_spread(df, AX), ID + _F14D + ["oil_term_regime"])


# --- F16 - F20 ------------------------------------------------------------------------------
def currency_steps(st: S.Steps) -> S.Steps:
    st.add(
        **{f"dxy_ret_{w}d": pct100("dxy", w) for w in (1, 5, 10, 21, 63)}, **{f"dxy_velocity_{w}d": S.diff("dxy", w) for w in (5, 10, 21)}, **{f"dxy_vs_ma{w}": vs_ma("dxy", w) for w in (21, 63, 252)},
        **{f"dxy_zscore_{w}d": half_z("dxy", w) for w in (21, 63, 252)}, **{f"dxy_percentile_{w}d": half_rank("dxy", w) for w in (21, 63, 252)}, dxy_bb_position_20d=bb_pos("dxy"), dxy_bb_width_20d=bb_width("dxy"),
        dxy_extreme_high=S.flag(f"dxy > {S.quantile('dxy', 0.9, 252)}"), dxy_extreme_low=S.flag(f"dxy < {S.quantile('dxy', 0.1, 252)}"), _r=S.pct("dxy", 1),
    )
    return st.add(**{f"dxy_vol_{w}d": S.rvol("_r", w) for w in (10, 21, 63)}, **{f"dxy_momentum_z_{w}d": half_z(f"dxy_velocity_{w}d", 63) for w in (5, 10, 21)}, dxy_accel_5d=S.diff("dxy_velocity_5d", 5))


_F16D = (
    [f"dxy_ret_{w}d" for w in (1, 5, 10, 21, 63)] + [f"dxy_velocity_{w}d" for w in (5, 10, 21)] + [f"dxy_vs_ma{w}" for w in (21, 63, 252)] + [f"dxy_{k}_{w}d" for k in ("zscore", "percentile") for w in (21, 63, 252)]
    + ["dxy_bb_position_20d", "dxy_bb_width_20d"] + [f"dxy_vol_{w}d" for w in (10, 21, 63)] + [f"dxy_momentum_z_{w}d" for w in (5, 10, 21)] + ["dxy_accel_5d"]
)


@query("F16", currency_steps(S.Steps(market_sql(["dxy"]))).out(_F16D, ["dxy_extreme_high", "dxy_extreme_low"]))
def pack_currency(spark, sf_dir):
    return shaped(VO.currency_index(market(spark, sf_dir, ["dxy"]), AX), ID + _F16D + ["dxy_extreme_high", "dxy_extreme_low"])


_F17D = [f"ovx_{k}_{w}d" for k in ("ret", "velocity") for w in (5, 10, 21)] + [f"ovx_{k}_{w}d" for k in ("zscore", "percentile") for w in (21, 63, 252)] + ["ovx_vs_ma21", "ovx_vs_ma63", "ovx_regime", "ovx_vix_ratio", "ovx_vix_spread", "ovx_vol_10d", "ovx_vol_21d", "ovx_vix_spread_zscore"] + [f"gvz_{k}_{w}d" for k in ("zscore", "percentile") for w in (21, 63)]
_F17 = S.Steps(market_sql(["ovx", "gvz", "vix"])).add(
    **{f"ovx_ret_{w}d": pct100("ovx", w) for w in (5, 10, 21)}, **{f"ovx_velocity_{w}d": S.diff("ovx", w) for w in (5, 10, 21)}, **{f"ovx_zscore_{w}d": half_z("ovx", w) for w in (21, 63, 252)}, **{f"ovx_percentile_{w}d": half_rank("ovx", w) for w in (21, 63, 252)},
    **{f"ovx_vs_ma{w}": vs_ma("ovx", w) for w in (21, 63)}, _r=S.pct("ovx", 1), ovx_regime=S.cut("ovx", [0, 20, 30, 45, 150]), ovx_vix_ratio=div("ovx", "vix"), ovx_vix_spread="ovx - vix", **{f"gvz_zscore_{w}d": half_z("gvz", w) for w in (21, 63)}, **{f"gvz_percentile_{w}d": half_rank("gvz", w) for w in (21, 63)},
).add(**{f"ovx_vol_{w}d": S.rvol("_r", w) for w in (10, 21)}, ovx_vix_spread_zscore=half_z("ovx_vix_spread", 63))


@query("F17", _F17.out(_F17D))
def pack_vol_indices(spark, sf_dir):
    df = VO.vol_index(market(spark, sf_dir, ["ovx", "gvz", "vix"]), AX, "ovx", (21, 63, 252), (10, 21), (21, 63), [0, 20, 30, 45, 150], "vix")
    return shaped(VO.vol_index(df, AX, "gvz", (21, 63)), ID + _F17D)


_F18D = [f"gold_ret_{w}d" for w in (5, 10, 21, 63)] + [f"gold_vol_{w}d" for w in (10, 21, 63)] + [f"gold_zscore_{w}d" for w in (21, 63, 252)] + ["gold_momentum_21d"] + [f"natgas_ret_{w}d" for w in (5, 10, 21)] + ["natgas_vol_21d", "natgas_zscore_21d", "natgas_zscore_63d"] + [f"copper_ret_{w}d" for w in (5, 10, 21, 63)] + [f"copper_zscore_{w}d" for w in (21, 63, 252)] + ["copper_momentum_63d"]
_F18 = S.Steps(market_sql(["gold", "natgas", "copper"])).add(
    **{f"gold_ret_{w}d": pct100("gold", w) for w in (5, 10, 21, 63)}, **{f"gold_zscore_{w}d": half_z("gold", w) for w in (21, 63, 252)}, g=S.pct("gold", 1), n=S.pct("natgas", 1), gold_momentum_21d=S.diff("gold", 21),
    **{f"natgas_ret_{w}d": pct100("natgas", w) for w in (5, 10, 21)}, **{f"natgas_zscore_{w}d": half_z("natgas", w) for w in (21, 63)}, **{f"copper_ret_{w}d": pct100("copper", w) for w in (5, 10, 21, 63)}, **{f"copper_zscore_{w}d": half_z("copper", w) for w in (21, 63, 252)},
    copper_momentum_63d=S.diff("copper", 63),
).add(**{f"gold_vol_{w}d": S.rvol("g", w) for w in (10, 21, 63)}, natgas_vol_21d=S.rvol("n", 21), gold_regime=S.flag("gold_momentum_21d > 0"), copper_economic_signal=S.flag("copper_momentum_63d > 0"))


@query("F18", _F18.out(_F18D, ["gold_regime", "copper_economic_signal"]))
def pack_commodities(spark, sf_dir):
    df = VO.commodity(market(spark, sf_dir, ["gold", "natgas", "copper"]), AX, "gold", (5, 10, 21, 63), (10, 21, 63), (21, 63, 252), (21, "gold_regime"))
    df = VO.commodity(VO.commodity(df, AX, "natgas", (5, 10, 21), (21,), (21, 63)), AX, "copper", (5, 10, 21, 63), (), (21, 63, 252), (63, "copper_economic_signal"))
    return shaped(df, ID + _F18D + ["gold_regime", "copper_economic_signal"])


_X = ["dxy", "gold", "copper", "crude", "ovx", "gvz", "vix"]
_F19D = ["dxy_gold_corr_21d", "dxy_gold_corr_63d", "dxy_gold_corr_126d", "dxy_gold_divergence", "ovx_oil_rv_spread", "ovx_oil_rv_ratio", "gvz_gold_rv_spread", "gvz_gold_rv_ratio", "multi_asset_vol_stress", "vol_stress_dispersion", "dxy_regime_numeric", "commodity_vol_regime", "risk_on_score"]
_F19I = ["dxy_gold_both_rally", "growth_concern_signal", "flight_to_safety_active"]
_F19 = S.Steps(market_sql(_X)).add(
    **{f"{c}1": S.pct(c, 1) for c in ("dxy", "gold", "crude")}, **{f"{c}21": S.pct(c, 21) for c in ("dxy", "gold", "copper")}, **{f"z_{c}": half_z(c, 63) for c in ("ovx", "gvz", "vix")}, dxy_percentile_252d=half_rank("dxy", 252),
).add(
    **{f"dxy_gold_corr_{w}d": S.corr("dxy1", "gold1", w) for w in (21, 63, 126)}, dxy_gold_divergence=f"abs({S.rank_pct('dxy21', 63)} - {S.rank_pct('gold21', 63)})", dxy_gold_both_rally=S.flag("dxy21 > 0 AND gold21 > 0"), growth_concern_signal=S.flag("copper21 < 0 AND dxy21 > 0"),
    ovx_oil_rv_spread=f"ovx - {S.rvol('crude1', 21)}", ovx_oil_rv_ratio=div("ovx", S.rvol("crude1", 21)), gvz_gold_rv_spread=f"gvz - {S.rvol('gold1', 21)}", gvz_gold_rv_ratio=div("gvz", S.rvol("gold1", 21)),
    multi_asset_vol_stress=S.nanmean(["z_ovx", "z_gvz", "z_vix"]), vol_stress_dispersion=S.nanstd(["z_ovx", "z_gvz", "z_vix"]), dxy_regime_numeric=S.cut("dxy_percentile_252d", [0, 25, 75, 100]), commodity_vol_regime=S.cut("ovx", [0, 20, 30, 45, 150]),
    flight_to_safety_active=S.flag("dxy21 > 0 AND gold21 > 0"), risk_on_score=f"({S.flag('dxy21 < 0')} + {S.flag('copper21 > 0')} + {S.flag('gold21 < 0')}) / 3.0",
)


@query("F19 F20 W9 W13", _F19.out(_F19D, _F19I))
def pack_cross_asset(spark, sf_dir):
    from tidegrid.functions import rolling as R

    df = VO.cross_asset(market(spark, sf_dir, _X), AX)
    df = R.with_columns(df, {"dxy_percentile_252d": VO.half_rank("dxy", 252, AX), **{f"{c}_ret_21d": R.pct_change(c, 21, AX) for c in ("dxy", "copper", "gold")}})
    return shaped(VO.commodity_regimes(df), ID + _F19D + _F19I)


# --- F21 - F25 ------------------------------------------------------------------------------
_F21D = [
    "vx1_vx2_spread", "vx2_vx1_ratio", "vx_contango_pct", "vx_curve_2_1_ratio", "vx_curve_3_2_ratio", "vx_curve_4_3_ratio", "vx_curve_steepness", "vx1_return_5d", "vx2_return_5d", "vx1_vx2_change_21d", "vx1_vx2_zscore_63d", "vx1_vx2_percentile_63d",
    "vx2_vx1_ratio_velocity_10d", "vx_term_structure_regime", "vx_term_structure_divergence", "vx_contango_5d_change", "vx_contango_zscore", "vx_curve_acceleration", "vx_oi_front_concentration", "vx_oi_imbalance", "vx_oi_5d_change", "vx_oi_zscore_63d", "vx_churn_ratio",
    "vx_oi_surge", "vx_churn_zscore_63d", "vx_roll_yield_annualized", "vx_roll_cost_5d", "vx_roll_yield_zscore_63d", "vx_vix_basis", "vx_vix_basis_pct", "vx_vix_basis_zscore_63d", "vx_regime_shift_velocity", "vx_momentum_5d", "vx_momentum_zscore",
]
_F21I = ["vx_vix_premium_flag", "vx_steep_contango_flag", "vx_backwardation_flag", "vx_extreme_backwardation_flag"]


def _ff(c, n):
    return f"coalesce({c}, last_value({c} IGNORE NULLS) {S.frame(n + 1)})"


_PICK = ", ".join(f"max({f}) FILTER (position = {i}) AS {p}{i}0" for f, p in (("settle", "vx"), ("dte", "dte"), ("volume", "vol"), ("open_interest", "oi")) for i in (1, 2, 3, 4))
_F21 = S.Steps(f"WITH {CONT_SQL} SELECT 'VX' AS series_id, ts, {_PICK} FROM cont GROUP BY 2")
_F21.add(**{f"{p}{i}": _ff(f"{p}{i}0", n) for p, n in (("vx", 10), ("dte", 10), ("vol", 5), ("oi", 5)) for i in (1, 2, 3, 4)}).add(spot="(vx3 + vx4) / 2", roll_="(vx1 - vx2) / nullif(dte1, 0)").add(
    vx1_vx2_spread="vx1 - vx2", vx2_vx1_ratio=div("vx2", "vx1"), vx_contango_pct="(vx2 / nullif(vx1, 0) - 1) * 100", vx_curve_2_1_ratio=div("vx2", "vx1"), vx_curve_3_2_ratio=div("vx3", "vx2"), vx_curve_4_3_ratio=div("vx4", "vx3"), vx_curve_steepness="(vx4 / nullif(vx1, 0) - 1) * 100",
    vx1_return_5d=pct100("vx1", 5), vx2_return_5d=pct100("vx2", 5), vx_oi_front_concentration=div("oi1", "oi1 + oi2"), vx_oi_imbalance=div("(oi1 - oi2)", "oi1 + oi2"), vx_oi_5d_change=S.diff("oi1", 5), vx_oi_zscore_63d=half_z("oi1", 63), vx_churn_ratio=div("vol1", "oi1"),
    vx_roll_yield_annualized="roll_ * 252", vx_roll_cost_5d="roll_ * 5", vx_roll_yield_zscore_63d=half_z("roll_", 63), vx_vix_basis="vx1 - spot", vx_vix_basis_pct="(vx1 - spot) / nullif(spot, 0) * 100", vx_vix_premium_flag=S.flag("vx1 - spot > 0"), vx_momentum_5d=S.pct("vx1", 5),
).add(
    vx1_vx2_change_21d=S.diff("vx1_vx2_spread", 21), vx1_vx2_zscore_63d=half_z("vx1_vx2_spread", 63), vx1_vx2_percentile_63d=half_rank("vx1_vx2_spread", 63), vx2_vx1_ratio_velocity_10d=S.diff("vx2_vx1_ratio", 10), q5=S.diff("vx2_vx1_ratio", 5),
    vx_term_structure_regime="CASE WHEN vx2_vx1_ratio <= -0.05 THEN 0 WHEN vx2_vx1_ratio <= 0 THEN 1 WHEN vx2_vx1_ratio <= 0.05 THEN 2 WHEN vx2_vx1_ratio > 0.05 THEN 3 END", vx_term_structure_divergence=f"abs({S.rank_pct('vx1_vx2_spread', 63, 32)} - {S.rank_pct('vx2_vx1_ratio', 63, 32)})",
    vx_contango_5d_change=S.diff("vx_contango_pct", 5), vx_contango_zscore=half_z("vx_contango_pct", 63), vx_oi_surge=S.clip(S.zscore_null("vx_oi_5d_change", 63), -3, 3), vx_churn_zscore_63d=half_z("vx_churn_ratio", 63), vx_vix_basis_zscore_63d=half_z("vx_vix_basis", 63),
    vx_steep_contango_flag=S.flag("vx_contango_pct > 5"), vx_backwardation_flag=S.flag("vx_contango_pct < 0"), vx_extreme_backwardation_flag=S.flag("vx_contango_pct < -10"), vx_regime_shift_velocity=S.diff("vx_contango_pct", 5), vx_momentum_zscore=S.zscore_null("vx_momentum_5d", 126),
).add(vx_curve_acceleration=S.diff("q5", 5))


@query("F21 F22 F23 F24 F25", _F21.out(_F21D, _F21I, fine=_RATIOS))
def pack_futures_curve(spark, sf_dir):
    df = CU.curve_frame(continuous(spark, sf_dir).withColumnRenamed("root", "series_id"), ["series_id"])
    df = df.withColumn("spot", (F.col("vx3") + F.col("vx4")) / 2)
    df = CU.curve_regimes(CU.basis(CU.roll_yield(CU.positioning(CU.curve_spreads(df, AX), AX), AX), AX, "spot"), AX)
    return shaped(df, ID + _F21D + _F21I, fine=_RATIOS)


# --- F26 - F30 ------------------------------------------------------------------------------
def _meta_base(spark, sf_dir):
    return PR.price_features(PR.level_features(market(spark, sf_dir, ["vix", "skew", "gold"]), AX), AX)


_MB = price_steps(level_steps(S.Steps(market_sql(["vix", "skew", "gold"])))).add(_rp="vix - spx_realized_vol_21d", liquidity_stress_composite=S.nanmean([c01("skew", 130, 30), c01("vix", 15, 25), c01("spx_realized_vol_21d", 15, 20)]), _g21=pct100("gold", 21), v5=S.diff("vix", 5), s5=S.diff("skew", 5), r5=S.diff("spx_realized_vol_21d", 5), v10=S.diff("vix", 10), s10=S.diff("skew", 10))
_MB.add(
    regime_transition_risk=S.clip("(abs(vix_velocity_5d) / nullif(vix, 0) * 100)", 0, 100), trend_strength_avg="(abs(spx_vs_ma200) + abs(spx_vs_ma50)) / 2", vix_regime_micro=S.checked_regime("vix", [0, 12, 16, 20, 100]), vol_regime=S.checked_regime("spx_realized_vol_21d", [0, 10, 15, 25, 100]),
    risk_premium_regime=S.checked_regime("_rp", [-100, 0, 5, 10, 100]), trend_regime=S.checked_regime("spx_vs_ma200", [-100, -5, 0, 5, 100]), liquidity_regime=S.checked_regime("liquidity_stress_composite", [0, 0.25, 0.5, 0.75, 1]), correlation_regime=S.checked_regime("spx_vix_corr_21d", [-1, -0.8, -0.5, 0, 1]),
    equity_vol_divergence=f"abs({expanding_rank('spx_ret_21d')} + {expanding_rank('vix_velocity_21d')} - 1)", equity_vol_corr_breakdown=f"abs(spx_vix_corr_21d - {S.mean('spx_vix_corr_21d', 63)})", risk_premium_ma21=S.mean("_rp", 21), risk_premium_velocity=S.diff("_rp", 10), risk_premium_zscore=S.zscore("_rp", 63),
    gold_spx_divergence=f"abs({expanding_rank('_g21')} - {expanding_rank('spx_ret_21d')})", vix_velocity_3d_pct=pct100("vix", 3), v55=S.diff("v5", 5), s55=S.diff("s5", 5), vix_momentum_regime="sign(v5)", skew_momentum_regime="sign(s5)", spx_realized_vol_21d_velocity_3d=S.diff("spx_realized_vol_21d", 3), spx_realized_vol_21d_acceleration_5d=S.diff("r5", 5),
    vix_skew_momentum_divergence=f"abs({expanding_rank('v10')} - {expanding_rank('s10')})", **{f"{n}_percentile_{w}d": S.pct_below(c, w) for n, c in (("vix", "vix"), ("skew", "skew"), ("risk_premium", "_rp")) for w in (21, 63, 126, 252)},
).add(vix_jerk_5d=S.diff("v55", 5), skew_jerk_5d=S.diff("s55", 5), **{f"{n}_percentile_velocity": S.diff(f"{n}_percentile_63d", 10) for n in ("vix", "skew", "risk_premium")}, **{f"{n}_extreme_low_{w}d": S.flag(f"{n}_percentile_{w}d < 10") for n in ("vix", "skew", "risk_premium") for w in (63, 252)})
_F26D = ["liquidity_stress_composite", "regime_transition_risk", "trend_strength_avg", "equity_vol_divergence", "equity_vol_corr_breakdown", "risk_premium_ma21", "risk_premium_velocity", "risk_premium_zscore", "gold_spx_divergence", "vix_velocity_3d_pct", "vix_momentum_regime", "skew_momentum_regime", "spx_realized_vol_21d_velocity_3d", "spx_realized_vol_21d_acceleration_5d", "vix_skew_momentum_divergence", "vix_jerk_5d", "skew_jerk_5d"] + [f"{n}_percentile_{w}d" for n in ("vix", "skew", "risk_premium") for w in (21, 63, 126, 252)] + [f"{n}_percentile_velocity" for n in ("vix", "skew", "risk_premium")]
_F26I = ["vix_regime_micro", "vol_regime", "risk_premium_regime", "trend_regime", "liquidity_regime", "correlation_regime"] + [f"{n}_extreme_low_{w}d" for n in ("vix", "skew", "risk_premium") for w in (63, 252)]


@query("F26 W15 W34 P7", _MB.out(_F26D, _F26I))
def pack_meta(spark, sf_dir):
    df = ME.regime_indicators(_meta_base(spark, sf_dir), AX)
    df = ME.percentile_rankings(ME.rates_of_change(ME.cross_relations(df, AX), AX), AX)
    return shaped(df, ID + _F26D + _F26I)


_F27D = ["vix_vel_spx_rv_ratio", "vix_spx_velocity_asymmetry", "vix_vel_spx_ret_ratio", "vix_z_spx_rv_product", "credit_vol_stress_composite", "credit_vol_divergence", "spx_ret_5d_regime_adj", "vix_velocity_5d_regime_adj", "vix_vol_21d_log", "spx_realized_vol_21d_log"] + [f"{n}_x_regime_{k}" for n in ("vix_velocity_5d", "vix_zscore_252d", "spx_realized_vol_63d") for k in range(4)]
_F27I = ["cross_asset_vol_cluster", "vol_correlation_breakage", "vix_velocity_5d_extreme_flag", "vix_accel_5d_extreme_flag", "spx_gap_extreme_flag", "spx_gap_magnitude_extreme_flag"]
_F27 = candle_steps(price_steps(level_steps(S.Steps(market_sql(["vix", "hy"]))))).add(
    drv=S.diff("spx_realized_vol_63d", 5), vz=S.zscore("vix_vol_21d", 63), sz=S.zscore("spx_realized_vol_21d", 63), cz=S.zscore("hy", 252), lz=S.zscore("vix", 63), rg=S.cut("vix", _L, lowest=True),
).add(
    vix_vel_spx_rv_ratio=div("vix_velocity_5d", "spx_realized_vol_63d"), vix_spx_velocity_asymmetry=f"abs({S.mean('abs(vix_velocity_5d)', 21)} - {S.mean('abs(drv)', 21)})", vix_vel_spx_ret_ratio="abs(vix_velocity_5d) / nullif(abs(spx_ret_5d), 0)", vix_z_spx_rv_product="vix_zscore_252d * spx_realized_vol_63d",
    cross_asset_vol_cluster=S.flag("vz > 1 AND sz > 1"), vol_correlation_breakage=S.flag(f"{S.corr('vz', 'sz', 21)} < -0.3"), credit_vol_stress_composite=S.clip("(cz * lz)", -4, 4), credit_vol_divergence=f"abs({S.rank_pct('cz', 63)} - {S.rank_pct('lz', 63)})",
    spx_ret_5d_regime_adj="spx_ret_5d - " + by_class("rg", [2.331, -0.813, -3.475, -6.487]), vix_velocity_5d_regime_adj="vix_velocity_5d - " + by_class("rg", [2.331, -0.813, -3.475, -6.487]),
    vix_vol_21d_log="CASE WHEN vix_vol_21d IS NOT NULL THEN ln(1 + greatest(vix_vol_21d, 0)) END", spx_realized_vol_21d_log="CASE WHEN spx_realized_vol_21d IS NOT NULL THEN ln(1 + greatest(spx_realized_vol_21d, 0)) END",
    **{f"{n}_x_regime_{k}": f"{n} * (CASE WHEN rg = {k} THEN 1 ELSE 0 END)" for n in ("vix_velocity_5d", "vix_zscore_252d", "spx_realized_vol_63d") for k in range(4)}, **{f"{c}_extreme_flag": S.flag(f"abs({c}) > {S.quantile(c, 0.95, 252)}") for c in ("vix_velocity_5d", "vix_accel_5d", "spx_gap", "spx_gap_magnitude")},
)


@query("F27 F28 F29 P11 P13 W21 W23", _F27.out(_F27D, _F27I))
def pack_interactions(spark, sf_dir):
    df = PR.candle_features(PR.price_features(PR.level_features(market(spark, sf_dir, ["vix", "hy"]).withColumn("hy_spread", F.col("hy")), AX), AX), AX)
    df = RG.regime_pack(df, AX)
    df = PR.interaction_features(df, AX)
    df = PR.transform_features(PR.regime_conditional_features(df, ["vix_velocity_5d", "vix_zscore_252d", "spx_realized_vol_63d"]), AX)
    return shaped(df, ID + _F27D + _F27I)


# --- F33 - F36 ------------------------------------------------------------------------------
_GC = ["vix", "vvix", "ovx", "gvz", "vix3m", "vix6m", "stress", "hy_bb", "hy_ccc"]
_near = "(0.5 * (vx2 - vx1) / nullif(vx1, 0) + 0.3 * (vx3 - vx2) / nullif(vx1, 0))"
_pq = lambda c, q, k, n: f"(CASE WHEN count({c}) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) >= {n} THEN quantile_cont({c}, {q}) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END)"


def gate_steps() -> S.Steps:
    return S.Steps(market_sql(_GC)).add(vx1="ovx", vx2="gvz", vx3="vix3m", vx4="vix6m", ret=S.pct("close", 1), stress_raw=S.lag("(stress + 0.5)", 5), quality_spread=f"{S.lag('hy_ccc', 1)} - {S.lag('hy_bb', 1)}").add(
        vx_contango_pct="(vx2 / nullif(vx1, 0) - 1) * 100", vix_vs_rv_21d=f"vix - {S.rvol('ret', 21)} / 30", c3_vvix_threshold=_pq("vvix", 0.85, 252, 126), credit_widening_regime=S.flag(f"quality_spread > {_pq('quality_spread', 0.8, 63, 63)}"),
        stress_regime=S.cut("stress_raw", [-10, -1, 0, 2, 20]), vvix_vix_ratio="vvix / CASE WHEN vix >= 5 THEN vix END", vx_curve_ok=f"CASE WHEN vx3 IS NOT NULL THEN {S.flag('vx2 > vx1 AND vx3 > vx2')} END",
        vx_curve_score=f"CASE WHEN vx4 IS NOT NULL THEN {_near} + 0.2 * (vx4 - vx3) / nullif(vx1, 0) ELSE {_near} / 0.8 END",
    ).add(gate_open="(CASE WHEN coalesce(vx_contango_pct > 0, false) AND coalesce(vix_vs_rv_21d > 2, false) AND coalesce(vvix < c3_vvix_threshold, false) AND credit_widening_regime = 0 AND coalesce(stress_regime <= 1, false) THEN 1 ELSE 0 END)")


_F33D = ["vx_contango_pct", "vix_vs_rv_21d", "c3_vvix_threshold", "stress_raw", "stress_regime", "vvix_vix_ratio", "vx_curve_ok", "vx_curve_score"]


def gate_rows(spark, sf_dir):
    df = market(spark, sf_dir, _GC)
    df = df.withColumns({"vx1": F.col("ovx"), "vx2": F.col("gvz"), "vx3": F.col("vix3m"), "vx4": F.col("vix6m"), "stress": F.col("stress") + 0.5})
    df = GT.gate_features(df, AX)
    # lineitem prices swing far more than an index: bring the realised volatility to the level's scale
    df = df.withColumn("vix_vs_rv_21d", F.col("vix") - (F.col("vix") - F.col("vix_vs_rv_21d")) / 30)
    return df.withColumn("gate_open", GT.gate_verdict().cast("int"))


@query("F33 F34", gate_steps().out(_F33D, ["credit_widening_regime", "gate_open"], fine=_RATIOS))
def gate_status(spark, sf_dir):
    return shaped(gate_rows(spark, sf_dir), ID + _F33D + ["credit_widening_regime", "gate_open"], fine=_RATIOS)


@query(
    "B11 A5 A6",
    gate_steps().done(
        "SELECT series_id, condition, " + S.r("p") + " AS pass_pct FROM (SELECT series_id, avg(coalesce(vx_contango_pct > 0, false)::INT) * 100 AS c1, avg(coalesce(vix_vs_rv_21d > 2, false)::INT) * 100 AS c2, avg(coalesce(vvix < c3_vvix_threshold, false)::INT) * 100 AS c3, avg((credit_widening_regime = 0)::INT) * 100 AS c4,"
        " avg(coalesce(stress_regime <= 1, false)::INT) * 100 AS c5, avg(gate_open) * 100 AS gate FROM {prev} GROUP BY 1) UNPIVOT (p FOR condition IN (c1, c2, c3, c4, c5, gate))"
    ),
)
def gate_pass_rates(spark, sf_dir):
    from tidegrid.operators.aggregates import pass_rates

    return shaped(pass_rates(gate_rows(spark, sf_dir), ["series_id"], {**GT.gate_conditions(), "gate": F.col("gate_open") == 1}))


_pr = lambda c, k, n: (
    f"(CASE WHEN {c} IS NOT NULL AND count({c}) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND 1 PRECEDING) + 1 >= {n} THEN len(list_filter(list({c}) FILTER ({c} IS NOT NULL) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND 1 PRECEDING), lambda v: v < {c})) * 1.0"
    f" / count({c}) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND 1 PRECEDING) END)"
)


@query(
    "F35 W31",
    S.Steps(market_sql(["vix"])).add(ret=S.pct("close", 1)).add(vrp=f"vix - {S.rvol('ret', 21)}").add(pct_126d=_pr("vix", 126, 75), vrp_pct=_pr("vrp", 252, 126)).add(
        state="CASE WHEN pct_126d IS NULL THEN NULL WHEN pct_126d >= 0.8 THEN 'PEAK' WHEN pct_126d <= 0.2 THEN 'TROUGH' ELSE 'NORMAL' END",
        tilt="CASE WHEN pct_126d IS NULL THEN NULL WHEN pct_126d >= 0.8 AND vix >= 30 THEN 'SWAN-WATCH' WHEN pct_126d >= 0.8 AND coalesce(vrp_pct >= 0.67, false) THEN 'LEAN-IN-STRONG' WHEN pct_126d >= 0.8 THEN 'LEAN-IN' WHEN pct_126d <= 0.2 THEN 'HOLD-BACK' ELSE 'standard' END",
        swan=S.flag("vix >= 30"), vrp_rich=S.flag("vrp_pct >= 0.67"),
    ).out(["pct_126d", "vrp_pct"], ["swan", "vrp_rich"], texts=["state", "tilt"]),
)
def volatility_state(spark, sf_dir):
    return shaped(GT.volatility_state(market(spark, sf_dir, ["vix"]), AX), ID + ["pct_126d", "vrp_pct", "state", "tilt", "swan", "vrp_rich"])


@query(
    "F36",
    S.Steps(market_sql(["vix", "vix3m", "vvix", "ovx", "gvz"])).add(sp="(ovx - gvz) / 5", ma20=S.mean("close", 20), ma50=S.mean("close", 50), ma200=S.mean("close", 200)).add(neg="coalesce(sp < 0, false)").add(pos=f"row_number() {S.over()}")
    .add(streak=f"CASE WHEN sp IS NULL THEN 0 ELSE pos - coalesce(max(CASE WHEN NOT neg THEN pos END) {S.upto()}, 0) END")
    .add(
        curve_points="CASE WHEN sp < 0 THEN 20 + (CASE WHEN sp < -2 THEN 10 WHEN sp < -1 THEN 5 ELSE 0 END) + (CASE WHEN streak < 5 THEN -5 ELSE 0 END) ELSE -10 END",
        level_points="CASE WHEN vix BETWEEN 15 AND 25 THEN 25 WHEN vix >= 12 AND vix < 15 THEN 10 WHEN vix > 25 AND vix <= 35 THEN 15 WHEN vix > 35 THEN 0 ELSE 5 END",
        calm_points="CASE WHEN vvix < 85 THEN 15 WHEN vvix < 100 THEN 10 WHEN vvix < 120 THEN 5 ELSE 0 END",
        trend_points=f"{S.flag('close > ma200')} * 10 + {S.flag('close > ma50')} * 5 + {S.flag('close > ma20')} * 5",
        q="coalesce(vix / nullif(vix3m, 0), 1)",
    )
    .add(term_points="CASE WHEN q < 0.9 THEN 10 WHEN q < 1 THEN 7 WHEN q < 1.05 THEN 3 ELSE 0 END").add(score="least(100, greatest(0, curve_points + level_points + calm_points + trend_points + term_points))")
    .add(rating="CASE WHEN score >= 80 THEN 'EXCELLENT' WHEN score >= 65 THEN 'FAVORABLE' WHEN score >= 50 THEN 'NEUTRAL' WHEN score >= 35 THEN 'CAUTIOUS' ELSE 'AVOID' END")
    .out([], ["curve_points", "level_points", "calm_points", "trend_points", "term_points", "score"], texts=["rating"]),
)
def premium_score(spark, sf_dir):
    from tidegrid.functions import rolling as R
    from tidegrid.operators.episodes import with_true_streak

    df = market(spark, sf_dir, ["vix", "vix3m", "vvix", "ovx", "gvz"]).withColumn("sp", (F.col("ovx") - F.col("gvz")) / 5)
    df = with_true_streak(df.withColumn("neg", F.col("sp") < 0), "neg", AX)
    df = df.withColumns({f"ma{w}": R.mean("close", w, AX) for w in (20, 50, 200)})
    df = df.withColumns(GT.premium_score("sp", "streak", "close", "ma20", "ma50", "ma200", "vix", "vix3m", "vvix"))
    return shaped(df, ID + ["curve_points", "level_points", "calm_points", "trend_points", "term_points", "score", "rating"])
