"""The whole feature matrix: every pack whose inputs exist, in dependency order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import dates as D
from tidegrid.operators import calendar as C
from tidegrid.operators.quality import feature_quality
from tidegrid.plans import curve as CU
from tidegrid.plans import macro as MA
from tidegrid.plans import meta as ME
from tidegrid.plans import price as PR
from tidegrid.plans import regimes as RG
from tidegrid.plans import volatility as VO
from tidegrid.plans.draft import together

# Features the row quality score asks for.
CRITICAL = ["vix", "close", "vix_percentile_21d", "spx_realized_vol_21d"]
IMPORTANT = ["vx1_vx2_spread", "skew", "yield_10y2y", "dxy"]
OPTIONAL = ["gamma", "vpn", "bfly"]
OIL_VOL_BINS = [0, 20, 30, 45, 150]


def market_features(df: DataFrame, ax: Axis) -> DataFrame:
    """Price, regime, volatility, macro and meta packs over a wide daily frame."""
    have = lambda *c: set(c) <= set(df.columns)
    first = [
        lambda d: PR.price_features(PR.level_features(d, ax), ax), lambda d: PR.candle_features(d, ax), lambda d: RG.regime_pack(d, ax), lambda d: MA.yields(d, ax),
    ]
    optional = [
        (("skew",), lambda d: RG.tail_regime_pack(d, ax)), (("skew",), lambda d: RG.joint_pack(d, ax)), (("vix3m", "vix6m"), lambda d: VO.term_structure(d, ax)),
        (("skew", "vxth", "vxtlt"), lambda d: VO.options_flow(d, ax)), (("vvix",), lambda d: VO.vol_of_vol(d, ax)), (("claims",), lambda d: MA.labour(d, ax)),
        (("stress",), lambda d: MA.stress(d, ax)), (("hy",), lambda d: MA.credit(d, ax)), (("dxy",), lambda d: VO.currency_index(d, ax)),
        (("vx1", "vx2", "vx3", "vx4"), lambda d: CU.curve_regimes(CU.curve_spreads(d, ax), ax)),
        (("oi1", "oi2", "vol1"), lambda d: CU.positioning(d, ax)), (("vx1", "vx2", "dte1"), lambda d: CU.roll_yield(d, ax)), (("vx1", "vix"), lambda d: CU.basis(d, ax, "vix")),
        (("gold",), lambda d: MA.macro_level(d, ax, "gold", "gold")), (("cpi",), lambda d: MA.macro_level(d, ax, "cpi", "cpi", relative=False)), (("cl_spread", "crude"), lambda d: MA.commodity_spread(d, ax)),
        (("ovx",), lambda d: VO.vol_index(d, ax, "ovx", (21, 63, 252), (10, 21), (21, 63), OIL_VOL_BINS, "vix")), (("gvz",), lambda d: VO.vol_index(d, ax, "gvz", (21, 63))),
        # after macro_level: of the two gold_zscore_63d, the one that starts at half a window stays
        (("gold",), lambda d: VO.commodity(d, ax, "gold", (5, 10, 21, 63), (10, 21, 63), (21, 63, 252), (21, "gold_regime"))), (("natgas",), lambda d: VO.commodity(d, ax, "natgas", (5, 10, 21), (21,), (21, 63))),
        (("copper",), lambda d: VO.commodity(d, ax, "copper", (5, 10, 21, 63), (), (21, 63, 252), (63, "copper_economic_signal"))),
        (("dxy", "gold", "copper", "crude", "ovx", "gvz", "vix"), lambda d: VO.cross_asset(d, ax)),
    ]
    df = together(df, first + [pack for needs, pack in optional if have(*needs)])
    second = [
        lambda d: PR.interaction_features(d, ax), lambda d: PR.regime_conditional_features(d, ["vix_velocity_5d", "vix_zscore_252d", "spx_realized_vol_63d"]), lambda d: PR.transform_features(d, ax),
    ]
    if have("skew"):
        second += [lambda d: ME.cross_relations(ME.regime_indicators(d, ax), ax), lambda d: ME.rates_of_change(d, ax), lambda d: ME.percentile_rankings(d, ax)]
    if have("dxy_gold_both_rally", "dxy_percentile_252d", "ovx"):
        second += [lambda d: VO.commodity_regimes(d)]
    return together(df, second)


def event_features(df: DataFrame, ax: Axis, meetings: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Calendar columns, cohort, event proximity and their products with market features.

    Event columns depend on the day alone: they are computed once per distinct day and joined back,
    one row per calendar day. ``calendar`` (the input before its features) keeps the event plan
    short."""
    days = (df if calendar is None else calendar).select(ax.ts).distinct()
    months = C.months_between(days, ax.ts)
    ev = C.event_distances(days, ax.ts, meetings, C.option_expiries(months), C.futures_expiries(months))
    ev = C.proximity_columns(ev.withColumns(C.cohort_columns())).withColumns(D.month_day_columns(ax.ts))
    return ME.event_products(df.join(F.broadcast(ev), ax.ts))  # one row per calendar day


def feature_matrix(df: DataFrame, ax: Axis, meetings: DataFrame, ages: dict[str, Column] | None = None, lags: dict[str, int] | None = None) -> DataFrame:
    """All features with a row quality score, infinities scrubbed and helper columns dropped.

    ``ages`` are days since a feature's last update, ``lags`` its publication lag: stale features lower
    the score."""
    out = event_features(market_features(df, ax), ax, meetings, df)
    out = out.withColumn("feature_quality", feature_quality(out, CRITICAL, IMPORTANT, OPTIONAL, ages, lags))
    scrub = "CASE WHEN NOT isnan(`{c}`) AND abs(`{c}`) < double('infinity') THEN `{c}` END AS `{c}`"
    keep = [f for f in out.schema.fields if not f.name.startswith("_")]
    return out.selectExpr(*[scrub.format(c=f.name) if f.dataType.typeName() == "double" else f"`{f.name}`" for f in keep])
