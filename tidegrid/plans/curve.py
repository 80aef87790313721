"""Futures-curve features from continuous positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import rolling as R
from tidegrid.functions.scalar import clip, cut, flag, nonzero, ratio
from tidegrid.functions.technical import stage
from tidegrid.operators.futures import position_columns
from tidegrid.plans.volatility import half_rank, half_z

NARROW = [-1e308, -0.05, 0, 0.05, 1e308]


def curve_frame(cont: DataFrame, keys: list[str], positions: list[int] = (1, 2, 3, 4)) -> DataFrame:
    """Settles, days to expiry, volume and open interest side by side, each carried forward over a
    bounded number of days."""
    ax = Axis(tuple(keys), "ts")
    wide = position_columns(cont, keys, {"settle": "vx", "days_to_expiry": "dte", "volume": "vol", "open_interest": "oi"}, list(positions))
    limits = {"vx": 10, "dte": 10, "vol": 5, "oi": 5}
    return stage(wide, {f"{p}{i}": R.fill_forward(f"{p}{i}", n, ax) for p, n in limits.items() for i in positions})


def curve_spreads(df: DataFrame, ax: Axis) -> DataFrame:
    v1, v2, v3, v4 = (F.col(f"vx{i}") for i in (1, 2, 3, 4))
    df = stage(df, {
        "vx1_vx2_spread": v1 - v2, "vx2_vx1_ratio": ratio("vx2", "vx1"), "vx_contango_pct": (v2 / nonzero(v1) - 1) * 100,
        "vx_curve_2_1_ratio": v2 / nonzero(v1), "vx_curve_3_2_ratio": v3 / nonzero(v2), "vx_curve_4_3_ratio": v4 / nonzero(v3), "vx_curve_steepness": (v4 / nonzero(v1) - 1) * 100,
        "vx1_return_5d": R.pct_change("vx1", 5, ax) * 100, "vx2_return_5d": R.pct_change("vx2", 5, ax) * 100,
    })
    s, q, c = "vx1_vx2_spread", "vx2_vx1_ratio", "vx_contango_pct"
    df = stage(df, {
        "vx1_vx2_change_21d": R.diff(s, 21, ax), "vx1_vx2_zscore_63d": half_z(s, 63, ax), "vx1_vx2_percentile_63d": half_rank(s, 63, ax),
        "vx2_vx1_ratio_velocity_10d": R.diff(q, 10, ax), "vx_term_structure_regime": cut(q, NARROW).cast("double"), "_q5": R.diff(q, 5, ax),
        "vx_term_structure_divergence": F.abs(R.rank_pct(s, 63, ax, 32) - R.rank_pct(q, 63, ax, 32)),
        "vx_contango_5d_change": R.diff(c, 5, ax), "vx_contango_zscore": half_z(c, 63, ax),
    })
    return stage(df, {"vx_curve_acceleration": R.diff("_q5", 5, ax)}).drop("_q5")


def positioning(df: DataFrame, ax: Axis) -> DataFrame:
    a, b = F.col("oi1"), F.col("oi2")
    df = stage(df, {
        "vx_oi_front_concentration": a / nonzero(a + b), "vx_oi_imbalance": (a - b) / nonzero(a + b), "vx_oi_5d_change": R.diff("oi1", 5, ax),
        "vx_oi_zscore_63d": half_z("oi1", 63, ax), "vx_churn_ratio": ratio("vol1", "oi1"),
    })
    return stage(df, {"vx_oi_surge": clip(R.zscore("vx_oi_5d_change", 63, ax, floor=None), -3, 3), "vx_churn_zscore_63d": half_z("vx_churn_ratio", 63, ax)})


def roll_yield(df: DataFrame, ax: Axis) -> DataFrame:
    df = stage(df, {"_roll": (F.col("vx1") - F.col("vx2")) / nonzero("dte1")})
    return stage(df, {"vx_roll_yield_annualized": F.col("_roll") * 252, "vx_roll_cost_5d": F.col("_roll") * 5, "vx_roll_yield_zscore_63d": half_z("_roll", 63, ax)}).drop("_roll")


def basis(df: DataFrame, ax: Axis, spot: str) -> DataFrame:
    gap = F.col("vx1") - F.col(spot)
    df = stage(df, {"vx_vix_basis": gap, "vx_vix_basis_pct": gap / nonzero(spot) * 100, "vx_vix_premium_flag": flag(gap > 0)})
    return stage(df, {"vx_vix_basis_zscore_63d": half_z("vx_vix_basis", 63, ax)})


def curve_regimes(df: DataFrame, ax: Axis) -> DataFrame:
    c = F.col("vx_contango_pct")
    df = stage(df, {
        "vx_steep_contango_flag": flag(c > 5), "vx_backwardation_flag": flag(c < 0), "vx_extreme_backwardation_flag": flag(c < -10),
        "vx_regime_shift_velocity": R.diff("vx_contango_pct", 5, ax), "vx_momentum_5d": R.pct_change("vx1", 5, ax),
    })
    return stage(df, {"vx_momentum_zscore": R.zscore("vx_momentum_5d", 126, ax, floor=None)})
