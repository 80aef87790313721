"""Regime classes, their fixed statistics, and the regime feature packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import rolling as R
from tidegrid.functions import technical as TI
from tidegrid.functions.scalar import boundary_distance, clip, col, cut, flag, lookup, nonzero, sign, step_class
from tidegrid.functions.technical import stage

# Regime bounds, names and per-regime statistics.
LEVEL_BOUNDS = [0, 15.57, 23.36, 31.16, 100]
LEVEL_NAMES = ["Low Vol", "Normal", "Elevated", "Crisis"]
LEVEL_LABELS = ["low_vol", "normal", "elevated", "crisis"]
LEVEL_RANGE = [(9.14, 16.76), (16.77, 24.40), (24.41, 39.66), (39.68, 82.69)]
MEAN_RETURN = [2.331, -0.813, -3.475, -6.487]
MEDIAN_RETURN = [0.990, -1.750, -3.787, -7.605]
RETURN_STD = [12.391, 13.158, 14.130, 16.984]
PROB_UP = [0.541, 0.435, 0.380, 0.335]
VOL_OF_VOL = [5.95, 6.53, 7.44, 10.36]
SPIKE_PROB = [0.0700, 0.0578, 0.0437, 0.0605]
PROB_STAY = [0.8726, 0.7365, 0.7320, 0.7209]
PROB_CRISIS = [0.0002, 0.0022, 0.0340, 0.7209]
PROB_ELEVATED = [0.0049, 0.1027, 0.7320, 0.2791]
MEDIAN_DURATION = [3, 2, 2, 2]
TAIL_BOUNDS = [0, 114.68, 119.61, 127.27, 200]
TAIL_EXPECTED = [0.878, 0.521, -0.255, -1.110]
TAIL_BEHAVIOUR = ["MOMENTUM", "MOMENTUM", "NEUTRAL", "MEAN_REVERSION"]
JOINT_MEAN = [-2.13, -2.36, -2.61, -3.41, 0.10, 1.13, 0.86, -0.17, 1.74, 2.61, 1.07, 7.64, 3.90, 6.52, 2.11, 14.19]
JOINT_STD = [9.87, 11.99, 12.51, 13.34, 10.01, 11.98, 12.84, 16.86, 11.51, 12.52, 13.92, 17.51, 14.09, 13.49, 17.52, 20.86]
JOINT_FREQ = [0.0626, 0.0862, 0.0983, 0.1146, 0.1152, 0.0956, 0.0955, 0.1024, 0.0490, 0.0507, 0.0367, 0.0253, 0.0228, 0.0176, 0.0196, 0.0078]
JOINT_CORR = [-0.069, 0.089, 0.073, 0.077, 0.007, 0.097, 0.146, 0.092, 0.269, 0.172, -0.030, 0.022, 0.273, 0.347, 0.288, -0.066]
LEVEL_MEAN, LEVEL_STD = 19.82, 8.39
TAIL_MEAN, TAIL_STD = 122.65, 11.32


def _by_class(values: list) -> dict[int, object]:
    return dict(enumerate(values))


def level_regime(c, closed: str = "right") -> Column:
    """Regime 0..3. Right-closed bins for series (out of range is null); ``left`` is the scalar
    rule, open at both ends, where a value on a bound falls in the upper class."""
    if closed == "left":
        return step_class(c, LEVEL_BOUNDS[1:-1])
    return cut(c, LEVEL_BOUNDS, include_lowest=True)


def level_label(regime) -> Column:
    return lookup(regime, _by_class(LEVEL_LABELS))


def tail_regime(c, closed: str = "right") -> Column:
    if closed == "left":
        return step_class(c, TAIL_BOUNDS[1:-1])
    return cut(c, TAIL_BOUNDS, include_lowest=True)


def checked_regime(c, edges: list[float], ax: Axis, labels: list[int] | None = None) -> Column:
    """Bin index where null or out of range is 0, and a series that is under half known or has no
    spread is 0 throughout."""
    x, w = col(c), ax.whole()
    known = F.count(x).over(w) / F.count(F.lit(1)).over(w)
    spread = F.max(x).over(w) - F.min(x).over(w)
    return F.when(known < 0.5, 0).when(spread < 1e-6, 0).otherwise(F.coalesce(cut(x, edges, labels), F.lit(0)))


def regime_dimension(spark: SparkSession) -> DataFrame:
    rows = [
        (i, LEVEL_LABELS[i], LEVEL_NAMES[i], float(LEVEL_BOUNDS[i]), float(LEVEL_BOUNDS[i + 1]), MEAN_RETURN[i], PROB_UP[i], PROB_STAY[i], MEDIAN_DURATION[i])
        for i in range(4)
    ]
    return spark.createDataFrame(rows, "regime int, regime_label string, regime_name string, bound_lo double, bound_hi double, mean_return double, prob_up double, prob_stay double, median_duration int")


def within_range(c, regime) -> Column:
    """Position of a value inside the recorded range of its regime, clipped to 0..1."""
    lo = lookup(regime, _by_class([a for a, _ in LEVEL_RANGE]))
    width = lookup(regime, _by_class([b - a for a, b in LEVEL_RANGE]))
    return clip((col(c) - lo) / width, 0, 1)


def changed(c: str, ax: Axis) -> Column:
    """1 where the state differs from the previous row; the first row counts as unchanged."""
    return flag(F.col(c) != R.lag(c, 1, ax))


def state_runs(df: DataFrame, state: str, ax: Axis, prefix: str, start: int = 1) -> DataFrame:
    """Change flag, run id and age of the current run. ``start`` is the age on the first day."""
    df = stage(df, {f"{prefix}_change_flag": changed(state, ax)})
    df = stage(df, {f"{prefix}_run": F.sum(f"{prefix}_change_flag").over(ax.upto())})
    age = F.row_number().over(ax.by(f"{prefix}_run").ordered()) - 1 + start
    return stage(df, {f"days_in_{prefix}": age})


def regime_pack(df: DataFrame, ax: Axis, level: str = "vix") -> DataFrame:
    """Class, distance, age, fixed statistics and transition odds of the level regime."""
    df = stage(df, {"vix_regime": level_regime(level)})
    r = F.col("vix_regime")
    df = stage(df, {
        "regime_distance_to_boundary": boundary_distance(level, LEVEL_BOUNDS),
        "regime_within_regime_percentile": within_range(level, level_regime(level, "left")),
        "regime_expected_return_5d": lookup(r, _by_class(MEAN_RETURN)),
        "regime_median_return_5d": lookup(r, _by_class(MEDIAN_RETURN)),
        "regime_return_std_5d": lookup(r, _by_class(RETURN_STD)),
        "regime_prob_up_5d": lookup(r, _by_class(PROB_UP)),
        "regime_vol_of_vol": lookup(r, _by_class(VOL_OF_VOL)),
        "regime_spike_prob": lookup(r, _by_class(SPIKE_PROB)),
        "regime_prob_stay": lookup(r, _by_class(PROB_STAY)),
        "regime_prob_crisis": lookup(r, _by_class(PROB_CRISIS)),
        "regime_prob_elevated": lookup(r, _by_class(PROB_ELEVATED)),
    })
    df = state_runs(df, "vix_regime", ax, "regime")
    typical = lookup(r, _by_class([max(d, 1) for d in MEDIAN_DURATION]))
    return stage(df, {"time_in_regime_pct": F.col("days_in_regime") / typical}).drop("regime_run")


def tail_regime_pack(df: DataFrame, ax: Axis, tail: str = "skew", level: str = "vix") -> DataFrame:
    """Tail-index regime with its ratio to the level index."""
    s = F.col(tail)
    m63 = R.mean(tail, 63, ax, 1)
    df = stage(df, {"skew_regime_numeric": tail_regime(tail), "skew_vix_ratio": s / nonzero(level)})
    r = F.col("skew_regime_numeric")
    df = stage(df, {
        "skew_complacency_flag": flag(s < TAIL_BOUNDS[1]),
        "skew_extreme_tail_flag": flag(s > TAIL_BOUNDS[3]),
        "skew_expected_5d_return": lookup(r, _by_class(TAIL_EXPECTED)),
        "skew_regime_behavior": lookup(r, _by_class(TAIL_BEHAVIOUR)),
        "skew_distance_to_boundary": boundary_distance(tail, TAIL_BOUNDS),
        "skew_regime_displacement": (s - m63) / nonzero(m63) * 100,
        "skew_percentile_63d": R.rank_pct(tail, 63, ax, 1),
        "skew_percentile_252d": R.rank_pct(tail, 252, ax, 1),
        "skew_vix_ratio_percentile_252d": R.rank_pct("skew_vix_ratio", 252, ax, 1),
        "skew_vix_ratio_velocity_10d": R.diff("skew_vix_ratio", 10, ax),
        "skew_vix_ratio_regime": cut("skew_vix_ratio", [0, 5.226, 8.968, 100], include_lowest=True).cast("double"),
    })
    df = state_runs(df, "skew_regime_numeric", ax, "skew_regime").drop("skew_regime_run")
    return stage(df, {"skew_within_regime_zscore": TI.group_zscore(tail, "skew_regime_numeric", ax)})


def joint_pack(df: DataFrame, ax: Axis, level: str = "vix", tail: str = "skew") -> DataFrame:
    """Joint state of both indices: lookups, divergence, co-movement and transitions."""
    df = stage(df, {"_lr": level_regime(level), "_tr": tail_regime(tail), "_dl": R.diff(level, 5, ax), "_dt": R.diff(tail, 5, ax)})
    df = stage(df, {
        "vix_skew_joint_regime": F.col("_lr") * 4 + F.col("_tr"),
        "vix_skew_divergence": F.abs((F.col(level) - LEVEL_MEAN) / LEVEL_STD - (F.col(tail) - TAIL_MEAN) / TAIL_STD),
        "vix_skew_velocity_corr_21d": R.corr("_dl", "_dt", 21, ax, 1),
        "vix_skew_level_corr_21d": R.corr(level, tail, 21, ax, 1),
        "vix_boundary_distance": boundary_distance(level, LEVEL_BOUNDS),
        "skew_boundary_distance": boundary_distance(tail, TAIL_BOUNDS),
        "vix_regime_transition_direction": F.coalesce(sign(R.diff("_lr", 1, ax)), F.lit(0.0)).cast("int"),
        "skew_regime_transition_direction": F.coalesce(sign(R.diff("_tr", 1, ax)), F.lit(0.0)).cast("int"),
    })
    j, d, v = F.col("vix_skew_joint_regime"), "vix_skew_divergence", "vix_skew_velocity_corr_21d"
    df = stage(df, {
        "joint_regime_expected_return": F.coalesce(lookup(j, _by_class(JOINT_MEAN)), F.lit(0.0)),
        "joint_regime_volatility": F.coalesce(lookup(j, _by_class(JOINT_STD)), F.lit(0.0)),
        "joint_regime_frequency": F.coalesce(lookup(j, _by_class(JOINT_FREQ)), F.lit(0.0)),
        "joint_regime_correlation": F.coalesce(lookup(j, _by_class(JOINT_CORR)), F.lit(0.0)),
        "vix_skew_divergence_zscore_63d": R.zscore(d, 63, ax, 1, floor=None),
        "vix_skew_divergence_extreme": flag(F.col(d) > R.quantile(d, 0.85, 252, ax, 1)),
        "vix_skew_synchronized": flag(F.col(d) < R.quantile(d, 0.25, 252, ax, 1)),
        "vix_skew_correlation_breakdown": flag(F.col(v) < R.quantile(v, 0.10, 252, ax, 1)),
        "vix_skew_correlation_regime": cut(v, [-1, -0.5, 0.5, 1], include_lowest=True).cast("double"),
        "both_near_boundary_flag": flag((F.col("vix_boundary_distance") < 2) & (F.col("skew_boundary_distance") < 5)),
        "both_regimes_changed_flag": flag((F.col("vix_regime_transition_direction") != 0) & (F.col("skew_regime_transition_direction") != 0)),
    })
    return state_runs(df, "vix_skew_joint_regime", ax, "joint_regime").drop("_lr", "_tr", "_dl", "_dt", "joint_regime_run")
