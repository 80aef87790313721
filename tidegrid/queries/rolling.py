"""Window-function queries over the daily panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import rolling as R
from tidegrid.functions import technical as TI
from tidegrid.functions.scalar import clip, flag, nonzero
from tidegrid.functions.technical import stage
from tidegrid.queries import sqlgen as S
from tidegrid.queries.frames import AX, BARS_SQL, bars, market, market_sql
from tidegrid.queries.registry import query, shaped

ID = ["series_id", "ts"]


@query(
    "W1 W2 W3 W4 W32",
    S.Steps(BARS_SQL)
    .add(
        lag1=S.lag("close", 1), lead1=S.lead("close", 1), diff5=S.diff("close", 5),
        pct5=f"{S.pct('close', 5)} * 100", pct5_plain=f"(close / nullif({S.lag('close', 5)}, 0) - 1) * 100",
        fwd_log_5=f"ln({S.lead('close', 5)} / close) * 100", bwd_log_5=f"ln(close / {S.lag('close', 5)}) * 100",
    )
    .add(accel5=S.diff("diff5", 5)).add(jerk5=S.diff("accel5", 5))
    .out(["lag1", "lead1", "diff5", "pct5", "pct5_plain", "fwd_log_5", "bwd_log_5", "accel5", "jerk5"]),
)
def shift_and_change(spark, sf_dir):
    df = stage(bars(spark, sf_dir), {
        "lag1": R.lag("close", 1, AX), "lead1": R.lead("close", 1, AX), "diff5": R.diff("close", 5, AX),
        "pct5": R.pct_change("close", 5, AX) * 100, "pct5_plain": R.pct_change("close", 5, AX, pad=False) * 100,
        "fwd_log_5": F.ln(R.lead("close", 5, AX) / F.col("close")) * 100,
        "bwd_log_5": F.ln(F.col("close") / R.lag("close", 5, AX)) * 100,
    })
    df = stage(df, {"accel5": R.diff("diff5", 5, AX)})
    df = stage(df, {"jerk5": R.diff("accel5", 5, AX)})
    return shaped(df, ID + ["lag1", "lead1", "diff5", "pct5", "pct5_plain", "fwd_log_5", "bwd_log_5", "accel5", "jerk5"])


@query(
    "W5 W6 W8 W11 W12",
    S.Steps(BARS_SQL).add(ret=S.pct("close", 1))
    .add(
        mean21=S.mean("close", 21), std21=S.std("close", 21), sum5=S.total("close", 5), rv21=S.rvol("ret", 21),
        skew21=S.guard("ret", 21, f"skewness(ret) {S.frame(21)}"), kurt21=S.guard("ret", 21, f"kurtosis(ret) {S.frame(21)}"),
        z63=S.zscore("close", 63), z63_half=S.zscore_null("close", 63, 31),
    )
    .out(["mean21", "std21", "sum5", "rv21", "skew21", "kurt21", "z63", "z63_half"]),
)
def rolling_moments(spark, sf_dir):
    df = stage(bars(spark, sf_dir), {"ret": R.pct_change("close", 1, AX)})
    df = stage(df, {
        "mean21": R.mean("close", 21, AX), "std21": R.std("close", 21, AX), "sum5": R.total("close", 5, AX),
        "rv21": R.realized_vol("ret", 21, AX), "skew21": R.skew("ret", 21, AX), "kurt21": R.kurt("ret", 21, AX),
        "z63": R.zscore("close", 63, AX), "z63_half": R.zscore("close", 63, AX, min_periods=31, floor=None),
    })
    return shaped(df, ID + ["mean21", "std21", "sum5", "rv21", "skew21", "kurt21", "z63", "z63_half"])


_prior = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"


@query(
    "W7 W21 W22",
    S.Steps(market_sql(["vix", "vix3m"]))
    .add(
        q10=S.quantile("vix", 0.1, 21), q95=S.quantile("vix3m", 0.95, 63, 32),
        low_flag=S.flag(f"vix < {S.quantile('vix', 0.1, 21)}"), high_flag=S.flag(f"abs(vix) > {S.quantile('vix', 0.9, 252)}"),
        threshold=f"(CASE WHEN count(vix) {_prior} >= 126 THEN quantile_cont(vix, 0.85) {_prior} END)",
    )
    .out(["q10", "q95", "threshold"], ["low_flag", "high_flag"]),
)
def rolling_quantile_flags(spark, sf_dir):
    df = stage(market(spark, sf_dir, ["vix", "vix3m"]), {
        "q10": R.quantile("vix", 0.1, 21, AX), "q95": R.quantile("vix3m", 0.95, 63, AX, 32),
        "low_flag": TI.extreme_flag("vix", 0.1, 21, AX, low=True),
        "high_flag": TI.extreme_flag("vix", 0.9, 252, AX, absolute=True),
        "threshold": R.prior_quantile("vix", 0.85, 252, AX, 126),
    })
    return shaped(df, ID + ["q10", "q95", "threshold", "low_flag", "high_flag"])


@query(
    "W9 W23",
    S.Steps(market_sql(["vix", "skew", "vix3m"])).add(dv=S.diff("vix", 5), ds=S.diff("skew", 5))
    .add(
        level_corr=S.corr("vix", "skew", 21), velocity_corr=S.corr("dv", "ds", 21, 1), sparse_corr=S.corr("vix3m", "skew", 63, 40),
        asymmetry=f"abs({S.mean('abs(dv)', 21)} - {S.mean('abs(ds)', 21)})",
    )
    .out(["level_corr", "velocity_corr", "sparse_corr", "asymmetry"]),
)
def rolling_correlation(spark, sf_dir):
    df = stage(market(spark, sf_dir, ["vix", "skew", "vix3m"]), {"dv": R.diff("vix", 5, AX), "ds": R.diff("skew", 5, AX)})
    df = stage(df, {
        "level_corr": R.corr("vix", "skew", 21, AX), "velocity_corr": R.corr("dv", "ds", 21, AX, 1),
        "sparse_corr": R.corr("vix3m", "skew", 63, AX, 40), "asymmetry": TI.velocity_asymmetry("dv", "ds", 21, AX),
    })
    return shaped(df, ID + ["level_corr", "velocity_corr", "sparse_corr", "asymmetry"])


@query(
    "W13 W14 W31 W34",
    S.Steps(market_sql(["vix", "vix3m"]))
    .add(
        rank63=S.rank_pct("vix", 63), rank63_any=S.rank_pct("vix3m", 63, 1), rank252_half=f"{S.rank_pct('vix', 252, 126)} * 100",
        below63=S.pct_below("vix", 63), below21=S.pct_below("vix3m", 21),
        prior126=(
            "(CASE WHEN count(vix) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) >= 75 THEN "
            "len(list_filter(list(vix) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 125 PRECEDING AND 1 PRECEDING), lambda v: v < vix)) * 1.0 "
            "/ count(vix) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 125 PRECEDING AND 1 PRECEDING) END)"
        ),
    )
    .add(below_velocity=S.diff("below63", 10))
    .out(["rank63", "rank63_any", "rank252_half", "below63", "below21", "prior126", "below_velocity"]),
)
def rolling_ranks(spark, sf_dir):
    df = stage(market(spark, sf_dir, ["vix", "vix3m"]), {
        "rank63": R.rank_pct("vix", 63, AX), "rank63_any": R.rank_pct("vix3m", 63, AX, 1),
        "rank252_half": R.rank_pct("vix", 252, AX, 126) * 100,
        "below63": R.pct_below("vix", 63, AX), "below21": R.pct_below("vix3m", 21, AX),
        "prior126": R.prior_rank("vix", 126, AX, 75),
    })
    df = stage(df, {"below_velocity": R.diff("below63", 10, AX)})
    return shaped(df, ID + ["rank63", "rank63_any", "rank252_half", "below63", "below21", "prior126", "below_velocity"])


@query(
    "W15",
    S.Steps(market_sql(["vix", "vix3m"]))
    .add(
        rank_vix=S.full_rank("vix"), rank_vix3m=S.full_rank("vix3m"),
        rank_expanding=(
            f"(len(list_filter(list(vix) {S.upto()}, lambda v: v < vix)) + (len(list_filter(list(vix) {S.upto()}, lambda v: v = vix)) + 1) / 2.0)"
            f" / count(vix) {S.upto()}"
        ),
    )
    .add(divergence="abs(rank_vix - rank_vix3m)")
    .out(["rank_vix", "rank_vix3m", "rank_expanding", "divergence"]),
)
def full_sample_ranks(spark, sf_dir):
    df = market(spark, sf_dir, ["vix", "vix3m"])
    df = stage(df, {"rank_expanding": R.expanding_rank_pct("vix", AX)})
    df = stage(df, {"rank_vix": R.full_rank_pct("vix", AX)})
    df = stage(df, {"rank_vix3m": R.full_rank_pct("vix3m", AX)})
    df = stage(df, {"divergence": F.abs(F.col("rank_vix") - F.col("rank_vix3m"))})
    return shaped(df, ID + ["rank_vix", "rank_vix3m", "rank_expanding", "divergence"])


def _ewm(x: str, span: int) -> str:
    keep = 1 - 2 / (span + 1)
    return (
        f"(SELECT b.series_id, b.pos, sum(a.{x} * pow({keep!r}::DOUBLE, b.pos - a.pos)) FILTER (a.{x} IS NOT NULL)"
        f" / sum(pow({keep!r}::DOUBLE, b.pos - a.pos)) FILTER (a.{x} IS NOT NULL) AS e"
        f" FROM {{prev}} a JOIN {{prev}} b ON a.series_id = b.series_id AND a.pos <= b.pos GROUP BY 1, 2)"
    )


def _macd_steps(base):
    return (
        S.Steps(base).add(pos=f"row_number() {S.over()}")
        .raw(
            f"SELECT p.*, f.e - s.e AS macd FROM {{prev}} p JOIN {_ewm('close', 12)} f ON p.series_id = f.series_id AND p.pos = f.pos"
            f" JOIN {_ewm('close', 26)} s ON p.series_id = s.series_id AND p.pos = s.pos"
        )
        .raw(f"SELECT p.*, g.e AS macd_signal FROM {{prev}} p JOIN {_ewm('macd', 9)} g ON p.series_id = g.series_id AND p.pos = g.pos")
        .add(macd_histogram="macd - macd_signal")
    )


@query("W16", _macd_steps(BARS_SQL).out(["macd", "macd_signal", "macd_histogram"]))
def ewm_macd(spark, sf_dir):
    return shaped(TI.macd(bars(spark, sf_dir), "close", AX), ID + ["macd", "macd_signal", "macd_histogram"])


@query(
    "W17 W18 W19 W20",
    S.Steps(BARS_SQL)
    .add(d=S.diff("close", 1), up=f"greatest({S.diff('high', 1)}, 0)", dn=f"greatest(-{S.diff('low', 1)}, 0)",
         tr=f"greatest(high - low, abs(high - {S.lag('close', 1)}), abs(low - {S.lag('close', 1)}))",
         m20=S.mean("close", 20), s20=S.std("close", 20), m21=S.mean("close", 21),
         has1=f"{S.lag('close', 1)} IS NOT NULL")
    .add(up="CASE WHEN has1 THEN up END", dn="CASE WHEN has1 THEN dn END")
    .raw("SELECT series_id, ts, close, d, tr, m20, s20, m21, CASE WHEN has1 THEN up END AS up2, CASE WHEN has1 THEN dn END AS dn2 FROM s1")
    .add(gain=S.mean("CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", 14), loss=S.mean("CASE WHEN d IS NOT NULL THEN -least(d, 0) END", 14),
         pdi=f"100 * {S.mean('up2', 14)} / nullif({S.mean('tr', 14)}, 0)", mdi=f"100 * {S.mean('dn2', 14)} / nullif({S.mean('tr', 14)}, 0)")
    .add(rsi_14="100 - 100 / (1 + gain / nullif(loss, 0))", dx="100 * abs(pdi - mdi) / nullif(pdi + mdi, 0)",
         bb_position=S.clip("((close - (m20 - 2 * s20)) / nullif((m20 + 2 * s20) - (m20 - 2 * s20), 0))", 0, 1),
         bb_width="((m20 + 2 * s20) - (m20 - 2 * s20)) / nullif(m20, 0) * 100",
         vs_ma21="(close - m21) / nullif(m21, 0) * 100", stretch="abs(close - m21)", reversion="abs(close - m21) / nullif(m21, 0)")
    .add(rsi_divergence=f"rsi_14 - {S.mean('rsi_14', 21)}", adx_14=S.mean("dx", 14))
    .out(["rsi_14", "rsi_divergence", "adx_14", "bb_position", "bb_width", "vs_ma21", "stretch", "reversion"]),
)
def technical_indicators(spark, sf_dir):
    df = TI.adx(TI.rsi(bars(spark, sf_dir), "close", AX), AX)
    m21 = R.mean("close", 21, AX)
    df = stage(df, {
        **TI.bollinger("close", AX, "bb"), "vs_ma21": R.vs_average("close", 21, AX), "stretch": F.abs(F.col("close") - m21),
        "reversion": F.abs(F.col("close") - m21) / nonzero(m21), "rsi_divergence": F.col("rsi_14") - R.mean("rsi_14", 21, AX),
    })
    return shaped(df, ID + ["rsi_14", "rsi_divergence", "adx_14", "bb_position", "bb_width", "vs_ma21", "stretch", "reversion"])


@query(
    "W33",
    S.Steps(market_sql(["skew"])).add(regime=S.cut("skew", [0, 114.68, 119.61, 127.27, 200], lowest=True))
    .add(
        z_all="CASE WHEN stddev_samp(skew) OVER g = 0 THEN 0 ELSE (skew - avg(skew) OVER g) / stddev_samp(skew) OVER g END".replace("OVER g", "OVER (PARTITION BY series_id, regime)"),
        z_past=f"CASE WHEN stddev_samp(skew) {S.upto('series_id, regime')} = 0 THEN 0 ELSE (skew - avg(skew) {S.upto('series_id, regime')}) / stddev_samp(skew) {S.upto('series_id, regime')} END",
    )
    .out(["z_all", "z_past"], ["regime"]),
)
def within_regime_zscore(spark, sf_dir):
    from tidegrid.functions.scalar import cut

    df = stage(market(spark, sf_dir, ["skew"]), {"regime": cut("skew", [0, 114.68, 119.61, 127.27, 200], include_lowest=True)})
    df = stage(df, {"z_all": TI.group_zscore("skew", "regime", AX, expanding=False), "z_past": TI.group_zscore("skew", "regime", AX)})
    return shaped(df, ID + ["regime", "z_all", "z_past"])


@query(
    "W35 W37 W38 P11",
    S.Steps(market_sql(["vix", "skew"])).add(prev=S.lag("vix", 1), s21=S.std("vix", 21))
    .add(fixed_gap="abs((vix - 19.82) / 8.39 - (skew - 122.65) / 11.32)", norm_vol="s21 / nullif(max(s21) OVER (PARTITION BY series_id), 0)",
         autocorr="corr(vix, prev) OVER (PARTITION BY series_id)", log_vol="CASE WHEN s21 IS NOT NULL THEN ln(1 + greatest(s21, 0)) END", root="sqrt(vix)", up="sign(vix - prev)", e="exp(-vix / 30)")
    .out(["fixed_gap", "norm_vol", "autocorr", "log_vol", "root", "up", "e"]),
)
def normalised_levels(spark, sf_dir):
    from pyspark.sql import Window

    df = TI.normalised_volatility(market(spark, sf_dir, ["vix", "skew"]), "vix", 21, AX, "norm_vol")
    df = stage(df, {"prev": R.lag("vix", 1, AX), "s21": R.std("vix", 21, AX)})
    df = stage(df, {
        "fixed_gap": F.abs((F.col("vix") - 19.82) / 8.39 - (F.col("skew") - 122.65) / 11.32),
        "autocorr": F.corr("vix", "prev").over(Window.partitionBy("series_id")),
        "log_vol": F.log1p(clip("s21", lo=0)), "root": F.sqrt("vix"), "up": F.signum(F.col("vix") - F.col("prev")), "e": F.exp(-F.col("vix") / 30),
    })
    return shaped(df, ID + ["fixed_gap", "norm_vol", "autocorr", "log_vol", "root", "up", "e"])


@query(
    "W36 P21",
    S.Steps(market_sql(["vix3m", "y10y"]))
    .add(
        filled=f"coalesce(vix3m, last_value(vix3m IGNORE NULLS) {S.frame(4)})",
        y_filled=f"coalesce(y10y, last_value(y10y IGNORE NULLS) {S.frame(6)})",
        age="row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) - 1",
    )
    .add(w="pow(0.5::DOUBLE, age / 21.0::DOUBLE)")
    .add(weight="w / sum(w) OVER (PARTITION BY series_id)")
    .out(["filled", "y_filled", "weight"], digits=6),
)
def limited_fill_and_decay(spark, sf_dir):
    df = stage(market(spark, sf_dir, ["vix3m", "y10y"]), {
        "filled": R.fill_forward("vix3m", 3, AX), "y_filled": R.fill_forward("y10y", 5, AX), "weight": R.decay_weights(AX, 21),
    })
    return shaped(df, ID + ["filled", "y_filled", "weight"])
