"""Whole-matrix and tick-grain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import rolling as R
from tidegrid.operators import calendar as C
from tidegrid.operators import scan as SC
from tidegrid.plans import assembly as AS
from tidegrid.plans import price as PR
from tidegrid.plans import regimes as RG
from tidegrid.queries import packs as PK
from tidegrid.queries import sqlgen as S
from tidegrid.queries.frames import AX, market, market_sql, table
from tidegrid.queries.packs import candle_steps, level_steps, price_steps
from tidegrid.queries.registry import REGISTRY, query, shaped
from tidegrid.queries.sourcing import fresh_folder
from tidegrid.queries.tables import _COHORT, _PROX_COLS
from tidegrid.session import stored

ID = ["series_id", "ts"]
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
_TICKS = f"SELECT l_returnflag AS series_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_extendedprice / 371 AS price, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, {', '.join(ORDER)}) - 1 AS ts FROM lineitem"


def ticks(spark, sf_dir, value):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("day"), *ORDER, (F.col("l_extendedprice") / 371).alias("price"))
    return SC.number_rows(li, ["series_id"], ["day", *ORDER], keep=["series_id", value], few=True)  # a series for each return flag


@query("W5 W11 W2 N1", S.Steps(_TICKS).add(mean21=S.mean("price", 21), z63=S.zscore("price", 63), diff5=S.diff("price", 5)).done(f"SELECT series_id, ts AS pos, {S.r('mean21')} AS mean21, {S.r('z63')} AS z63, {S.r('diff5')} AS diff5 FROM {{prev}}"))
def tick_rolling_chunks(spark, sf_dir):
    # chunks sized for the test tables; the default suits executors
    # the frame's mean and deviation once each: a z-score said whole works the deviation out twice
    frames = lambda ax: {"mean21": R.mean("price", 21, ax), **R.moments("price", [63], ax), "diff5": R.diff("price", 5, ax)}
    out = SC.halo_frames(ticks(spark, sf_dir, "price"), ["series_id"], 62, frames, chunk_rows=4000).withColumn("z63", R.z_of("price", 63))
    return shaped(out.select("series_id", F.col("_pos").alias("pos"), "mean21", "z63", "diff5"))


@query(
    "W25 W28",
    S.Steps(_TICKS).add(up="l_quantity >= 10").add(volume_to_date=f"CAST(sum(l_quantity) {S.upto()} AS DOUBLE)", streak=f"ts - coalesce(max(CASE WHEN NOT up THEN ts END) {S.upto()}, -1)").done(
        f"SELECT series_id, ts AS pos, {S.r('volume_to_date')} AS volume_to_date, CAST(streak AS BIGINT) AS streak FROM {{prev}}"
    ),
)
def tick_running_chunks(spark, sf_dir):
    held = stored(ticks(spark, sf_dir, "l_quantity"), "ticks")  # read twice by each chunked operator
    d = SC.running_sum(held, ["series_id"], "l_quantity", "volume_to_date", chunk_rows=4000)
    d = SC.running_streak(d.withColumn("up", F.col("l_quantity") >= 10), ["series_id"], "up", "streak", chunk_rows=4000)
    return shaped(d.select("series_id", F.col("_pos").alias("pos"), "volume_to_date", "streak"))


def series_panel(spark, sf_dir, key):
    """Daily mean price of every supplier or part: as many series as the table has keys."""
    from tidegrid.operators.bars import spread_series

    li = table(spark, sf_dir, "lineitem").groupBy(F.col(key).alias("series_id"), F.to_date("l_shipdate").alias("ts"))
    return spread_series(li.agg(F.round(F.avg("l_extendedprice") / 371, 4).alias("close"), F.sum("l_quantity").alias("volume")), AX)


def _series_sql(key):
    return S.Steps(f"SELECT {key} AS series_id, CAST(l_shipdate AS DATE) AS ts, round(avg(l_extendedprice) / 371, 4) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2").add(
        z21=S.zscore("close", 21), below10=S.pct_below("close", 10), ret5=f"{S.pct('close', 5)} * 100", pos=f"row_number() {S.over()}"
    ).add(streak=f"pos - coalesce(max(CASE WHEN NOT volume > 25 THEN pos END) {S.upto()}, 0)").out(["z21", "below10", "ret5"], ["streak"])


def _series_features(df):
    from tidegrid.operators.episodes import with_true_streak

    df = R.with_columns(df, {"z21": R.zscore("close", 21, AX), "below10": R.pct_below("close", 10, AX), "ret5": R.pct_change("close", 5, AX) * 100, "busy": F.col("volume") > 25})
    return shaped(with_true_streak(df, "busy", AX), ID + ["z21", "below10", "ret5", "streak"])


@query("W4 W11 W14 W25", _series_sql("l_suppkey"))
def supplier_series_features(spark, sf_dir):
    return _series_features(series_panel(spark, sf_dir, "l_suppkey"))


@query("W4 W11 W14 W25", _series_sql("l_partkey"))
def part_series_features(spark, sf_dir):
    return _series_features(series_panel(spark, sf_dir, "l_partkey"))


_EV_SQL = _COHORT.done("SELECT * FROM {prev}").replace("CAST(o_orderdate AS DATE) AS ts FROM orders", "CAST(l_shipdate AS DATE) AS ts FROM lineitem").replace(
    "min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS year FROM orders", "min(year(l_shipdate)), max(year(l_shipdate)) + 1)) AS year FROM lineitem"
)
# The products of market features with event proximity, spelled out for the SQL.
_PROD = {
    "vix_vel_x_fomc_prox": "vix_velocity_5d * fomc_proximity", "vix_vel_x_fomc_pre": "vix_velocity_5d * fomc_pre_period", "vix_vel_x_fomc_post": "vix_velocity_5d * fomc_post_period", "vix_vel_x_opex_prox": "vix_velocity_5d * opex_proximity",
    "vix_vel_x_earnings": "vix_velocity_5d * earnings_intensity_norm", "vix_vel_x_macro_event": "vix_velocity_5d * macro_event_intensity", "vix_x_fomc_prox": "vix * fomc_proximity", "vix_x_opex_prox": "vix * opex_proximity", "vix_x_earnings": "vix * earnings_intensity_norm",
    "vx_spread_x_opex_prox": "vx1_vx2_spread * opex_proximity", "vx_spread_x_opex_week": "vx1_vx2_spread * opex_week_intensity", "vx_spread_x_vix_expiry": "vx1_vx2_spread * vix_expiry_proximity",
    "spx_gap_x_fomc_post": "spx_gap * fomc_post_period", "spx_gap_x_macro_event": "spx_gap * macro_event_intensity", "spx_rv_x_earnings": "spx_realized_vol_21d * earnings_intensity_norm", "spx_rv_x_fomc_prox": "spx_realized_vol_21d * fomc_proximity",
    "risk_premium_x_fomc_pre": "risk_premium * fomc_pre_period", "risk_premium_x_fomc_post": "risk_premium * fomc_post_period", "risk_premium_x_opex": "risk_premium * opex_proximity",
    "skew_x_fomc_prox": "skew * fomc_proximity", "skew_x_fomc_pre": "skew * fomc_pre_period", "skew_x_macro_event": "skew * macro_event_intensity", "spx_mom_x_earnings": "spx_ret_5d * earnings_intensity_norm", "spx_mom_x_fomc_post": "spx_ret_5d * fomc_post_period",
    "vix_accel_x_fomc_prox": "vix_accel_5d * fomc_proximity", "vix_accel_x_opex_prox": "vix_accel_5d * opex_proximity", "vix_vol_x_opex_week": "vix_vol_21d * opex_week_intensity", "vix_vol_x_vix_expiry": "vix_vol_21d * vix_expiry_proximity",
    "hy_spread_x_fomc_prox": "hy_spread * fomc_proximity", "hy_spread_x_macro_event": "hy_spread * macro_event_intensity", "regime_x_fomc_prox": "vix_regime * fomc_proximity", "regime_x_opex_prox": "vix_regime * opex_proximity", "regime_x_earnings": "vix_regime * earnings_intensity_norm",
}
_F30 = candle_steps(price_steps(level_steps(S.Steps(market_sql(["vix", "skew", "vix3m", "hy"]))))).raw(
    "SELECT p.*, " + ", ".join(f"e.{c}" for c in _PROX_COLS) + f" FROM {{prev}} p JOIN ({_EV_SQL}) e ON e.ts = p.ts"
).add(risk_premium="vix - spx_realized_vol_21d", vx1_vx2_spread="vix - vix3m", hy_spread="hy * 2", vix_regime=S.cut("vix", [0, 15.57, 23.36, 31.16, 100], lowest=True)).add(
    **{k: f"coalesce({v}, 0)" for k, v in _PROD.items()}, vix_vel_abs_x_multi_event="coalesce(abs(vix_velocity_5d) * multi_event_stress, 0)"
)
_F30D = [*_PROD, "vix_vel_abs_x_multi_event"]


def meetings(spark, sf_dir):
    return C.meetings_from_rows(table(spark, sf_dir, "orders").filter("o_totalprice > 490000"), "o_orderdate")


@query("F30 T11", _F30.out(_F30D))
def pack_event_products(spark, sf_dir):
    """All twelve families; futures spread and credit spread are stood in for by two levels and a scaled one."""
    df = PR.candle_features(PR.price_features(PR.level_features(market(spark, sf_dir, ["vix", "skew", "vix3m", "hy"]), AX), AX), AX)
    df = RG.regime_pack(df.withColumns({"vx1_vx2_spread": F.col("vix") - F.col("vix3m"), "hy_spread": F.col("hy") * 2}), AX)
    return shaped(AS.event_features(df, AX, meetings(spark, sf_dir)), ID + _F30D)


_ALL = ["vix", "vix3m", "vix6m", "skew", "vvix", "vxth", "vxtlt", "stress", "hy", "hy_bb", "hy_b", "hy_ccc", "ig", "y3m", "y2y", "y5y", "y10y", "y30y", "y6m", "gold", "dxy", "ovx", "gvz", "crude", "natgas", "copper"]
_SPREAD = [c for c in PK._F14D if c.startswith(("cl1_", "crude_"))]
_COMMODITY_D, _COMMODITY_I = _SPREAD + PK._F17D + PK._F18D + PK._F19D, ["oil_term_regime", "gold_regime", "copper_economic_signal", *PK._F19I]


def whole_market(spark, sf_dir):
    return market(spark, sf_dir, _ALL).withColumn("cl_spread", (F.col("crude") - F.col("copper")) / 10)


@query(
    "F31 F15 F17 F18 F19 F20",
    f"SELECT * FROM ({PK._F14.out(_SPREAD, ['oil_term_regime'])}) JOIN ({PK._F17.out(PK._F17D)}) USING (series_id, ts) JOIN ({PK._F18.out(PK._F18D, ['gold_regime', 'copper_economic_signal'])}) USING (series_id, ts) JOIN ({PK._F19.out(PK._F19D, PK._F19I)}) USING (series_id, ts)",
)
def matrix_commodity_columns(spark, sf_dir):
    """The whole matrix's commodity and cross-asset columns against the SQL of their packs."""
    out = AS.feature_matrix(whole_market(spark, sf_dir), AX, meetings(spark, sf_dir))
    return shaped(out, ID + _COMMODITY_D + _COMMODITY_I)


_q31 = ["vix", "close", "p21", "rv"]
_AGES = {"skew": "day(ts) % 9", "dxy": "day(ts)"}  # days since the last update, as the SQL says it


def _aged(c: str, age: str, lag: int) -> str:
    late = f"({age} - {lag})"
    return f"CASE WHEN {c} IS NULL THEN 0.5 WHEN {late} <= 0 THEN 1 WHEN {late} <= 3 THEN 0.95 WHEN {late} <= 7 THEN 0.8 WHEN {late} <= 14 THEN 0.5 ELSE 0.2 END"


@query(
    "F31 V6 V7 F26",
    S.Steps(market_sql(["vix", "skew", "y10y", "y2y", "dxy"])).add(sr=S.pct("close", 1), p21=S.pct_below("vix", 21)).add(rv=S.rvol("sr", 21)).add(
        feature_quality="(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in _q31) + f" + 0.5 + {_aged('skew', _AGES['skew'], 1)} + CASE WHEN y10y - y2y IS NULL THEN 0.5 ELSE 1 END + {_aged('dxy', _AGES['dxy'], 0)} + 2.7) / 11.0",
        vix_percentile_21d="p21", spx_realized_vol_21d="rv", yield_10y2y="y10y - y2y",
    ).out(["vix", "vix_percentile_21d", "spx_realized_vol_21d", "yield_10y2y", "feature_quality"]),
)
def feature_matrix(spark, sf_dir):
    """Quality of each row with the age of two of its features."""
    ages = {"skew": F.dayofmonth("ts") % 9, "dxy": F.dayofmonth("ts")}
    out = AS.feature_matrix(whole_market(spark, sf_dir), AX, meetings(spark, sf_dir), ages, {"skew": 1})
    return shaped(out, ID + ["vix", "vix_percentile_21d", "spx_realized_vol_21d", "yield_10y2y", "feature_quality"])


# Columns of packs that the matrix has otherwise or not at all, and columns of the matrix that no pack's SQL has.
_OTHERWISE = {
    "pack_tail_regime": ("skew_percentile_63d", "skew_percentile_252d"), "pack_macro_and_spread": ("gold_zscore_63d", "gold_ret_10d", "gold_ret_21d", "gold_ret_63d", "cpi_lag1", "cpi_zscore_63d", "cpi_change_10d", "cpi_change_21d", "cpi_change_63d"),
    "pack_interactions": ("credit_vol_divergence",),  # ranks of z-scores, which flip with the last bit of their input
    "pack_event_products": ("vx_spread_x_opex_prox", "vx_spread_x_opex_week", "vx_spread_x_vix_expiry", "hy_spread_x_fomc_prox", "hy_spread_x_macro_event"), "pack_futures_curve": None,
}
_UNSAID = (
    "feature_quality", "credit_vol_divergence", "hy_spread_x_fomc_prox", "hy_spread_x_macro_event", "risk_premium", "crude_oil_vol_21d_log", "regime_run", "skew_regime_run", "joint_regime_run", "vix_skew_correlation_breakdown", "vix_skew_correlation_regime", "initial_claims",
    "rsi_14", "rsi_regime", "rsi_divergence", "macd", "macd_signal", "macd_histogram", "adx_14", *[f"gvz_{k}_{w}d" for k in ("ret", "velocity") for w in (5, 10, 21)],
    "days_to_meeting", "days_to_opex", "days_to_futures", "is_minutes", "is_cpi", "is_pce", "earnings_intensity", "cohort_weight", "is_fomc_period", "is_opex_week", "is_earnings_heavy", "month", "day_of_week", "day_of_month",
)


#: Places that the packs' SQL gives, where it is not six.
_DIGITS = {4: tuple(PK._F9D + PK._F10D), 9: tuple(c for c in PK._RATIOS if c != "vvix_vix_ratio")}


def _long(sql: str, drop: tuple[str, ...] = ()) -> str:
    gone = ", ".join(("series_id", "ts", *drop))
    return f"SELECT series_id, ts, feature, value FROM (UNPIVOT (SELECT series_id, CAST(ts AS DATE) AS ts, TRY_CAST(COLUMNS(* EXCLUDE ({gone})) AS DOUBLE) FROM ({sql})) ON COLUMNS(* EXCLUDE (series_id, ts)) INTO NAME feature VALUE value)"


def _every_column() -> str:
    parts = [_long(f"SELECT *, (crude - copper) / 10 AS cl_spread FROM ({market_sql(_ALL)})")]
    parts += [_long(q.sql, _OTHERWISE.get(n, ())) for n, q in sorted(REGISTRY.items()) if n.startswith("pack_") and _OTHERWISE.get(n, ()) is not None]
    parts.append(_long(f"SELECT m.series_id, m.ts, {', '.join(f'e.{c}' for c in _PROX_COLS)} FROM ({market_sql([])}) m JOIN ({_EV_SQL}) e ON e.ts = m.ts"))
    digits = "CASE " + " ".join(f"WHEN feature IN ({', '.join(chr(39) + c + chr(39) for c in names)}) THEN round(value, {n})" for n, names in _DIGITS.items()) + " ELSE round(value, 6) END"
    exact = f"CAST({digits} AS DECIMAL(38, 9))"
    return (
        f"SELECT feature, count(*) AS known, CAST(sum({exact}) AS VARCHAR) AS total, CAST(sum({exact} * (ts - DATE '1970-01-01')) AS VARCHAR) AS by_day"
        f" FROM (SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)})) GROUP BY 1"
    )


@query("F31 F1 F2 F3 F4 F5 F6 F7 F8 F9 F10 F11 F12 F14 F16 F17 F18 F19 F26 F27 F30", _every_column())
def feature_matrix_columns(spark, sf_dir):
    """Every column of the whole matrix against the SQL of its pack: known cells, and exact sums of the rounded
    cells, plain and weighted by day."""
    out = AS.feature_matrix(whole_market(spark, sf_dir), AX, meetings(spark, sf_dir))
    cols = [f.name for f in out.schema.fields if f.dataType.typeName() in ("double", "integer", "long") and f.name not in _UNSAID]
    wide = stored(out.select("ts", *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]), "matrix")  # one wide pass, one long one
    long = wide.unpivot(["ts"], cols, "feature", "value").filter("value IS NOT NULL")
    rounded = F.when(F.col("feature").isin(*_DIGITS[4]), F.round("value", 4)).when(F.col("feature").isin(*_DIGITS[9]), F.round("value", 9)).otherwise(F.round("value", 6))
    exact = rounded.cast("decimal(20,9)")
    day = F.datediff("ts", F.lit("1970-01-01").cast("date"))
    return long.groupBy("feature").agg(F.count("value").alias("known"), F.sum(exact).cast("decimal(38,9)").cast("string").alias("total"), F.sum(exact * day).cast("decimal(38,9)").cast("string").alias("by_day"))


@query("F31 F32 A9")
def feature_matrix_profile(spark, sf_dir):
    """Known share and mean of every feature of the full matrix."""
    out = AS.feature_matrix(whole_market(spark, sf_dir), AX, meetings(spark, sf_dir))
    cols = [f.name for f in out.schema.fields if f.dataType.typeName() in ("double", "integer", "long") and f.name not in ("series_id",)]
    path = fresh_folder(spark, "matrix")
    out.write.parquet(path)
    stored = spark.read.parquet(path)
    long = stored.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot([], cols, "feature", "value")
    return shaped(long.groupBy("feature").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("known_share"), F.avg("value").alias("mean")))
