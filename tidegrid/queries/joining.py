"""Alignment and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import rolling as R
from tidegrid.operators import calendar as C
from tidegrid.operators import joins as J
from tidegrid.queries import sqlgen as S
from tidegrid.queries.frames import AX, BARS_SQL, bars, market, market_sql
from tidegrid.queries.registry import query, shaped
from tidegrid.queries.sourcing import fresh_folder
from tidegrid.sources import sinks as SK

# A sparse source: daily bars whose close is unknown on days of one order only.
SPARSE_SQL = f"SELECT series_id, ts, CASE WHEN volume >= 2 OR day(ts) <= 20 THEN close END AS v FROM ({BARS_SQL})"
DAYS_SQL = f"SELECT series_id, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM ({BARS_SQL}) GROUP BY 1"


def sparse(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.select("series_id", "ts", F.when((F.col("volume") >= 2) | (F.dayofmonth("ts") <= 20), F.col("close")).alias("v"))


def all_days(spark, sf_dir):
    return C.series_calendar(bars(spark, sf_dir), AX)


def _asof_sql(limit: int | None) -> str:
    cond = "TRUE" if limit is None else f"reuse <= {limit}"
    return (
        f"WITH src AS ({SPARSE_SQL}), tgt AS ({DAYS_SQL}),"
        " m AS (SELECT t.series_id, t.ts, s.ts AS lbl, s.v FROM tgt t ASOF LEFT JOIN src s ON t.series_id = s.series_id AND t.ts >= s.ts),"
        " c AS (SELECT *, count(*) FILTER (lbl <> ts) OVER (PARTITION BY series_id, lbl ORDER BY ts) AS reuse FROM m)"
        f" SELECT series_id, {S.day('ts')} AS ts, CASE WHEN {cond} THEN {S.r('v')} END AS v, CASE WHEN {cond} THEN {S.day('lbl')} END AS matched_ts FROM c"
    )


@query("J2 S13 N12", _asof_sql(2))
def asof_backward_limited(spark, sf_dir):
    out = J.asof_join(all_days(spark, sf_dir), sparse(spark, sf_dir), AX, ["v"], limit=2, matched="matched_ts")
    return shaped(out, ["series_id", "ts", "v", "matched_ts"])


@query("J3", _asof_sql(None))
def asof_backward_unlimited(spark, sf_dir):
    out = J.asof_join(all_days(spark, sf_dir), sparse(spark, sf_dir), AX, ["v"], matched="matched_ts")
    return shaped(out, ["series_id", "ts", "v", "matched_ts"])


@query(
    "J4",
    f"WITH src AS ({SPARSE_SQL}), tgt AS ({DAYS_SQL}) SELECT t.series_id, {S.day('t.ts')} AS ts, {S.r('s.v')} AS v, {S.day('s.ts')} AS matched_ts"
    " FROM tgt t ASOF LEFT JOIN src s ON t.series_id = s.series_id AND t.ts <= s.ts",
)
def asof_forward(spark, sf_dir):
    out = J.asof_join(all_days(spark, sf_dir), sparse(spark, sf_dir), AX, ["v"], direction="forward", matched="matched_ts")
    return shaped(out, ["series_id", "ts", "v", "matched_ts"])


@query(
    "J5",
    f"WITH src AS ({SPARSE_SQL}), tgt AS ({DAYS_SQL}),"
    " b AS (SELECT t.series_id, t.ts, s.ts AS bt, s.v AS bv FROM tgt t ASOF LEFT JOIN src s ON t.series_id = s.series_id AND t.ts >= s.ts),"
    " f AS (SELECT t.*, s.ts AS ft, s.v AS fv FROM b t ASOF LEFT JOIN src s ON t.series_id = s.series_id AND t.ts <= s.ts)"
    f" SELECT series_id, {S.day('ts')} AS ts, {S.r('CASE WHEN bt IS NULL OR ft - ts <= ts - bt THEN fv ELSE bv END')} AS v,"
    f" {S.day('CASE WHEN bt IS NULL OR ft - ts <= ts - bt THEN ft ELSE bt END')} AS matched_ts FROM f",
)
def nearest_label(spark, sf_dir):
    out = J.nearest_join(all_days(spark, sf_dir), sparse(spark, sf_dir), AX, ["v"])
    return shaped(out, ["series_id", "ts", "v", "matched_ts"])


@query(
    "J6",
    f"WITH src AS ({SPARSE_SQL}), tgt AS ({DAYS_SQL}) SELECT t.series_id, {S.day('t.ts')} AS ts, {S.day('min(s.ts)')} AS found_ts, {S.r('arg_min(s.v, s.ts)')} AS v"
    " FROM tgt t LEFT JOIN (SELECT * FROM src WHERE v IS NOT NULL) s ON t.series_id = s.series_id AND s.ts BETWEEN t.ts + 5 AND t.ts + 8 GROUP BY 1, t.ts",
)
def bounded_forward_probe(spark, sf_dir):
    src = sparse(spark, sf_dir).filter(F.col("v").isNotNull())
    out = J.first_within(all_days(spark, sf_dir), src, AX, F.date_add("ts", 5), 3, ["v"])
    return shaped(out, ["series_id", "ts", "found_ts", "v"])


@query(
    "J1 U1 W36",
    f"WITH b AS ({BARS_SQL}), d AS (SELECT DISTINCT ts FROM b) SELECT {S.day('d.ts')} AS ts, "
    + ", ".join(f"{S.r(f'max(close) FILTER (series_id = {chr(39)}{p}{chr(39)})')} AS {a}" for p, a in [("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"), ("4-NOT SPECIFIED", "unspecified"), ("5-LOW", "low")])
    + " FROM d JOIN b ON d.ts = b.ts GROUP BY d.ts",
)
def outer_alignment(spark, sf_dir):
    from tidegrid.axis import Axis

    names = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
    long = bars(spark, sf_dir).withColumn("market", F.lit("all"))
    wide = J.align_long_to_wide(long, Axis(("market",), "ts"), "series_id", "close", list(names))
    return shaped(wide.select("ts", *[F.col(f"`{k}`").alias(v) for k, v in names.items()]))


@query(
    "J8 J9 T8 T9 T11",
    "WITH days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS ts FROM lineitem), ev AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_totalprice > 490000),"
    " nx AS (SELECT days.ts, min(ev.d) AS d FROM days LEFT JOIN ev ON ev.d >= days.ts GROUP BY 1)"
    f" SELECT {S.day('ts')} AS ts, CAST(-(d - ts) AS DOUBLE) AS days_to_meeting,"
    " CASE WHEN EXISTS (SELECT 1 FROM ev WHERE abs(nx.ts - (ev.d + 21)) <= 2) THEN 1 ELSE 0 END AS is_minutes FROM nx",
)
def event_distance(spark, sf_dir):
    from tidegrid.queries.frames import table

    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("ts")).distinct()
    ev = C.meetings_from_rows(table(spark, sf_dir, "orders").filter("o_totalprice > 490000"), "o_orderdate")
    d = J.signed_days_to_next(days, ev, "ts", "event_date", "days_to_meeting")
    d = J.near_any_event(d, ev, "ts", "event_date", 21, 2, "is_minutes")
    return shaped(d.select("ts", F.col("days_to_meeting").cast("double").alias("days_to_meeting"), "is_minutes"))


@query(
    "J10 J18",
    "WITH m AS (" + market_sql(["vix", "skew"]) + "), t(regime, regime_name, mean_return, prob_up, stay) AS (VALUES (0,'Low Vol',2.331::DOUBLE,0.541::DOUBLE,0.8726::DOUBLE),(1,'Normal',-0.813,0.435,0.7365),(2,'Elevated',-3.475,0.380,0.7320),(3,'Crisis',-6.487,0.335,0.7209)),"
    f" r AS (SELECT *, {S.cut('vix', [0, 15.57, 23.36, 31.16, 100], lowest=True)} AS regime FROM m)"
    f" SELECT series_id, t.regime_name, count(*) AS days, {S.r('min(vix)')} AS vix_min, {S.r('max(vix)')} AS vix_max, {S.r('any_value(mean_return)')} AS mean_return, {S.r('any_value(prob_up)')} AS prob_up, {S.r('any_value(stay)')} AS prob_stay"
    " FROM r JOIN t USING (regime) GROUP BY 1, 2",
)
def regime_lookup(spark, sf_dir):
    from tidegrid.plans import regimes as RG

    df = market(spark, sf_dir, ["vix", "skew"]).withColumn("regime", RG.level_regime("vix"))
    df = J.attach_lookup(df, RG.regime_dimension(spark), ["regime"], {"mean_return": 0.0, "prob_up": 0.0, "prob_stay": 0.0})
    out = df.groupBy("series_id", "regime_name").agg(
        F.count("*").alias("days"), F.min("vix").alias("vix_min"), F.max("vix").alias("vix_max"),
        F.first("mean_return").alias("mean_return"), F.first("prob_up").alias("prob_up"), F.first("prob_stay").alias("prob_stay"),
    )
    return shaped(out)


_STATE = S.Steps(BARS_SQL).add(go=f"close > {S.mean('close', 10)}").add(prev_go=S.lag("go", 1))


@query(
    "J11 J12 U2 U3",
    _STATE.done(
        f"SELECT a.series_id, {S.day('a.ts')} AS ts, CASE WHEN t.ts IS NOT NULL THEN 'transition' ELSE 'control' END AS day_group FROM {{prev}} a"
        " LEFT JOIN (SELECT series_id, ts FROM {prev} WHERE prev_go AND NOT go) t ON a.series_id = t.series_id AND a.ts = t.ts"
        " WHERE t.ts IS NOT NULL OR a.go"
    ),
)
def event_and_control_days(spark, sf_dir):
    df = bars(spark, sf_dir)
    df = df.withColumn("go", F.col("close") > R.mean("close", 10, AX))
    df = df.withColumn("prev_go", R.lag("go", 1, AX))
    events = df.filter("prev_go AND NOT go").select("series_id", "ts")
    hit = df.join(events, ["series_id", "ts"], "left_semi").withColumn("day_group", F.lit("transition"))
    control = df.filter("go").join(events, ["series_id", "ts"], "left_anti").withColumn("day_group", F.lit("control"))
    return shaped(hit.unionByName(control), ["series_id", "ts", "day_group"])


@query(
    "J13",
    S.Steps(BARS_SQL).add(f5=f"({S.lead('close', 5)} / close - 1) * 100", b3=f"(close / {S.lag('close', 3)} - 1) * 100", big=f"volume >= 2").done(
        f"SELECT series_id, {S.day('ts')} AS ts, {S.r('f5')} AS f5, {S.r('b3')} AS b3 FROM {{prev}} WHERE big"
    ),
)
def shifted_self_join(spark, sf_dir):
    df = bars(spark, sf_dir).withColumns({
        "f5": (R.lead("close", 5, AX) / F.col("close") - 1) * 100, "b3": (F.col("close") / R.lag("close", 3, AX) - 1) * 100,
    })
    return shaped(df.filter("volume >= 2"), ["series_id", "ts", "f5", "b3"])


@query(
    "J16 D14 A17",
    S.Steps(market_sql(["vix"])).add(score=S.rank_pct("vix", 63), fwd=f"({S.lead('close', 10)} / close - 1) * 100").done(
        "SELECT s.series_id, CAST(count(*) AS BIGINT) AS n, "
        + ", ".join(f"{S.r(e)} AS {a}" for a, e in [("mean", "avg(fwd)"), ("median", "median(fwd)"), ("std_pop", "stddev_pop(fwd)"), ("share_pos", "avg((fwd > 0)::INT)"), ("share_neg", "avg((fwd < 0)::INT)"), ("min", "min(fwd)"), ("max", "max(fwd)")])
        + " FROM {prev} s JOIN (SELECT series_id, arg_max(score, ts) AS cur FROM {prev} WHERE score IS NOT NULL GROUP BY 1) c ON s.series_id = c.series_id"
        " WHERE abs(score - cur) <= 0.10 AND fwd IS NOT NULL GROUP BY 1 HAVING count(*) >= 5"
    ),
)
def similar_state_returns(spark, sf_dir):
    from tidegrid.operators.aggregates import return_profile

    df = R.with_columns(market(spark, sf_dir, ["vix"]), {"score": R.rank_pct("vix", 63, AX), "fwd": (R.lead("close", 10, AX) / F.col("close") - 1) * 100})
    return shaped(return_profile(J.similar_states(df, AX, "score", 0.10), ["series_id"], "fwd", bounded=True))


_SPLIT = "DATE '1999-06-30'"


@query(
    "J17 S15 C5",
    f"WITH b AS ({BARS_SQL}), a AS (SELECT series_id, ts, close, 'first' AS origin FROM b WHERE ts <= {_SPLIT}), n AS (SELECT series_id, ts, close, 'second' AS origin FROM b WHERE ts > DATE '1999-01-01'),"
    " l AS (SELECT series_id, max(ts) AS last FROM a GROUP BY 1)"
    f" SELECT series_id, {S.day('ts')} AS ts, {S.r('close')} AS close, origin FROM (SELECT * FROM a UNION ALL SELECT n.* FROM n JOIN l USING (series_id) WHERE n.ts > l.last)",
)
def append_newer_rows(spark, sf_dir):
    b = bars(spark, sf_dir).select("series_id", "ts", "close")
    first = b.filter("ts <= DATE '1999-06-30'").withColumn("origin", F.lit("first"))
    second = b.filter("ts > DATE '1999-01-01'").withColumn("origin", F.lit("second"))
    path = fresh_folder(spark, "appended")
    SK.write_panel(first, path, AX)
    SK.append_newer_rows(path, second, AX)
    return shaped(SK.read_written(spark, path).select("series_id", "ts", "close", "origin"))


@query(
    "J15 A15",
    "WITH m AS (" + market_sql(["vix", "skew", "vvix", "gold", "crude", "hy_bb"]) + ") "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {S.r(f'abs(corr({a}, {b}))')} AS corr, CAST(count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS n FROM m"
        for i, a in enumerate(sorted(["vix", "skew", "vvix", "gold", "crude", "hy_bb"])) for b in sorted(["vix", "skew", "vvix", "gold", "crude", "hy_bb"])[i + 1:]
    ),
)
def pairwise_correlation(spark, sf_dir):
    from tidegrid.operators.correlation import pairwise_correlation as pc

    cols = ["vix", "skew", "vvix", "gold", "crude", "hy_bb"]
    return shaped(pc(market(spark, sf_dir, cols), cols))
