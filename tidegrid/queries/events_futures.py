"""Episode, transition, event-study and futures queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import dates as D
from tidegrid.functions import rolling as R
from tidegrid.operators import calendar as C
from tidegrid.operators import episodes as E
from tidegrid.operators import eventstudy as ES
from tidegrid.operators import futures as FU
from tidegrid.plans import regimes as RG
from tidegrid.queries import sqlgen as S
from tidegrid.queries.frames import AX, BARS_SQL, bars, market, market_sql, table
from tidegrid.queries.registry import query, shaped
from tidegrid.queries.tables import rr

ID = ["series_id", "ts"]
MD = S.day("ts")

# --- the flagship: bars -> rolling features -> regime -> episodes ------------------------------
_FLAG = (
    S.Steps(BARS_SQL).add(z=S.zscore("close", 21), below=S.pct_below("close", 21)).raw("SELECT * FROM {prev} WHERE z IS NOT NULL")
    .add(regime=S.cut("below", [0, 25, 50, 75, 100], lowest=True)).raw("SELECT * FROM {prev} WHERE regime IS NOT NULL")
    .add(opens=f"CASE WHEN {S.lag('regime', 1)} IS NULL OR {S.lag('regime', 1)} <> regime THEN 1 ELSE 0 END")
    .add(run=f"sum(opens) {S.upto()}")
)


@query(
    "B1 W5 W6 W11 W14 P6 W24",
    _FLAG.done(f"SELECT series_id, CAST(run AS BIGINT) AS run_id, any_value(regime) AS regime, {S.day('min(ts)')} AS start, {S.day('max(ts)')} AS \"end\", count(*) AS days, {S.r('max(abs(z))')} AS peak_abs, {S.r('avg(z)')} AS mean FROM {{prev}} GROUP BY series_id, run"),
)
def regime_episodes(spark, sf_dir):
    from tidegrid.functions.scalar import cut

    df = R.with_columns(bars(spark, sf_dir), {"z": R.zscore("close", 21, AX), "below": R.pct_below("close", 21, AX)}).filter("z IS NOT NULL")
    df = df.withColumn("regime", cut("below", [0, 25, 50, 75, 100], include_lowest=True)).filter("regime IS NOT NULL")
    return shaped(E.episodes(df, "regime", "z", AX))


_SPR = (
    S.Steps(BARS_SQL).add(gap=f"close - {S.mean('close', 10)}").raw("SELECT * FROM {prev} WHERE gap IS NOT NULL").add(state="CASE WHEN gap >= 0 THEN 'backwardation' ELSE 'contango' END")
    .add(opens=f"CASE WHEN {S.lag('state', 1)} IS NULL OR {S.lag('state', 1)} <> state THEN 1 ELSE 0 END").add(run=f"sum(opens) {S.upto()}")
    .raw("SELECT series_id, CAST(run AS BIGINT) AS run_id, any_value(state) AS state, min(ts) AS start, max(ts) AS \"end\", count(*) AS days, max(abs(gap)) AS peak_abs, avg(gap) AS mean FROM {prev} GROUP BY series_id, run")
)


def _spread_episodes(spark, sf_dir):
    df = bars(spark, sf_dir).withColumn("gap", F.col("close") - R.mean("close", 10, AX)).filter("gap IS NOT NULL")
    df = df.withColumn("state", F.when(F.col("gap") >= 0, "backwardation").otherwise("contango"))
    return E.episodes(df, "state", "gap", AX)


@query(
    "B2",
    _SPR.done(
        "SELECT series_id, state, count(*) AS n_episodes, CAST(sum(days) AS BIGINT) AS total_days, " + rr(median_days="median(days)", mean_days="avg(days)") + ", max(days) AS max_days, min(days) AS min_days, "
        + rr(median_peak="median(peak_abs)", max_peak="max(peak_abs)") + ", count(*) FILTER (days <= 10) AS n_short, count(*) FILTER (days > 10 AND days <= 30) AS n_medium, count(*) FILTER (days > 30) AS n_long, "
        + S.r("sum(days) * 100.0 / sum(sum(days)) OVER (PARTITION BY series_id)") + " AS pct_days FROM {prev} GROUP BY 1, 2"
    ),
)
def episode_statistics(spark, sf_dir):
    return shaped(E.episode_stats(_spread_episodes(spark, sf_dir), ["series_id"], "state", bounded=True))


@query(
    "B3 O6",
    _SPR.raw("SELECT *, max(run_id) OVER (PARTITION BY series_id) AS last_run FROM {prev}")
    .raw("SELECT e.*, n.days AS current_days FROM {prev} e JOIN {prev} n ON e.series_id = n.series_id AND n.run_id = n.last_run AND e.state = n.state AND e.days > n.days AND e.run_id <> n.run_id")
    .raw("SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY days DESC, start) AS rank FROM {prev}")
    .done(f"SELECT series_id, state, current_days, rank, {S.day('start')} AS start, {S.day(chr(34) + 'end' + chr(34))} AS \"end\", days FROM {{prev}} WHERE rank <= 3"),
)
def current_versus_longest(spark, sf_dir):
    return shaped(E.current_versus_history(_spread_episodes(spark, sf_dir), ["series_id"], "state"))


_ST = S.Steps(market_sql(["vix"])).add(regime=S.cut("vix", [0, 15.57, 23.36, 31.16, 100], lowest=True)).add(chg=f"CASE WHEN {S.lag('regime', 1)} <> regime THEN 1 ELSE 0 END", step=f"coalesce(sign(regime - {S.lag('regime', 1)}), 0)").add(run=f"sum(chg) {S.upto()}").add(
    age1="row_number() OVER (PARTITION BY series_id, run ORDER BY ts)"
)


@query("W24 W27 W28 N21", _ST.add(age0="age1 - 1").out([], ["regime", "chg", "run", "age1", "age0", "step"]))
def regime_age(spark, sf_dir):
    from tidegrid.functions.scalar import sign

    df = market(spark, sf_dir, ["vix"]).withColumn("regime", RG.level_regime("vix"))
    df = df.withColumn("step", F.coalesce(sign(R.diff("regime", 1, AX)), F.lit(0.0)).cast("int"))
    df = RG.state_runs(df, "regime", AX, "regime", start=1)
    return shaped(df.select("series_id", "ts", "regime", F.col("regime_change_flag").alias("chg"), F.col("regime_run").alias("run"), F.col("days_in_regime").alias("age1"), (F.col("days_in_regime") - 1).alias("age0"), "step"))


_COND = S.Steps(BARS_SQL).add(m10=S.mean("close", 10)).add(go="close > m10").raw("SELECT * FROM {prev} WHERE go IS NOT NULL").add(pos=f"row_number() {S.over()}").add(
    last_false=f"coalesce(max(CASE WHEN NOT go THEN pos END) {S.upto()}, 0)"
)


def _conditions(spark, sf_dir):
    df = bars(spark, sf_dir).withColumn("m10", R.mean("close", 10, AX))
    return df.withColumn("go", F.col("close") > F.col("m10")).filter("go IS NOT NULL")


@query(
    "W25 W26 W29 W30 B10",
    _COND.add(
        prev_go=S.lag("go", 1), last_true=f"max(CASE WHEN go THEN ts END) {S.upto()}",
        nxt="min(CASE WHEN go THEN pos END) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)",
    ).done(
        f"SELECT p.series_id, {S.day('p.ts')} AS ts, CAST(p.pos - p.last_false AS INT) AS streak, CASE WHEN coalesce(p.prev_go AND NOT p.go, false) THEN 1 ELSE 0 END AS left_state,"
        " CAST(coalesce(p.ts - p.last_true, 9999) AS INT) AS days_since_true, CAST(p.nxt - p.pos AS DOUBLE) AS rows_until, " + S.r("ln(n.close / p.close) * 100") + " AS return_until"
        " FROM {prev} p LEFT JOIN {prev} n ON p.series_id = n.series_id AND n.pos = p.nxt"
    ),
)
def streaks_and_transitions(spark, sf_dir):
    df = E.with_true_streak(_conditions(spark, sf_dir), "go", AX)
    df = E.until_next_true(E.since_last_true(E.transitions(df, "go", AX), "go", AX), "go", AX, "close")
    return shaped(df.withColumn("rows_until", F.col("rows_until").cast("double")), ID + ["streak", "left_state", "days_since_true", "rows_until", "return_until"])


_RUNS = S.Steps(BARS_SQL).add(m10=S.mean("close", 10)).add(go="close > m10").raw("SELECT * FROM {prev} WHERE go IS NOT NULL").add(pos=f"row_number() {S.over()}").add(grp="pos - row_number() OVER (PARTITION BY series_id, go ORDER BY ts)", lastts="max(ts) OVER (PARTITION BY series_id)").raw(
    "SELECT series_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS days, CASE WHEN max(ts) = max(lastts) THEN 1 ELSE 0 END AS is_open FROM {prev} WHERE go GROUP BY series_id, grp"
)


@query("W25 D12", _RUNS.done(f"SELECT series_id, {S.day('start')} AS start, {S.day(chr(34) + 'end' + chr(34))} AS \"end\", days, is_open FROM {{prev}}"))
def condition_zones(spark, sf_dir):
    return shaped(E.streak_lengths(_conditions(spark, sf_dir), "go", AX).drop("run_id"))


@query(
    "D10",
    _RUNS.done(
        "SELECT r.series_id, CAST(any_value(r.total_days) AS BIGINT) AS total_days, " + S.r("any_value(r.rate)") + " AS rate, coalesce(max(days) FILTER (is_open = 1), 0) AS current_streak, "
        + rr(mean_duration="coalesce(avg(days) FILTER (is_open = 0), 0)", median_duration="coalesce(median(days) FILTER (is_open = 0), 0)")
        + ", coalesce(max(days) FILTER (is_open = 0), 0) AS max_duration, count(*) FILTER (is_open = 0) AS num_episodes"
        " FROM (SELECT series_id, sum(go::INT) AS total_days, avg(go::INT) AS rate FROM s2 GROUP BY 1) r LEFT JOIN {prev} e ON r.series_id = e.series_id GROUP BY 1"
    ).replace("FROM s2 GROUP BY 1", "FROM s3 GROUP BY 1"),
)
def persistence_statistics(spark, sf_dir):
    return shaped(E.persistence_stats(_conditions(spark, sf_dir), "go", AX))


# --- event studies --------------------------------------------------------------------------
_H = [1, 5, 10, 21]
_EV = S.Steps(BARS_SQL).add(m10=S.mean("close", 10)).add(go="close > m10", busy="volume < 3", **{f"fwd_{h}d": f"ln({S.lead('close', h)} / close) * 100" for h in _H}, **{f"bwd_{h}d": f"ln(close / {S.lag('close', h)}) * 100" for h in (1, 3, 5)}).raw(
    "SELECT * FROM {prev} WHERE go IS NOT NULL"
).add(prev_go=S.lag("go", 1), prev_busy=S.lag("busy", 1)).add(leaves="coalesce(prev_go AND NOT go, false)", c_leaves="coalesce(prev_go AND prev_busy AND NOT busy, false)")


def _event_rows(spark, sf_dir):
    df = bars(spark, sf_dir).withColumns({"m10": R.mean("close", 10, AX), "busy": F.col("volume") < 3, **ES.horizon_returns("close", AX, _H, [1, 3, 5])})
    df = df.withColumn("go", F.col("close") > F.col("m10")).filter("go IS NOT NULL")
    df = E.transitions(df, "go", AX, "leaves")
    c_first = F.coalesce(R.lag("go", 1, AX) & R.lag("busy", 1, AX) & ~F.col("busy"), F.lit(False))
    return df.withColumn("c_leaves", c_first)


_GROUPS = {"baseline": "true", "control": "go AND NOT leaves", "transition": "leaves", "condition": "c_leaves"}


def _study_sql(groups, cols, by="series_id"):
    arms = [
        f"SELECT {by}, '{g}' AS day_group, '{c}' AS horizon, count({c}) AS n, avg({c}) AS a, median({c}) AS m, avg(({c} > 0)::INT) * 100 AS p FROM {{prev}} WHERE ({cond}) AND {c} IS NOT NULL GROUP BY 1"
        for g, cond in groups.items() for c in cols
    ]
    keep = lambda e: S.r(f"CASE WHEN n >= 5 THEN {e} END")
    return f"SELECT {by}, day_group, horizon, n, {keep('a')} AS mean, {keep('m')} AS median, {keep('p')} AS pct_pos FROM ({' UNION ALL '.join(arms)})"


@query("B4 B5 W32 J11 J12", _EV.done(_study_sql(_GROUPS, [f"fwd_{h}d" for h in _H])))
def transition_event_study(spark, sf_dir):
    df = ES.label_groups(_event_rows(spark, sf_dir), {"baseline": F.lit(True), "control": F.expr("go AND NOT leaves"), "transition": F.col("leaves"), "condition": F.col("c_leaves")})
    return shaped(ES.study(df, ["series_id", "day_group"], [f"fwd_{h}d" for h in _H], bounded=True))


@query("B4 B5", _EV.done(_study_sql(_GROUPS, [f"fwd_{h}d" for h in _H], by="'all'").replace("SELECT 'all', day_group", "SELECT day_group").replace("SELECT 'all', '", "SELECT '").replace("WHERE (", "WHERE (").replace(" GROUP BY 1", "")))
def pooled_event_study(spark, sf_dir):
    """All series in one group: the medians come from the bucketed exact path."""
    df = ES.label_groups(_event_rows(spark, sf_dir), {"baseline": F.lit(True), "control": F.expr("go AND NOT leaves"), "transition": F.col("leaves"), "condition": F.col("c_leaves")})
    return shaped(ES.study(df, ["day_group"], [f"fwd_{h}d" for h in _H]))


@query("B6", _EV.done(_study_sql({"transition": "leaves"}, ["bwd_1d", "bwd_3d", "bwd_5d"])))
def pre_event_drift(spark, sf_dir):
    df = ES.label_groups(_event_rows(spark, sf_dir), {"transition": F.col("leaves")})
    return shaped(ES.study(df, ["series_id", "day_group"], ["bwd_1d", "bwd_3d", "bwd_5d"], bounded=True))


_CLOSED = _COND.add(prev_go=S.lag("go", 1), nxt="min(CASE WHEN go THEN pos END) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)").raw(
    "SELECT p.series_id, p.nxt - p.pos AS gap, ln(n.close / p.close) * 100 AS ret FROM {prev} p LEFT JOIN {prev} n ON p.series_id = n.series_id AND n.pos = p.nxt WHERE p.prev_go AND NOT p.go"
)


@query(
    "B7",
    _CLOSED.done(
        "SELECT series_id, count(gap) AS n_closed, count(*) - count(gap) AS still_closed, " + rr(median_days="median(gap)", mean_days="avg(gap)", p25="quantile_cont(gap, 0.25)", p75="quantile_cont(gap, 0.75)")
        + ", CAST(max(gap) AS BIGINT) AS max_days, " + rr(mean_return="avg(ret)", median_return="median(ret)", pct_positive="avg((ret > 0)::INT) * 100") + " FROM {prev} GROUP BY 1"
    ),
)
def closed_periods(spark, sf_dir):
    df = E.until_next_true(E.transitions(_conditions(spark, sf_dir), "go", AX), "go", AX, "close").filter("left_state")
    g, x = "rows_until", "return_until"
    return shaped(df.groupBy("series_id").agg(
        F.count(g).alias("n_closed"), (F.count(F.lit(1)) - F.count(g)).alias("still_closed"), F.percentile(g, F.lit(0.5)).alias("median_days"), F.avg(g).alias("mean_days"),
        F.percentile(g, F.lit(0.25)).alias("p25"), F.percentile(g, F.lit(0.75)).alias("p75"), F.max(g).cast("long").alias("max_days"), F.avg(x).alias("mean_return"),
        F.percentile(x, F.lit(0.5)).alias("median_return"), (F.avg((F.col(x) > 0).cast("double")) * 100).alias("pct_positive"),
    ))


@query(
    "B8",
    _EV.done("SELECT series_id, CAST(count(*) FILTER (leaves) AS BIGINT) AS events, count(*) FILTER (leaves AND NOT go) AS gate_failing, count(*) FILTER (leaves AND NOT busy) AS busy_failing, count(*) FILTER (c_leaves) AS c_events FROM {prev} GROUP BY 1"),
)
def condition_breakdown(spark, sf_dir):
    n = lambda e: F.sum(F.expr(e).cast("long"))
    return shaped(_event_rows(spark, sf_dir).groupBy("series_id").agg(
        n("leaves").alias("events"), n("leaves AND NOT go").alias("gate_failing"), n("leaves AND NOT busy").alias("busy_failing"), n("c_leaves").alias("c_events"),
    ))


_TICK = "SELECT c_mktsegment AS series_id, CAST(o_orderdate AS DATE) AS ts, round(avg(o_totalprice) / 371.0, 4) AS close FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"


@query(
    "B9 J4",
    "WITH t AS (" + _TICK + "), f AS (SELECT *, (lead(close, 5) OVER w / close - 1) * 100 AS fwd_5d, (lead(close, 21) OVER w / close - 1) * 100 AS fwd_21d, (close / lag(close, 5) OVER w - 1) * 100 AS bwd_5d FROM t WINDOW w AS (PARTITION BY series_id ORDER BY ts)),"
    " ev AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_quantity = 50 AND l_discount >= 0.1),"
    " hit AS (SELECT DISTINCT f.* FROM ev JOIN f ON f.ts = (SELECT min(ts) FROM t WHERE t.series_id = f.series_id AND t.ts >= ev.d)), p AS (SELECT * FROM hit) "
    + _study_sql({"event": "true"}, ["fwd_5d", "fwd_21d", "bwd_5d"]).replace("{prev}", "p").replace("series_id, day_group, horizon", "series_id, horizon", 1),
)
def multi_series_event_study(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    t = o.join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("series_id"), F.to_date("o_orderdate").alias("ts")).agg(F.round(F.avg("o_totalprice") / 371.0, 4).alias("close"))
    t = t.withColumns(ES.horizon_returns("close", AX, [5, 21], [5], log=False))
    ev = table(spark, sf_dir, "lineitem").filter("l_quantity = 50 AND l_discount >= 0.1").select(F.to_date("l_shipdate").alias("event_date"))
    return shaped(ES.study(ES.rows_at_events(t, ev, AX), ["series_id"], ["fwd_5d", "fwd_21d", "bwd_5d"], bounded=True))


# --- futures --------------------------------------------------------------------------------
_Q = "{'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_quantity}"
CONTRACT_SQL = f"""
SELECT CAST(l_shipdate AS DATE) AS ts, year(date_trunc('month', l_shipdate) + to_months(l_linenumber - 1)) AS year, month(date_trunc('month', l_shipdate) + to_months(l_linenumber - 1)) AS month,
  (min({_Q})).e AS open, max(l_quantity) FILTER (l_linestatus = 'O') AS high, min(l_quantity) FILTER (l_linestatus = 'F') AS low, (max({_Q})).e AS close,
  round(avg(l_quantity) FILTER (l_tax > 0), 4) AS settle, sum(l_quantity) AS volume, count(*)::DOUBLE AS open_interest FROM lineitem GROUP BY 1, 2, 3
"""
CLEAN_SQL = """
SELECT * FROM (SELECT ts, year, month, greatest(h, l, s) AS high, least(h, l, s) AS low, CASE WHEN open > 0 THEN open ELSE s END AS open, s AS close, s AS settle, volume, open_interest
 FROM (SELECT *, CASE WHEN high > 0 AND low > 0 THEN high ELSE s END AS h, CASE WHEN high > 0 AND low > 0 THEN low ELSE s END AS l FROM (SELECT *, CASE WHEN settle IS NULL OR settle = 0 THEN close ELSE settle END AS s FROM raw) WHERE s > 0)) WHERE settle BETWEEN 3 AND 300
"""
CONT_SQL = f"""raw AS ({CONTRACT_SQL}), clean AS ({CLEAN_SQL}),
 y AS (SELECT unnest(generate_series(min(year(l_shipdate)), max(year(l_shipdate)) + 1)) AS year FROM lineitem), m AS (SELECT year, unnest(generate_series(1, 12)) AS month FROM y),
 n AS (SELECT year, month, make_date(CASE WHEN month = 12 THEN year + 1 ELSE year END, CASE WHEN month = 12 THEN 1 ELSE month + 1 END, 15) AS nx FROM m),
 x AS (SELECT year, month, nx + ((5 - isodow(nx) + 7) % 7)::INT - 30 AS expiry FROM n),
 days AS (SELECT DISTINCT ts FROM clean WHERE isodow(ts) <= 5), alive AS (SELECT d.ts, x.year, x.month, x.expiry, row_number() OVER (PARTITION BY d.ts ORDER BY x.expiry) AS position FROM days d JOIN x ON x.expiry > d.ts),
 cont0 AS (SELECT a.position, c.*, a.expiry, a.expiry - c.ts AS dte FROM clean c JOIN alive a ON a.ts = c.ts AND a.year = c.year AND a.month = c.month WHERE a.position <= 6),
 cont1 AS (SELECT *, CASE WHEN lag(expiry) OVER (PARTITION BY position ORDER BY ts) IS DISTINCT FROM expiry THEN 1 ELSE 0 END AS roll FROM cont0),
 cont AS (SELECT *, sum(roll) OVER (PARTITION BY position ORDER BY ts) AS seg FROM cont1)"""


def raw_contracts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    month = F.add_months(F.trunc(F.to_date("l_shipdate"), "month"), F.col("l_linenumber") - 1)
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    q = F.col("l_quantity")
    return li.groupBy(F.to_date("l_shipdate").alias("ts"), F.year(month).alias("year"), F.month(month).alias("month")).agg(
        F.min_by(q, seq).alias("open"), F.max(F.when(F.col("l_linestatus") == "O", q)).alias("high"), F.min(F.when(F.col("l_linestatus") == "F", q)).alias("low"), F.max_by(q, seq).alias("close"),
        F.round(F.avg(F.when(F.col("l_tax") > 0, q)), 4).alias("settle"), F.sum(q).alias("volume"), F.count(F.lit(1)).cast("double").alias("open_interest"),
    )


def continuous(spark, sf_dir):
    raw = raw_contracts(spark, sf_dir)
    exp = C.expiry_table(C.months_between(raw, "ts"))
    con = FU.clean_contracts(raw).join(F.broadcast(exp), ["year", "month"])  # one row per month
    return FU.continuous_positions(con.withColumn("root", F.lit("VX")), exp, ["root"])


@query(
    "C1",
    f"WITH raw AS ({CONTRACT_SQL}), clean AS ({CLEAN_SQL}) SELECT {MD} AS ts, year, month, {rr(open='open', high='high', low='low', close='close', settle='settle', volume='volume', open_interest='open_interest')} FROM clean",
)
def clean_contract_rows(spark, sf_dir):
    return shaped(FU.clean_contracts(raw_contracts(spark, sf_dir)))


@query(
    "C2 C3 C4 J7 W28 T6",
    f"WITH {CONT_SQL} SELECT CAST(position AS INT) AS position, {MD} AS ts, {rr(settle='settle', volume='volume')}, CAST(dte AS INT) AS days_to_expiry, roll AS roll_indicator, CAST(seg AS BIGINT) AS contract_id FROM cont",
)
def continuous_contracts(spark, sf_dir):
    return shaped(continuous(spark, sf_dir), ["position", "ts", "settle", "volume", "days_to_expiry", "roll_indicator", "contract_id"])


@query(
    "C5 C6",
    f"WITH {CONT_SQL}, w AS (SELECT ts, max(settle) FILTER (position = 1) AS v1, max(settle) FILTER (position = 2) AS v2 FROM cont GROUP BY 1)"
    f" SELECT {MD} AS ts, {rr(spread='v1 - v2', ratio='v1 / v2', log_ratio='ln(v1 / v2)')} FROM w WHERE v1 IS NOT NULL AND v2 IS NOT NULL",
)
def spread_and_ratio(spark, sf_dir):
    w = FU.position_columns(continuous(spark, sf_dir), ["root"], {"settle": "v"}, [1, 2]).filter("v1 IS NOT NULL AND v2 IS NOT NULL")
    return shaped(w.select("ts", (F.col("v1") - F.col("v2")).alias("spread"), (F.col("v1") / F.col("v2")).alias("ratio"), F.ln(F.col("v1") / F.col("v2")).alias("log_ratio")))


_REC = "(SELECT DATE '1996-03-01' AS a, DATE '1996-11-30' AS b UNION ALL SELECT DATE '2000-03-01', DATE '2000-11-30')"


@query(
    "B12",
    S.Steps(BARS_SQL).add(ret=S.pct("close", 1)).add(rv=S.rvol("ret", 21), sd=S.std("close", 21)).add(rvn="rv / max(rv) OVER (PARTITION BY series_id)", sdn="sd / max(sd) OVER (PARTITION BY series_id)").done(
        f"SELECT series_id, CASE WHEN r.a IS NOT NULL THEN 1 ELSE 0 END AS in_interval, count(*) AS days, {rr(mean_rv='avg(rvn)', mean_sd='avg(sdn)', gap='avg(rvn - sdn)')} FROM {{prev}} LEFT JOIN {_REC} r ON ts BETWEEN r.a AND r.b GROUP BY 1, 2"
    ),
)
def volatility_comparison(spark, sf_dir):
    from tidegrid.functions import technical as TI
    from tidegrid.plans.gates import in_intervals

    df = bars(spark, sf_dir).withColumn("ret", R.pct_change("close", 1, AX))
    df = df.withColumns({"rv": R.realized_vol("ret", 21, AX), "sd": R.std("close", 21, AX)})
    df = df.withColumns({n: F.col(c) / F.max(c).over(AX.whole()) for c, n in (("rv", "rvn"), ("sd", "sdn"))})
    df = in_intervals(df, "ts", [("1996-03-01", "1996-11-30"), ("2000-03-01", "2000-11-30")], "in_interval")
    return shaped(df.groupBy("series_id", "in_interval").agg(F.count("*").alias("days"), F.avg("rvn").alias("mean_rv"), F.avg("sdn").alias("mean_sd"), F.avg(F.col("rvn") - F.col("sdn")).alias("gap")))
