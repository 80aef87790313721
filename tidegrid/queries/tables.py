"""Aggregate, ordering, set, scalar and calendar queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegrid.functions import dates as D
from tidegrid.functions import rolling as R
from tidegrid.functions import scalar as X
from tidegrid.operators import aggregates as A
from tidegrid.operators import calendar as C
from tidegrid.operators import ranks as RK
from tidegrid.operators import sets as U
from tidegrid.plans import regimes as RG
from tidegrid.queries import sqlgen as S
from tidegrid.queries.frames import AX, BARS_SQL, bars, market, market_sql, table
from tidegrid.queries.registry import query, shaped

ID = ["series_id", "ts"]
MD = S.day("ts")


def rr(digits: int = 6, **exprs: str) -> str:
    return ", ".join(f"{S.r(e, digits)} AS {a}" for a, e in exprs.items())


# --- scalars --------------------------------------------------------------------------------
@query(
    "P1 P2 P3 P4 P5 S5",
    "WITH b AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, value FROM events)"
    f" SELECT event_id, {rr(8, k='k', clipped='least(greatest(value, 2.5), 40.0)', ratio='value / nullif(k, 0)', safe='coalesce(CASE WHEN abs(k - 50) >= 1 THEN value / abs(k - 50) END, -1)', signed='CASE WHEN abs(k - 50) >= 1 THEN value / (k - 50) END', scrubbed='coalesce(CASE WHEN k <> 0 THEN value / k END, 0)', parsed='value * 1000')} FROM b",
)
def scalar_guards(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", X.to_double(F.get_json_object("props", "$.k")).alias("k"), "value")
    comma = F.format_number(F.col("value") * 1000, 3)
    inf = F.when(F.col("k") == 0, F.lit(X.INF)).otherwise(F.col("value") / F.when(F.col("k") != 0, F.col("k")))
    from tidegrid.sources.parse import number_text

    return shaped(e.select(
        "event_id", "k", X.clip("value", 2.5, 40.0).alias("clipped"), X.ratio("value", "k").alias("ratio"),
        X.safe_divide("value", F.col("k") - 50, fill=-1.0, min_den=1.0, signed=False).alias("safe"),
        X.safe_divide("value", F.col("k") - 50, min_den=1.0).alias("signed"), X.finite(inf, 0.0).alias("scrubbed"), number_text(comma).alias("parsed"),
    ), digits=8)


_L = [0, 15.57, 23.36, 31.16, 100]


@query(
    "P6 P7 P8 P9 P10 P13 P15 N10 N11",
    S.Steps(market_sql(["vix", "skew", "vix3m"]))
    .add(right=S.cut("vix", _L, lowest=True), left="CASE WHEN vix IS NULL THEN NULL WHEN vix < 15.57 THEN 0 WHEN vix < 23.36 THEN 1 WHEN vix < 31.16 THEN 2 ELSE 3 END",
         checked=S.checked_regime("vix3m", [0, 12, 16, 20, 100]), dist="least(abs(vix), abs(vix - 15.57), abs(vix - 23.36), abs(vix - 31.16), abs(vix - 100))",
         tail=S.cut("skew", [0, 114.68, 119.61, 127.27, 200], lowest=True))
    .add(label="CASE \"left\" WHEN 0 THEN 'low_vol' WHEN 1 THEN 'normal' WHEN 2 THEN 'elevated' WHEN 3 THEN 'crisis' END",
         inside="least(greatest((vix - CASE \"left\" WHEN 0 THEN 9.14 WHEN 1 THEN 16.77 WHEN 2 THEN 24.41 ELSE 39.68 END::DOUBLE) / (CASE \"left\" WHEN 0 THEN 7.62 WHEN 1 THEN 7.63 WHEN 2 THEN 15.25 ELSE 43.01 END::DOUBLE), 0), 1)",
         x1='(CASE WHEN "right" = 1 THEN 1 ELSE 0 END) * skew', both=S.flag('vix > 23.36 AND skew > 127.27'))
    .out(["dist", "inside", "x1"], ["right", "left", "checked", "tail", "both"], texts=["label"]),
)
def regime_binning(spark, sf_dir):
    df = market(spark, sf_dir, ["vix", "skew", "vix3m"])
    df = df.withColumns({
        "right": RG.level_regime("vix"), "left": RG.level_regime("vix", "left"), "tail": RG.tail_regime("skew"),
        "checked": RG.checked_regime("vix3m", [0, 12, 16, 20, 100], AX), "dist": X.boundary_distance("vix", RG.LEVEL_BOUNDS),
        "both": X.flag((F.col("vix") > 23.36) & (F.col("skew") > 127.27)),
    })
    df = df.withColumns({"label": RG.level_label("left"), "inside": RG.within_range("vix", "left"), "x1": X.one_hot("right", [1])[1] * F.col("skew")})
    return shaped(df, ID + ["right", "left", "checked", "tail", "both", "label", "dist", "inside", "x1"])


_Y = ["y3m", "y2y", "y5y", "y10y", "y30y"]


@query(
    "P12",
    S.Steps(market_sql(_Y)).add(level=S.nanmean(_Y), spread=S.nanstd(_Y), total=" + ".join(f"coalesce({y}, 0)" for y in _Y)).out(["level", "spread", "total"]),
)
def row_statistics(spark, sf_dir):
    return shaped(market(spark, sf_dir, _Y).select("series_id", "ts", X.row_mean(_Y).alias("level"), X.row_std(_Y).alias("spread"), X.row_sum(_Y).alias("total")))


@query(
    "P17",
    "SELECT p_name AS feature, CASE WHEN regexp_matches(lower(p_name), '^red') THEN 'R' WHEN regexp_matches(lower(p_name), 'bolt|gear') THEN 'HW' WHEN regexp_matches(lower(p_name), 'ring$') THEN 'RING' END AS source, count(*) AS n FROM part GROUP BY 1, 2",
)
def infer_source_by_pattern(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("feature"))
    src = X.first_match("feature", [("^red", "R"), ("bolt|gear", "HW"), ("ring$", "RING")])
    return p.groupBy("feature", src.alias("source")).agg(F.count("*").alias("n"))


@query(
    "P22 A3 M20",
    "WITH e AS (SELECT o_orderpriority AS a, o_orderstatus AS b, (o_totalprice - 250000) / 1000 AS err, exp(-0.125::DOUBLE * (date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') / 30.0::DOUBLE)) AS w FROM orders)"
    f" SELECT a, b, CASE WHEN grouping(a) = 0 AND grouping(b) = 0 THEN 'both' WHEN grouping(a) = 0 THEN 'first' WHEN grouping(b) = 0 THEN 'second' ELSE 'global' END AS level, {rr(bias='sum(w * err) / sum(w)')}, count(*) AS n"
    " FROM e GROUP BY GROUPING SETS ((a, b), (a), (b), ()) HAVING count(*) >= 50",
)
def weighted_bias_levels(spark, sf_dir):
    from tidegrid.operators.calibration import bias_levels

    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"), ((F.col("o_totalprice") - 250000) / 1000).alias("err"),
        X.time_decay(F.datediff(F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate")), 0.125).alias("w"),
    )
    return shaped(bias_levels(o, "a", "b", "err", "w", 50, names=("both", "first", "second", "global")))


# --- aggregates -----------------------------------------------------------------------------
@query(
    "A1 A2",
    f"WITH b AS ({BARS_SQL}) SELECT series_id, count(close) AS count, {rr(mean='avg(close)', std='stddev_samp(close)', min='min(close)', max='max(close)', median='median(close)', q25='quantile_cont(close, 0.25)', q75='quantile_cont(close, 0.75)')} FROM b GROUP BY 1",
)
def summary_statistics(spark, sf_dir):
    return shaped(A.summary_stats(bars(spark, sf_dir), ["series_id"], "close", bounded=True))


@query(
    "A4 A18",
    f"WITH m AS ({market_sql(['vix'])}), r AS (SELECT series_id, {S.cut('vix', _L, lowest=True)} AS regime FROM m)"
    f" SELECT series_id, regime, count(*) AS n, {S.r('count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY series_id)')} AS share FROM r GROUP BY 1, 2",
)
def regime_shares(spark, sf_dir):
    df = market(spark, sf_dir, ["vix"]).withColumn("regime", RG.level_regime("vix"))
    return shaped(A.value_shares(df, ["series_id"], "regime"))


_G = S.Steps(BARS_SQL).add(above=f"close > {S.mean('close', 10)}", busy="volume > 1")


@query(
    "A5 A6",
    _G.done(
        f"SELECT series_id, year(ts) AS year, CAST(sum((coalesce(above, false))::INT) AS BIGINT) AS open_days, count(above) AS total_days, {S.r('sum((coalesce(above, false))::INT) * 100.0 / count(above)')} AS open_pct"
        " FROM {prev} GROUP BY 1, 2 HAVING count(above) >= 5"
    ),
)
def annual_open_rate(spark, sf_dir):
    df = bars(spark, sf_dir).withColumn("above", F.col("close") > R.mean("close", 10, AX))
    return shaped(A.annual_rate(df, AX, "above"))


@query(
    "A6 B11",
    _G.done("SELECT series_id, c AS condition, " + S.r("p") + " AS pass_pct FROM (SELECT series_id, 'above' AS c, avg(coalesce(above, false)::INT) * 100 AS p FROM {prev} GROUP BY 1 UNION ALL SELECT series_id, 'busy', avg(busy::INT) * 100 FROM {prev} GROUP BY 1)"),
)
def condition_pass_rates(spark, sf_dir):
    df = bars(spark, sf_dir).withColumns({"above": F.col("close") > R.mean("close", 10, AX)})
    return shaped(A.pass_rates(df, ["series_id"], {"above": F.col("above"), "busy": F.col("volume") > 1}))


@query(
    "A7",
    f"WITH b AS ({BARS_SQL}), l AS (SELECT series_id, arg_max(close, ts) AS current FROM b GROUP BY 1)"
    f" SELECT series_id, {rr(current='any_value(current)', pct_below='avg((close < current)::INT) * 100', pct_at_or_below='avg((close <= current)::INT) * 100')} FROM b JOIN l USING (series_id) GROUP BY 1",
)
def latest_percentile(spark, sf_dir):
    return shaped(A.latest_percentile(bars(spark, sf_dir), AX, "close"))


@query(
    "A8",
    f"WITH b AS ({BARS_SQL}) SELECT series_id, {rr(p5='quantile_cont(close, 0.05)', p10='quantile_cont(close, 0.10)', p85='quantile_cont(close, 0.85)', p92='quantile_cont(close, 0.92)', p98='quantile_cont(close, 0.98)')} FROM b GROUP BY 1",
)
def percentile_set(spark, sf_dir):
    return shaped(RK.group_quantiles(bars(spark, sf_dir), ["series_id"], "close", {"p5": 0.05, "p10": 0.10, "p85": 0.85, "p92": 0.92, "p98": 0.98}))


_PC = ["vix", "vix3m", "vix6m", "skew", "y10y", "y30y", "ig"]


@query(
    "A9 D1 V10",
    f"WITH m AS ({market_sql(_PC)}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS rows, count(*) - count({c}) AS nulls, count(*) FILTER ({c} = 0) AS zeros, count(DISTINCT {c}) AS uniques, {rr(mean=f'avg({c})', min=f'min({c})', max=f'max({c})', std=f'stddev_samp({c})')},"
        f" CASE WHEN count(*) FILTER ({c} = 0) * 1.0 / count(*) > 0.95 THEN 'constant_zero' WHEN (count(*) - count({c})) * 1.0 / count(*) > 0.80 THEN 'too_sparse' WHEN stddev_samp({c}) < 1e-6 THEN 'no_variance'"
        f" WHEN count(DISTINCT {c}) * 1.0 / count({c}) < 0.05 AND count(DISTINCT {c}) < 3 THEN 'too_few_unique' ELSE 'valid' END AS status FROM m"
        for c in _PC
    ),
)
def column_screen(spark, sf_dir):
    from tidegrid.operators.quality import screen_status

    return shaped(A.column_profile(market(spark, sf_dir, _PC), _PC).withColumn("status", screen_status()))


@query(
    "A13",
    f"WITH m AS ({market_sql(['vix'])}) SELECT series_id, CAST(floor(vix / 0.5) AS BIGINT) AS bin, count(*) AS n, {S.r('CAST(floor(vix / 0.5) AS BIGINT) * 0.5')} AS bin_start FROM m WHERE floor(vix / 0.5) BETWEEN 0 AND 119 GROUP BY 1, 2",
)
def fixed_width_histogram(spark, sf_dir):
    return shaped(A.fixed_histogram(market(spark, sf_dir, ["vix"]), ["series_id"], "vix", 0.5, 60.0))


@query(
    "A13",
    f"WITH m AS ({market_sql(['vix'])}), s AS (SELECT series_id, min(vix) AS lo, max(vix) AS hi FROM m GROUP BY 1), t AS (SELECT *, CAST(greatest(20, least(50, ceil((hi - lo) / 0.5))) AS INT) AS bins FROM s)"
    " SELECT series_id, bins, CAST(least(floor((vix - lo) / (hi - lo) * bins), bins - 1) AS INT) AS bin, count(*) AS n FROM m JOIN t USING (series_id) WHERE vix IS NOT NULL GROUP BY 1, 2, 3",
)
def dynamic_histogram(spark, sf_dir):
    return shaped(A.dynamic_histogram(market(spark, sf_dir, ["vix"]), ["series_id"], "vix"))


@query(
    "A14",
    S.Steps(market_sql(["vix"])).add(score=S.rank_pct("vix", 63))
    .raw("SELECT series_id, min(score) AS lo, max(score) AS hi, count(score) AS n FROM {prev} GROUP BY 1")
    .raw("SELECT *, unnest(generate_series(0, 50)) AS i FROM {prev}")
    .done(
        "SELECT g.series_id, CAST(g.i AS INT) AS i, " + S.r("any_value(lo + (hi - lo) / 50 * i)") + " AS x, "
        + S.r("sum(exp(-0.5 * pow((lo + (hi - lo) / 50 * i - m.score) / 0.05::DOUBLE, 2))) / (sqrt(2 * pi()) * any_value(n) * 0.05::DOUBLE)") + " AS density"
        " FROM {prev} g JOIN s1 m ON g.series_id = m.series_id WHERE m.score IS NOT NULL GROUP BY 1, 2"
    ),
)
def kernel_density(spark, sf_dir):
    df = R.with_columns(market(spark, sf_dir, ["vix"]), {"score": R.rank_pct("vix", 63, AX)})
    return shaped(A.kernel_density(df, ["series_id"], "score"))


_DIR = S.Steps(BARS_SQL).add(fwd=f"({S.lead('close', 5)} / close - 1) * 100", z=S.zscore("close", 21)).add(
    pred="CASE WHEN z IS NULL OR abs(z) < 0.5 THEN 'NO_DECISION' WHEN z < 0 THEN 'UP' ELSE 'DOWN' END", actual="CASE WHEN fwd > 0 THEN 'UP' ELSE 'DOWN' END", conf="CASE WHEN z IS NOT NULL THEN least(abs(z) / 3, 1) END",
)


def _directions(spark, sf_dir):
    df = bars(spark, sf_dir).withColumns({"fwd": (R.lead("close", 5, AX) / F.col("close") - 1) * 100, "z": R.zscore("close", 21, AX)})
    return df.withColumns({
        "pred": F.when(F.col("z").isNull() | (F.abs("z") < 0.5), "NO_DECISION").when(F.col("z") < 0, "UP").otherwise("DOWN"),
        "actual": F.when(F.col("fwd") > 0, "UP").otherwise("DOWN"), "conf": X.clip(F.abs("z") / 3, hi=1),
    })


def _side(s):
    lo = s.lower()
    return (
        f"CAST(count(*) FILTER (pred = '{s}') AS BIGINT) AS {lo}_count, {S.r(f'coalesce(avg((pred = actual)::INT) FILTER (pred = {chr(39)}{s}{chr(39)}), 0)')} AS {lo}_accuracy,"
        f" {S.r(f'coalesce(avg(conf) FILTER (pred = {chr(39)}{s}{chr(39)}), 0)')} AS {lo}_confidence, {S.r(f'coalesce(avg(fwd) FILTER (pred = {chr(39)}{s}{chr(39)}), 0)')} AS {lo}_magnitude"
    )


@query(
    "A10 M12",
    _DIR.done(
        "SELECT series_id, count(*) AS total_samples, count(*) FILTER (pred <> 'NO_DECISION') AS made_decision, count(*) FILTER (pred = 'NO_DECISION') AS no_decision,"
        + f" {rr(no_decision_pct='avg((pred = ' + chr(39) + 'NO_DECISION' + chr(39) + ')::INT)', overall_accuracy='coalesce(avg((pred = actual)::INT) FILTER (pred <> ' + chr(39) + 'NO_DECISION' + chr(39) + '), 0)')}, {_side('UP')}, {_side('DOWN')}"
        + " FROM {prev} GROUP BY 1"
    ),
)
def direction_scorecard(spark, sf_dir):
    return shaped(A.direction_scores(_directions(spark, sf_dir), ["series_id"], "pred", "actual", "conf", "fwd"))


@query(
    "A11 M19",
    _DIR.done(
        "SELECT series_id, pred, count(e) AS n, " + rr(mae="avg(abs(e))", rmse="sqrt(avg(e * e))", bias="avg(e)", median_error="median(abs(e))") + ", CAST(grouping(pred) AS INT) AS is_total"
        " FROM (SELECT *, z - fwd AS e FROM {prev} WHERE pred <> 'NO_DECISION') GROUP BY ROLLUP(series_id, pred)"
    ),
)
def forecast_errors_rollup(spark, sf_dir):
    df = _directions(spark, sf_dir).filter("pred <> 'NO_DECISION'")
    return shaped(A.size_errors(df, "pred", "z", "fwd", ["series_id"]))


@query(
    "A12",
    _DIR.raw("SELECT series_id, conf, (fwd > 0)::INT AS y FROM {prev} WHERE conf IS NOT NULL AND fwd IS NOT NULL").done(
        "SELECT a.series_id, " + rr(
            precision="any_value(tp * 1.0 / nullif(tp + fp, 0))", recall="any_value(tp * 1.0 / nullif(tp + fn, 0))", f1="any_value(2.0 * tp / nullif(2 * tp + fp + fn, 0))", accuracy="any_value(acc)",
            auc="any_value((rs - np * (np + 1) / 2.0) / (np * nn))",
        )
        + " FROM (SELECT series_id, count(*) FILTER (conf >= 0.5 AND y = 1) AS tp, count(*) FILTER (conf >= 0.5 AND y = 0) AS fp, count(*) FILTER (conf < 0.5 AND y = 1) AS fn, avg(((conf >= 0.5)::INT = y)::INT) AS acc,"
        " count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn FROM {prev} GROUP BY 1) a JOIN"
        " (SELECT series_id, sum(rk) FILTER (y = 1) AS rs FROM (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY conf) + (count(*) OVER (PARTITION BY series_id, conf) - 1) / 2.0 AS rk FROM {prev}) GROUP BY 1) b ON a.series_id = b.series_id GROUP BY 1"
    ),
)
def classifier_scores(spark, sf_dir):
    df = _directions(spark, sf_dir).filter("conf IS NOT NULL AND fwd IS NOT NULL").withColumn("y", (F.col("fwd") > 0).cast("int"))
    return shaped(A.binary_scores(df, ["series_id"], "conf", "y"))


@query(
    "A16 M15",
    "SELECT event_type AS feature, count(DISTINCT CAST(ts AS DATE)) AS n_runs, " + S.r("count(DISTINCT CAST(ts AS DATE)) / 30.0") + " AS frequency, CASE WHEN count(DISTINCT CAST(ts AS DATE)) / 30.0 >= 0.8 THEN 1 ELSE 0 END AS stable FROM events WHERE value > 60 GROUP BY 1",
)
def feature_frequency(spark, sf_dir):
    runs = table(spark, sf_dir, "events").filter("value > 60").select(F.col("event_type").alias("feature"), F.to_date("ts").alias("run"))
    return shaped(A.feature_frequency(runs, 30))


@query(
    "A19 T13",
    f"SELECT month(o_orderdate) AS month, isodow(o_orderdate) - 1 AS day_of_week, count(*) AS n, {S.r('avg(o_totalprice) / 371.0', 4)} AS mean_price,"
    f" {S.day('max(last_day(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH))')} AS last_full_month, {S.day('min(CAST(o_orderdate AS DATE) - (2 * 365 + 450))')} AS training_start FROM orders GROUP BY 1, 2",
)
def calendar_breakdown(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("ts", F.to_date("o_orderdate"))
    parts = D.month_day_columns("ts")
    out = o.groupBy(parts["month"].alias("month"), parts["day_of_week"].alias("day_of_week")).agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice") / 371.0, 4).alias("mean_price"),
        F.max(D.last_complete_month_end("ts")).alias("last_full_month"), F.min(D.training_start("ts", 2)).alias("training_start"),
    )
    return shaped(out)


# --- order, top-k, sets -----------------------------------------------------------------------
@query(
    "O1 O2",
    f"SELECT p_partkey, {S.r('p_retailprice')} AS p_retailprice, p_name FROM part ORDER BY p_retailprice DESC, p_name, p_partkey LIMIT 25",
)
def top_n_overall(spark, sf_dir):
    return shaped(U.top_n(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_name"), [F.desc("p_retailprice"), F.asc("p_name"), F.asc("p_partkey")], 25))


@query(
    "O3",
    f"SELECT p_brand, p_partkey, {S.r('p_retailprice')} AS p_retailprice, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rk FROM part) WHERE rk <= 3",
)
def top_n_per_group(spark, sf_dir):
    return shaped(U.top_n_per_group(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], {"p_retailprice": "desc", "p_partkey": "asc"}, 3))


@query(
    "O4 D13",
    f"WITH b AS ({BARS_SQL}), n AS (SELECT *, row_number() {S.over()} AS pos, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS back FROM b)"
    f" SELECT series_id, {MD} AS ts, {S.r('close')} AS close, CASE WHEN back <= 30 THEN 'tail' ELSE 'body' END AS part FROM n WHERE pos > 63",
)
def head_tail_slices(spark, sf_dir):
    b = bars(spark, sf_dir)
    kept = U.drop_warmup(b, AX, 63)
    return shaped(U.mark_tail(kept, AX, 30).select("series_id", "ts", "close", F.when(F.col("in_tail") == 1, "tail").otherwise("body").alias("part")))


_DUP = "SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderkey AS arrival, o_totalprice / 371.0 AS v FROM orders"


@query(
    "O5",
    f"WITH x AS ({_DUP}), n AS (SELECT *, row_number() OVER (PARTITION BY k, year(d) ORDER BY arrival) AS f, row_number() OVER (PARTITION BY k, year(d) ORDER BY arrival DESC) AS l, count(*) OVER (PARTITION BY k, year(d)) AS c FROM x)"
    f" SELECT k, year(d) AS y, {S.r('max(v) FILTER (f = 1)')} AS first_v, {S.r('max(v) FILTER (l = 1)')} AS last_v, max(c) AS copies FROM n GROUP BY 1, 2",
)
def deduplicate_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("arrival"), (F.col("o_totalprice") / 371.0).alias("v"))
    first = U.keep_first(o, ["k", "y"], "arrival", ["v"]).withColumnRenamed("v", "first_v")
    last = U.keep_last(o, ["k", "y"], "arrival", ["v"]).withColumnRenamed("v", "last_v")
    copies = o.groupBy("k", "y").agg(F.count("*").alias("copies"))
    return shaped(first.join(last, ["k", "y"]).join(copies, ["k", "y"]))


@query(
    "O5",
    f"WITH x AS ({_DUP}) SELECT k, {S.day('d')} AS d, arrival, {S.r('v')} AS v FROM (SELECT *, count(*) OVER (PARTITION BY k, d) AS c FROM x) WHERE c > 1",
)
def duplicated_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("arrival"), (F.col("o_totalprice") / 371.0).alias("v"))
    return shaped(U.duplicated_rows(o, ["k", "d"]))


@query(
    "U1 U2 U3",
    "SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 AND n > 5 THEN 'both' WHEN c_acctbal > 5000 THEN 'balance' ELSE 'orders' END AS origin FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE c_acctbal > 5000 OR n > 5",
)
def set_operations(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    busy = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).count().filter("count > 5").select("k").join(known, "k", "left_semi")
    both = rich.intersect(busy).withColumn("origin", F.lit("both"))
    only_rich = rich.exceptAll(busy).withColumn("origin", F.lit("balance"))
    only_busy = busy.exceptAll(rich).withColumn("origin", F.lit("orders"))
    return both.unionByName(only_rich).unionByName(only_busy)


@query("U4", "SELECT vec_id FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id LIMIT 100")
def seeded_subset(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    return U.seeded_sample(ids, "vec_id", 100, seed=42)


# --- calendar -------------------------------------------------------------------------------
_BI = "(5 * (({d} - DATE '1969-12-29') // 7) + least(({d} - DATE '1969-12-29') % 7, 5))"


@query(
    "T1 T2 T3 S9 S12",
    "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),"
    " c AS (SELECT x, row_number() OVER (ORDER BY x) AS n FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS x) WHERE isodow(x) <= 5)"
    f" SELECT {S.day('d')} AS d, {S.day('(SELECT x FROM c WHERE n = (SELECT min(n) FROM c WHERE x >= d.d) + 5)')} AS plus5,"
    " (SELECT count(*) FROM c WHERE x BETWEEN d.d AND DATE '2001-08-01') AS to_end,"
    " (SELECT count(*) FROM c WHERE x BETWEEN d.d AND d.d + 30) - 1 AS lag30,"
    f" {S.day('d - 5 - greatest(isodow(d - 5) - 5, 0)::INT')} AS refetch, CASE WHEN isodow(d) <= 5 THEN 1 ELSE 0 END AS business FROM d",
)
def business_day_math(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return shaped(d.select(
        "d", D.add_business_days("d", 5).alias("plus5"), D.business_days_between("d", F.lit("2001-08-01").cast("date")).alias("to_end"),
        D.business_lag("d", F.date_add("d", 30)).alias("lag30"), D.refetch_start("d").alias("refetch"), D.is_business_day("d").cast("int").alias("business"),
    ))


@query(
    "T6",
    "WITH y AS (SELECT unnest(generate_series(min(year(o_orderdate)) + 19, max(year(o_orderdate)) + 26)) AS year FROM orders), m AS (SELECT year, unnest(generate_series(1, 12)) AS month FROM y),"
    " g AS (SELECT *, make_date(CASE WHEN month = 12 THEN year + 1 ELSE year END, CASE WHEN month = 12 THEN 1 ELSE month + 1 END, 15) AS nxt FROM m)"
    " SELECT CAST(year AS INT) AS year, CAST(month AS INT) AS month, coalesce(day, strftime(nxt + ((5 - isodow(nxt) + 7) % 7)::INT - 30, '%Y-%m-%d')) AS contract_expiry, (day IS NOT NULL)::INT AS moved"
    " FROM g LEFT JOIN (VALUES (2014, 3, '2014-03-18'), (2019, 3, '2019-03-19'), (2022, 3, '2022-03-15'), (2024, 6, '2024-06-18'), (2025, 3, '2025-03-18'), (2026, 5, '2026-05-19')) v(year, month, day) USING (year, month)",
)
def moved_expiries(spark, sf_dir):
    """Contract expiries of the years for which moved dates are recorded: the orders' years, 19 years on."""
    later = table(spark, sf_dir, "orders").select(F.add_months("o_orderdate", 12 * 19).alias("d"))
    months = C.months_between(later, "d", years_after=7)
    rule = months.select("year", "month", D.contract_expiry("year", "month").alias("by_rule"))
    out = C.expiry_table(months).join(rule, ["year", "month"])
    return shaped(out.select("year", "month", F.col("expiry_date").alias("contract_expiry"), (F.col("expiry_date") != F.col("by_rule")).cast("int").alias("moved")))


@query(
    "T4 T5 T6 T7",
    "WITH y AS (SELECT unnest(generate_series(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS year FROM orders), m AS (SELECT year, unnest(generate_series(1, 12)) AS month FROM y),"
    " f AS (SELECT year, month, make_date(year, month, 15) + ((5 - isodow(make_date(year, month, 15)) + 7) % 7)::INT AS opex FROM m),"
    " g AS (SELECT *, make_date(CASE WHEN month = 12 THEN year + 1 ELSE year END, CASE WHEN month = 12 THEN 1 ELSE month + 1 END, 15) AS nxt FROM f)"
    " SELECT CAST(year AS INT) AS year, CAST(month AS INT) AS month, strftime(opex, '%Y-%m-%d') AS option_expiry, strftime(opex - 30 + ((3 - isodow(opex - 30) + 7) % 7)::INT, '%Y-%m-%d') AS futures_expiry,"
    " strftime(nxt + ((5 - isodow(nxt) + 7) % 7)::INT - 30, '%Y-%m-%d') AS contract_expiry, substr('FGHJKMNQUVXZ', CAST(month AS INT), 1) || CAST(year % 10 AS VARCHAR) AS contract_code FROM g",
)
def expiry_calendars(spark, sf_dir):
    m = C.months_between(table(spark, sf_dir, "orders").select("o_orderdate"), "o_orderdate")
    opex = C.option_expiries(m).withColumnRenamed("event_date", "option_expiry")
    fut = C.futures_expiries(m).withColumnRenamed("event_date", "futures_expiry")
    con = C.expiry_table(m).withColumnRenamed("expiry_date", "contract_expiry")
    return shaped(opex.join(fut, ["year", "month"]).join(con, ["year", "month"]))


def _event_days(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    days = o.select(F.to_date("o_orderdate").alias("ts")).distinct()
    months = C.months_between(o.select("o_orderdate"), "o_orderdate")
    meetings = C.meetings_from_rows(o.filter("o_totalprice > 490000"), "o_orderdate")
    return C.event_distances(days, "ts", meetings, C.option_expiries(months), C.futures_expiries(months))


_COHORT = (
    S.Steps("SELECT DISTINCT CAST(o_orderdate AS DATE) AS ts FROM orders", "days")
    .raw("SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_totalprice > 490000")
    .raw("SELECT year, unnest(generate_series(1, 12)) AS month FROM (SELECT unnest(generate_series(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS year FROM orders)")
    .raw("SELECT make_date(year, month, 15) + ((5 - isodow(make_date(year, month, 15)) + 7) % 7)::INT AS d FROM {prev}")
    .raw("SELECT d - 30 + ((3 - isodow(d - 30) + 7) % 7)::INT AS d FROM {prev}")
    .raw(
        "SELECT ts, -((SELECT min(d) FROM s1 WHERE d >= ts) - ts) AS m, -((SELECT min(d) FROM s3 WHERE d >= ts) - ts) AS o, -((SELECT min(d) FROM s4 WHERE d >= ts) - ts) AS f,"
        " EXISTS (SELECT 1 FROM s1 WHERE abs(ts - (d + 21)) <= 2) AS minutes, abs(day(ts) - 12) <= 2 AS cpi, abs(day(ts) - 28) <= 3 AS pce,"
        " CASE WHEN month(ts) IN (1, 4, 7, 10) AND (day(ts) - 1) // 7 + 1 IN (2, 3, 4) THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END AS ei FROM days"
    )
    .add(cohort="CASE WHEN m BETWEEN -7 AND 2 OR cpi OR pce OR minutes THEN 'fomc_period' WHEN o BETWEEN -7 AND 0 OR f BETWEEN -7 AND 0 THEN 'opex_week' WHEN ei BETWEEN 0.15 AND 1.0 THEN 'earnings_heavy' ELSE 'mid_cycle' END")
)


@query(
    "T10 N17 M23",
    _COHORT.done(f"SELECT {MD} AS ts, cohort AS calendar_cohort, 1.0::DOUBLE AS cohort_weight, (cohort = 'fomc_period')::INT AS is_fomc_period, (cohort = 'opex_week')::INT AS is_opex_week, (cohort = 'earnings_heavy')::INT AS is_earnings_heavy FROM {{prev}}"),
)
def calendar_cohorts(spark, sf_dir):
    d = _event_days(spark, sf_dir).withColumns(C.cohort_columns())
    return shaped(d, ["ts", "calendar_cohort", "cohort_weight", "is_fomc_period", "is_opex_week", "is_earnings_heavy"])


_PROX = _COHORT.add(
    fomc_proximity="coalesce(greatest(0, 1 - abs(m) / 14.0::DOUBLE), 0)", fomc_pre_period="CASE WHEN m < 0 THEN greatest(0, 1 + m / 7.0::DOUBLE) ELSE 0 END", fomc_post_period="CASE WHEN m >= 0 THEN 1 - m / 3.0::DOUBLE ELSE 0 END",
    opex_proximity="coalesce(greatest(0, 1 - abs(o) / 10.0::DOUBLE), 0)", opex_week_intensity="CASE WHEN o BETWEEN -7 AND 0 THEN greatest(0, 1 + o / 7.0::DOUBLE) ELSE 0 END", vix_expiry_proximity="coalesce(greatest(0, 1 - abs(f) / 10.0::DOUBLE), 0)",
    earnings_intensity_norm="(ei - 0.05::DOUBLE) / 0.20::DOUBLE", cpi_week="cpi::INT::DOUBLE", pce_week="pce::INT::DOUBLE",
).add(
    macro_event_intensity="least(1, fomc_proximity + cpi_week * 0.5 + pce_week * 0.5)", multi_event_stress="((fomc_proximity > 0.3)::INT + (opex_proximity > 0.3)::INT + (earnings_intensity_norm > 0.5)::INT) / 3.0",
)
_PROX_COLS = ["fomc_proximity", "fomc_pre_period", "fomc_post_period", "opex_proximity", "opex_week_intensity", "vix_expiry_proximity", "earnings_intensity_norm", "cpi_week", "pce_week", "macro_event_intensity", "multi_event_stress"]


@query("T11 T8 T9", _PROX.out(_PROX_COLS, keys=()))
def event_proximity(spark, sf_dir):
    return shaped(C.proximity_columns(_event_days(spark, sf_dir)), ["ts"] + _PROX_COLS)


@query(
    "T12 U2 S19",
    f"WITH b AS ({BARS_SQL}), e AS (SELECT series_id, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM b GROUP BY 1)"
    f" SELECT series_id, {MD} AS ts FROM e WHERE isodow(ts) <= 5 AND ts NOT IN (DATE '1997-07-04', DATE '1998-12-25') AND NOT EXISTS (SELECT 1 FROM b WHERE b.series_id = e.series_id AND b.ts = e.ts)",
)
def missing_trading_days(spark, sf_dir):
    closures = C.literal_dates(spark, ["1997-07-04", "1998-12-25"])
    return shaped(C.missing_days(bars(spark, sf_dir), AX, closures), ID)


@query(
    "T14 J2",
    f"WITH b AS (SELECT *, lag(close, 3) {S.over()} AS lagged FROM ({BARS_SQL})), e AS (SELECT series_id, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM b GROUP BY 1),"
    " m AS (SELECT e.series_id, e.ts, b.ts AS lbl, b.lagged FROM e ASOF LEFT JOIN b ON e.series_id = b.series_id AND e.ts >= b.ts),"
    " c AS (SELECT *, count(*) FILTER (lbl <> ts) OVER (PARTITION BY series_id, lbl ORDER BY ts) AS reuse FROM m)"
    f" SELECT series_id, {MD} AS ts, CASE WHEN reuse <= 5 THEN {S.r('lagged')} END AS close FROM c",
)
def publication_lag(spark, sf_dir):
    b = bars(spark, sf_dir).select("series_id", "ts", "close")
    return shaped(C.lag_then_align(C.series_calendar(b, AX), b, AX, "close", 3, 5))
