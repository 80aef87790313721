"""Source, sink, refresh and document queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegrid.axis import Axis
from tidegrid.functions import dates as D
from tidegrid.operators import bars as B
from tidegrid.operators import quality as Q
from tidegrid.queries import sqlgen as S
from tidegrid.queries.events_futures import CONTRACT_SQL, raw_contracts
from tidegrid.queries.frames import AX, BARS_SQL, bars, market, market_sql, table
from tidegrid.queries.registry import query, shaped
from tidegrid.queries.tables import rr
from tidegrid.session import shared_dir
from tidegrid.sources import documents as DOC
from tidegrid.sources import parse as P
from tidegrid.sources import readers as RD
from tidegrid.sources import refresh as RF
from tidegrid.sources import sinks as SK
from tidegrid.sources import versions

MD = S.day("ts")


def fresh_folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("S1 S10 S14", f"WITH b AS ({BARS_SQL}) SELECT series_id, {MD} AS ts, {S.r('close')} AS close FROM b WHERE ts BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'")
def stored_panel_slice(spark, sf_dir):
    path = fresh_folder(spark, "panel")
    SK.write_panel(bars(spark, sf_dir), path, AX)
    return shaped(RD.read_panel(spark, path, ["close"], "1997-01-01", "1998-06-30"))


@query(
    "S2 S5 S14",
    f"WITH b AS ({BARS_SQL}) SELECT {MD} AS ts, {rr(close='CASE WHEN day(ts) = 13 THEN NULL ELSE round(close * 1000, 2) END', volume='volume')} FROM b",
)
def csv_series(spark, sf_dir):
    path = fresh_folder(spark, "csv")
    text = F.when(F.dayofmonth("ts") == 13, "n/a").otherwise(F.format_number(F.col("close") * 1000, 2))
    bars(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd 00:00:00").alias("Date"), text.alias("Close"), F.col("volume").cast("string").alias("Volume")).write.option("header", True).csv(path)
    return shaped(RD.read_series_csv(spark, path, ["close", "volume"]))


@query(
    "S3",
    "SELECT event_type AS series_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS ts, " + S.r("value") + " AS value FROM events WHERE value >= 5 AND value < 60",
)
def json_observations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("value") < 5, ".").when(F.col("value") >= 60, "bad").otherwise(F.col("value").cast("string"))
    day = F.date_format("ts", "yyyy-MM-dd")
    # one document per event: documents never gather a whole series
    docs = e.select(F.col("event_type").alias("series_id"), F.to_json(F.struct(F.array(F.struct(day.alias("date"), text.alias("value"))).alias("observations"))).alias("doc"))
    return shaped(P.explode_observations(docs, "doc", ["series_id"]))


@query(
    "S3",
    "SELECT event_type AS series_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS ts, " + S.r("value") + " AS value FROM events WHERE value >= 5 AND value < 60",
)
def observation_files(spark, sf_dir):
    """The same observations through files of JSON documents."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("value") < 5, ".").when(F.col("value") >= 60, "bad").otherwise(F.col("value").cast("string"))
    day = F.date_format("ts", "yyyy-MM-dd")
    path = fresh_folder(spark, "observations")
    e.select(F.col("event_type").alias("series_id"), F.array(F.struct(day.alias("date"), text.alias("value"))).alias("observations")).write.json(path)
    return shaped(RD.read_observations(spark, path))


@query("S10", f"WITH b AS ({BARS_SQL}) SELECT series_id, (min(ts) <= DATE '1995-01-05' AND max(ts) >= DATE '2001-07-20')::INT AS covered FROM b GROUP BY 1")
def stored_panel_cover(spark, sf_dir):
    path = fresh_folder(spark, "cover")
    SK.write_panel(bars(spark, sf_dir), path, AX)
    return shaped(RD.covers(RD.read_panel(spark, path, ["close"]), "1995-01-05", "2001-07-20"))


@query("S14", f"WITH b AS ({BARS_SQL}) SELECT series_id, count(*) AS days, {S.r('max(high)')} AS top FROM b GROUP BY 1")
def published_report(spark, sf_dir):
    """A summary as a JSON report, read back."""
    path = fresh_folder(spark, "report")
    SK.write_report(bars(spark, sf_dir).groupBy("series_id").agg(F.count("*").alias("days"), F.max("high").alias("top")), path)
    return shaped(spark.read.schema("series_id string, days long, top double").json(path))


@query(
    "S4",
    f"WITH raw AS ({CONTRACT_SQL}) SELECT substr('FGHJKMNQUVXZ', CAST(month AS INT), 1) || CAST(year % 10 AS VARCHAR) AS contract_code, count(*) AS rows, count(DISTINCT ts) AS days, {rr(9, settle='avg(settle)', volume='sum(volume)')} FROM raw GROUP BY 1",
)
def contract_files(spark, sf_dir):
    path = fresh_folder(spark, "contracts")
    raw = raw_contracts(spark, sf_dir).withColumns({"code": D.contract_code("year", "month"), "expiry": D.contract_expiry("year", "month")})
    named = raw.select(
        F.concat(F.concat_ws("_", F.lit("VX"), "code", F.date_format("expiry", "yyyy-MM-dd")), F.lit(".csv")).alias("contract"), F.date_format("ts", "yyyy-MM-dd").alias("Trade Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"),
        F.col("close").alias("Close"), F.col("settle").alias("Settle"), F.col("volume").alias("Total Volume"), F.col("open_interest").alias("Open Interest"),
    )
    named.write.partitionBy("contract").option("header", True).csv(path)
    got = RD.read_contract_files(spark, path)
    return shaped(got.groupBy("contract_code").agg(F.count("*").alias("rows"), F.countDistinct("ts").alias("days"), F.avg("settle").alias("settle"), F.sum("volume").alias("volume")), digits=9)


@query(
    "S6",
    "SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS event_date, 'scheduled' AS meeting_type FROM orders WHERE o_totalprice > 490000 AND year(o_orderdate) BETWEEN 1996 AND 1999 GROUP BY 1",
)
def event_calendar_file(spark, sf_dir):
    path = fresh_folder(spark, "calendar")
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 490000")
    o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("scheduled").alias("meeting_type")).write.option("header", True).csv(path)
    return shaped(RD.read_event_calendar(spark, path, 1996, 1999))


_EV = "SELECT user_id AS series_id, CAST(ts AS DATE) AS ts, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2"


@query("S7", f"WITH d AS ({_EV}), n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM d) SELECT series_id, {MD} AS ts, {S.r('v')} AS value FROM n WHERE n >= 10")
def normalised_index(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), F.col("ts").alias("raw_ts"), "event_id", "value")
    return shaped(B.normalise_index(e, AX, "raw_ts", "event_id", ["value"]))


_CUT = "DATE '2000-06-30'"


@query(
    "S8 S9 X2",
    f"WITH b AS ({BARS_SQL}), s AS (SELECT series_id, ts, close FROM b WHERE ts <= {_CUT}), f AS (SELECT series_id, ts, close + 1 AS close FROM b WHERE ts > {_CUT} - 30)"
    f" SELECT series_id, {MD} AS ts, {S.r('close')} AS close FROM (SELECT * FROM f UNION ALL SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.series_id = s.series_id AND f.ts = s.ts))",
)
def merged_panel(spark, sf_dir):
    b = bars(spark, sf_dir).select("series_id", "ts", "close")
    path = fresh_folder(spark, "merged")
    versions.create(b.filter("ts <= DATE '2000-06-30'"), path, AX, buckets=4)
    fresh = b.filter("ts > DATE '2000-05-31'").withColumn("close", F.col("close") + 1)
    versions.upsert(path, fresh, AX, ["close"])
    return shaped(versions.read(spark, path))


@query(
    "S9 S11 S12 S18",
    f"WITH b AS ({BARS_SQL}), l AS (SELECT series_id, max(ts) - CAST(substr(series_id, 1, 1) AS INT) * 17 AS last FROM b GROUP BY 1), m AS (SELECT *, CASE substr(series_id, 1, 1) WHEN '1' THEN 'daily' WHEN '2' THEN 'weekly' WHEN '3' THEN 'monthly' WHEN '4' THEN 'quarterly' ELSE 'other' END AS frequency, DATE '2001-08-14' AS now FROM l),"
    " c AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS x), g AS (SELECT m.*, (SELECT count(*) FROM c WHERE x BETWEEN last AND now AND isodow(x) <= 5) - 1 AS gap, (year(now) - year(last)) * 12 + month(now) - month(last) AS mo FROM m)"
    " SELECT series_id, frequency, CASE frequency WHEN 'daily' THEN 5 WHEN 'weekly' THEN 7 WHEN 'monthly' THEN 35 WHEN 'quarterly' THEN 135 ELSE 5 END AS max_fill, gap AS business_gap,"
    f" {S.day('last - 5 - greatest(isodow(last - 5) - 5, 0)::INT')} AS fetch_from,"
    " CASE WHEN CASE frequency WHEN 'daily' THEN gap > 1 WHEN 'weekly' THEN gap > 2 WHEN 'monthly' THEN CASE WHEN mo = 0 THEN false WHEN mo = 1 THEN day(now) >= 12 ELSE true END"
    " WHEN 'quarterly' THEN month(now) > (month(last) // 3) * 3 AND now >= make_date(year(last), (month(last) // 3) * 3, 1) + INTERVAL 1 MONTH + INTERVAL 35 DAY ELSE now - last > 2 END THEN 1 ELSE 0 END AS should_update,"
    " CASE WHEN now - last <= 7 THEN 'excellent' WHEN now - last <= 21 THEN 'good' WHEN now - last <= 60 THEN 'acceptable' ELSE 'stale' END AS grade, (gap > 1)::INT AS stale_at_ten, (gap > 0)::INT AS stale_at_five FROM g",
)
def refresh_rules(spark, sf_dir):
    l = RF.refetch_windows(bars(spark, sf_dir), AX).withColumn("last_day", F.date_sub("last_day", F.substring("series_id", 1, 1).cast("int") * 17))
    names = {"1": "daily", "2": "weekly", "3": "monthly", "4": "quarterly"}
    from tidegrid.functions.scalar import lookup

    m = l.withColumn("frequency", F.coalesce(lookup(F.substring("series_id", 1, 1), names), F.lit("other"))).withColumn("now", F.lit("2001-08-14").cast("date"))
    grade, _ = Q.freshness_grade(F.datediff("now", "last_day"))
    out = RF.attach_fill_limit(m).select(
        "series_id", "frequency", "max_fill", D.business_lag("last_day", "now").alias("business_gap"), D.refetch_start("last_day").alias("fetch_from"), RF.should_update("frequency", "last_day", "now").alias("should_update"), grade.alias("grade"),
        RF.is_stale("last_day", F.lit("2001-08-14 10:00:00").cast("timestamp_ntz")).alias("stale_at_ten"), RF.is_stale("last_day", F.lit("2001-08-14 17:00:00").cast("timestamp_ntz")).alias("stale_at_five"),
    )
    return shaped(out)


@query(
    "S11 S13",
    f"WITH b AS (SELECT series_id, date_trunc('month', ts)::DATE AS ts, max(close) AS v FROM ({BARS_SQL}) GROUP BY 1, 2), e AS (SELECT series_id, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM b GROUP BY 1),"
    " m AS (SELECT e.series_id, e.ts, b.ts AS lbl, b.v FROM e ASOF LEFT JOIN b ON e.series_id = b.series_id AND e.ts >= b.ts), c AS (SELECT *, count(*) FILTER (lbl <> ts) OVER (PARTITION BY series_id, lbl ORDER BY ts) AS reuse FROM m)"
    f" SELECT series_id, {MD} AS ts, CASE WHEN reuse <= 20 THEN {S.r('v')} END AS v FROM c",
)
def daily_from_monthly(spark, sf_dir):
    m = bars(spark, sf_dir).groupBy("series_id", F.trunc("ts", "month").alias("ts")).agg(F.max("close").alias("v"))
    return shaped(RF.expand_to_days(m, AX, ["v"], 20))


@query(
    "S19 S18",
    f"WITH m AS ({market_sql(['vix3m'])}), p AS (SELECT series_id, min(ts) FILTER (vix3m IS NOT NULL) AS first_day, max(ts) FILTER (vix3m IS NOT NULL) AS last_day, count(vix3m) AS known_rows, count(*) AS rows FROM m GROUP BY 1),"
    " c AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2001-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS x), l AS (SELECT max(last_day) AS lead, min(last_day) AS lag FROM p)"
    f" SELECT series_id, {S.day('first_day')} AS first_day, {S.day('last_day')} AS last_day, rows, known_rows, last_day - first_day AS span_days, DATE '2001-12-01' - last_day AS age_days, (SELECT count(*) FROM c WHERE x BETWEEN last_day AND lead AND isodow(x) <= 5) - 1 AS lag_business_days, (last_day = lag)::INT AS is_stalest FROM p, l",
)
def series_coverage(spark, sf_dir):
    return shaped(RF.coverage(market(spark, sf_dir, ["vix3m"]), AX, "vix3m", F.lit("2001-12-01").cast("date")))


@query(
    "S16",
    f"WITH b AS ({BARS_SQL}) SELECT series_id, {S.r('arg_max(close, ts)')} AS vix, {S.r('avg(close)')} AS score, count(*) AS total, '2.0.0' AS version FROM b GROUP BY 1",
)
def live_documents(spark, sf_dir):
    d = bars(spark, sf_dir).groupBy("series_id").agg(F.max_by("close", "ts").alias("last"), F.avg("close").alias("mean"), F.count("*").alias("n"))
    doc = DOC.live_document(d, ["series_id"], {"vix": F.col("last"), "spx": F.col("last") * 2}, {"ensemble_score": F.col("mean")}, {"total": F.col("n")})
    j = lambda p: F.get_json_object("document", f"$.{p}")
    return shaped(doc.select("series_id", j("market.vix").cast("double").alias("vix"), j("anomaly.ensemble_score").cast("double").alias("score"), j("persistence.total").cast("long").alias("total"), j("schema_version").alias("version")))


@query(
    "S17",
    "WITH x AS (SELECT event_id, event_type AS t, value / 50 AS s FROM events)"
    " SELECT event_id, 'critical' AS severity, 'missing required field persistence' AS violation FROM x WHERE t = 'error' UNION ALL SELECT event_id, 'critical', 'missing required field market' FROM x WHERE t = 'view'"
    " UNION ALL SELECT event_id, 'error', 'market.vix is not a number' FROM x WHERE t = 'click' UNION ALL SELECT event_id, 'critical', 'document is null or not JSON' FROM x WHERE t = 'signup' UNION ALL SELECT event_id, 'warning', 'score out of range' FROM x WHERE t <> 'signup' AND s > 1",
)
def document_violations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("t"), (F.col("value") / 50).alias("s"))
    vix = F.when(F.col("t") == "click", F.lit('"high"')).otherwise(F.col("s").cast("string"))
    market_part = F.when(F.col("t") != "view", F.concat(F.lit('"market":{"vix":'), vix, F.lit(',"spx":1.5},'))).otherwise("")
    persistence = F.when(F.col("t") != "error", F.lit(',"persistence":{"n":1}')).otherwise("")
    text = F.concat(F.lit('{"schema_version":"2.0.0",'), market_part, F.lit('"anomaly":{"ensemble_score":'), F.col("s").cast("string"), F.lit("}"), persistence, F.lit("}"))
    docs = e.select("event_id", F.when(F.col("t") == "signup", F.lit("{broken")).otherwise(text).alias("document"))
    return DOC.validate_documents(docs, ["event_id"], "document", "live")


@query(
    "S17",
    "SELECT event_id, 'warning' AS severity, 'array lengths differ' AS violation FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'critical', 'missing required field attribution' FROM events WHERE event_type = 'error'"
    " UNION ALL SELECT event_id, 'error', 'historical.dates is not an array' FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 'critical', 'document is null or not JSON' FROM events WHERE event_type = 'signup'",
)
def historical_document_violations(spark, sf_dir):
    kind, day = F.col("event_type"), F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"'))
    dates = F.when(kind == "view", day).when(kind == "click", F.concat(F.lit("["), day, F.lit(","), day, F.lit("]"))).otherwise(F.concat(F.lit("["), day, F.lit("]")))
    rest = F.when(kind == "error", F.lit("")).otherwise(F.lit(',"attribution":{}'))
    text = F.concat(F.lit('{"schema_version":"2.0.0","historical":{"dates":'), dates, F.lit(',"ensemble_scores":['), F.col("value").cast("string"), F.lit("]}"), rest, F.lit("}"))
    docs = table(spark, sf_dir, "events").select("event_id", F.when(kind == "signup", F.lit("[1")).otherwise(text).alias("document"))
    return DOC.validate_documents(docs, ["event_id"], "document", "historical")


_HD = ["vix", "vix3m", "skew", "y10y"]


@query(
    "D15",
    f"WITH m AS ({market_sql(['vix3m', 'y30y'])}) SELECT series_id, {rr(valid_share='count(y30y) * 1.0 / count(*)', value_range='max(y30y) - min(y30y)')}, CASE WHEN count(y30y) * 1.0 / count(*) < 0.5 THEN 'too few valid values' WHEN count(y30y) > 1 AND max(y30y) - min(y30y) < 1e-6 THEN 'insufficient variance' ELSE 'ok' END AS reason,"
    " CASE WHEN count(y30y) * 1.0 / count(*) >= 0.5 AND max(y30y) - min(y30y) >= 1e-6 THEN 1 ELSE 0 END AS is_valid FROM m GROUP BY 1",
)
def series_validity(spark, sf_dir):
    return shaped(Q.series_validity(market(spark, sf_dir, ["vix3m", "y30y"]), AX, "y30y"))


@query(
    "V1",
    "SELECT boundary, CAST(b - a AS INT) AS gap_days, CASE WHEN b - a <= 0 THEN 1 ELSE 0 END AS leak, CASE WHEN b - a > 10 THEN 1 ELSE 0 END AS large_gap FROM (SELECT 'train->val' AS boundary, max(d) FILTER (d <= DATE '1998-12-31') AS a, min(d) FILTER (d > DATE '1998-12-31' AND d <= DATE '2000-06-30') AS b FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)"
    " UNION ALL SELECT 'val->test', max(d) FILTER (d > DATE '1998-12-31' AND d <= DATE '2000-06-30'), min(d) FILTER (d > DATE '2000-07-20') FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders))",
)
def split_boundaries(spark, sf_dir):
    from tidegrid.operators.targets import time_split

    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("ts"))
    o = o.withColumn("split", time_split("ts", "1998-12-31", "2000-06-30")).filter("ts <= DATE '2000-06-30' OR ts > DATE '2000-07-20'")
    return Q.split_check(o, [], "split", "ts", ["train", "val", "test"])


_AUD = ["vix3m", "skew", "dxy", "crude", "gold", "vxtlt", "y10y"]
_LAGS = {"^VIX": 0, "SKEW": 1, "DX-Y.NYB": 3, "CL=F": 14}  # days by source; the others have none


@query(
    "V3 P17",
    f"WITH m AS ({market_sql(_AUD)}), l AS (" + " UNION ALL ".join(f"SELECT series_id, '{c}' AS feature, '{src}' AS source, max(ts) FILTER ({c} IS NOT NULL) AS last_known, DATE '2001-11-05' - {lag} AS allowed FROM m GROUP BY 1" for c, src, lag in (("vix3m", "^VIX", 0), ("skew", "SKEW", 1), ("dxy", "DX-Y.NYB", 3), ("crude", "CL=F", 14)))
    + f") SELECT series_id, feature, source, {S.day('last_known')} AS last_known, {S.day('allowed')} AS allowed, (last_known > allowed)::INT AS violation FROM l WHERE last_known IS NOT NULL",
)
def publication_lag_audit(spark, sf_dir):
    """Sources are read off the features' names; gold and the yield point to none that has a lag."""
    return shaped(Q.publication_violations(market(spark, sf_dir, _AUD), AX, F.lit("2001-11-05").cast("date"), _LAGS, _AUD))


@query(
    "V3",
    f"WITH m AS ({market_sql(['vix3m'])}), l AS (SELECT series_id, max(ts) FILTER (vix3m IS NOT NULL) AS k, max(ts) AS e FROM m GROUP BY 1) SELECT series_id, lag, {S.day('k')} AS last_known, {S.day('e - lag')} AS allowed, (NOT coalesce(k > e - lag, false))::INT AS in_order FROM l, (VALUES (0), (1), (30)) v(lag)",
)
def term_structure_audit(spark, sf_dir):
    df, out = market(spark, sf_dir, ["vix3m"]), None
    for lag in (0, 1, 30):
        part = Q.term_structure_timing(df, AX, "vix3m", lag).withColumn("lag", F.lit(lag))
        out = part if out is None else out.unionByName(part)
    return shaped(out)


@query(
    "V4",
    f"WITH m AS ({market_sql(['vix3m', 'y10y'])}), u AS (SELECT series_id, ts, 'vix3m' AS feature, 1 AS lag, DATE '2001-06-30' AS av FROM m WHERE vix3m IS NOT NULL UNION ALL SELECT series_id, ts, 'y10y', 14, DATE '2001-07-31' FROM m WHERE y10y IS NOT NULL)"
    " SELECT series_id, feature, count(*) AS checked, CAST(sum((av > ts - lag)::INT) AS BIGINT) AS violations FROM u GROUP BY 1, 2",
)
def walk_forward_audit(spark, sf_dir):
    meta = spark.createDataFrame([("vix3m", 1, "2001-06-30"), ("y10y", 14, "2001-07-31")], "feature string, lag_days int, d string").select("feature", "lag_days", F.col("d").cast("date").alias("last_available"))
    v = Q.walk_forward_violations(market(spark, sf_dir, ["vix3m", "y10y"]), ["series_id", "ts"], "ts", ["vix3m", "y10y"], meta)
    return v.groupBy("series_id", "feature").agg(F.count("*").alias("checked"), F.sum("violation").alias("violations"))


@query(
    "V5 U4",
    f"WITH m AS ({market_sql(['vix3m', 'y10y'])}), cal AS (SELECT DISTINCT ts FROM m), late AS (SELECT ts FROM cal WHERE ts - DATE '1970-01-01' >= (SELECT quantile_cont(ts - DATE '1970-01-01', 0.5) FROM cal)),"
    " pick AS (SELECT ts FROM late ORDER BY md5(CAST(ts AS VARCHAR) || ':42'), ts LIMIT 20),"
    " k AS (SELECT ts, DATE '2001-06-30' > ts - 1 AS v FROM m WHERE vix3m IS NOT NULL UNION ALL SELECT ts, DATE '2001-07-31' > ts - 14 FROM m WHERE y10y IS NOT NULL)"
    f" SELECT {MD} AS ts, count(*) AS checked, CAST(sum(v::INT) AS BIGINT) AS violations, CAST(sum(v::INT) = 0 AS INT) AS passed FROM k JOIN pick USING (ts) GROUP BY 1",
)
def sampled_availability(spark, sf_dir):
    meta = spark.createDataFrame([("vix3m", 1, "2001-06-30"), ("y10y", 14, "2001-07-31")], "feature string, lag_days int, d string").select("feature", "lag_days", F.col("d").cast("date").alias("last_available"))
    return shaped(Q.sampled_walk_forward(market(spark, sf_dir, ["vix3m", "y10y"]), ["series_id", "ts"], "ts", ["vix3m", "y10y"], meta))


_qs = "(vix IS NOT NULL)::INT + (skew IS NOT NULL)::INT + 0 + CASE WHEN y10y IS NULL THEN 0.5 ELSE CASE WHEN day(ts) - 1 <= 0 THEN 1.0 WHEN day(ts) - 1 <= 3 THEN 0.95 WHEN day(ts) - 1 <= 7 THEN 0.8 WHEN day(ts) - 1 <= 14 THEN 0.5 ELSE 0.2 END END + CASE WHEN vix6m IS NULL THEN 0.5 ELSE 1 END + CASE WHEN y30y IS NULL THEN 0.9 ELSE 1 END"
_QL = S.Steps(market_sql(["vix", "skew", "y10y", "vix6m", "y30y"])).add(q=f"(({_qs}) / 6.0)")


def quality_rows(spark, sf_dir):
    df = market(spark, sf_dir, ["vix", "skew", "y10y", "vix6m", "y30y"])
    q = Q.feature_quality(df, ["vix", "skew", "absent"], ["y10y", "vix6m"], ["y30y"], {"y10y": F.dayofmonth("ts")}, {"y10y": 1})
    return df.withColumn("q", q)


@query(
    "V6 V7 V8 M5",
    _QL.add(grade="CASE WHEN q >= 0.95 THEN 'excellent' WHEN q >= 0.85 THEN 'good' WHEN q >= 0.7 THEN 'acceptable' WHEN q >= 0.5 THEN 'poor' ELSE 'unusable' END", usable="(q >= 0.7)::INT").out(["q"], ["usable"], texts=["grade"]),
)
def row_quality(spark, sf_dir):
    df = quality_rows(spark, sf_dir)
    grade, usable = Q.quality_grade("q")
    return shaped(df.withColumns({"grade": grade, "usable": usable}), ["series_id", "ts", "q", "usable", "grade"])


@query("M5", _QL.done(f"SELECT series_id, {MD} AS ts, {S.r('q')} AS q FROM {{prev}} WHERE q >= 0.7"))
def quality_filtered_rows(spark, sf_dir):
    from tidegrid.operators.targets import quality_filter

    return shaped(quality_filter(quality_rows(spark, sf_dir).select("series_id", "ts", "q"), "q", 0.7, strategy="warn"))


@query(
    "M5",
    _QL.done(
        "SELECT threshold, count(*) AS rows, " + S.r("avg((q < threshold)::INT) * 100") + " AS lost_pct, CASE WHEN avg((q < threshold)::INT) > 0.5 THEN 'error' WHEN avg((q < threshold)::INT) > 0.2 THEN 'warn' ELSE 'ok' END AS verdict"
        " FROM {prev}, (VALUES (0.5::DOUBLE), (0.6), (0.65), (0.7), (0.75), (0.8), (0.9)) v(threshold) GROUP BY 1"
    ),
)
def quality_loss_levels(spark, sf_dir):
    from tidegrid.operators.targets import quality_loss

    return shaped(quality_loss(quality_rows(spark, sf_dir).select("q"), "q", [0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9]))


@query(
    "V9",
    f"WITH m AS ({market_sql(['vix', 'y10y', 'vix6m'])}) SELECT series_id, feature, tier, issue, count(*) AS n FROM (SELECT series_id, 'y10y' AS feature, 'CRITICAL' AS tier, 'missing' AS issue FROM m WHERE y10y IS NULL UNION ALL SELECT series_id, 'vix6m', 'Important', 'missing' FROM m WHERE vix6m IS NULL"
    " UNION ALL SELECT series_id, 'absent', 'CRITICAL', 'not in feature set' FROM m) GROUP BY 1, 2, 3, 4",
)
def quality_issue_report(spark, sf_dir):
    df = market(spark, sf_dir, ["vix", "y10y", "vix6m"])
    return Q.quality_issues(df, ["series_id", "ts"], ["vix", "y10y", "absent"], ["vix6m"]).groupBy("series_id", "feature", "tier", "issue").agg(F.count("*").alias("n"))


_VC = ["vix", "y10y", "skew", "thin"]
_RIDGE_X = ["vix", "y10y", "skew"]


def audited(spark, sf_dir):
    df = market(spark, sf_dir, ["vix", "y10y", "skew", "vvix"])
    return df.withColumn("thin", F.when((F.dayofmonth("ts") > 13) & (F.dayofmonth("ts") % 2 == 0) | (F.col("ts") > F.lit("1999-12-31").cast("date")), F.col("vvix")))


_THIN = "CASE WHEN (day(ts) > 13 AND day(ts) % 2 = 0) OR ts > DATE '1999-12-31' THEN vvix END AS thin"


@query(
    "V2",
    f"WITH m0 AS ({market_sql(['vix', 'y10y', 'skew', 'vvix'])}), m AS (SELECT *, {_THIN} FROM m0), s AS (SELECT *, (ts > DATE '1999-12-31')::INT AS side FROM m), n AS (SELECT *, row_number() OVER (PARTITION BY series_id, side ORDER BY CASE WHEN side = 0 THEN -(ts - DATE '1970-01-01') ELSE ts - DATE '1970-01-01' END) AS k FROM s), c AS (SELECT * FROM n WHERE k <= 20),"
    + " full_ AS (" + " UNION ALL ".join(f"SELECT series_id, '{c}' AS feature FROM (SELECT series_id, side, avg(({c} IS NULL)::INT) AS lack FROM s GROUP BY 1, 2) GROUP BY 1 HAVING max(lack) <= 0.5" for c in _VC) + "),"
    + " u AS (" + " UNION ALL ".join(f"SELECT series_id, '{c}' AS feature, ts, side, {c} AS v FROM c WHERE {c} IS NOT NULL" for c in _VC) + "), p AS (SELECT *, lag(v) OVER (PARTITION BY series_id, feature ORDER BY ts) AS pv FROM u)"
    f" SELECT series_id, feature, CAST(sum((side = 0)::INT) AS BIGINT) AS n_before, CAST(sum(side) AS BIGINT) AS n_after, {S.r('corr(v, pv)')} AS autocorr, CASE WHEN sum((side = 0)::INT) > 5 AND sum(side) > 5 AND corr(v, pv) > 0.99 THEN 1 ELSE 0 END AS suspicious FROM p JOIN full_ USING (series_id, feature) GROUP BY 1, 2",
)
def fold_continuity(spark, sf_dir):
    return shaped(Q.split_continuity(audited(spark, sf_dir), AX, _VC, F.lit("1999-12-31").cast("date")))


def _det(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_A = [[f"(s{min(i, j)}{max(i, j)}" + (" + 1)" if i == j else ")") for j in range(3)] for i in range(3)]
_W = [f"{_det([[f'b{r}' if c == k else _A[r][c] for c in range(3)] for r in range(3)])} / {_det(_A)} AS w{k}" for k in range(3)]


@query(
    "V2",
    f"WITH m AS ({market_sql(_RIDGE_X)}), t AS (SELECT *, lead(vix, 5) OVER (PARTITION BY series_id ORDER BY ts) AS y FROM m), s AS (SELECT series_id, ts, y, " + ", ".join(f"coalesce({c}, 0) AS x{i}" for i, c in enumerate(_RIDGE_X)) + ", (ts > DATE '1999-12-31')::INT AS side FROM t WHERE y IS NOT NULL),"
    " n AS (SELECT *, row_number() OVER (PARTITION BY series_id, side ORDER BY CASE WHEN side = 0 THEN -(ts - DATE '1970-01-01') ELSE ts - DATE '1970-01-01' END) AS k FROM s), tr AS (SELECT * FROM n WHERE side = 0 AND k <= 100), va AS (SELECT * FROM n WHERE side = 1 AND k <= 50),"
    " mu AS (SELECT series_id, count(*) AS nt, avg(y) AS my, " + ", ".join(f"avg(x{i}) AS m{i}" for i in range(3)) + " FROM tr GROUP BY 1),"
    " g AS (SELECT series_id, any_value(nt) AS nt, any_value(my) AS my, " + ", ".join(f"any_value(m{i}) AS m{i}, sum((x{i} - m{i}) * (y - my)) AS b{i}" for i in range(3)) + ", " + ", ".join(f"sum((x{i} - m{i}) * (x{j} - m{j})) AS s{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM tr JOIN mu USING (series_id) GROUP BY 1),"
    f" w AS (SELECT *, {', '.join(_W)} FROM g), q AS (SELECT series_id, y, nt, count(*) OVER (PARTITION BY series_id) AS nv, avg(y) OVER (PARTITION BY series_id) AS vy, my + " + " + ".join(f"(x{i} - m{i}) * w{i}" for i in range(3)) + " AS p FROM va JOIN w USING (series_id)),"
    " r AS (SELECT series_id, CASE WHEN any_value(nt) >= 100 AND any_value(nv) > 10 AND sum(pow(y - vy, 2)) > 0 THEN 1 - sum(pow(y - p, 2)) / sum(pow(y - vy, 2)) END AS r2 FROM q GROUP BY 1)"
    f" SELECT series_id, {S.r('r2')} AS r2, coalesce(r2 > 0.8, false)::INT AS suspicious FROM r",
)
def fold_ridge_check(spark, sf_dir):
    df = market(spark, sf_dir, _RIDGE_X)
    return shaped(Q.ridge_leak_check(df.withColumn("next", F.lead("vix", 5).over(AX.ordered())), AX, _RIDGE_X, "next", F.lit("1999-12-31").cast("date")))


@query(
    "V10",
    f"WITH m AS ({market_sql(_HD)}), n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS back FROM m) "
    + " UNION ALL ".join(f"SELECT series_id, '{c}' AS feature, {S.r(f'avg(({c} IS NULL)::INT) * 100')} AS missing_pct, min(coalesce(({c} = 0)::INT, 1)) AS all_zero, coalesce((min({c}) FILTER (back <= 20) = max({c}) FILTER (back <= 20))::INT, 0) AS constant_tail FROM n GROUP BY 1" for c in _HD),
)
def column_diagnostics(spark, sf_dir):
    return shaped(Q.constant_tail(market(spark, sf_dir, _HD), AX, _HD))


@query(
    "F32",
    "WITH b AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS a, value * 50000 AS b FROM events)"
    f" SELECT event_id, {rr(a='coalesce(a, 0)', b='least(greatest(b, -1e6), 1e6)')} FROM b",
)
def repaired_features(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("a"), (F.col("value") * 50000).alias("b"))
    return shaped(Q.repair_features(e, ["a", "b"]))


@query(
    "F32",
    "WITH b AS (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE value END AS a, value * 50000 AS b FROM events)"
    " SELECT 'a' AS feature, count(*) - count(a) AS nulls, 0 AS infinite, count(*) FILTER (abs(a) > 1e6) AS extreme FROM b UNION ALL SELECT 'b', count(*) - count(b), 0, count(*) FILTER (abs(b) > 1e6) FROM b",
)
def feature_defects(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", F.col("value")).alias("a"), (F.col("value") * 50000).alias("b"))
    return shaped(Q.defect_counts(e, ["a", "b"]))
