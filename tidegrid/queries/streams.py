"""Streaming queries: each runs a job over the given tables as a stream, to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import rolling as R
from tidegrid.queries import sqlgen as S
from tidegrid.queries.anomalies import DIMS, vectors
from tidegrid.queries.frames import AX, BARS_SQL, bars, table
from tidegrid.queries.registry import query, shaped
from tidegrid.queries.rolling import _ewm
from tidegrid.queries.sourcing import fresh_folder
from tidegrid.queries.tables import rr
from tidegrid.sources import versions
from tidegrid.streaming import jobs as J

TS = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def ts_text(c):
    return TS.format(c=c)


def event_stream(spark, sf_dir):
    """The events table read as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", J.event_time_column("ts"))


def run(spark, stream, keys, values, mode="update", name="stream"):
    path, chk = fresh_folder(spark, name), fresh_folder(spark, f"{name}-chk")
    J.write_updates(stream, path, chk, mode)
    return J.latest_updates(spark.read.parquet(path), keys, values)


@query(
    "X1 S7",
    f"SELECT event_type, {ts_text('time_bucket(INTERVAL 1 HOUR, ts)')} AS bar_start, {rr(open='arg_min(value, ts)', high='max(value)', low='min(value)', close='arg_max(value, ts)', volume='count(*)::DOUBLE')} FROM events GROUP BY 1, 2",
)
def stream_hourly_bars(spark, sf_dir):
    s = J.bar_stream(event_stream(spark, sf_dir), ["event_type"], "ts", "value", "1 hour", "10 minutes", tick="event_id")
    return shaped(run(spark, s, ["event_type", "bar_start"], ["open", "high", "low", "close", "volume"]))


@query(
    "X7",
    "WITH e AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events)"
    f" SELECT event_type, {ts_text('w')} AS window_start, count(*) AS n, {S.r('sum(value)')} AS total FROM e GROUP BY 1, 2",
)
def stream_sliding_activity(spark, sf_dir):
    s = J.sliding_activity(event_stream(spark, sf_dir), ["event_type"], "ts", "value", "1 hour", "30 minutes", "10 minutes")
    return shaped(run(spark, s, ["event_type", "window_start"], ["n", "total"]))


@query(
    "X7",
    "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR > ts THEN 0 ELSE 1 END AS opens FROM events), r AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g),"
    " a AS (SELECT user_id, min(ts) AS session_start, max(ts) AS last_ts, count(*) AS n, sum(value) AS total FROM r GROUP BY user_id, s)"
    f" SELECT user_id, {ts_text('session_start')} AS session_start, {ts_text('last_ts')} AS last_ts, n, {S.r('total')} AS total FROM a",
)
def stream_sessions(spark, sf_dir):
    """Every session: those still open when the events are over come out once the end is marked."""
    events = event_stream(spark, sf_dir).select("user_id", "ts", "value")
    marker, out, chk = (fresh_folder(spark, f"sessions-{n}") for n in ("marker", "out", "chk"))
    spark.createDataFrame([], events.schema).write.parquet(marker)
    s = J.session_activity(J.with_end_marker(events, marker), ["user_id"], "ts", "value", "2 hours", "10 minutes")
    J.write_updates(s, out, chk, "append")
    J.end_of_stream(spark, events.schema, marker, "ts")
    J.write_updates(s, out, chk, "append")
    found = spark.read.parquet(out).filter("user_id IS NOT NULL")
    return shaped(J.latest_updates(found, ["user_id", "session_start"], ["last_ts", "n", "total"]))


def bar_files(spark, sf_dir, name):
    """Daily bars written in three time-ordered steps, then read back one file set at a time."""
    path = fresh_folder(spark, name)
    cuts = ["1900-01-01", "1997-06-30", "1999-06-30", "2100-01-01"]
    stored = fresh_folder(spark, f"{name}-all")
    bars(spark, sf_dir).select("series_id", "ts", "close").write.parquet(stored)
    b = spark.read.parquet(stored)
    for lo, hi in zip(cuts, cuts[1:]):
        b.filter((F.col("ts") > F.lit(lo).cast("date")) & (F.col("ts") <= F.lit(hi).cast("date"))).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(path), b


@query(
    "X5 W25",
    S.Steps(BARS_SQL).add(go="close > 600").add(pos=f"row_number() {S.over()}").add(streak=f"pos - coalesce(max(CASE WHEN NOT go THEN pos END) {S.upto()}, 0)").out([], ["streak"]),
)
def stream_streaks(spark, sf_dir):
    s, _ = bar_files(spark, sf_dir, "streak-in")
    s = s.withColumn("go", F.col("close") > 600)
    return shaped(run(spark, J.streak_stream(s, ["series_id"], "ts", "go"), ["series_id", "ts"], ["streak"], "append"))


@query(
    "X6 W16",
    S.Steps(BARS_SQL).add(pos=f"row_number() {S.over()}").raw(f"SELECT p.*, f.e AS ewm, p.close AS last_value FROM {{prev}} p JOIN {_ewm('close', 12)} f ON p.series_id = f.series_id AND p.pos = f.pos").out(["ewm", "last_value"]),
)
def stream_ewm(spark, sf_dir):
    s, _ = bar_files(spark, sf_dir, "ewm-in")
    return shaped(run(spark, J.ewm_stream(s, ["series_id"], "ts", "close", 12), ["series_id", "ts"], ["ewm", "last_value"], "append"))


_CUT = "DATE '2000-06-30'"


@query(
    "X2 S8",
    f"WITH b AS ({BARS_SQL}) SELECT series_id, {S.day('ts')} AS ts, {S.r(f'CASE WHEN ts > {_CUT} - 30 THEN close + 2 ELSE close END')} AS close FROM b",
)
def stream_corrections(spark, sf_dir):
    b = bars(spark, sf_dir).select("series_id", "ts", "close")
    stored, feed = fresh_folder(spark, "corrected"), fresh_folder(spark, "feed")
    versions.create(b.filter("ts <= DATE '2000-06-30'"), stored, AX, buckets=4)
    late = b.filter("ts > DATE '2000-05-31'")
    arrivals = late.select("series_id", "ts", F.explode(F.array(*[F.struct(F.lit(i).alias("arrival"), (F.col("close") + i).alias("close")) for i in (0, 1, 2)])).alias("v")).select("series_id", "ts", "v.*")
    arrivals.write.parquet(feed)
    J.upsert_stream(spark.readStream.schema(spark.read.parquet(feed).schema).parquet(feed), stored, fresh_folder(spark, "corrected-chk"), AX, ["close"])
    return shaped(versions.read(spark, stored))


@query("X3", S.Steps(BARS_SQL).add(z21=S.zscore("close", 21), change5=S.diff("close", 5)).out(["z21", "change5"]))
def stream_feature_refresh(spark, sf_dir):
    s, b = bar_files(spark, sf_dir, "refresh-in")
    out, stored = fresh_folder(spark, "refresh-out"), fresh_folder(spark, "refresh-stored")
    versions.create(b, stored, AX, buckets=4)
    feats = lambda d: d.withColumns({"z21": R.zscore("close", 21, AX), "change5": R.diff("close", 5, AX)}).select("series_id", "ts", "_since", "z21", "change5")
    J.refresh_stream(s, stored, out, fresh_folder(spark, "refresh-chk"), AX, feats, 21)
    return shaped(J.latest_updates(spark.read.parquet(out), ["series_id", "ts"], ["z21", "change5"]))


@query("X4 D3 D8")
def stream_anomaly_scores(spark, sf_dir):
    from tidegrid.operators import anomaly as AN
    from tidegrid.operators import ranks as RK

    v = vectors(spark, sf_dir)
    forest = AN.fit_forest(v, [f"d{i}" for i in range(DIMS)], "vec_id", trees=100)
    train = AN.score_rows(v, forest).select((-F.col("raw")).alias("s"))
    cut = RK.exact_quantiles(RK.constant_key(train), ["_all"], "s", AN.LEVELS).first().asDict()  # one row
    schema = table(spark, sf_dir, "embeddings").schema
    live = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.parquet*")
    rows = live.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(DIMS)])
    scored = J.score_stream(rows, forest, cut).select("vec_id", "raw", "level")
    return shaped(run(spark, scored, ["vec_id"], ["raw", "level"], "append"))
