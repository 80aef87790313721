import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from helpers import AX, days
from tidegrid.sources import documents as DOC
from tidegrid.sources import readers as RD
from tidegrid.sources import refresh as RF
from tidegrid.sources import sinks as SK
from tidegrid.sources import versions as VS


def test_series_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Date,Close,Vol\n2024-01-02,"1,234.5",x\n2024-01-03 00:00:00,7,8\nbad,1,2\n')
    rows = RD.read_series_csv(spark, str(tmp_path / "s.csv"), ["close", "vol"]).orderBy("ts").collect()
    assert [(str(r["ts"]), r["close"], r["vol"]) for r in rows] == [("2024-01-02", 1234.5, None), ("2024-01-03", 7.0, 8.0)]


def test_observations(spark, tmp_path):
    doc = {"series_id": "s", "observations": [{"date": "2024-01-01", "value": "1.5"}, {"date": "2024-01-02", "value": "."}, {"date": "2024-01-03", "value": "n/a"}]}
    (tmp_path / "o.json").write_text(json.dumps(doc))
    assert [(r["series_id"], str(r["ts"]), r["value"]) for r in RD.read_observations(spark, str(tmp_path / "o.json")).collect()] == [("s", "2024-01-01", 1.5)]


def test_contract_file_names(spark, tmp_path):
    head = "Trade Date,Open,High,Low,Close,Settle,Total Volume,Open Interest\n"
    (tmp_path / "VX_F4_2024-01-17.csv").write_text(head + "2024-01-02,13,14,12,13.5,13.4,100,50\n")
    (tmp_path / "VX_G4_2024-02-14.csv").write_text(head + '2024-01-02,15,16,14,15.5,15.4,"1,100",50\n')
    (tmp_path / "notes.csv").write_text("x\n1\n")
    rows = RD.read_contract_files(spark, str(tmp_path)).orderBy("contract_code").collect()
    assert [(r["contract_code"], str(r["expiry_date"]), r["volume"]) for r in rows] == [("F4", "2024-01-17", 100.0), ("G4", "2024-02-14", 1100.0)]


def test_event_calendar_checks_columns(spark, tmp_path):
    (tmp_path / "e.csv").write_text("date,meeting_type\n2023-05-03,a\n2024-01-31,b\n2024-01-31,b\n")
    assert RD.read_event_calendar(spark, str(tmp_path / "e.csv"), 2024, 2025).count() == 1
    (tmp_path / "bad.csv").write_text("date,kind\n2024-01-31,b\n")
    with pytest.raises(ValueError):
        RD.read_event_calendar(spark, str(tmp_path / "bad.csv"), 2024, 2025)


def panel(spark, vals, start="2023-12-30"):
    return spark.createDataFrame([("a", d, float(v)) for d, v in zip(days(len(vals), start), vals)], "series_id string, ts date, close double")


def closes(df):
    return [r["close"] for r in df.orderBy("series_id", "ts").collect()]


def test_upsert_rewrites_only_touched_years(spark, tmp_path):
    path = str(tmp_path / "p")
    VS.create(panel(spark, range(6)), path, AX, buckets=2)
    old = {p.folder for p in VS.version(spark, path).parts if p.year == 2023}
    v = VS.upsert(path, panel(spark, [100, 101], "2024-01-02"), AX, ["close"])
    assert v.number == 2 and old < {p.folder for p in v.parts}
    assert closes(VS.read(spark, path)) == [0.0, 1.0, 2.0, 100.0, 101.0, 5.0]
    assert closes(VS.read(spark, path, number=1)) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert closes(VS.read(spark, path, "2024-01-01")) == [2.0, 100.0, 101.0, 5.0]
    assert all("year=2024" in f for f in VS.read(spark, path, "2024-01-01").inputFiles())


def test_a_writer_that_dies_before_the_commit_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "p")
    VS.create(panel(spark, range(6)), path, AX, buckets=2)

    def dies():
        raise OSError("lost")

    with pytest.raises(OSError):
        VS.upsert(path, panel(spark, [9, 9], "2024-01-02"), AX, ["close"], before_commit=dies)
    assert VS.version(spark, path).number == 1 and closes(VS.read(spark, path)) == [float(k) for k in range(6)]
    assert VS.clean_up(spark, path) == []  # what the dead writer left is too young to go
    assert len(VS.clean_up(spark, path, older_than=0)) == 1 and closes(VS.read(spark, path)) == [float(k) for k in range(6)]


def test_the_loser_of_a_race_merges_over_the_winner(spark, tmp_path):
    path, raced = str(tmp_path / "p"), []
    VS.create(panel(spark, range(6)), path, AX, buckets=2)

    def other():
        if not raced:
            raced.append(VS.upsert(path, panel(spark, [50], "2024-01-01"), AX, ["close"]))

    v = VS.upsert(path, panel(spark, [70], "2024-01-03"), AX, ["close"], before_commit=other)
    assert (raced[0].number, v.number) == (2, 3) and closes(VS.read(spark, path)) == [0.0, 1.0, 50.0, 3.0, 70.0, 5.0]
    with pytest.raises(VS.Conflict):
        VS.commit(spark, path, v)
    gone = VS.clean_up(spark, path, keep=1, older_than=0)
    assert {"v00000001", "v00000002"} <= set(gone) and len(gone) == 4 and closes(VS.read(spark, path)) == [0.0, 1.0, 50.0, 3.0, 70.0, 5.0]
    VS.create(panel(spark, []), str(tmp_path / "none"), AX)
    assert VS.read(spark, str(tmp_path / "none")).count() == 0


def test_a_refresh_opens_only_the_files_it_needs(spark, tmp_path):
    path = str(tmp_path / "p")
    names = [f"s{k}" for k in range(12)]
    many = panel(spark, range(2200), "2018-01-01").drop("series_id").crossJoin(spark.createDataFrame([(n,) for n in names], "series_id string")).select("series_id", "ts", "close")
    VS.create(many, path, AX, buckets=8)
    every = len(VS.read(spark, path).inputFiles())
    since = spark.createDataFrame([("s3", dt.date(2023, 6, 1))], "series_id string, _since date")
    near = VS.read_near(spark, path, since, AX, 21)
    bucket = many.filter("series_id = 's3'").select(VS.bucket_of(AX, 8).alias("b")).first()["b"]
    assert all(f"bucket={bucket}/" in f and ("year=2022" in f or "year=2023" in f or "year=2024" in f) for f in near.inputFiles())
    assert len(near.inputFiles()) <= 3 < every and near.filter("ts < DATE '2023-06-01'").count() >= 21
    long = VS.read_near(spark, path, since, AX, 900)  # three years back
    assert len(near.inputFiles()) < len(long.inputFiles()) < every and long.filter("ts < DATE '2023-06-01'").count() >= 900


def test_append_newer_rows(spark, tmp_path):
    path = str(tmp_path / "p")
    SK.write_panel(panel(spark, range(6)), path, AX)
    SK.append_newer_rows(path, panel(spark, [7, 8, 9], "2024-01-03"), AX)
    assert closes(SK.read_written(spark, path)) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 9.0]


def test_read_pushes_range_and_columns(spark, tmp_path):
    path = str(tmp_path / "q")
    SK.write_panel(panel(spark, range(6)), path, AX)
    plan = RD.read_panel(spark, path, ["close"], "2024-01-01", "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<series_id:string,ts:date,close:double>" in plan


def test_coverage_and_staleness(spark):
    d = panel(spark, [1, 2, 3], "2024-01-01").unionByName(panel(spark, [1], "2024-01-01").withColumn("series_id", F.lit("b")))
    c = {r["series_id"]: r for r in RF.coverage(d, AX, "close", F.lit(dt.date(2024, 1, 10))).collect()}
    assert c["a"]["lag_business_days"] == 0 and c["b"]["lag_business_days"] == 2 and c["b"]["is_stalest"] == 1 and c["a"]["age_days"] == 7
    t = spark.createDataFrame([(dt.date(2024, 1, 5), dt.datetime(2024, 1, 8, 10)), (dt.date(2024, 1, 5), dt.datetime(2024, 1, 8, 17)), (dt.date(2024, 1, 8), dt.datetime(2024, 1, 8, 17)), (None, dt.datetime(2024, 1, 8, 17))], "l date, n timestamp")
    assert [r[0] for r in t.select(RF.is_stale("l", "n")).collect()] == [0, 1, 0, 1]


def test_document_violations(spark):
    ok = {"schema_version": "2", "market": {"vix": 1.0, "spx": 2}, "anomaly": {"ensemble_score": 0.4}, "persistence": {}}
    hist = {"schema_version": "2", "historical": {"dates": ["a", "b"], "ensemble_scores": [1]}, "attribution": {}}
    bad = {"schema_version": "2", "historical": {"dates": "a", "ensemble_scores": [1]}}
    live = spark.createDataFrame([(1, json.dumps(ok)), (2, "nope"), (3, json.dumps({**ok, "anomaly": {"ensemble_score": 1.5}}))], "i int, document string")
    got = {(r["i"], r["severity"]) for r in DOC.validate_documents(live, ["i"], "document", "live").collect()}
    assert got == {(2, "critical"), (3, "warning")}
    h = spark.createDataFrame([(1, json.dumps(hist)), (2, json.dumps(bad))], "i int, document string")
    got = {(r["i"], r["severity"], r["violation"]) for r in DOC.validate_documents(h, ["i"], "document", "historical").collect()}
    assert got == {(1, "warning", "array lengths differ"), (2, "critical", "missing required field attribution"), (2, "error", "historical.dates is not an array")}


def test_shared_folder(spark):
    from types import SimpleNamespace

    import pytest as pt

    from tidegrid.session import shared_dir

    def session(master, named, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: folder, applicationId="none"))

    assert shared_dir(session("yarn", "hdfs://n/m/", "hdfs://x/y")) == "hdfs://n/m"
    assert shared_dir(session("yarn", None, "hdfs://x/y")) == "hdfs://x/y"
    with pt.raises(ValueError):
        shared_dir(session("yarn", None, None))
    with pt.raises(ValueError):
        shared_dir(session("local-cluster[2,1,1024]", None, None))
    assert shared_dir(spark) == shared_dir(spark)


def test_running_streams_take_late_rows(spark, tmp_path):
    import datetime as dt

    from pyspark.sql import functions as F

    from tidegrid.streaming import jobs as J

    day = lambda n: dt.date(2024, 1, n)
    shape = "k string, ts date, go boolean, x double"
    for i, rows in enumerate([[("a", day(1), True, 1.0), ("a", day(3), True, 3.0)], [("a", day(2), False, 2.0), ("b", day(9), True, None)], [("a", day(4), True, None), ("a", day(3), True, 5.0)]]):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for name, stream, cols in (("streak", J.streak_stream(s, ["k"], "ts", "go"), ["streak"]), ("ewm", J.ewm_stream(s, ["k"], "ts", "x", 3), ["ewm", "last_value"])):
        J.write_updates(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-chk", "append")
        got = {(r["k"], r["ts"].day): tuple(r[c] for c in cols) for r in J.latest_updates(spark.read.parquet(f"{tmp_path}/{name}"), ["k", "ts"], cols).collect()}
        if name == "streak":
            assert got == {("a", 1): (1,), ("a", 2): (0,), ("a", 3): (1,), ("a", 4): (2,), ("b", 9): (1,)}
        else:
            mean = [1.0, 5 / 3, (0.25 + 1.0 + 5.0) / 1.75]
            assert [round(got["a", n][0], 9) for n in (1, 2, 3, 4)] == [round(m, 9) for m in (*mean, mean[2])]
            assert got["a", 4][1] == 5.0 and got["b", 9][0] is None


def test_late_rows_are_put_aside_and_idle_keys_leave(spark, tmp_path):
    from tidegrid.streaming import jobs as J

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    shape = "k string, ts date, go boolean"
    # a is alive; b falls silent, leaves, and comes back; c's second row is behind its own newest day, its third behind all
    steps = [[("a", 0, True), ("b", 0, True), ("c", 0, True), ("c", 20, True), ("c", 50, True)], [("a", 150, True), ("c", 3, True)], [("a", 151, True), ("c", 2, True)], [("b", 152, True), ("c", 1, True)], [("a", 180, True)], [("a", 181, True)]]
    for i, rows in enumerate(steps):
        spark.createDataFrame([(k, day(n), g) for k, n, g in rows], shape).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    told = J.write_updates(J.streak_stream(s, ["k"], "ts", "go", late=10, idle=60), f"{tmp_path}/out", f"{tmp_path}/chk", "append", f"{tmp_path}/late")
    got = {(r["k"], (r["ts"] - day(0)).days): r["streak"] for r in J.latest_updates(spark.read.parquet(f"{tmp_path}/out"), ["k", "ts"], ["streak"]).collect()}
    assert got == {("a", 0): 1, ("a", 150): 2, ("a", 151): 3, ("a", 180): 4, ("a", 181): 5, ("b", 0): 1, ("b", 152): 1, ("c", 0): 1, ("c", 20): 2, ("c", 50): 3}
    assert [(r["k"], (r["ts"] - day(0)).days) for r in spark.read.parquet(f"{tmp_path}/late").orderBy("ts").collect()] == [("c", 2), ("c", 3)]
    assert told["late"] == 2 and told["dropped"] == 1 and told["held"] == 2  # a and the new b; c has left


def test_the_last_sessions_come_out_and_the_state_is_empty(spark, tmp_path):
    from tidegrid.streaming import jobs as J

    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    shape = "u long, ts timestamp, v double"
    events = spark.createDataFrame([(1, at(0), 1.0), (1, at(50), 2.0), (1, at(400), 4.0), (2, at(410), 8.0)], shape)
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/end")
    live = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
    s = J.session_activity(J.with_end_marker(live, f"{tmp_path}/end"), ["u"], "ts", "v", "2 hours", "10 minutes")
    first = J.write_updates(s, f"{tmp_path}/out", f"{tmp_path}/chk", "append")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1 and first["held"] == 2
    J.end_of_stream(spark, events.schema, f"{tmp_path}/end", "ts")
    last = J.write_updates(s, f"{tmp_path}/out", f"{tmp_path}/chk", "append")
    got = {(r["u"], r["n"], r["total"]) for r in spark.read.parquet(f"{tmp_path}/out").filter("u IS NOT NULL").collect()}
    assert got == {(1, 2, 3.0), (1, 1, 4.0), (2, 1, 8.0)} and last["held"] <= 1  # nothing but the marker's own
