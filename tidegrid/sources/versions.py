"""Panels as immutable files under numbered manifests: atomic upserts, and reads that open only what matters.

A panel is cut by a hash of its series into buckets and by year. ``data/<write>/bucket=b/year=y`` is written once and
never changed; a manifest lists the folders that make up one version, with the days they span. A writer puts its folders
beside the others and then renames a finished manifest to the next number, which fails if somebody else was first: it
then merges again over their version. Readers see whole versions only, whenever a writer dies."""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegrid.axis import Axis
from tidegrid.operators.bars import merge_new_rows

BUCKETS = 64


@dataclass(frozen=True)
class Part:
    folder: str
    bucket: int
    year: int
    lo: str
    hi: str
    rows: int


@dataclass(frozen=True)
class Version:
    number: int
    buckets: int
    schema: str
    parts: tuple[Part, ...]


class Conflict(RuntimeError):
    """Somebody else committed this version number."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _files(spark, path), _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(n[1:-5]) for n in _names(spark, f"{path}/manifest") if n.startswith("v") and n.endswith(".json")]


def bucket_of(ax: Axis, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*ax.keys), F.lit(buckets)).cast("int")


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest version, or one that is still kept; a panel that was never written has none."""
    path = path.rstrip("/")
    numbers = _numbers(spark, path)
    if not numbers:
        raise FileNotFoundError(f"no version of a panel in {path}")
    number = numbers[-1] if number is None else number
    stream = _files(spark, path).open(_path(spark, f"{path}/manifest/v{number:08d}.json"))
    try:
        m = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Version(m["number"], m["buckets"], m["schema"], tuple(Part(**p) for p in m["parts"]))


def commit(spark: SparkSession, path: str, new: Version) -> None:
    """Publish a version: a whole file, renamed to its number unless that is taken."""
    path = path.rstrip("/")
    fs = _files(spark, path)
    fs.mkdirs(_path(spark, f"{path}/manifest"))
    draft, final = _path(spark, f"{path}/manifest/.draft-{uuid.uuid4().hex}"), _path(spark, f"{path}/manifest/v{new.number:08d}.json")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps({**asdict(new), "parts": [asdict(p) for p in new.parts]}).encode()))
    finally:
        out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, final, plain)  # without overwriting
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {new.number} of {path} was written by another") from None
        raise


def _put(df: DataFrame, path: str, ax: Axis, buckets: int) -> list[Part]:
    """Write rows as folders of a new write; returns them with the days they span."""
    name = uuid.uuid4().hex
    cut = df.withColumns({"bucket": bucket_of(ax, buckets), "year": F.year(ax.ts)})
    cut.repartition("bucket", "year").write.partitionBy("bucket", "year").parquet(f"{path}/data/{name}")
    day = F.date_format
    found = df.sparkSession.read.parquet(f"{path}/data/{name}").groupBy("bucket", "year").agg(day(F.min(ax.ts), "yyyy-MM-dd").alias("lo"), day(F.max(ax.ts), "yyyy-MM-dd").alias("hi"), F.count(F.lit(1)).alias("rows"))
    return [Part(f"data/{name}/bucket={r.bucket}/year={r.year}", r.bucket, r.year, r.lo, r.hi, r.rows) for r in found.collect()]  # buckets times years at most


def create(df: DataFrame, path: str, ax: Axis, buckets: int = BUCKETS) -> Version:
    """The first version of a panel."""
    path = path.rstrip("/")
    new = Version(1, buckets, df.schema.json(), tuple(_put(df, path, ax, buckets)) if df.take(1) else ())
    commit(df.sparkSession, path, new)
    return new


def read_parts(spark: SparkSession, path: str, v: Version, parts: list[Part]) -> DataFrame:
    schema = StructType.fromJson(json.loads(v.schema))
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{p.folder}" for p in parts])


def read(spark: SparkSession, path: str, lo: str | None = None, hi: str | None = None, number: int | None = None) -> DataFrame:
    """A version's rows; of a range of days (dates as text) only the folders that reach into it are opened."""
    v = version(spark, path, number)
    return read_parts(spark, path, v, [p for p in v.parts if (lo is None or p.hi >= lo) and (hi is None or p.lo <= hi)])


def upsert(path: str, fresh: DataFrame, ax: Axis, values: list[str], tries: int = 5, before_commit=None) -> Version:
    """Merge fresh rows over the newest version, the fresh one winning; only the buckets and years that they fall
    into are read and written again. ``fresh`` has one row per series and day.

    Nothing is visible until the commit; whoever loses the race to it merges again over the winner's version.
    ``before_commit`` is called in between (tests)."""
    spark, path = fresh.sparkSession, path.rstrip("/")
    fresh = fresh.select(*ax.id_cols, *values)
    for _ in range(tries):
        v = version(spark, path)
        cells = fresh.select(bucket_of(ax, v.buckets).alias("b"), F.year(ax.ts).alias("y")).distinct().collect()  # buckets times years at most
        touched = {(r.b, r.y) for r in cells}
        if not touched:
            return v
        old = read_parts(spark, path, v, [p for p in v.parts if (p.bucket, p.year) in touched]).select(*ax.id_cols, *values)
        made = _put(merge_new_rows(old, fresh, ax, values), path, ax, v.buckets)
        new = Version(v.number + 1, v.buckets, v.schema, (*(p for p in v.parts if (p.bucket, p.year) not in touched), *made))
        if before_commit:
            before_commit()
        try:
            commit(spark, path, new)
            return new
        except Conflict:
            continue
    raise Conflict(f"{path}: lost the race {tries} times")


def clean_up(spark: SparkSession, path: str, keep: int = 2, older_than: float = 86_400.0) -> list[str]:
    """Delete manifests but the newest ``keep``, and writes that none of those names and that are ``older_than`` seconds
    old (a younger one may be about to be committed). Returns what went."""
    path = path.rstrip("/")
    fs, numbers = _files(spark, path), _numbers(spark, path)
    live = {p.folder.split("/")[1] for n in numbers[-keep:] for p in version(spark, path, n).parts}
    gone = []
    for n in numbers[:-keep]:
        fs.delete(_path(spark, f"{path}/manifest/v{n:08d}.json"), False)
        gone.append(f"v{n:08d}")
    for name in _names(spark, f"{path}/data"):
        where = _path(spark, f"{path}/data/{name}")
        if name not in live and time.time() - fs.getFileStatus(where).getModificationTime() / 1000 >= older_than:
            fs.delete(where, True)
            gone.append(name)
    return gone


def read_near(spark: SparkSession, path: str, since: DataFrame, ax: Axis, warmup_rows: int) -> DataFrame:
    """Rows of the series in ``since`` (keys, _since) from ``warmup_rows`` rows before their day on, with ``_since``.

    Only the buckets of those series are opened, from a year before their first change; further back, year by
    year fourfold, only while some series has fewer rows before its change than asked for and there are older files."""
    v = version(spark, path)
    first = {r.b: r.d for r in since.groupBy(bucket_of(ax, v.buckets).alias("b")).agg(F.min("_since").alias("d")).collect()}  # a row per bucket
    mine = [p for p in v.parts if p.bucket in first]
    n, years = since.count(), 1
    while True:
        near = [p for p in mine if dt.date.fromisoformat(p.hi) >= first[p.bucket] - dt.timedelta(days=366 * years)]
        rows = read_parts(spark, path, v, near).join(since, list(ax.keys))
        if len(near) == len(mine):
            return rows
        warm = rows.filter(F.col(ax.ts) < F.col("_since")).groupBy(*ax.keys).count().filter(F.col("count") >= warmup_rows).count()
        if warm >= n:
            return rows
        years *= 4
