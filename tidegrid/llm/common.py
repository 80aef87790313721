"""Shared scratch tables, safe column access and blocked meeting of rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The blanks of the contracts, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OWN: dict[str, str] = {}  # application id -> folder, in local mode only


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of its own only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tidegrid-llm-")
    return "file://" + _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidegrid-llm/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; pure ASCII takes the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of the contracts; bytes methods lower A-Z and split at the six ASCII blanks only."""
    return text.lower().split() if text else []


def id_crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def local_groups(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b, by label propagation with jumping."""
    lab = np.arange(n)
    while True:
        m = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, lab[a], m)
        np.minimum.at(new, lab[b], m)
        new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def meet(rows: DataFrame, key: str, role: str, fn: Callable, schema: str, flush: Callable | None = None) -> DataFrame:
    """Deal rows by ``key``; within a key, rows of role 0 come first and are held, all others are passed
    by in batches: ``fn(held, passing)`` gets dicts of numpy columns and yields record batches. Integer nulls are 0;
    passing columns have a mask ``<name>_null`` for them.

    Only the held rows of one key and one Arrow batch are in memory, so callers bound what they give
    role 0 under one key; passing rows have no bound."""
    names = [c for c in rows.columns if c not in (key, role)]

    def column(batch: pa.RecordBatch, name: str):
        a = batch.column(batch.schema.get_field_index(name))
        if pa.types.is_integer(a.type):
            return (a.fill_null(0) if a.null_count else a).to_numpy()
        if pa.types.is_floating(a.type):
            return a.to_numpy(zero_copy_only=False)
        return np.array(a.to_pylist() + [None], dtype=object)[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: column(batch, n) for n in names}
            nulls = {f"{n}_null": batch.column(batch.schema.get_field_index(n)).is_null().to_numpy(zero_copy_only=False) for n in names if pa.types.is_integer(batch.schema.field(n).type)}
            k, r = column(batch, key), column(batch, role)
            cut = np.flatnonzero((k[1:] != k[:-1]) | (r[1:] != r[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(k)]):
                if at is None or k[lo] != at:
                    at, parts, held = k[lo], [], None
                piece = {n: c[lo:hi] for n, c in cols.items()}
                if r[lo] == 0:
                    parts.append(piece)
                    continue
                if held is None:
                    held = {n: np.concatenate([p[n] for p in parts]) if parts else None for n in names}
                    parts = []
                if held[names[0]] is not None:
                    yield from fn(held, piece | {n: c[lo:hi] for n, c in nulls.items()})
        if flush is not None:
            yield from flush()

    return rows.repartition(key).sortWithinPartitions(key, role).mapInArrow(run, schema)
