"""Correlation of many columns at once, and greedy pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TILE = 64  # columns of a tile
SALTS = 32  # first-level sums of a tile


def _tiles(n: int) -> list[tuple[int, int]]:
    k = -(-n // TILE)
    return [(i, j) for i in range(k) for j in range(i, k)]


def gram_tiles(df: DataFrame, cols: list[str], shift: dict[str, float]) -> DataFrame:
    """(i, j, sums): for each pair of column tiles i <= j, six matrices of sums over rows where both columns are present,
    as one binary: count, x*y, x, y, x*x and y*y of the shifted values.

    A task folds all its rows by matrix products and gives a row per pair of tiles, not per pair of columns; those are
    added up as matrices in two levels, each holding one pair at a time."""
    n, tiles = len(cols), _tiles(len(cols))
    away = np.array([shift[c] for c in cols])
    cut = [slice(k * TILE, min(n, (k + 1) * TILE)) for k in range(-(-n // TILE))]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, xy, x1, x2 = (np.zeros((n, n)) for _ in range(4))
        for b in batches:
            x = np.column_stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(n)]) - away
            ok = np.isfinite(x)
            m, z = ok.astype(float), np.where(ok, x, 0.0)
            count += m.T @ m
            xy += z.T @ z
            x1 += z.T @ m
            x2 += (z * z).T @ m
        task = TaskContext.get().partitionId() % SALTS
        rows = [np.stack([count[cut[i], cut[j]], xy[cut[i], cut[j]], x1[cut[i], cut[j]], x1[cut[j], cut[i]].T, x2[cut[i], cut[j]], x2[cut[j], cut[i]].T]).tobytes() for i, j in tiles]
        yield pa.RecordBatch.from_pydict({"i": [t[0] for t in tiles], "j": [t[1] for t in tiles], "salt": [task] * len(tiles), "sums": rows}, schema=shape)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in batches:
            for r in range(b.num_rows):
                key = tuple(b.column(k)[r].as_py() for k in range(3))
                part = np.frombuffer(b.column(3)[r].as_buffer())
                if key != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(("i", "j", "salt", "sums"), (*at, total.tobytes())))], schema=shape)
                    at, total = key, part.copy()
                else:
                    total += part
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("i", "j", "salt", "sums"), (*at, total.tobytes())))], schema=shape)

    shape = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("salt", pa.int32()), ("sums", pa.binary())])
    kind = "i int, j int, salt int, sums binary"
    parts = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInArrow(fold, kind)
    some = parts.repartition("i", "j", "salt").sortWithinPartitions("i", "j", "salt").mapInArrow(add, kind)
    whole = some.withColumn("salt", F.lit(0)).repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(add, kind)
    return whole.drop("salt")


def pairwise_correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Absolute Pearson correlation of every pair ``a < b`` over rows where both are present (null without spread).

    One pass finds column means, a second the tiles of ``gram_tiles``; pairs are made from the summed tiles."""
    cols = sorted(cols)
    centre = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    shift = {c: centre[c] if centre[c] is not None and math.isfinite(centre[c]) else 0.0 for c in cols}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                left, right = cols[i * TILE : (i + 1) * TILE], cols[j * TILE : (j + 1) * TILE]
                n, xy, x, y, xx, yy = np.frombuffer(raw.as_buffer()).reshape(6, len(left), len(right))
                with np.errstate(divide="ignore", invalid="ignore"):
                    cov = xy - x * y / n
                    scale = np.sqrt(np.maximum(xx - x * x / n, 0) * np.maximum(yy - y * y / n, 0))
                    corr = np.where((n > 1) & (scale > 0), np.abs(cov / scale), np.nan)
                p, q = np.triu_indices(len(left), 1) if i == j else (k.ravel() for k in np.indices((len(left), len(right))))
                c = corr[p, q]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(left, object)[p], pa.string()), pa.array(np.array(right, object)[q], pa.string()), pa.array(c, mask=np.isnan(c)), pa.array(n[p, q].astype(np.int64))],
                    ["a", "b", "corr", "n"],
                )

    return gram_tiles(df, cols, shift).mapInArrow(pairs, "a string, b string, corr double, n long")


def prune_correlated(pairs: list[tuple[str, str, float]], importance: dict[str, float], threshold: float) -> set[str]:
    """Names to drop: strongest pairs first, the less important of a pair goes (name breaks ties).

    The pairs come from at most a few dozen candidate columns, never from rows."""
    dropped: set[str] = set()
    strong = sorted((p for p in pairs if p[2] is not None and p[2] > threshold), key=lambda p: (-p[2], p[0], p[1]))
    for a, b, _ in strong:
        if a in dropped or b in dropped:
            continue
        by_name = sorted((a, b), reverse=True)  # stable: on equal importance the later name goes
        dropped.add(sorted(by_name, key=importance.get)[0])
    return dropped
