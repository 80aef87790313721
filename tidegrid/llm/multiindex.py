"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import meet, stage

SAMPLE = 16_384  # vectors on which centroids and the candidate share are fitted, if 64 MB hold them; all are indexed
SAMPLE_BYTES = 64 << 20
CENTROIDS = (64, 1024)  # of each half, at least and at most: half the root of the distinct vectors, as a power of two
PROBES = 512  # sampled vectors that the candidate share is measured with
TARGET = 0.97  # recall on the sample that the share is set for
BLOCK = 4096  # indexed vectors per task unit
SALTS = 32


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct (vec_id, v) with an id and a vector that is not null, empty or zero and has finite components only,
    of the most frequent length (of two as frequent, the longer)."""
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = good.filter("vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    size = good.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return good.filter(F.size("v") == (size["d"] if size else 0)).distinct()


def groups(rows: DataFrame, keep: int) -> DataFrame:
    """(gid, v, ids): equal vectors once, with their ``keep`` smallest ids, which are all that a search can return.

    Ids are cut per vector and salt first, so a vector that a third of all rows have never meets in one task."""
    salted = F.row_number().over(Window.partitionBy("v", F.pmod("vec_id", F.lit(SALTS))).orderBy("vec_id"))
    every = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    cut = rows.withColumn("k", salted).filter(F.col("k") <= keep).withColumn("k", every).filter(F.col("k") <= keep)
    return cut.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("gid", F.monotonically_increasing_id())


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        for j in np.flatnonzero(n):
            c[j] = x[at == j].mean(0)
    return c


@dataclass
class Codebook:
    """Centroids of both halves and the share of all entries that a search collects."""

    first: np.ndarray
    second: np.ndarray
    share: float

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.first.shape[1]], x[:, self.first.shape[1] :]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return nearest(a, self.first) * len(self.second) + nearest(b, self.second)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(((h[:, None] - c) ** 2).sum(2) for h, c in zip(self.halves(x), (self.first, self.second)))


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
    """Cells in order of summed centroid distance until they hold ``want`` entries: a heap holds the next
    pair of each row reached so far."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, n2 = d1[o1].tolist(), d2[o2].tolist(), len(o2)
    o1, o2, heap, out, got, k2 = o1.tolist(), o2.tolist(), [(s1[0] + s2[0], 0, 0)], [], 0, len(d2)
    while heap and got < want:
        _, i, j = heapq.heappop(heap)
        cell = o1[i] * k2 + o2[j]
        if counts[cell]:
            out.append(cell)
            got += int(counts[cell])
        if j + 1 < n2:
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def centroids_for(n: int) -> int:
    """Centroids of each half for n distinct vectors, so that a cell holds some four of them until the most is reached:
    what a search walks through gets finer as the index grows."""
    least, most = CENTROIDS
    return min(most, max(least, 1 << round(np.log2(max(n, 1)) / 2 - 1)))


def fit(sample: np.ndarray, top: int, centroids: int = CENTROIDS[0], target: float = TARGET) -> Codebook:
    """Centroids by k-means; the share from where the true neighbours of sampled vectors lie in their traversals.

    Neighbours within a sample are farther off than those among all vectors, so the share errs upwards."""
    x = unit(sample)
    half = max(1, x.shape[1] // 2)
    a, b = x[:, :half], x[:, half:]
    if not b.shape[1]:
        b = np.zeros((len(x), 0))
    book = Codebook(kmeans(a, centroids), kmeans(b, centroids) if b.shape[1] else np.zeros((1, 0)), 1.0)
    cell = book.cells(x)
    counts = np.bincount(cell, minlength=len(book.first) * len(book.second))
    needed = []
    for lo in range(0, min(PROBES, len(x)), 64):
        q = x[lo : min(lo + 64, PROBES)]
        s = q @ x.T
        s[np.arange(len(q)), lo + np.arange(len(q))] = -2
        best = np.argsort(-s, axis=1)[:, :top]
        for i, (d1, d2) in enumerate(zip(*book.distances(q))):
            order = np.argsort((d1[:, None] + d2).ravel(), kind="stable")
            upto = np.empty(len(order), np.int64)
            upto[order] = np.cumsum(counts[order])
            needed += upto[cell[best[i]]].tolist()
    book.share = float(np.quantile(needed, target)) / len(x) if needed else 1.0
    return book


def search(rows: DataFrame, queries: str, top: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", centroids: int | None = None, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that meet the SQL condition ``queries`` on vec_id, the
    ``top`` largest cosines found among all rows of other ids, ties to the smaller id.

    Every usable vector is indexed under the nearest centroids of its two halves. A query walks the cells
    by summed centroid distance until they hold the fitted share of all entries; those are reranked by
    cosine in double precision. Vectors that are null, zero or hold null or non-finite components take no
    part, nor do null ids; rows that are equal count once. Fewer candidates give fewer rows, none give none."""
    spark = rows.sparkSession
    good = stage(usable(rows, id_col, vec_col), "vectors")
    all_ = stage(groups(good, top + 1), "groups")
    distinct, width = all_.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not distinct:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    picked = all_.orderBy(F.xxhash64("v"), "gid").limit(some).select("v").toArrow().column("v")  # bounded, and the same in every run
    book = fit(np.array(picked.to_pylist(), np.float64), top, centroids or centroids_for(distinct), target)

    def index(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64)
            cell = book.cells(unit(x)) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], ["gid", "v", "ids", "cell"])

    entries = stage(all_.select("gid", "v", "ids").mapInArrow(index, "gid long, v array<double>, ids array<long>, cell int"), "index")
    counts = np.zeros(len(book.first) * len(book.second), np.int64)  # bounded: a count per cell
    for r in entries.groupBy("cell").count().collect():
        counts[r[0]] = r[1]
    parts = np.maximum(1, -(-counts // BLOCK))  # a crowded cell has blocks of its own, small ones share
    first, at, fill = np.zeros_like(counts), 0, 0
    for c, (n, k) in enumerate(zip(counts, parts)):
        if k > 1 or fill + n > BLOCK:
            at, fill = at + (fill > 0), 0
        first[c] = at
        at, fill = (at + k, 0) if k > 1 else (at, fill + n)
    want = max(10 * top, int(np.ceil(book.share * counts.sum())))
    sent = spark.sparkContext.broadcast((book, counts, parts, first))  # bounded by the cells

    def deal(batches):
        book, counts, parts, first = sent.value
        for b in batches:
            gid, v, cell, asks = (b.column(b.schema.get_field_index(c)) for c in ("gid", "v", "cell", "asks"))
            g, c = gid.to_numpy(), cell.to_numpy()
            if not len(g):
                continue
            block = first[c] + g % parts[c]
            yield batch(block, 0, b, np.arange(len(g)), [None] * len(g))
            who = np.flatnonzero(asks.to_numpy(zero_copy_only=False))
            if not len(who):
                continue
            x = unit(np.array([v[int(i)].as_py() for i in who], np.float64))
            blocks, owner, walks = [], [], []
            for i, d1, d2 in zip(who, *book.distances(x)):
                cells = np.sort(np.array(traverse(d1, d2, counts, want), np.int64))  # blocks rise with cells
                to = np.repeat(first[cells], parts[cells]) + np.arange(parts[cells].sum()) - np.repeat(np.cumsum(parts[cells]) - parts[cells], parts[cells])
                held = np.repeat(cells, parts[cells]).astype("<i4")
                cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                blocks.append(to[cut])
                owner.append(np.full(len(cut), i))
                walks += [held[a:z].tobytes() for a, z in zip(cut, np.append(cut[1:], len(held)))]  # the walk's cells in each block
            yield batch(np.concatenate(blocks), 1, b, np.concatenate(owner), walks)

    def batch(block, role, b, who, walks):
        take = pa.array(who)
        cols = [b.column(b.schema.get_field_index(c)).take(take) for c in ("gid", "v", "ids", "cell")]
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(np.full(len(who), role, np.int32)), *cols, pa.array(walks, pa.binary())], ["block", "role", "gid", "v", "ids", "cell", "walk"])

    def rerank(held, passing):
        x = held.get("x")
        if x is None:
            x = held["x"] = unit(np.array(held["v"].tolist(), np.float64))
            held["lead"] = np.array([i[0] for i in held["ids"]])
            held["cells"], held["at"] = np.unique(held["cell"], return_inverse=True)
        for lo in range(0, len(passing["gid"]), 256):
            q = unit(np.array(passing["v"][lo : lo + 256].tolist(), np.float64))
            seen = np.stack([np.isin(held["cells"], np.frombuffer(w, "<i4")) for w in passing["walk"][lo : lo + 256]])
            s = np.where(seen[:, held["at"]], q @ x.T, -np.inf)
            gids, ids, scores = [], [], []
            for i, row in enumerate(s):
                cut = np.partition(row, -(top + 1))[-(top + 1)] if len(row) > top + 1 else -np.inf
                near = np.flatnonzero((row >= cut) & (row > -np.inf))
                for j in near[np.lexsort((held["lead"][near], -row[near]))][: top + 1]:
                    gids.append(passing["gid"][lo + i])
                    ids.append(held["ids"][j])
                    scores.append(row[j])
            if gids:
                yield pa.RecordBatch.from_arrays([pa.array(gids, pa.int64()), pa.array(scores, pa.float64()), pa.array([list(i) for i in ids], pa.list_(pa.int64()))], ["gid", "score", "ids"])

    asking = good.filter(queries).withColumnRenamed("vec_id", "query_id").join(all_.select("v", "gid"), "v").select("query_id", "gid")
    asked = entries.join(asking.select("gid", F.lit(True).alias("asks")).distinct(), "gid", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    dealt = asked.mapInArrow(deal, "block long, role int, gid long, v array<double>, ids array<long>, cell int, walk binary")
    found = meet(dealt, "block", "role", rerank, "gid long, score double, ids array<long>").select("gid", "score", F.explode("ids").alias("vec_id"))
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("gid").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("k") <= top + 1)
    lists = best.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("k", "vec_id", "score"))).alias("near"))
    mine = asking.join(lists, "gid").select("query_id", F.expr(f"slice(filter(near, x -> x.vec_id <> query_id), 1, {top})").alias("near"))
    return mine.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
