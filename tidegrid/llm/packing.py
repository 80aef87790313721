"""Best-fit packing by minimum bin slack."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import stage
from tidegrid.llm.tokens import encoder, texts_of

_PIECE = "uid long, blk int, nth long, doc_id long, piece int, start long, length int, ids_crc32 long, ids binary"


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document's ids (with the end id): documents longer than ``capacity`` are cut.

    ``ids`` are little-endian 16-bit (32-bit where the vocabulary needs it); ``nth`` counts the pieces of a
    length within the task's block ``blk``. Staged, because the counts must not change. A null text is empty."""

    def run(batches):
        blk, seen, uid = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), 0
        coder, end = encoder(tokenizer, False), np.array([end_id], "<u4").tobytes()
        kind = "<u2" if coder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for b in batches:
            rows, size = [], 0
            for doc, got in zip(b.column(0).to_pylist(), coder.encode(texts_of(b.column(1)))):
                raw = got + end
                for piece, lo in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[lo : lo + 4 * capacity]
                    n = len(part) // 4
                    rows.append((blk << 33 | uid, blk, int(seen[n]), doc, piece, lo // 4, n, zlib.crc32(part), np.frombuffer(part, "<u4").astype(kind).tobytes()))
                    seen[n] += 1
                    uid += 1
                    size += len(part)
                if size > 8 << 20:
                    yield batch(rows)
                    rows, size = [], 0
            yield batch(rows)

    def batch(rows):
        cols = list(zip(*rows)) or [()] * len(shape)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, shape)], schema=shape)

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    shape = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in _PIECE.split(", "))])
    own = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return stage(own.mapInArrow(run, _PIECE), "pieces")


@dataclass
class Plan:
    """Where the pieces of each length go: ranks lo.. of ``length`` fill ``per`` places in each sequence
    from ``seq`` on, the first at ``offset``. At most a few ranges per combination, whatever the corpus."""

    length: np.ndarray
    lo: np.ndarray
    seq: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    sequences: int


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum within ``room``, by subset sums in a bitset."""
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in sorted(counts, reverse=True):
        left, k = min(counts[n], room // n), 1
        while left > 0:  # 1, 2, 4.. copies at a time give every number of copies
            k = min(k, left)
            steps.append((n, k, reach))
            reach = (reach | reach << (n * k)) & full
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            out[n] = out.get(n, 0) + k
            at -= n * k
    return out


def plan(counts: dict[int, int], capacity: int = 2048) -> Plan:
    """Minimum bin slack over the number of pieces of each length.

    Each bin takes the longest piece left and the fullest combination beside it; the same combination is
    taken again as long as it is available, which is what packing bin by bin would find. The driver sees
    at most ``capacity`` counts."""
    left = {n: c for n, c in counts.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    rows, seq = [], 0
    while left:
        top = max(left)
        rest = {n: c - (n == top) for n, c in left.items() if n <= capacity - top and c > (n == top)}
        combo = {top: 1}
        for n, k in fullest(rest, capacity - top).items():
            combo[n] = combo.get(n, 0) + k
        times, offset = min(left[n] // k for n, k in combo.items()), 0
        for n, k in sorted(combo.items(), reverse=True):
            rows.append((n, taken[n], seq, k, offset))
            offset += n * k
            taken[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
        seq += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*cols, sequences=seq)


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset.

    A piece's rank among those of its length is its count within its block plus the earlier blocks'
    counts; the rank finds its place in the plan. No rank is taken over rows, so a length that a third of
    all pieces have costs no more than any other."""
    spark = pieces.sparkSession
    tally = stage(pieces.groupBy("length", "blk").agg(F.count(F.lit(1)).alias("n")), "tally")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = F.sum("n").over(Window.partitionBy("length").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))
    base = tally.withColumn("base", F.coalesce(before, F.lit(0))).select("length", "blk", "base")
    found = plan(counts, capacity)
    sent = spark.sparkContext.broadcast(found)  # bounded by the capacity

    def run(batches):
        p = sent.value
        keys = (p.length << 44) + p.lo
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length.astype(np.int64) << 44) + rank, side="right") - 1
            nth = rank - p.lo[at]
            seq, offset = p.seq[at] + nth // p.per[at], p.offset[at] + nth % p.per[at] * length
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(seq, pa.int64()), pa.array(offset.astype(np.int32))], [*keep, "sequence_id", "offset"])

    ranked = pieces.join(base, ["length", "blk"]).withColumn("rank", F.col("nth") + F.col("base")).drop("base")
    kinds = ", ".join(f"{n} {t}" for n, t in ranked.drop("rank").dtypes)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset int")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): each sequence's ids in order; placed must hold ``ids``."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return placed.groupBy("sequence_id").agg(inside.alias("p")).select("sequence_id", F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> a || x)").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def digest(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece. No docs give no rows."""
    pieces = encode_pieces(docs, tokenizer, end_id, capacity, id_col, text_col)
    placed = place(pieces.select("blk", "nth", "doc_id", "piece", "start", "length", "ids_crc32"), capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
