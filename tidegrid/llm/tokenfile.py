"""Token files of directly addressable codes."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import fresh_path, stage
from tidegrid.llm.tokens import encoder, texts_of

MAGIC = b"TGDAC1\0\0"
BITS = 8  # of an id in each level
BLOCK = 512  # codes of a rank directory entry
LEVELS = 4  # 32-bit ids at most
SHARD = 4 << 20  # tokens from which a file is closed
_HEAD = struct.Struct("<8sQQI4x")
_LEVEL = struct.Struct("<QQQQ")  # codes, and where codes, continuation bits and rank directory begin


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """A file's bytes: the documents' ids and token offsets, then for each level the low 8 bits of what is
    left of each id, a bitmap of the ids that go on, and their number before every 512th code.

    The rest of an id that goes on stands in the next level at that rank, so any token can be read alone."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    body = [known.tobytes(), b"\0" * (-len(known) % 8), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()]
    rest, levels, at = ids.astype(np.uint32), [], _HEAD.size + LEVELS * _LEVEL.size + sum(map(len, body))
    for _ in range(LEVELS):
        more = rest > 0xFF
        ones = np.concatenate([np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else [], [0]]).astype("<u8")
        parts = [(rest & 0xFF).astype(np.uint8).tobytes(), np.packbits(more, bitorder="little").tobytes(), (np.cumsum(ones) - ones).astype("<u8").tobytes()]
        where = [at, at + len(parts[0]), at + len(parts[0]) + len(parts[1])]
        levels.append(_LEVEL.pack(len(rest), *where))
        body += parts
        at += sum(map(len, parts))
        rest = rest[more] >> BITS
    return b"".join([_HEAD.pack(MAGIC, len(ids), len(doc_ids), LEVELS), *levels, *body])


class TokenFile:
    """Reads a file through ``read_at(size, offset)``; only the bytes that a call needs are read."""

    def __init__(self, read_at):
        self.read_at = lambda n, at: read_at(n, at) if n else b""
        head = self.read_at(_HEAD.size + LEVELS * _LEVEL.size, 0)
        magic, self.n_tokens, self.n_docs, levels = _HEAD.unpack_from(head)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.levels = [_LEVEL.unpack_from(head, _HEAD.size + k * _LEVEL.size) for k in range(levels)]

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The documents' ids and where each begins, and the end."""
        at = _HEAD.size + LEVELS * _LEVEL.size
        known = np.frombuffer(self.read_at(self.n_docs, at), np.uint8)
        at += self.n_docs + -self.n_docs % 8
        ids = np.frombuffer(self.read_at(8 * self.n_docs, at), "<i8")
        starts = np.frombuffer(self.read_at(8 * (self.n_docs + 1), at + 8 * self.n_docs), "<u8").astype(np.int64)
        return [int(i) if k else None for i, k in zip(ids, known)], starts

    def _rank(self, level: int, i: int) -> int:
        """Ids before code i that go on."""
        _, _, bits, ranks = self.levels[level]
        block = i // BLOCK
        before = int(np.frombuffer(self.read_at(8, ranks + 8 * block), "<u8")[0])
        part = np.frombuffer(self.read_at((i - block * BLOCK + 7) // 8, bits + block * BLOCK // 8), np.uint8)
        return before + int(np.unpackbits(part, bitorder="little")[: i - block * BLOCK].sum())

    def tokens(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids of the tokens lo to hi; what goes on lies side by side in the next level too."""
        return self._codes(0, lo, self.n_tokens if hi is None else hi)

    def token(self, i: int) -> int:
        return int(self.tokens(i, i + 1)[0])

    def _codes(self, level: int, lo: int, hi: int) -> np.ndarray:
        n, codes, bits, _ = self.levels[level]
        if not 0 <= lo <= hi <= n:
            raise IndexError((lo, hi, n))
        out = np.frombuffer(self.read_at(hi - lo, codes + lo), np.uint8).astype("<u4")
        first = lo // 8
        more = np.unpackbits(np.frombuffer(self.read_at((hi + 7) // 8 - first, bits + first), np.uint8), bitorder="little")[lo - 8 * first : hi - 8 * first].astype(bool)
        if more.any():
            r = self._rank(level, lo)
            out[more] |= self._codes(level + 1, r, r + int(more.sum())) << BITS
        return out


def open_file(path: str) -> TokenFile:
    """A file in any store that pyarrow reaches (file, hdfs, s3, gs URIs)."""
    store, at = fs.FileSystem.from_uri(path)
    return TokenFile(store.open_input_file(at).read_at)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write token files under ``path`` in ascending id order; returns the manifest
    (part, nth, file, n_docs, n_tokens), staged.

    Documents are range-partitioned and sorted by id (nulls first; rows that repeat an id by text hash).
    A file's name has the attempt in it and only what a finished task reports is in the manifest, so a
    task that runs twice leaves nothing wrong. A null text is an empty one: the end id alone."""

    def run(batches):
        part, nth, ids, names, sizes, n = TaskContext.get().partitionId(), 0, [], [], [], 0
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        coder, end = encoder(tokenizer, True), np.array([end_id], "<u4").tobytes()

        def close():
            name = f"part-{part:06d}-{nth:05d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(pack(np.frombuffer(b"".join(ids), "<u4"), names, np.array(sizes, np.int64)))
            return pa.RecordBatch.from_pylist([{"part": part, "nth": nth, "file": f"{path}/{name}", "n_docs": len(names), "n_tokens": n}], schema=shape)

        for b in batches:
            for doc, got in zip(b.column(0).to_pylist(), coder.encode(texts_of(b.column(1)))):
                ids += [got, end]
                names.append(doc)
                sizes.append(len(got) // 4 + 1)
                n += sizes[-1]
                if n >= SHARD:
                    yield close()
                    nth, ids, names, sizes, n = nth + 1, [], [], [], 0
        if names:
            yield close()

    shape = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    own = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    ordered = own.repartitionByRange("i").sortWithinPartitions("i", F.xxhash64("t"))
    return stage(ordered.mapInArrow(run, "part int, nth int, file string, n_docs long, n_tokens long"), "token_files")


def with_starts(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: tokens in all files before. Only one sum per partition is collected."""
    total, before = 0, []
    for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        before.append((r["part"], total))
        total += r["n"]
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("own", own).join(spark.createDataFrame(before, "part int, before long"), "part").select("part", "nth", "file", "n_docs", "n_tokens", (F.col("before") + F.col("own")).alias("start"))


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of a manifest with starts, one task per file or so."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = open_file(file)
                docs, starts = f.documents()
                ids = f.tokens()
                crc = [zlib.crc32(ids[lo:hi].tobytes()) for lo, hi in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.select("file", "start").repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the documents' token files in the shared folder and read every document back from them."""
    spark = docs.sparkSession
    return read_documents(with_starts(spark, write_tokens(docs, tokenizer, end_id, fresh_path(spark, "tokens"))))
