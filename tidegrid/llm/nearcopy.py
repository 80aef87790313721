"""Near copies by word shingles: MinHash bands give candidates, exact Jaccard similarity decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import local_groups, meet, stage, words_of
from tidegrid.llm.graph import components

SHINGLE = 5
#: Similarity of 4 / 5 and more. A pair at that very edge shares no band with a chance of (1 - 0.8^4)^24 = 3e-6.
NUMER, DENOM = 4, 5
BANDS, IN_BAND = 24, 4
TILE_ROWS, TILE_BYTES = 4096, 8 << 20  # of one tile of a candidate group
REPS = 4  # groups of a tile that are tried by one member each before all of it
_CHUNK = 4096  # shingles that meet all minima at a time
_P = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(42)
_FLIP, _TIMES = _RNG.integers(0, 1 << 64, (2, BANDS * IN_BAND, 1), np.uint64)
_TIMES |= np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``shingle`` words; a shorter text is one run, one without words none."""
    w = np.array([xxhash.xxh64_intdigest(x, 42) for x in words_of(text)], np.uint64)
    if not len(w):
        return w
    size = min(shingle, len(w))
    n, g = len(w) - size + 1, np.uint64(0)
    for i in range(size):
        g = g * _P + w[i : i + n]
    return np.unique(_mix(g))


def _name(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64)) if len(own) else 0


def bands(own: np.ndarray) -> np.ndarray:
    """A hash for each band of minima: equal in two sets with the chance of their similarity to the fourth."""
    if not len(own):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * IN_BAND, np.iinfo(np.uint64).max)
    for lo in range(0, len(own), _CHUNK):
        np.minimum(low, ((own[lo : lo + _CHUNK] ^ _FLIP) * _TIMES).min(1), out=low)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for v in low.reshape(BANDS, IN_BAND).T:
        h = h * _P + v
    return _mix(h).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, sid, bands): the name of the set of shingles and its bands, for each row of docs."""

    def run(batches):
        for b in batches:
            own = [shingles(t) for t in b.column(1).to_pylist()]
            hs = [bands(s) for s in own]
            at = np.concatenate([[0], np.cumsum([len(h) for h in hs], dtype=np.int64)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *hs])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_name(s) for s in own], pa.int64()), lists], ["doc_id", "sid", "bands"])

    return _own(docs, id_col, text_col).mapInArrow(run, "doc_id long, sid long, bands array<long>")


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))


def candidates(distinct: DataFrame) -> DataFrame:
    """(node, root): groups of the sets that are joined by common bands. Each set is linked to the least one of each
    of its bands, so links grow with the sets and not with the pairs."""
    each = stage(distinct.select("sid", F.explode("bands").alias("band")), "bands")
    least = stage(each.groupBy("band").agg(F.min("sid").alias("least")), "least")
    near = each.join(least, "band").groupBy("sid").agg(F.collect_set(F.when(F.col("least") != F.col("sid"), F.col("least"))).alias("to"))
    return stage(components(near.select("sid", F.explode("to").alias("to")), "sid", "to"), "candidates")


def sets_of(docs: DataFrame, groups: DataFrame, distinct: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sid, root, own): the shingles of each candidate set, once, from one of its documents."""
    own = _own(docs, id_col, text_col)
    chosen = distinct.join(groups, F.col("sid") == F.col("node"), "left_semi").select(F.col("first_id").alias("doc_id")).distinct()
    few = own.join(chosen, "doc_id", "left_semi").unionByName(own.filter("doc_id is null"))

    def run(batches):
        for b in batches:
            for t in b.column(1).to_pylist():
                s = shingles(t)
                yield pa.RecordBatch.from_arrays([pa.array([_name(s)], pa.int64()), pa.array([s.tobytes()], pa.binary())], ["sid", "own"])

    sets = few.mapInArrow(run, "sid long, own binary").join(groups.withColumnRenamed("node", "sid"), "sid")
    return stage(sets.groupBy("sid").agg(F.first("root").alias("root"), F.first("own").alias("own")), "sets")


class _Tile:
    """Held sets by shingle, and which of them are linked so far."""

    def __init__(self, sid: np.ndarray, own: np.ndarray):
        self.sid, self.sets = sid, [np.frombuffer(x, np.uint64) for x in own]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        flat = np.concatenate(self.sets)
        order = np.argsort(flat, kind="stable")
        self.row = np.repeat(np.arange(len(sid)), self.size)[order]
        self.keys, self.start = np.unique(flat[order], return_index=True)
        self.end = np.append(self.start[1:], len(flat))
        self.root, self.reps = np.arange(len(sid)), None

    def like(self, s: np.ndarray) -> np.ndarray:
        """Held sets that are as similar to s as asked."""
        if self.reps is None:
            self.reps = np.unique(self.root)
        if len(self.reps) <= REPS:  # all of s's links follow where it matches one of each group
            if all(_alike(s, self.sets[r]) for r in self.reps):
                return self.reps
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        at = at[self.keys[at] == s]
        both = np.zeros(len(self.sid), np.int64)
        for lo in range(0, len(at), 1024):
            some = at[lo : lo + 1024]
            both += np.bincount(np.concatenate([self.row[a:b] for a, b in zip(self.start[some], self.end[some])]), minlength=len(both))
        hit = np.flatnonzero(DENOM * both >= NUMER * (self.size + len(s) - both))
        roots = np.unique(self.root[hit])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]
            self.reps = None
        return hit


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOM * both >= NUMER * (len(a) + len(b) - both)


def links(sets: DataFrame) -> DataFrame:
    """(a, b): links that join all sets of a candidate group whose Jaccard similarity is 0.8 or more, a forest per
    pair of tiles. Every pair of the group is compared; a tile has at most about 4096 sets or 8 MB of them."""
    size = sets.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum(F.octet_length("own")) / TILE_BYTES)).cast("int").alias("tiles"))
    dealt = sets.join(stage(size, "tiles"), "root").withColumn("tile", F.pmod(F.xxhash64("sid"), "tiles").cast("int"))
    places = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("tile")), lambda k: F.struct(F.lit(0).alias("role"), F.col("tile").alias("i"), k.alias("j"))),
        F.transform(F.sequence(F.col("tile"), F.col("tiles") - 1), lambda k: F.struct(F.lit(1).alias("role"), k.alias("i"), F.col("tile").alias("j"))),
    )
    rows = dealt.select("root", "sid", "own", F.explode(places).alias("at")).select(F.xxhash64("root", "at.i", "at.j").alias("key"), "at.role", "sid", "own")

    def compare(held, passing):
        tile = held.get("tile")
        if tile is None:
            tile = held["tile"] = _Tile(held["sid"], held["own"])
        a, b = [], []
        for sid, own in zip(passing["sid"], passing["own"]):
            hit = tile.like(np.frombuffer(own, np.uint64))
            a.append(np.full(len(hit), sid))
            b.append(tile.sid[hit])
            if sum(map(len, a)) > 1 << 20:
                yield from forest(a, b)
                a, b = [], []
        yield from forest(a, b)

    def forest(a, b):
        a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
        if (a != b).any():
            node, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = local_groups(idx[: len(a)], idx[len(a) :], len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], ["a", "b"])

    return meet(rows, "key", "role", compare, "a long, b long").filter("a <> b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id reachable over pairs whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more. One row per row of docs.

    Words are those of the contracts; texts without any are copies of each other. Rows with a null id are linked
    like any other but never name a component (null if no member has an id). No docs give no rows."""
    own = stage(signatures(docs, id_col, text_col), "signatures")
    distinct = stage(own.groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")), "distinct")
    sets = sets_of(docs, candidates(distinct), distinct, id_col, text_col)
    roots = components(links(sets), "a", "b")
    each = distinct.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), "first_id")
    each = stage(each, "members")
    named = stage(each.groupBy("root").agg(F.min("first_id").alias("component_id")), "components")
    found = stage(each.select("sid", "root").join(named, "root").select("sid", "component_id"), "found")
    return own.select("doc_id", "sid").join(found, "sid").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs whose id names their component: one document of each group; all rows with a null id stay."""
    keep = near_copies(docs, id_col, text_col).filter("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(keep, docs[id_col] == keep["__keep"], "left_semi").unionByName(docs.filter(docs[id_col].isNull()))
