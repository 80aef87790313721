"""Scoring with a hashed maximum-entropy language model."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import meet, stage

GROUPS = 16  # classes of frequent tokens
TAILS = 15  # classes of the other training tokens, by ending; one more class holds unknown tokens
CLASSES = GROUPS + TAILS + 1
#: Codes are 16 bits: frequent tokens have 0.., the others, told apart by a hash as contexts, what lies between.
UNKNOWN, START = 0xFFFE, 0xFFFF  # of unknown tokens, and before a text
ROUNDS = 2
PULL = 2.0  # expected count that a weight is drawn to 0 with
STEP_CLASS, STEP_WORD, CLIP = 0.4, 1.0, 3.0
BLOCK_BYTES = 16 << 20  # text of a vocabulary block
ADD = 0.1  # fixed value of the contract
_ROWS = 64  # gradient rows sent together
_TOKENS = 1 << 15  # tokens scored at a time
_CELLS = 1 << 20  # numbers added at a time


def to_planes(numbers: np.ndarray) -> bytes:
    """24-bit numbers as a plane of low halves and one of high bytes, which is mostly zeros and packs well."""
    return (numbers & 0xFFFF).astype("<u2").tobytes() + (numbers >> 16).astype(np.uint8).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    n = len(raw) // 3
    return np.frombuffer(raw, "<u2", n).astype(np.int32) | np.frombuffer(raw, np.uint8, n, 2 * n).astype(np.int32) << 16


def vocabulary_blocks(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    """Staged rows of two kinds: role 0 is a distinct word of a block (its number there, 96 bits of its hash, ending,
    training count), role 1 a document (its word numbers). A block is up to 16 MB of one task's text, so
    memory is bounded whatever the corpus's vocabulary."""

    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        words, rows, size = defaultdict(itertools.count().__next__), [], 0
        for b in batches:
            ids, out = b.column(0).to_pylist(), b.column(1).to_pylist()
            for doc, hold, text in zip(ids, out, b.column(2)):
                raw = text.as_py() or b""
                rows.append((doc, hold, np.array(list(map(words.__getitem__, raw.lower().split())), np.int32)))
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield from close(part << 24 | nth, words, rows)
                    nth, words, rows, size = nth + 1, defaultdict(itertools.count().__next__), [], 0
        if rows:
            yield from close(part << 24 | nth, words, rows)

    def close(blk, words, rows):
        n = len(words)
        train = [t for _, hold, t in rows if not hold]
        count = np.bincount(np.concatenate(train), minlength=n) if train else np.zeros(n, np.int64)
        half = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">i8").reshape(-1, 2).astype(np.int64) if n else np.zeros((0, 2), np.int64)
        ending = np.array([zlib.crc32(w[-3:]) % TAILS for w in words], np.int32)
        yield batch(blk, 0, n, idx=np.arange(n, dtype=np.int32), h1=half[:, 0], h2=half[:, 1].astype(np.int32), ending=ending, n=count.astype(np.int64))
        for lo in range(0, len(rows), 2000):
            some = rows[lo : lo + 2000]
            yield batch(blk, 1, len(some), doc_id=pa.array([r[0] for r in some], pa.int64()), held=pa.array([r[1] for r in some], pa.bool_()), toks=pa.array([to_planes(r[2]) for r in some], pa.binary()))

    def batch(blk, role, size, **cols):
        fixed = {"blk": np.full(size, blk, np.int64), "role": np.full(size, role, np.int32)}
        arrays = [pa.array(fixed[f.name]) if f.name in fixed else pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(size, f.type) for f in shape]
        return pa.RecordBatch.from_arrays(arrays, schema=shape)

    shape = pa.schema([("blk", pa.int64()), ("role", pa.int32()), ("idx", pa.int32()), ("h1", pa.int64()), ("h2", pa.int32()), ("ending", pa.int32()), ("n", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("toks", pa.binary())])
    own = docs.select(F.col(id_col).cast("long").alias("i"), held.alias("h"), F.col(text_col).cast("binary").alias("t"))
    return stage(own.mapInArrow(run, "blk long, role int, idx int, h1 long, h2 int, ending int, n long, doc_id long, held boolean, toks binary"), "blocks")


@dataclass(frozen=True)
class Sizes:
    """How large the model is: it grows with what the corpus holds, as the root of its distinct and of all its tokens."""

    words: int  # frequent tokens in each class
    class_rows: int  # hashed context features of the class softmax
    word_rows: int  # those of a class's words

    @property
    def frequent(self) -> int:
        return GROUPS * self.words

    @property
    def hashes(self) -> int:
        """Codes of each tail class, by hash of the word."""
        return (UNKNOWN - self.frequent) // TAILS

    def class_of(self, codes: np.ndarray) -> np.ndarray:
        c = codes.astype(np.int64)
        return np.where(c < self.frequent, c // self.words, np.where(c >= UNKNOWN, CLASSES - 1, GROUPS + (c - self.frequent) % TAILS))


def sizes_for(tokens: int, distinct: int) -> Sizes:
    """In a class, a thirty-second to a sixteenth of the root of the distinct tokens (32 to 2,048). As rows of the class softmax some
    16 times the root of all tokens up to 2^15, and from there on 1.3 to 2.6 times the root (up to 2^19); half as
    many weights for words. A task holds them and their sums: 6 MB of weights for 10^8 tokens, 100 MB from 10^11 on."""
    power = lambda x, lo, hi: 1 << min(hi, max(lo, math.ceil(math.log2(max(x, 1)))))
    words = power(math.sqrt(distinct) / 32, 5, 11)
    rows = max(power(max(min(16 * math.sqrt(tokens), 1 << 15), 1.3 * math.sqrt(tokens)), 14, 19), 8 * GROUPS * words)
    return Sizes(words, rows, max(64 * GROUPS, rows * CLASSES // 2 // words))


@dataclass
class Vocabulary:
    """Counts that every task needs: bounded by the number of classes and frequent tokens."""

    tokens: int  # N
    distinct: int  # V
    ends: int  # training documents
    end_code: int
    word_mass: np.ndarray  # of the frequent tokens, GROUPS x words
    tail_mass: np.ndarray
    sizes: Sizes

    def class_bias(self) -> np.ndarray:
        mass = np.concatenate([self.word_mass.sum(1), self.tail_mass, [ADD]])
        return np.log(np.maximum(mass, 1e-12) / mass.sum()).astype(np.float32)

    def word_bias(self) -> np.ndarray:
        m = np.maximum(self.word_mass, 1e-12)
        return np.log(m / m.sum(1, keepdims=True)).astype(np.float32)

    def per_token(self) -> float:
        return float(np.log10(self.tokens + ADD * (self.distinct + 1)))


def count_words(blocks: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """Training counts of every word (h1, h2, c, code), and the vocabulary. Only totals and the frequent
    tokens come to the driver: 32,767 at most."""
    seen = blocks.filter("role = 0 and n > 0").groupBy("h1", "h2").agg(F.sum("n").alias("c"), F.min("ending").alias("ending"))
    seen = stage(seen, "counts")
    ends = blocks.filter("role = 1 and not held").count()
    total, distinct = seen.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    sizes = sizes_for(total + ends, distinct + 1)
    frequent = sizes.frequent
    top = [(r["c"], r["h1"], r["h2"]) for r in seen.orderBy(F.col("c").desc(), "h1", "h2").limit(frequent - 1).collect()]
    ranked = sorted([*top, *([(ends, None, None)] if ends else [])], key=lambda r: -r[0])
    mass, end_code = np.zeros(frequent), UNKNOWN
    mass[: len(ranked)] = [r[0] + ADD for r in ranked]
    codes = []
    for k, (_, a, b) in enumerate(ranked):
        if a is None:
            end_code = k
        else:
            codes.append((a, b, k))
    table = blocks.sparkSession.createDataFrame(codes, "h1 long, h2 int, k int")
    other = F.col("ending") + frequent + TAILS * F.pmod("h1", F.lit(sizes.hashes)).cast("int")
    coded = seen.join(F.broadcast(table), ["h1", "h2"], "left").select("h1", "h2", "c", F.coalesce("k", other).alias("code"), F.col("k").isNull().alias("rare"), "ending")  # at most 32,767 rows
    tails = np.zeros(TAILS)
    for r in coded.filter("rare").groupBy("ending").agg(F.sum(F.col("c") + ADD).alias("m")).collect():
        tails[r["ending"]] = r["m"]
    return coded.drop("rare", "ending"), Vocabulary(total + ends, distinct + (ends > 0), ends, end_code, mass.reshape(GROUPS, sizes.words), tails, sizes)


def encode(blocks: DataFrame, coded: DataFrame, vocab: Vocabulary) -> DataFrame:
    """One staged row per document: doc_id, held, n_tokens, n_known, base_score, tail (log10 probability of its
    tail tokens within their classes) and codes. Each block's words meet the counts, then its documents."""
    words = blocks.filter("role = 0").select("blk", "idx", "h1", "h2").join(coded, ["h1", "h2"], "left")
    held = words.select("blk", F.lit(0).alias("role"), "idx", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("code", F.lit(UNKNOWN)).alias("code"), *(F.lit(None).cast(t).alias(n) for n, t in (("doc_id", "long"), ("held", "boolean"), ("toks", "binary"))))
    passing = blocks.filter("role = 1").select("blk", "role", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("int").alias("code"), "doc_id", "held", "toks")
    rows = held.unionByName(passing)
    none = blocks.filter("role = 1 and octet_length(toks) = 0").select("doc_id", "held")  # no words: they may be a block without any
    empty_known = int(vocab.ends > 0)
    end_base = float(np.log10((vocab.ends if vocab.ends else 0) + ADD)) - vocab.per_token()
    tail_log, frequent = np.log10(np.maximum(vocab.tail_mass, 1e-12)), vocab.sizes.frequent

    def look_up(have, come):
        t = have.get("table")
        if t is None:
            n = len(have["idx"])
            order = np.empty(n, np.int64)
            order[have["idx"].astype(np.int64)] = np.arange(n)
            c, code = have["c"].astype(np.float64)[order], have["code"].astype(np.int64)[order]
            lg = np.log10(c + ADD)
            inside = np.where((code >= frequent) & (code < UNKNOWN), lg - tail_log[(code - frequent) % TAILS], 0.0)
            t = have["table"] = (c > 0, lg, inside, code.astype(np.uint16))
        known, lg, inside, code = t
        out = []
        for doc, bare, hold, raw in zip(come["doc_id"].tolist(), come["doc_id_null"], come["held"], come["toks"]):
            tok = from_planes(raw)
            if not len(tok):
                continue
            out.append((None if bare else doc, bool(hold), len(tok) + 1, int(known[tok].sum()) + empty_known, float(lg[tok].sum()) - len(tok) * vocab.per_token() + end_base, float(inside[tok].sum()), np.append(code[tok], np.uint16(vocab.end_code)).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)

    shape = pa.schema([("doc_id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("tail", pa.float64()), ("codes", pa.binary())])
    met = meet(rows, "blk", "role", look_up, "doc_id long, held boolean, n_tokens long, n_known long, base_score double, tail double, codes binary")
    end = bytearray(np.array([vocab.end_code], np.uint16).tobytes())
    bare = none.select("doc_id", "held", F.lit(1).cast("long").alias("n_tokens"), F.lit(empty_known).cast("long").alias("n_known"), F.lit(end_base).alias("base_score"), F.lit(0.0).alias("tail"), F.lit(end).alias("codes"))
    return stage(met.unionByName(bare), "codes")


@dataclass
class Model:
    """Weights by hashed feature; None before the first gradient. Rows of words belong to a class: class by class, so
    many of each."""

    sizes: Sizes
    class_bias: np.ndarray
    word_bias: np.ndarray
    by_class: np.ndarray | None = None
    by_word: np.ndarray | None = None


def _mix(kind: int, *codes: np.ndarray) -> np.ndarray:
    h = np.full(len(codes[0]), kind * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for c in codes:
        h = (h ^ c) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return h


def class_features(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, sizes: Sizes) -> list[np.ndarray]:
    """Rows of the token before, of the two before, and with skips of the second and the third before. Single frequent tokens
    have rows of their own; rare ones share a quarter of the rest by hash, pairs what is left."""
    own, rest = sizes.frequent, sizes.class_rows - 3 * sizes.frequent
    few = rest // 4
    one = [np.where(w < own, k * own + w, 3 * own + _mix(k, w) % np.uint32(few)) for k, w in enumerate((w1, w2, w3))]
    pair = 3 * own + few + _mix(5, w1, w2) % np.uint32(rest - few)
    return [x.astype(np.int64) for x in (one[0], pair, one[1], one[2])]


def batches_of(codes: list[bytes], sizes: Sizes):
    """(document of each token, token, class, features, frequent tokens, their word feature) of up to 32k tokens at a time.

    Features of the class are the token before, the two before, and with skips the second and the third before;
    of a frequent token within its class, the token before."""
    arrays = [np.frombuffer(c, np.uint16) for c in codes]
    lo = 0
    while lo < len(arrays):
        hi, n = lo, 0
        while hi < len(arrays) and (n == 0 or n + len(arrays[hi]) <= _TOKENS):
            n += len(arrays[hi])
            hi += 1
        size = np.array([len(a) for a in arrays[lo:hi]])
        start = np.full(3, START, np.uint16)
        flat = np.concatenate([x for a in arrays[lo:hi] for x in (start, a)]).astype(np.uint32)
        doc = np.repeat(np.arange(hi - lo), size)
        pos = np.arange(n) + 3 * (doc + 1)
        for a in range(0, n, 2 * _TOKENS):
            at = pos[a : a + 2 * _TOKENS]
            w, w1, w2, w3 = flat[at], flat[at - 1], flat[at - 2], flat[at - 3]
            cls = sizes.class_of(w)
            feats = class_features(w1, w2, w3, sizes)
            inner = np.flatnonzero(w < sizes.frequent)
            each = sizes.word_rows // GROUPS
            word = cls[inner] * each + _mix(5, w1[inner]) % np.uint32(each)
            yield lo + doc[a : a + 2 * _TOKENS], w, cls, feats, inner, word
        lo = hi


def _softmax(bias, table, feats) -> np.ndarray:
    s = np.take(table, feats[0], axis=0)  # several times as fast as by index
    for f in feats[1:]:
        s += np.take(table, f, axis=0)
    s += bias
    s -= s.max(1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(1, keepdims=True)
    return s


def _add_rows(to: np.ndarray, f: np.ndarray, p: np.ndarray) -> None:
    """Adds each row of p to the row f of ``to``, in doubles: numpy's quick way needs one type on a flat array."""
    width, flat = p.shape[1], to.reshape(-1)
    some, col = max(1, _CELLS // width), np.arange(width)
    for lo in range(0, len(f), some):
        at = f[lo : lo + some, None].astype(np.int64) * width + col
        np.add.at(flat, at.reshape(-1), p[lo : lo + some].astype(np.float64).reshape(-1))


def gradient(model: Model, docs: DataFrame, observed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Observed and expected counts of every feature with every class, and with every token of a class, over
    all training tokens. Tasks sum their own and send touched rows, which are summed again by row block as
    they stream in; what the driver gets has the size of the model. Without weights, expected counts follow from the
    biases and only the observed ones are summed; with weights only the expected ones, as ``observed`` are
    those of the first round, which no weight changes."""
    first = model.by_class is None
    if not first and observed is None:
        observed = gradient(Model(model.sizes, model.class_bias, model.word_bias), docs)[::2]
    sent, sizes = docs.sparkSession.sparkContext.broadcast(model), model.sizes  # bounded by the sizes
    shapes = (sizes.class_rows, CLASSES), (sizes.word_rows, sizes.words)

    def run(batches):
        m = sent.value
        sums = [np.zeros(s) for s in shapes]
        for b in batches:
            for _, w, cls, feats, inner, word in batches_of(b.column(0).to_pylist(), sizes):
                if first:
                    for f in feats:
                        np.add.at(sums[0].reshape(-1), f.astype(np.int64) * CLASSES + cls, 1.0)
                    if len(inner):
                        np.add.at(sums[1].reshape(-1), word * sizes.words + w[inner] % sizes.words, 1.0)
                    continue
                p = _softmax(m.class_bias, m.by_class, feats)
                for f in feats:
                    _add_rows(sums[0], f, p)
                if len(inner):
                    _add_rows(sums[1], word, _softmax(np.take(m.word_bias, cls[inner], axis=0), m.by_word, [word]))
        for k, (rows, _) in enumerate(shapes):
            a = sums[k].reshape(rows // _ROWS, -1).astype(np.float32)
            for i in np.flatnonzero(a.any(1)):
                yield pa.RecordBatch.from_arrays([pa.array([k * 100_000 + int(i)], pa.int32()), pa.array([a[i].tobytes()], pa.binary())], ["chunk", "body"])

    def add(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for c, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(body, np.float32).astype(np.float64)
                got[c] = got[c] + x if c in got else x
        for c, x in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["chunk", "body"])

    parts = docs.filter("not held").select("codes").mapInArrow(run, "chunk int, body binary")
    summed = parts.repartition("chunk").mapInArrow(add, "chunk int, body binary")
    got = [np.zeros(s) for s in shapes]
    for r in summed.toLocalIterator():
        k, i = divmod(r["chunk"], 100_000)
        got[k][i * _ROWS : (i + 1) * _ROWS] = np.frombuffer(bytes(r["body"]), np.float32).reshape(_ROWS, -1)
    if not first:
        return observed[0], got[0], observed[1], got[1]
    return got[0], got[0].sum(1, keepdims=True) * np.exp(model.class_bias), got[1], got[1].sum(1, keepdims=True) * np.repeat(np.exp(model.word_bias), sizes.word_rows // GROUPS, 0)


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Rounds of full gradients over all training tokens, each scaled by its expected count."""
    m, observed = Model(vocab.sizes, vocab.class_bias(), vocab.word_bias()), None
    for _ in range(rounds):
        seen, want, wseen, wwant = gradient(m, docs, observed)
        observed = seen, wseen
        step = np.clip(STEP_CLASS * (seen - want) / (want + PULL), -CLIP, CLIP)
        wstep = np.clip(STEP_WORD * (wseen - wwant) / (wwant + PULL), -CLIP, CLIP)
        old = m.by_class if m.by_class is not None else 0.0
        wold = m.by_word if m.by_word is not None else 0.0
        m = Model(m.sizes, m.class_bias, m.word_bias, (old + step).astype(np.float32), (wold + wstep).astype(np.float32))
    return m


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    ``held`` marks rows that are scored but not learned from (default: none). The model's events are those of
    the base: the training tokens and one for all unknown ones; it starts as the base and learns how the three
    tokens before shift classes, and the one before tokens within a class. Null texts are empty: an end
    alone. Without training rows both scores come from the unknown token's share."""
    blocks = vocabulary_blocks(docs, id_col, text_col, F.coalesce(held, F.lit(False)) if held is not None else F.lit(False))
    coded, vocab = count_words(blocks)
    rows = encode(blocks, coded, vocab)
    sent = docs.sparkSession.sparkContext.broadcast(train(rows, vocab, rounds) if vocab.tokens else None)

    def run(batches):
        m = sent.value
        for b in batches:
            total = b.column(5).to_numpy().copy()
            if m is not None:
                for doc, w, cls, feats, inner, word in batches_of(b.column(6).to_pylist(), m.sizes):
                    p = _softmax(m.class_bias, m.by_class, feats)
                    lg = np.log10(np.maximum(p[np.arange(len(w)), cls], 1e-30)).astype(np.float64)
                    if len(inner):
                        q = _softmax(np.take(m.word_bias, cls[inner], axis=0), m.by_word, [word])
                        lg[inner] += np.log10(np.maximum(q[np.arange(len(inner)), (w[inner] % m.sizes.words).astype(np.int64)], 1e-30))
                    total += np.bincount(doc, weights=lg, minlength=len(total))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(np.full(len(total), vocab.tokens, np.int64)), b.column(4), pa.array(total)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
