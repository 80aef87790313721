"""SentencePiece BPE encoding and decoding of whole texts by vectorised merge rounds."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

SPACE = "▁"  # stands for a blank in pieces
NEVER = np.iinfo(np.int32).max  # rank of a pair that does not merge
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces
ROUNDS = 64  # words that are not done by then are finished by a heap
WORDS = 300_000  # words that a worker remembers
CHARS = 1 << 21  # of texts encoded or ids decoded at a time

_MODELS: dict[str, Pieces] = {}


def _parting(pieces: list[str]) -> re.Pattern:
    """Where no piece goes on, a text can be parted before its merges: before a run of blanks, at line feeds,
    and between letters and other characters. Each rule is used only if every piece keeps to it."""
    line = "" if any("\n" in p for p in pieces) else "\n"
    letter, other = "[^\\W\\d_²³¹]", f"[\\W\\d_²³¹]"
    split = re.compile(f"{letter}*|{other}*")
    if all(split.fullmatch(p.lstrip(SPACE)) for p in pieces):
        body = f"{letter}+|(?:(?![{SPACE}{line}]){other})+"
    else:
        body = f"[^{SPACE}{line}]+"
    return re.compile(f"{SPACE}*(?:{body})|{SPACE}+" + (f"|{line}" if line else ""))


class Pieces:
    """Tables of a BPE model with byte fallback and no normalisation rules."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, np.array([p.type for p in model.pieces], np.int8)
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or set(kinds.tolist()) - {NORMAL, UNKNOWN, CONTROL, BYTE} or (kinds == BYTE).sum() != 256 or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, plain pieces and no normalisation are known here")
        self.prefix, self.kinds = bool(norm.add_dummy_prefix), kinds
        text = [p.piece for p in model.pieces]
        ids = {p: i for i, p in enumerate(text) if kinds[i] == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("pieces that go on after a blank are not known here")
        self.byte_id = np.zeros(256, np.int32)
        self.byte_id[[int(text[i][1:-1], 16) for i in np.flatnonzero(kinds == BYTE)]] = np.flatnonzero(kinds == BYTE)
        self._pairs(ids, np.array([p.score for p in model.pieces], np.float32))
        self.parts, self.known = _parting(list(ids)).findall, {}
        unknown = model.trainer_spec.unk_surface
        shown = [p.replace(SPACE, " ").encode() if k == NORMAL else bytes([int(p[1:-1], 16)]) if k == BYTE else unknown.encode() if k == UNKNOWN else b"" for p, k in zip(text, kinds)]
        self.size = np.array([len(s) for s in shown], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.blank_first = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(text, kinds)])

    def _pairs(self, ids: dict[str, int], scores: np.ndarray) -> None:
        """Every parting of every piece into two symbols: key -> (rank, piece). Equal scores have equal ranks."""
        by_score = np.unique(-scores[list(ids.values())], return_inverse=True)[1]
        rank_of = dict(zip(ids, by_score.tolist()))
        symbol = dict(ids)
        for p in ids:
            for c in p:
                symbol.setdefault(c, len(self.kinds) + len(symbol))  # a character that is a symbol, not a piece
        self.span = max(symbol.values()) + 2
        found = [(symbol[p[:k]] * self.span + symbol[p[k:]], rank_of[p], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        table = np.array(sorted(found), np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.merged = np.append(table[:, 0], np.iinfo(np.int64).max), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        own = np.full(self.span, NEVER, np.int32)
        own[list(ids.values())] = by_score
        # a piece is fair if no pair that it is half of ranks before it or as well: then all its merges may go at once
        self.fair = np.ones(self.span, bool)
        for half in (table[:, 0] // self.span, table[:, 0] % self.span):
            self.fair[half[(self.ranks <= own[half]) & (own[half] != NEVER)]] = False
        self.char = np.full(0x110000, -1, np.int32)
        single = [p for p in symbol if len(p) == 1]
        self.char[[ord(p) for p in single]] = [symbol[p] for p in single]
        self.char_only = np.arange(self.span) >= len(self.kinds)
        self.letters = {i: p for p, i in symbol.items()}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; NEVER where none."""
        key = left.astype(np.int64) * self.span + right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        at = np.where(hit, at, 0)
        return np.where(hit, self.ranks[at], NEVER), self.merged[at]

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols and the word of each; an unknown character is its bytes' pieces, which never merge."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        sym = self.char[chars]
        if (sym >= 0).all():
            return sym, word
        n = np.where(sym >= 0, 1, 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000))
        out = np.repeat(sym, n)
        out[out < 0] = self.byte_id[np.frombuffer("".join(map(chr, chars[sym < 0].tolist())).encode(), np.uint8)]
        return out, np.repeat(word, n)

    def merge(self, words: list[str], rounds: int = ROUNDS) -> list[bytes]:
        """Ids of each word, little-endian 32-bit.

        A round finds each word's best pair, merges all its places from the left, and closes the gaps. Of an
        unfair piece only the places up to the first that forms a pair as good are merged, since that pair
        comes next; so the order is that of merging one best leftmost pair at a time. Words without a pair leave."""
        sym, word = self._symbols(words)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for step in range(rounds + 1):
            rank, piece = self.lookup(sym[:-1], sym[1:])
            rank = np.append(np.where(word[:-1] == word[1:], rank, NEVER), NEVER)[: len(sym)]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(sym) else np.zeros(0, np.int64)
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym)))) if len(sym) else rank
            on = best != NEVER
            if step == rounds and on.any():
                got = [(self.one_by_one(sym[word == w]), w) for w in np.unique(word[on])]
                done += [(s, np.full(len(s), w, np.int32)) for s, w in got]
            if not on.all():
                done.append((sym[~on], word[~on]))
            if step == rounds or not on.any():
                break
            sym, word, rank, best, piece = sym[on], word[on], rank[on], best[on], np.append(piece, 0)[: len(on)][on]
            at = np.flatnonzero(rank == best)
            run = np.append(True, np.diff(at) > 1)
            at = at[(np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]  # of places that overlap, every other
            at = self._until_rival(sym, word, rank, piece, at)
            sym = sym.copy()
            sym[at] = piece[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, word = sym[stay], word[stay]
        sym, word = np.concatenate([s for s, _ in done] or [sym]), np.concatenate([w for _, w in done] or [word])
        order = np.argsort(word, kind="stable")
        sym, cut = self._as_bytes(sym[order], word[order], len(words))
        raw = sym.astype("<i4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(cut, cut[1:])]

    def _until_rival(self, sym, word, rank, piece, at):
        """Without the places after the first, in a word, whose new neighbours rank as well or before."""
        doubt = np.flatnonzero(~self.fair[piece[at]])
        if not len(doubt):
            return at
        p = at[doubt]
        end = len(sym) - 1
        before, after = np.maximum(p - 1, 0), np.minimum(p + 2, end)
        left = np.where(np.isin(p - 2, at), piece[np.maximum(p - 2, 0)], sym[before])
        lr = np.where((p > 0) & (word[before] == word[p]), self.lookup(left, piece[p])[0], NEVER)
        rr = np.where((p + 2 <= end) & (word[after] == word[p]), self.lookup(piece[p], sym[after])[0], NEVER)
        rival = p[(lr <= rank[p]) | (rr <= rank[p])]
        if not len(rival):
            return at
        last = np.full(int(word[-1]) + 1, len(sym))
        np.minimum.at(last, word[rival], rival)
        return at[at <= last[word[at]]]

    def one_by_one(self, symbols: np.ndarray) -> np.ndarray:
        """The same merges by a heap, for the rare word that needs many rounds (as thousands of blanks do)."""
        sym, nxt, prv = symbols.tolist(), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        pair = {}
        heap = []

        def offer(i: int) -> None:
            j = nxt[i] if i >= 0 else len(sym)
            if i < 0 or j >= len(sym):
                return
            key = (sym[i], sym[j])
            if key not in pair:
                r, m = self.lookup(np.array([key[0]]), np.array([key[1]]))
                pair[key] = (int(r[0]), int(m[0]))
            if pair[key][0] != NEVER:
                heapq.heappush(heap, (pair[key][0], i, *key))

        for i in range(len(sym)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j], nxt[i] = pair[a, b][1], -1, nxt[j]
            if nxt[i] < len(sym):
                prv[nxt[i]] = i
            offer(prv[i])
            offer(i)
        return np.array([s for s in sym if s >= 0], np.int32)

    def _as_bytes(self, sym, word, n):
        """Characters that are no pieces of their own as bytes; where each word's ids begin."""
        odd = self.char_only[sym]
        if odd.any():
            parts = [self.byte_id[list(self.letters[s].encode())] if o else np.array([s], np.int32) for s, o in zip(sym.tolist(), odd.tolist())]
            word = np.repeat(word, [len(p) for p in parts])
            sym = np.concatenate(parts)
        return sym, np.searchsorted(word, np.arange(n + 1)).tolist()

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of whole texts; the words of all texts given are merged together, each once per worker."""
        parted = [self.parts(((SPACE if self.prefix else "") + t).replace(" ", SPACE)) if t else [] for t in texts]
        known = self.known
        new = {w for words in parted for w in words if w not in known}
        if len(known) + len(new) > WORDS:
            known.clear()
            new = {w for words in parted for w in words}
        todo = sorted(new, key=len)
        lo = 0
        while lo < len(todo):  # some 2 million characters at a time
            hi = lo + max(1, CHARS // max(1, len(todo[min(len(todo) - 1, lo + CHARS // 64)])) // 4)
            known.update(zip(todo[lo:hi], self.merge(todo[lo:hi])))
            lo = hi
        for words in parted:
            yield b"".join(map(known.__getitem__, words))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids as the library's decode gives it: a blank that begins the text is dropped, control
        pieces are silent, and each byte that is no part of a valid character becomes U+FFFD."""
        told = np.flatnonzero(self.kinds[ids] != CONTROL)
        strip = bool(self.prefix and len(told) and self.blank_first[ids[told[0]]])
        if len(told) == len(ids):
            return self._shown(ids, strip)
        parts = np.split(told, np.flatnonzero(np.diff(told) > 1) + 1)  # bytes on both sides of a control piece don't join
        return "".join(self._shown(ids[p], strip and k == 0) for k, p in enumerate(parts))

    def _shown(self, ids: np.ndarray, strip: bool) -> str:
        n = self.size[ids]
        total = int(n.sum())
        place = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[ids], n)
        raw = self.shown[place].tobytes()[int(strip) :]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _mended(raw)


def _mended(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start].decode(), "�"]
            at += e.start + 1
    return "".join(out)


def pieces(path: str) -> Pieces:
    """This worker's model."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def _slices(lengths: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold CHARS or so."""
    lo = n = hi = 0
    for hi, k in enumerate(lengths, 1):
        n += k
        if n >= CHARS:
            yield lo, hi
            lo, n = hi, 0
    if lo < hi:
        yield lo, hi


def _clear(df: DataFrame, names: list[str], added: set[str]) -> None:
    taken = [c for c in names if c in added]
    if taken or len(set(names)) != len(names):
        raise ValueError(f"columns {taken or names} clash with what is added")


def encode(docs: DataFrame, model: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row with ``ids array<int>``: whole texts, no begin or end ids, no sampling.

    Null and empty texts have no ids; rows that repeat are rows of their own, an empty table gives none. Kept
    columns must not be called ``ids`` or ``_t``. Rows stay where they are: nothing is shuffled, and a lost task runs
    again by itself. A text of any length is one row; texts are taken some 2 million characters at a time."""
    names = list(keep)
    _clear(docs, names, {"ids", "_t"})
    own = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("_t"))
    out = StructType([*own.schema.fields[: len(names)], StructField("ids", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        for b in batches:
            text = b.column(len(names))
            for lo, hi in _slices(len(t.as_py() or "") for t in text):
                got = list(m.encode([t.as_py() for t in text[lo:hi]]))
                cut = np.cumsum([0, *(len(x) // 4 for x in got)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.frombuffer(b"".join(got), "<i4")))
                yield pa.RecordBatch.from_arrays([*(b.column(k)[lo:hi] for k in range(len(names))), ids], [*names, "ids"])

    return own.mapInArrow(run, out)


def decode(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of their ids (null ids: an empty text); ``decoded`` must not be there before."""
    _clear(rows, rows.columns, {"decoded"})
    names, out = rows.columns, StructType([*rows.schema.fields, StructField("decoded", StringType())])
    where = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        for b in batches:
            ids = b.column(where)
            for lo, hi in _slices((len(x.values) if x.is_valid else 0) for x in ids):
                texts = [m.decode(np.asarray(x.values, np.int64)) if x.is_valid else "" for x in ids[lo:hi]]
                yield pa.RecordBatch.from_arrays([*(b.column(k)[lo:hi] for k in range(len(names))), pa.array(texts, pa.string())], [*names, "decoded"])

    return rows.mapInArrow(run, out)


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")


def digest(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids of whole texts, and the texts decoded from those ids."""
    out = decode(encode(docs, model), model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text(F.col("ids")).cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
