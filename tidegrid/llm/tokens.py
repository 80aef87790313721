"""Whole texts to token ids, each distinct run of characters between blanks encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECES = 800_000  # encoded runs and parts of plain texts that a worker remembers
RUNS = 100_000  # encoded runs between blanks, of texts that are not plain
LONG = 1 << 16  # characters from which a text is cut where a blank parts two letters or digits

#: How the two kinds of vocabularies part a text, for texts of ASCII and Latin-1 letters.
_SPLIT_SPACED = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
_SPLIT_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_PLAIN = re.compile(r"[\t-\r !-~À-ÖØ-öø-ÿ]*")
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_MEMORY: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """ids of the ``tokenizers`` library for whole texts, as little-endian 32-bit bytes.

    A plain text, of ASCII and Latin-1 letters, is taken run by run, as blanks and line ends part it; each run is
    parted here once, as the vocabulary's own pattern does, and its parts are given to the library's model.
    Where white space meets white space, whole texts are parted in that way. Of any other text, the runs between single blanks go
    through the whole library, each once, since no pattern joins characters over such a blank; ``spaced``: a
    run takes the blank before it along (byte-level vocabularies), else white space is dropped. Texts with
    other white space, and vocabularies that part text in another way, are encoded by plain calls."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.known, self.runs, self.parts = Tokenizer.from_file(path), spaced, {}, {}, {}
        self.tokenize = self.tokenizer.model.tokenize  # taken once: each look at the model makes an object
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.direct = self._parts_as_expected(made.get("normalizer"), made.get("pre_tokenizer") or {})
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}  # fixed values: bytes that stand for themselves
        hidden = [b for b in range(256) if b not in visible]
        self.shown = {b: chr(256 + k) for k, b in enumerate(hidden)}

    def _parts_as_expected(self, normalizer, parting) -> bool:
        if self.spaced:
            return normalizer is None and parting.get("type") == "ByteLevel" and parting.get("use_regex", False) and not parting.get("add_prefix_space", True)
        kinds = [n.get("type") for n in (normalizer or {}).get("normalizers", [])]
        steps = parting.get("pretokenizers", [])
        return kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"].get("Regex") == _WORD_PATTERN and not steps[1].get("use_regex", True) and not steps[1].get("add_prefix_space", True)

    def _plain(self, text: str) -> bytes:
        """Ids of a plain text, run by run; of one with other white space than single blanks, part by part."""
        if self.spaced:
            keys = text.replace("\n", " \n").split(" ")
            keys[0] = "\0" + keys[0]  # the first run has no blank before it
        else:
            keys = text.lower().split()
        get = self.runs.get
        try:
            return b"".join(map(get, keys))
        except TypeError:  # a run that is not known, or known to have other white space
            new = {k for k in keys if k not in self.runs}
        if new:
            if self._crowded(len(new)):
                new = set(keys)
            for k in new:
                self.runs[k] = self._run(k)
        got = list(map(get, keys))
        return b"".join(map(self._by_parts, self._cut(text))) if None in got else b"".join(got)

    def _crowded(self, new: int) -> bool:
        """Forgets all that is remembered if so much more is too much."""
        if len(self.runs) + len(self.parts) + new <= PIECES:
            return False
        self.runs.clear()
        self.parts.clear()
        return True

    def _run(self, key: str) -> bytes | None:
        """Ids of a run with what stands before it: a line end, nothing, or else (``spaced``) a blank."""
        if self.spaced and key.isalpha() and key.isascii():  # one part, which stands for itself
            return self._shown_ids(self.shown[32] + key)
        if not self.spaced:
            text = key
        elif key[:1] in ("\0", "\n"):
            body, text = key[1:], key if key[0] == "\n" else key[1:]
        else:
            body, text = key, " " + key
        if self.spaced and body.split() != [body]:
            return None
        found = (_SPLIT_SPACED if self.spaced else _SPLIT_WORDS).findall(text)
        return self._ids(text) if len(found) == 1 else b"".join(map(self._part, found))

    def _part(self, p: str) -> bytes:
        held, key = (self.runs, p[1:]) if self.spaced and p[0] == " " else (self.parts, p)
        ids = held.get(key)
        if ids is None:
            ids = held[key] = self._ids(p)
        return ids

    def _ids(self, p: str) -> bytes:
        if p.isascii() and p.isprintable():  # all but the blank stand for themselves
            bytes_shown = p.replace(" ", self.shown[32])
        else:
            bytes_shown = p.encode().decode("latin-1").translate(self.shown)
        return self._shown_ids(bytes_shown)

    def _shown_ids(self, bytes_shown: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(bytes_shown)]).tobytes()

    def _by_parts(self, text: str) -> bytes:
        found = _SPLIT_SPACED.findall(text)
        get = self.parts.get
        got = list(map(get, found))
        if None in got:
            new = {p for p, ids in zip(found, got) if ids is None}
            if self._crowded(len(new)):
                new = set(found)
            for p in new:
                self.parts[p] = self._ids(p)
            got = list(map(get, found))
        return b"".join(got)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str]:
        parts, lo = [], 0
        while len(text) - lo > LONG:
            at = text.find(" ", lo + LONG)
            while at >= 0 and not (text[at - 1].isalnum() and text[at + 1 : at + 2].isalnum()):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            parts.append(text[lo:at])
            lo = at
        return [*parts, text[lo:]]

    def _keys(self, text: str) -> list[str]:
        if not self.spaced:
            return ["\n"] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        if " \r" in text:  # looks like the mark of the first run
            return ["\n"]
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\r" + keys[0]  # the first run has no blank before it
        return keys

    def _learn(self, new: set[str]) -> None:
        texts = {}
        for k in new:
            body = k[1:] if self.spaced and k[:1] in ("\n", "\r") else k
            if not body or len(body.split()) != 1 or body != body.strip():
                self.known[k] = None  # other white space: the text goes off the fast path
                continue
            text = body if not self.spaced or k[0] == "\r" else k if k[0] == "\n" else " " + k
            texts[k] = text
        for k, ids in zip(texts, self._library(list(texts.values()))):
            self.known[k] = ids

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        known = self.known
        for text in texts:
            if not text:
                yield b""
                continue
            if self.direct and "<|" not in text and _PLAIN.fullmatch(text):
                yield self._plain(text)
                continue
            keys = self._keys(text)
            got = list(map(known.get, keys))
            if None in got:
                new = {k for k, ids in zip(keys, got) if ids is None and k not in known}
                if len(known) + len(new) > RUNS:
                    known.clear()
                    new = set(keys)
                self._learn(new)
                got = list(map(known.get, keys))
            yield b"".join(self._library(self._cut(text)) if None in got else got)


def encoder(path: str, spaced: bool) -> Encoder:
    """This worker's encoder."""
    if (path, spaced) not in _MEMORY:
        _MEMORY[path, spaced] = Encoder(path, spaced)
    return _MEMORY[path, spaced]


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """Texts of an Arrow column one at a time."""
    return (x.as_py() for x in column)
