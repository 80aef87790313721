"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
OURS, LIBRARY = pieces.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = [None, "", " ", "  ", "\0a b", " " * 3000, "a" * 4000, "the" * 2000 + " x", "▁▁ x", "日本語 テスト", "é x", "👍🏽 ok", "a\n\nb \n c", "\t\tx", "² ³.².", " a  b   c    d", "　x", "ab" * 40, "(); }); ... ---", "word " * 30_000, "a", "a"]


def ids_of(text, **how):
    return np.frombuffer(next(iter(OURS.encode([text], **how))), "<i4").tolist()


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdefghinorst \n.,(▁é1²日👍;")), max_size=60))
def test_encoding_is_the_librarys(text):
    assert ids_of(text) == LIBRARY.encode(text)
    assert OURS.decode(np.array(ids_of(text), np.int64)) == LIBRARY.decode(LIBRARY.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_encoding_of_any_text(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert ids_of(text) == LIBRARY.encode(text)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(1, 300) | st.integers(0, 31999) | st.sampled_from([28705, 2, 1]), max_size=9))
def test_decoding_of_any_ids(ids):
    assert OURS.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids)


def test_rounds_and_heap_agree():
    rng = random.Random(3)
    words = ["▁" * rng.randrange(0, 40) + "".join(rng.choice("theinras") for _ in range(rng.randrange(1, 70))) for _ in range(400)]
    assert OURS.merge(words) == OURS.merge(words, rounds=0) == OURS.merge(words, rounds=1000)
    assert OURS.merge([]) == []


def test_pieces_of_whole_tables(spark):
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, "k", i) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens string, extra int")
    rows = pieces.digest(docs, MODEL).collect()
    want = []
    for i, t in enumerate(ODD):
        ids = LIBRARY.encode(t or "")
        want.append((None if i == 3 else i // 2, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids)))))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    kept = pieces.encode(docs, MODEL, keep=("extra", "doc_id", "n_tokens", "text"))
    assert kept.columns == ["extra", "doc_id", "n_tokens", "text", "ids"] and {r.extra: r.text for r in kept.collect()} == dict(enumerate(ODD))
    assert pieces.digest(docs.limit(0), MODEL).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None), (2, [])], "i int, ids array<int>"), MODEL).collect()[0].decoded == ""


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, ids int")
    with pytest.raises(ValueError):
        pieces.encode(docs, MODEL, keep=("ids",))
    with pytest.raises(ValueError):
        pieces.decode(docs.withColumn("decoded", docs.text), MODEL)
