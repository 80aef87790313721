"""Encoding run by run is what the library does, and learns a run once."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegrid.llm import tokens

PATHS = {True: public_tokenizers.path("byte_bpe_50k.json"), False: public_tokenizers.path("word_bpe_49k.json")}
MADE = {s: (Tokenizer.from_file(p), tokens.Encoder(p, s)) for s, p in PATHS.items()}


def agrees(text, spaced):
    plain, ours = MADE[spaced]
    return np.frombuffer(next(iter(ours.encode([text]))), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sZé1.,- \n\r\t")), max_size=30), st.booleans())
def test_runs_with_any_white_space(text, spaced):
    assert agrees(text, spaced)


@pytest.mark.parametrize("spaced", [True, False])
@pytest.mark.parametrize("text", ["字 \rb", "a \rb", "\n", " ", " a", "a\n", "a\nb c", "it's, 'so' -'s x'", "\ra", "été, ça\nn'est 2x"])
def test_runs_at_the_edges(text, spaced):
    assert agrees(text, spaced) and agrees(f"{text} {text}", spaced)


@pytest.mark.parametrize("spaced", [True, False])
def test_a_known_run_is_not_parted_again(spaced, monkeypatch):
    ours = tokens.Encoder(PATHS[spaced], spaced)
    text = "Some words, again: words and some-thing\nwords, again"
    first = list(ours.encode([text]))
    monkeypatch.setattr(ours, "_run", None)
    assert list(ours.encode([text])) == first


def test_memory_of_runs_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 50)
    ours = tokens.Encoder(PATHS[True], True)
    texts = [" ".join(f"w{k * i}x, é{k}" for k in range(20)) for i in range(1, 9)]
    want = [e.ids for e in MADE[True][0].encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode(texts)] == want
    assert len(ours.runs) + len(ours.parts) <= 150
