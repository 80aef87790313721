"""Runs of letters alone are one part and are not parted."""

import os
import re

import pytest

from tidegrid.llm import tokens
from tidegrid.llm.queries import tokenizer_path


def test_runs_of_letters_are_not_parted(monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("tokenizer absent")
    coder = tokens.Encoder(path, True)
    whole = lambda t: b"".join(coder._library([t]))
    for text in ("Plain words s t ll", "don't it's", "über naïve", "a1 b,c"):
        assert b"".join(coder.encode([text])) == whole(text)
    monkeypatch.setattr(tokens, "_SPLIT_SPACED", re.compile("(?!)"))  # finds no part
    assert coder._run("Zebrawood") == whole(" Zebrawood")
