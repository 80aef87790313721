"""Signs that lose their slot get a second one before any join."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from tidegrid.llm import mixing


def test_signs_left_out_of_the_first_slots_have_second_ones(spark, monkeypatch):
    rng = np.random.default_rng(14)
    texts = [" ".join(rng.choice([f"{'b' if i % 2 else 'f'}{k}" for k in range(60)], 12)) for i in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, "toxic" if i % 2 else "good") for i in range(120)], "doc_id long, domain string")
    sizes, stage = {}, mixing.stage

    def counted(df, name, *more):
        out = stage(df, name, *more)
        if name in ("weights", "rest"):
            sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(mixing, "stage", counted)
    monkeypatch.setattr(mixing, "SLOTS", 128)
    got = mixing.posteriors(docs, labels)[0].toPandas()
    assert sizes["weights"][0] > sizes["rest"][0] > sizes["rest"][1]
    assert len(got) == 160 and ((got.p1 > 0.5) == (got.doc_id % 2 == 1)).all()


def test_slots_are_rows_and_no_value_of_a_task(spark, monkeypatch):
    """One row for each slot, met by a broadcast join: as one array they went with every task and filled the driver."""
    docs = spark.createDataFrame([(i, "b c d" if i % 2 else "f g h") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "toxic" if i % 2 else "good") for i in range(30)], "doc_id long, domain string")
    rows, stage = [], mixing.stage

    def counted(df, name, *more):
        out = stage(df, name, *more)
        if name == "slots":
            rows.append(out.count())
        return out

    monkeypatch.setattr(mixing, "stage", counted)
    monkeypatch.setattr(mixing, "SLOTS", 64)
    assert mixing.posteriors(docs, labels)[0].count() == 40
    assert rows == [64, 64]


def test_only_taken_slots_are_broadcast(spark, monkeypatch):
    """A row for each telling sign: with a row for each empty slot too, building the broadcast filled the driver. Signs that have no
    slot add nothing or meet the join, so the posteriors are those of many slots and of few."""
    rng = np.random.default_rng(15)
    texts = [" ".join(rng.choice([f"{'b' if i % 2 else 'f'}{k}" for k in range(60)], 12)) + f" only{i}" for i in range(160)] + [None, "", " \n "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, "toxic" if i % 2 else "good") for i in range(120)], "doc_id long, domain string")
    weights, sent, stage, broadcast = [], [], mixing.stage, F.broadcast

    def counted(df, name, *more):
        out = stage(df, name, *more)
        if name == "weights":
            weights.append(out.count())
        return out

    def looked(df):
        sent.append(df.count())
        return broadcast(df)

    monkeypatch.setattr(mixing, "stage", counted)
    monkeypatch.setattr(mixing.F, "broadcast", looked)
    got = {}
    for slots in (1 << 12, 8):
        weights.clear(), sent.clear()
        monkeypatch.setattr(mixing, "SLOTS", slots)
        got[slots] = mixing.posteriors(docs, labels)[0].toPandas().sort_values("doc_id")
        assert len(sent) == 2 and 0 < sum(sent) <= min(weights[0], 2 * slots)
    many, few = got.values()
    assert many.doc_id.tolist() == few.doc_id.tolist() == list(range(163))
    assert many.n_tokens.tolist() == few.n_tokens.tolist() == [13] * 160 + [0] * 3
    assert np.allclose(many[["p0", "p1"]], few[["p0", "p1"]], rtol=1e-12, atol=1e-15)


def test_texts_are_cut_into_signs_once(spark, monkeypatch):
    """Labelled texts too: their counts are taken from the stored hashes of signs, no text is cut a second time."""
    docs = spark.createDataFrame([(i, "b c d" if i % 2 else "f g h") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "toxic" if i % 2 else "good") for i in range(30)], "doc_id long, domain string")
    cut, stage = [], mixing.stage

    def looked(df, name, *more):
        if "split(" in df._jdf.queryExecution().optimizedPlan().toString():
            cut.append(name)
        return stage(df, name, *more)

    monkeypatch.setattr(mixing, "stage", looked)
    got = mixing.posteriors(docs, labels)[0].toPandas()
    assert cut == ["held"]
    assert len(got) == 40 and ((got.p1 > 0.5) == (got.doc_id % 2 == 1)).all()


def test_signs_of_odd_texts(spark):
    """Six blanks part words, no others do; symbols and line ends are counted; null, empty and blank texts have no words."""
    texts = ["\n a\tB\x0bc\x0cd\r\ne  A ", "x\x1cy z İ Été\n\n", "#$% a@b [\\] ^_{|}~ 'q' -,.;: \"", "one", "", " \n ", None, "\U0001f600 \U0001f600 <b>&amp;</b>\n" * 9]
    got = mixing.with_signs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text")
    assert got.columns == ["doc_id", "text", "__n", "__held"]
    for r in got.collect():
        t = r.text or ""
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", t) if x]
        odd = sum(c in "!#$%&()*+/<=>?@[\\]^_{|}~" for c in t)
        counts = [f"\tn{math.floor(math.log2(len(w) + 1))}", f"\to{math.floor(2 * math.log1p(100 * odd / (len(w) + 10)))}", f"\tl{math.floor(2 * math.log2((len(t) + 1) / (len(w) + 1)))}", f"\tb{math.floor(math.log1p(100 * t.count(chr(10)) / (len(w) + 10)))}"]
        signs = spark.createDataFrame([(x.lower(),) for x in [*w, *counts]], "s string")
        assert r["__n"] == len(w)
        assert sorted(r["__held"]) == sorted({x.h for x in signs.select(F.xxhash64("s").alias("h")).collect()})
