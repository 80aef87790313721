"""Whole-job tests of the round's findings: near copies, mixing, HTML rules, long training texts."""

import numpy as np
import pytest

from tidegrid.llm import htmltext, langid, mixing, nearcopy
from tidegrid.llm.common import local_groups

SCHEMA = "doc_id long, text string"


def runs(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_texts():
    """Edited copies at Jaccard similarities from under 0.8 up to 0.99, in several groups."""
    rng = np.random.default_rng(8)
    texts = ["", " \t", "one two", "One  two", "one two three"]
    for _ in range(12):
        base = [f"w{k}" for k in rng.integers(0, 5000, 400)]
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 7, 8, 9, 10, 12, 20):
            v = list(base)
            for k in rng.choice(80, edits, replace=False):
                v[5 * k] = f"x{rng.integers(0, 1 << 30)}"
            texts.append(" ".join(v))
    return texts


@pytest.mark.parametrize("tile", [4096, 7])
def test_near_copies_at_similarity_of_four_fifths(spark, monkeypatch, tile):
    import corpus_pipeline

    monkeypatch.setattr(nearcopy, "TILE_ROWS", tile)
    texts = near_texts()
    sets = [runs(t) for t in texts]
    sim = np.array([[len(a & b) / len(a | b) if a | b else 1.0 for b in sets] for a in sets])
    assert ((sim >= 0.8) & (sim < 0.9)).sum() > 50 and ((sim > 0.6) & (sim < 0.8)).sum() > 50
    want = local_groups(*np.nonzero(sim >= 0.8), len(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert {r.doc_id: r.component_id for r in nearcopy.near_copies(docs).collect()} == dict(enumerate(want.tolist()))
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == set(want.tolist())


def test_near_copies_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "A b c d e f"), (3, "other text"), (9, None)], SCHEMA)
    out = nearcopy.near_copies(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out) == [(-1, 7), (3, 3), (7, 7), (9, 9)]
    assert nearcopy.one_of_each(docs).count() == 4
    assert nearcopy.near_copies(docs.limit(0)).count() == 0


def test_mixing_looks_at_every_telling_sign(spark):
    """More than 128 signs tell of the domain, each of few documents: none of them is left out."""
    rng = np.random.default_rng(9)
    texts, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        texts.append(" ".join([f"{'bad' if bad else 'fine'}{k}" for k in rng.choice(150, 8, replace=False)] + [f"n{k}" for k in rng.choice(40, 20)]))
        labels.append((i, 1 - int(bad), 0))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    some = spark.createDataFrame(labels[:800], "doc_id long, quality int, toxic int")
    model = mixing.train(docs.join(mixing.domain_labels(some), "doc_id"), "text", "domain")
    assert model.weights.count() >= 290
    rows, domains, _ = mixing.mix(docs, mixing.domain_labels(some), {"good": 0.9, "poor": 0.1})
    late = rows.filter("doc_id >= 800").toPandas().set_index("doc_id")
    assert domains == ["good", "poor"]
    assert ((late.p1 > 0.9) == (late.index % 3 == 0)).all() and ((late.p1 < 0.1) == (late.index % 3 != 0)).all()


def test_mixing_rates_are_stationary(spark):
    """Many rates at 0: a descent of 60 steps ends before the least value."""
    rng = np.random.default_rng(10)
    n = rng.integers(1, 500, 600)
    p = rng.dirichlet([0.9, 0.5, 0.5], 600)
    rows = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(600)], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    goal = n.sum() * np.array([0.9, 0.07, 0.03])
    r = mixing.fit_rates(rows, 3, goal.tolist())[0].orderBy("doc_id").toPandas().rate.to_numpy()
    m = (p * n[:, None]).T @ p + 1e-9 * n.sum() * np.eye(3)
    slope = p @ np.linalg.solve(m, (p * (n * r)[:, None]).sum(0) - goal) + mixing.STIFF * (r - 1)
    assert (r == 0).mean() > 0.2
    assert np.abs(slope[r > 0]).max() < 1e-6 and slope[r == 0].min() > -1e-6


@pytest.mark.parametrize(
    "css, shown",
    [
        (".m{display:none}", False),
        ("@media print {.m{display:none}}", True),
        ("@media (max-width:600px){.m{display:none} p{margin:0}}", True),
        ("@media screen and (max-width:600px){.m{display:none}}", True),
        ("@media screen{.m{display:none}}", False),
        ("@media all, print{p{margin:0}.m{color:red;display:none}}", False),
        ("@supports (display:grid){@media print{.m{display:none}}}", True),
        ("@media print{.x{color:red}} .m{display:none}", False),
        ("@import url('a;b{'); /* } */ .m{display:none", False),
        (".m{display:none} .m{display:block}", True),
        (".m{display:block} .m{display:none}", False),
        ("#i{display:block} .m{display:none}", True),
        (".m{display:none!important} #i{display:block}", False),
        (".m{visibility:hidden} .m{display:block}", False),
        (".m{display:none} .m{visibility:visible}", False),
    ],
)
def test_html_rules_that_hold_on_a_screen(css, shown):
    html = f"<style>{css}</style><p>a</p><p id=i class=m>b</p>"
    assert htmltext.render(html) == ("a\n\nb" if shown else "a")


def test_html_rules_of_several_styles_and_closed_comments():
    assert htmltext.render("<style>.m{display:none}</style><style>.m{display:block}</style><p class=m>b") == "b"
    assert htmltext.render("<style media=print>.m{display:none}</style><p class=m>b") == "b"
    assert htmltext.render("<style>.m{display:none}</style><p class=m style='display:block'>b") == "b"
    assert htmltext.render("a<!-->b<!--->c<!-- x -->d") == "abcd"


def test_language_of_long_texts_alone(spark):
    rows = [(i, "sch keit ung ein " * 2000, "yy") for i in range(4)] + [(9, "1 " * 20_000 + "tion ing er the " * 900, "xx")]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "ein keit ung sch keit ein"), (2, "the er ing tion the ing"), (3, "1 2")], SCHEMA)
    assert {r.id: r.lang_pred for r in langid.identify(docs, learn).collect()} == {1: "yy", 2: "xx", 3: "und"}
