"""Line dedup, quality rules, language ID, SimHash and mixing on small tables, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidegrid.llm import langid, linededup, mixing, quality, simhash
from tidegrid.llm.common import id_crc_mod, local_groups
from tidegrid.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h1 long, word string"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LINE = "This line is shared by several of the documents in here"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old tree near the river bank"


def table(spark, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    return spark.createDataFrame([(i, t, l, "s", None, 1, "w") for i, t, l in zip(ids, texts, langs)], DOCS)


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def lines_by_hand(docs):
    key = lambda x: lower(x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    found = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                found.setdefault(key(line), set()).add(i)
    out = set()
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(found.get(key(x), ())) >= 5 and max(found[key(x)]) != i)]
        out.add((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_lines_against_brute_force(spark):
    texts = [None, "", "\n", f"{LINE}\nown 1", f"  {LINE.upper()}\t\nown 2\n{LINE}", f"own 3\n{LINE}", f"{LINE}\n\n{LINE}", f"x\n{LINE}\x0b", "É" * 40, "é" * 40, *["é" * 40] * 4, "y\n" * 300 + LINE + "\n" + "z\n" * 300]
    docs = list(enumerate(texts))
    got = {tuple(r) for r in linededup.digest(table(spark, texts)).collect()}
    assert got == lines_by_hand(docs)


def test_dedup_lines_keeps_columns_and_null_ids(spark):
    texts = [f"{LINE}\na{i}" for i in range(6)]
    out = linededup.dedup_lines(table(spark, texts, [1, 2, 3, 4, None, 9]))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert {r.text for r in out.collect()} == {"a0", "a1", "a2", "a3", "a4", f"{LINE}\na5"}
    assert linededup.dedup_lines(table(spark, texts).limit(0)).count() == 0


def test_repeated_rows_count_once(spark):
    out = linededup.digest(table(spark, [LINE] * 6, [1, 1, 1, 2, 3, 4]))
    assert {r.n_dropped for r in out.collect()} == {0}


def test_base_statistics(spark):
    texts = [None, "", " \n\t", "a b c", "a b c d e " * 3, "x " * 7, "one\none\n\n\none two", "# $ % & | < > * é", "p q r s t u p q r s t v", "a\x1cb c\x85d", "long " * 3000]
    got = {r.doc_id: r for r in quality.base_statistics(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = BLANK.findall(t or "")
        at = {}
        for k in range(len(w) - 4):
            at.setdefault(tuple(w[k : k + 5]), []).append(k)
        covered = {p + q for v in at.values() if len(v) > 1 for p in v for q in range(5)}
        lines = [x for x in (t or "").split("\n") if BLANK.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t


def test_quality_rejects_outliers_and_keeps_prose(spark):
    rng = np.random.default_rng(0)
    words = PROSE.split()
    texts = [" ".join(rng.permutation(words * 8)[: rng.integers(40, 150)]) for _ in range(150)] + [" ".join(f"{w}###$$$%%%" for w in rng.permutation(words * 3)) for _ in range(5)] + ["few words", None]
    langs = [None if i % 7 == 0 else "en" for i in range(len(texts))]
    out = {r.doc_id: r for r in quality.judge(table(spark, texts, langs=langs)).collect()}
    assert sum(out[i].kept for i in range(150)) >= 148
    assert not any(out[i].kept for i in range(150, 157))
    assert not out[150].base_failed and out[155].base_failed
    kept = quality.keep_good(table(spark, texts, langs=langs))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept}


def test_estimates_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4, 4)) * 0.3 + np.eye(4)
    x = rng.normal(size=(4000, 4)) @ a.T
    x[:400] += 30
    rows = spark.createDataFrame([("en", "s", *map(float, v)) for v in x], "lang string, source string, x0 double, x1 double, x2 double, x3 double")
    r = quality.robust_estimates(rows).collect()
    assert len(r) == 1
    np.testing.assert_allclose([r[0][f"m{i}"] for i in range(4)], x[400:].mean(0), atol=0.1)
    cov = np.cov(x[400:].T)
    for i in range(4):
        for j in range(i + 1):
            ridge = quality.RIDGE[i] if i == j else 0
            assert abs((r[0][f"c{i}{j}"] - ridge) * quality.CONSISTENCY - cov[i, j]) < 0.35


def test_quality_of_no_rows(spark):
    assert quality.judge(table(spark, ["a"]).limit(0)).count() == 0


def fingerprint_by_hand(t):
    w = BLANK.findall(lower(t or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("shared", [3, 40])
def test_simhash_components(spark, monkeypatch, shared):
    monkeypatch.setattr(simhash, "HELD", shared)
    monkeypatch.setattr(simhash, "PASSING", shared * 2)
    rng = np.random.default_rng(3)
    words = PROSE.split()
    base = [" ".join(rng.choice(words, 300)) for _ in range(20)]
    texts = [None, "", " \t", "one", "One two"]
    for t in base:
        w = t.split()
        for k in range(3):
            v = list(w)
            v[k * 7] = "changed"
            texts.append(" ".join(v))
        texts += [t, t.upper()]
    fps = np.array([fingerprint_by_hand(t) for t in texts], np.uint64)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= 2)
    want = local_groups(a, b, len(fps))
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert got == {i: (int(f), int(c)) for i, (f, c) in enumerate(zip(fps, want))}


def test_links_between_random_fingerprints(spark):
    rng = np.random.default_rng(5)
    f = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = np.concatenate([f, f[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)), f[:80] ^ np.uint64(3 << 62), f[:40] ^ np.uint64(7)])
    near = np.unique(near)
    pairs = simhash.links(spark.createDataFrame([(int(x),) for x in near.view(np.int64)], "fp long")).collect()
    at = {int(x): i for i, x in enumerate(near.view(np.int64))}
    got = local_groups(np.array([at[r.a] for r in pairs]), np.array([at[r.b] for r in pairs]), len(near))
    i, j = np.nonzero(np.bitwise_count(near[:, None] ^ near) <= 2)
    np.testing.assert_array_equal(got, local_groups(i, j, len(near)))


def test_simhash_null_ids_and_no_rows(spark):
    out = simhash.near_duplicates(table(spark, [PROSE, PROSE, "other text here", PROSE], [None, 7, None, 3])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out) == [(-1, -1), (-1, 3), (3, 3), (7, 3)]
    assert {r.doc_id for r in simhash.one_of_each(table(spark, [PROSE, PROSE, "a b"], [4, 2, None])).collect()} == {2, None}
    assert simhash.near_duplicates(table(spark, [PROSE]).limit(0)).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in range(100, 160)}


def test_language(spark):
    rng = np.random.default_rng(2)
    voc = {"xx": ["tion", "ing", "er", "the", "ed"], "yy": ["keit", "ung", "sch", "ein", "ver"]}
    texts, langs = [], []
    for i in range(160):
        lang = "xx" if i % 2 else "yy"
        texts.append(" ".join("".join(rng.choice(voc[lang], 2)) for _ in range(40)))
        langs.append(lang)
    texts += [None, "", "12 34 !!", "verung scheinkeit einver " * 1000]
    langs += ["xx", None, "yy", None]
    docs = table(spark, texts, langs=langs)
    held = id_crc_mod("doc_id", 4) == 2
    out = {r.id: r for r in langid.identify(docs, docs.filter(~held)).collect()}
    test = [i for i in range(160) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert test and all(out[i].lang_pred == langs[i] and 0 <= out[i].score <= 1 for i in test)
    assert [out[i].lang_pred for i in (160, 161, 162, 163)] == ["und", "und", "und", "yy"]
    assert {r.lang_pred for r in langid.identify(docs, docs.limit(0)).collect()} == {"und"}


def test_mixing_rates_against_numpy(spark):
    rng = np.random.default_rng(4)
    n = rng.integers(0, 500, 400)
    p = rng.dirichlet([0.4, 0.3, 0.2], 400)
    rows = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(400)], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    goal = n.sum() * np.array([0.6, 0.3, 0.1])
    rates, gap = mixing.fit_rates(rows, 3, goal.tolist())
    out = rates.orderBy("doc_id").toPandas()
    assert (out.rate >= 0).all()
    np.testing.assert_allclose(gap, ((p * n[:, None] * out.rate.to_numpy()[:, None]).sum(0) - goal) / n.sum(), atol=1e-7)
    np.testing.assert_allclose((p * n[:, None] * out.rate.to_numpy()[:, None]).sum(0), goal, atol=2e-3 * n.sum())
    r = np.ones(400)  # the same descent by hand, run on
    m = np.linalg.inv((p * n[:, None]).T @ p + 1e-9 * n.sum() * np.eye(3))
    for _ in range(2000):
        r = np.maximum(0, r - (p @ (m @ ((p * n[:, None] * r[:, None]).sum(0) - goal)) + mixing.STIFF * (r - 1)) / (1 + mixing.STIFF))
    assert np.abs(out.rate.to_numpy() - r).max() < 0.1


def test_mixing_by_labels(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(PROSE.split(), 60)) + (" idiot" if i % 4 == 0 else "") for i in range(200)] + [None, ""]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)] + [(3, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rows, domains, gap = mixing.mix(docs, mixing.domain_labels(labels), {"good": 0.9, "toxic": 0.1})
    assert len(gap) == 2 and max(map(abs, gap)) < 0.05
    assert domains == ["good", "toxic"]
    got = rows.toPandas().set_index("doc_id").sort_index()
    late = got.loc[120:199]
    assert ((late.p1 > 0.5) == (late.index % 4 == 0)).all()
    assert late.rate[late.p1 > 0.5].max() < late.rate[late.p1 < 0.5].min()
    assert got.n_tokens[[200, 201]].tolist() == [0, 0]
    out = mixing.resample(docs, mixing.domain_labels(labels), {"good": 1.3, "toxic": 0.3}, relative=True)
    assert out.columns == docs.columns
    counts = out.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert set(counts.index) >= {i for i in range(200) if i % 4}


def test_mixing_without_labels(spark):
    docs = table(spark, [PROSE, None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.resample(docs, mixing.domain_labels(none), {"good": 2.0}, relative=True).count() == 2
    assert mixing.resample(docs.limit(0), mixing.domain_labels(none), {"good": 2.0}).count() == 0
    rows, domains, gap = mixing.mix(docs.limit(0), mixing.domain_labels(none), {"good": 2.0})
    assert rows.count() == 0 and domains == ["all"] and gap == [0.0]


def naive_bayes(texts, labelled, heat_fold):
    """The posteriors' logits by hand: over all labelled rows, and over those outside the fold."""
    blank = "\x20\x09\x0a\x0b\x0c\x0d"

    def signs(t):
        t = t or ""
        w = [x for x in re.split(f"[{blank}]+", t.lower()) if x]
        odd = sum(c in "!#$%&()*+/<=>?@[\\]^_{|}~" for c in t)
        return set(w) | {f"\tn{math.floor(math.log2(len(w) + 1))}", f"\to{math.floor(2 * math.log1p(100 * odd / (len(w) + 10)))}", f"\tl{math.floor(2 * math.log2((len(t) + 1) / (len(w) + 1)))}", f"\tb{math.floor(math.log1p(100 * t.count(chr(10)) / (len(w) + 10)))}"}

    held = [signs(t) for t in texts]
    names = sorted(set(labelled.values()))
    size = {d: sum(v == d for v in labelled.values()) for d in names}
    total = len(labelled)
    seen = Counter(s for i in labelled for s in held[i])
    tested = [s for s, n in seen.items() if n >= 5]
    h = lambda counts: sum(-c * math.log(c / sum(counts)) for c in counts if c)
    out = {}
    for part in (False, True):
        rows = [i for i in labelled if not (part and i in heat_fold)]
        n = {d: sum(labelled[i] == d for i in rows) for d in names}
        z = np.zeros((len(texts), len(names)))
        for s in tested:
            inside = [sum(s in held[i] for i in labelled if labelled[i] == d) for d in names]
            gain = h([size[d] for d in names]) - h(inside) - h([size[d] - c for d, c in zip(names, inside)])
            if 2 * gain <= 2 * math.log(max(len(tested), 2)):
                continue
            for k, d in enumerate(names):
                q = (sum(s in held[i] for i in rows if labelled[i] == d) + 1) / (n[d] + 2)
                z[:, k] += [math.log(q) if s in t else math.log(1 - q) for t in held]
        out[part] = z
    prior = np.array([math.log((size[d] + 1) / (total + len(names))) for d in names])
    best = None
    for heat in mixing.HEATS:
        loss = []
        for i in heat_fold:
            v = prior + out[True][i] / heat
            p = np.exp(v - v.max())
            loss.append(-math.log(max((p / p.sum())[names.index(labelled[i])], 1e-12)))
        if best is None or np.mean(loss) < best[0] - 1e-12:
            best = (np.mean(loss), heat)
    v = prior + out[False] / best[1]
    p = np.exp(v - v.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def test_posteriors_against_naive_bayes_by_hand(spark):
    rng = np.random.default_rng(12)
    bad, fine = [f"b{k}" for k in range(12)], [f"f{k}" for k in range(12)]
    texts = [None, "", *[" ".join([*rng.choice(bad if i % 3 == 0 else fine, 4), *rng.choice(bad + fine, 4), *rng.choice(PROSE.split(), 6)]) + (" #$%\nx" if i % 5 == 0 else ".") for i in range(220)]]
    labelled = {i: ("toxic" if i % 3 == 2 else "good") for i in range(2, 160)}
    labels = spark.createDataFrame(list(labelled.items()), "doc_id long, domain string")
    folds = spark.range(2, 160).filter(F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(mixing.FOLDS)) == 0).collect()
    rows, domains = mixing.posteriors(table(spark, texts), labels, keep=("lang", "word"))
    got = rows.orderBy("doc_id").toPandas()
    assert domains == ["good", "toxic"] and list(got.columns[:4]) == ["doc_id", "lang", "word", "n_tokens"]
    np.testing.assert_allclose(got[["p0", "p1"]].to_numpy(), naive_bayes(texts, labelled, {r.id for r in folds}), atol=1e-9)
    with pytest.raises(ValueError):
        mixing.mix(table(spark, texts), labels, {}, keep=("n_tokens",))


def test_signs_beyond_their_slots(spark, monkeypatch):
    """With few slots most signs take the join; the posteriors stay."""
    rng = np.random.default_rng(14)
    texts = [" ".join(rng.choice([f"{'b' if i % 2 else 'f'}{k}" for k in range(60)], 12)) for i in range(160)]
    labels = spark.createDataFrame([(i, "toxic" if i % 2 else "good") for i in range(120)], "doc_id long, domain string")
    some = mixing.posteriors(table(spark, texts), labels)[0].orderBy("doc_id").toPandas()
    monkeypatch.setattr(mixing, "SLOTS", 8)
    few = mixing.posteriors(table(spark, texts), labels)[0].orderBy("doc_id").toPandas()
    np.testing.assert_allclose(few[["p0", "p1"]], some[["p0", "p1"]], atol=1e-12)
    assert ((some.p1 > 0.5) == (some.doc_id % 2 == 1)).all()


def test_bit_filter_holds_all_and_little_else(spark):
    some = spark.range(3000).select(F.xxhash64("id").alias("h"))
    bits, size = mixing.bit_filter(some, "h")
    probes = spark.range(40_000).select("id", bits.scalar().alias("b"), F.xxhash64("id").alias("h"))
    passed = {r.id for r in probes.filter(mixing.may_hold("b", size, F.col("h"))).collect()}
    assert passed >= set(range(3000)) and len(passed) < 3000 + 0.05 * 37_000
