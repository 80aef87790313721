"""Nearest neighbours, token files, packing, language model, HTML and the pipeline on small tables."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidegrid.llm import htmltext, maxent, multiindex, packing, queries, tokenfile
from tidegrid.llm.common import fresh_path, id_crc_mod, shared_dir
from tidegrid.llm.tokens import Encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, length int, ids string, rank int"
ODD = [None, "", " ", "\n", "a\nb", "a \n b", "\n\nlead", "tail \n", "two  blanks", "tab\there", "it's we'll don't 's", "x\x1cy z", "x\x85y", "naïve Ünïcode ﬁ İstanbul ΣΑΣ", "emoji 👍🏽 ok", "nb\xa0sp a", "<|endoftext|> in <|endoftext|>text", "é ́combining", "123 4567,89!! ...", "a" * 70_000, "word " * 20_000 + "end", ("x\t" + "long words here and " * 5000)]


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "c", 2) for i, t in zip(ids, texts)], DOCS)


@pytest.mark.parametrize("path,spaced", [(BYTES, True), (WORDS, False)])
def test_encoder_is_exact(path, spaced):
    plain, ours = Tokenizer.from_file(path), Encoder(path, spaced)
    for t, got in zip(ODD, ours.encode(ODD)):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)[:60]


PLAIN = {s: (Tokenizer.from_file(p), Encoder(p, s)) for p, s in ((BYTES, True), (WORDS, False))}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sZé 1\n\t  ́-.<|>\x1f字")), max_size=40), st.booleans())
def test_encoder_on_any_text(text, spaced):
    plain, ours = PLAIN[spaced]
    assert np.frombuffer(next(iter(ours.encode([text]))), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=33, max_codepoint=255), min_size=1, max_size=8), max_size=12), st.sampled_from([" ", "\n"]), st.booleans())
def test_encoder_on_latin_text(runs, blank, spaced):
    plain, ours = PLAIN[spaced]
    text = blank.join(runs)
    assert ours.direct
    assert np.frombuffer(next(iter(ours.encode([text]))), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), max_size=6))
def test_codes_round_trip(docs):
    flat = np.array([x for d in docs for x in d], np.uint32)
    raw = tokenfile.pack(flat, [None if k == 1 else k for k in range(len(docs))], np.array([len(d) for d in docs], np.int64))
    f = tokenfile.TokenFile(lambda n, at: raw[at : at + n])
    assert f.tokens().tolist() == flat.tolist()
    ids, starts = f.documents()
    assert ids == [None if k == 1 else k for k in range(len(docs))] and np.diff(starts).tolist() == [len(d) for d in docs]
    for i in range(0, len(flat), 97):
        assert f.token(i) == flat[i]
        assert f.tokens(i, min(len(flat), i + 50)).tolist() == flat[i : i + 50].tolist()


def test_token_files(spark, monkeypatch):
    ids = [None, *range(50, 50 - len(ODD) + 1, -1)]
    plain = Tokenizer.from_file(BYTES)
    docs = table(spark, ODD, ids)
    manifest = tokenfile.with_starts(spark, tokenfile.write_tokens(docs, BYTES, 2, fresh_path(spark, "t")))
    start, want = 0, set()
    for i, t in sorted(zip(ids, ODD), key=lambda x: (x[0] is not None, x[0] or 0)):
        x = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.add((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert {tuple(r) for r in tokenfile.read_documents(manifest).collect()} == want
    one = manifest.orderBy("start").first()
    assert tokenfile.open_file(one["file"]).token(0) == 2  # the null text's end
    assert tokenfile.digest(docs.limit(0), BYTES).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=8), st.integers(1, 60))
def test_fullest_is_the_best_sum(counts, room):
    best = {0}
    for n, c in counts.items():
        best = {s + n * k for s in best for k in range(c + 1) if s + n * k <= room}
    combo = packing.fullest(counts, room)
    assert sum(n * k for n, k in combo.items()) == max(best) and all(k <= counts[n] for n, k in combo.items())


def test_packing(spark):
    texts = [*ODD, *["word " * k for k in range(1, 400, 7)], *["same text"] * 30, "w " * 5000]
    ids = [None if k == 3 else k // 2 if k > 40 else k for k in range(len(texts))]
    plain = Tokenizer.from_file(WORDS)
    rows = packing.digest(table(spark, texts, ids), WORDS).toPandas()
    want, total = Counter(), 0
    for i, t in zip(ids, texts):
        x = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(x)
        for k, lo in enumerate(range(0, len(x), 2048)):
            want[i, k, lo, len(x[lo : lo + 2048]), zlib.crc32(x[lo : lo + 2048].tobytes())] += 1
    got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples())
    assert got == want
    for _, x in rows.sort_values("offset").groupby("sequence_id"):
        assert x.offset.tolist() == [0, *np.cumsum(x.length)[:-1]] and x.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= -(-total // 2048) + 1
    assert packing.digest(table(spark, ["a"]).limit(0), WORDS).count() == 0


def test_sequences_hold_the_ids(spark):
    placed = packing.place(packing.encode_pieces(table(spark, ["one two three"] * 5 + [None]), WORDS, 0))
    rows = packing.sequences(placed).collect()
    assert len(rows) == 1
    ids = np.frombuffer(bytes(rows[0]["ids"]), "<u2").tolist()
    one = [*Tokenizer.from_file(WORDS).encode("one two three").ids]
    one = [x for x in one if x < 49406] + [0]
    assert Counter(ids) == Counter(one * 5 + [0])


def brute(vecs, ids, top=5):
    x = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    out = {}
    for i in range(len(ids)):
        if ids[i] % 50 == 0:
            s = x @ x[i]
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[i]][:top]
            out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16)) * 3
    v = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32).astype(float)
    v[100:1100] = v[100]  # a third of all rows are one vector
    ids = np.arange(3000)
    bad = [(5000, None, 1), (5050, [0.0] * 16, 1), (5100, [float("nan")] + [1.0] * 15, 1), (5150, [None] + [1.0] * 15, 1), (5200, [float("inf")] * 16, 1), (5250, [1.0, 2.0], 1), (5300, [], 1), (None, v[3].tolist(), 1)]
    rows = spark.createDataFrame([*((int(i), x.tolist(), 1) for i, x in zip(ids, v)), (50, v[50].tolist(), 1), *bad], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in multiindex.search(rows, "vec_id % 50 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id])
    want = brute(v, ids)
    assert set(got) == set(want)
    assert got[100] == [101, 102, 103, 104, 105] and got[150] == [100, 101, 102, 103, 104]
    assert np.mean([len(set(got[k]) & set(want[k])) / 5 for k in want]) >= 0.9


def test_search_of_few_rows(spark):
    shape = "vec_id long, embedding array<float>"
    assert multiindex.search(spark.createDataFrame([], shape), "vec_id % 50 = 0").count() == 0
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 2.0])], shape)
    got = multiindex.search(rows, "vec_id % 50 = 0").orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2)]
    assert math.isclose(got[0].score, math.sqrt(0.5)) and got[1].score == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 9), min_size=1, max_size=6), st.lists(st.floats(0, 9), min_size=1, max_size=6), st.integers(1, 30))
def test_traversal_goes_by_summed_distance(d1, d2, want):
    counts = np.arange(len(d1) * len(d2)) % 3
    sums = np.add.outer(d1, d2).ravel()
    cells = multiindex.traverse(np.array(d1), np.array(d2), counts, want)
    assert len(set(cells)) == len(cells) and all(counts[c] for c in cells)
    assert np.all(np.diff(sums[cells]) >= 0)
    rest = [c for c in range(len(counts)) if counts[c] and c not in cells]
    assert counts[cells].sum() >= min(want, counts.sum()) and all(sums[c] >= sums[cells[-1]] for c in rest)


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(maxent, "BLOCK_BYTES", 4000)
    rng = np.random.default_rng(8)
    a, b = [f"a{k}" for k in range(40)], [f"B{k}" for k in range(40)]
    texts = [" ".join(rng.choice(a if i % 2 else b, 60)) for i in range(300)] + [None, "", " \t", "unseen words only", "a1\x0bA1\xa0x"]
    ids = [*range(300), 1000, 1001, 1002, 1003, None]
    docs = table(spark, texts, ids)
    out = maxent.score(docs, held=id_crc_mod("doc_id", 10) == 0).toPandas()
    end, counts, words = object(), Counter(), []
    for i, t in zip(ids, texts):
        words.append([*(t or "").encode().lower().split(), end])
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update(words[-1])
    n, v = sum(counts.values()), len(counts)
    got = {None if r.doc_id != r.doc_id else int(r.doc_id): r for r in out.itertuples()}
    assert len(out) == len(texts) and set(out.train_tokens) == {n}
    for i, w in zip(ids, words):
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (got[i].n_tokens, got[i].n_known) == (len(w), sum(counts[x] > 0 for x in w))
        assert math.isclose(got[i].base_score, base, abs_tol=1e-6)
    held = out[out.held_out & (out.n_tokens > 10)]
    assert len(held) and held.score.sum() > held.base_score.sum() * 0.97  # the words before tell the half of the vocabulary
    assert maxent.score(docs.limit(0)).count() == 0
    assert maxent.score(docs.limit(3), held=id_crc_mod("doc_id", 1) == 0).filter("score is null or score > 0").count() == 0


def test_language_model_sums_to_one():
    sizes = maxent.sizes_for(900, 40)
    vocab = maxent.Vocabulary(900, 40, 3, 0, np.abs(np.random.default_rng(0).normal(size=(maxent.GROUPS, sizes.words))) * 50 + 0.1, np.full(maxent.TAILS, 2.0), sizes)
    rng = np.random.default_rng(1)
    m = maxent.Model(sizes, vocab.class_bias(), vocab.word_bias(), rng.normal(size=(sizes.class_rows, maxent.CLASSES)).astype(np.float32), rng.normal(size=(sizes.word_rows, sizes.words)).astype(np.float32))
    feats = [np.array([k], np.uint16) for k in (3, 9, 27, 81)]
    p = maxent._softmax(m.class_bias, m.by_class, feats)[0]
    inside = [maxent._softmax(m.word_bias[[c]], m.by_word, [np.array([c], np.uint16)])[0].sum() for c in range(maxent.GROUPS)]
    assert math.isclose(p.sum(), 1, abs_tol=1e-5) and np.allclose(inside, 1, atol=1e-5)


def test_the_model_grows_with_the_corpus():
    grown = [maxent.sizes_for(n, n // 10) for n in (10**6, 10**8, 10**9, 10**10, 10**11)]
    for a, b in zip(grown, grown[1:]):
        assert b.frequent >= a.frequent and b.class_rows >= a.class_rows and (b.frequent > a.frequent or b.class_rows > a.class_rows)
    for s in grown:
        codes = np.arange(1 << 16)
        kinds = s.class_of(codes)
        assert s.word_rows % (64 * maxent.GROUPS) == 0 and s.class_rows * maxent.CLASSES + s.word_rows * s.words <= 25 << 20
        assert np.bincount(kinds[: s.frequent]).tolist() == [s.words] * maxent.GROUPS and set(kinds[s.frequent : s.frequent + maxent.TAILS * s.hashes]) == set(range(maxent.GROUPS, maxent.CLASSES - 1))
        assert s.frequent + maxent.TAILS * s.hashes <= maxent.UNKNOWN and kinds[maxent.UNKNOWN] == maxent.CLASSES - 1


def by_hand(docs, vocab, rounds):
    """The model with a dictionary per feature: weights by (kind, hash) and gradients token by token; returns the scorer."""
    s = vocab.sizes
    each = s.word_rows // maxent.GROUPS

    def parts(codes):
        flat = [maxent.START] * 3 + codes
        for i, w in enumerate(codes, 3):
            w1, w2, w3 = flat[i - 1], flat[i - 2], flat[i - 3]
            h = lambda k, *c: int(maxent._mix(k, *[np.array([x], np.uint32) for x in c])[0])
            c = int(s.class_of(np.array([w]))[0])
            feats = [int(f[0]) for f in maxent.class_features(*[np.array([x], np.uint32) for x in (w1, w2, w3)], s)]
            yield w, c, feats, c * each + h(5, w1) % each if w < s.frequent else None

    def soft(bias, rows):
        z = bias + sum(rows, np.zeros(len(bias)))
        e = np.exp(z - z.max())
        return e / e.sum()

    zero = lambda n: lambda: np.zeros(n)
    cls, word = defaultdict(zero(maxent.CLASSES)), defaultdict(zero(s.words))
    cb, wb = vocab.class_bias().astype(float), vocab.word_bias().astype(float)
    for _ in range(rounds):
        seen, want, wseen, wwant = (defaultdict(zero(n)) for n in (maxent.CLASSES, maxent.CLASSES, s.words, s.words))
        for codes in docs:
            for w, c, feats, row in parts(codes):
                p = soft(cb, [cls[f] for f in feats])
                for f in feats:
                    seen[f][c] += 1
                    want[f] += p
                if row is not None:
                    wseen[row][w % s.words] += 1
                    wwant[row] += soft(wb[c], [word[row]])
        for f in seen:
            cls[f] = cls[f] + np.clip(maxent.STEP_CLASS * (seen[f] - want[f]) / (want[f] + maxent.PULL), -maxent.CLIP, maxent.CLIP)
        for f in wseen:
            word[f] = word[f] + np.clip(maxent.STEP_WORD * (wseen[f] - wwant[f]) / (wwant[f] + maxent.PULL), -maxent.CLIP, maxent.CLIP)

    def score(codes):
        total = 0.0
        for w, c, feats, row in parts(codes):
            total += math.log10(soft(cb, [cls[f] for f in feats])[c])
            if row is not None:
                total += math.log10(soft(wb[c], [word[row]])[w % s.words])
        return total

    return score


def test_gradients_and_scores_against_dictionaries(spark):
    rng = np.random.default_rng(13)
    texts = [" ".join(f"{'ab'[i % 2]}{k}" for k in rng.zipf(1.3, 40) if k < 3000) for i in range(50)]
    docs = table(spark, texts)
    held = F.col("doc_id") % 10 == 0
    blocks = maxent.vocabulary_blocks(docs, "doc_id", "text", held)
    coded, vocab = maxent.count_words(blocks)
    vocab.sizes = maxent.Sizes(2, 256, 64)  # few frequent tokens, so that all kinds of tokens occur, and collisions
    rows = maxent.encode(blocks, coded, vocab).collect()
    codes = {r.doc_id: np.frombuffer(r.codes, np.uint16).tolist() for r in rows}
    frame = spark.createDataFrame([(r.doc_id, r.held, r.codes) for r in rows], "doc_id long, held boolean, codes binary").repartition(3)
    vocab.word_mass = vocab.word_mass.reshape(-1)[: 2 * maxent.GROUPS].reshape(maxent.GROUPS, 2)
    hand = by_hand([codes[r.doc_id] for r in rows if not r.held], vocab, 2)
    m = maxent.train(frame, vocab, 2)
    for i in (0, 10, 3):
        lg = 0.0
        for _, w, cls, feats, inner, word in maxent.batches_of([np.array(codes[i], np.uint16).tobytes()], m.sizes):
            p = maxent._softmax(m.class_bias, m.by_class, feats)
            lg += np.log10(p[np.arange(len(w)), cls]).sum()
            if len(inner):
                q = maxent._softmax(m.word_bias[cls[inner]], m.by_word, [word])
                lg += np.log10(q[np.arange(len(inner)), (w[inner] % m.sizes.words).astype(np.int64)]).sum()
        assert math.isclose(lg, hand(codes[i]), rel_tol=1e-4)


HTML = [
    ("<p>One   two<p>three<br>four", "One two\n\nthree\nfour"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>z", "- a\n- b\n  3. c\n  4. d\n- e\n\nz"),
    ("<table><tr><td>Name<td>Qty<tr><td>apple pie<td>3</table>", "Name       Qty\napple pie  3"),
    ("<table><tr><th rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<style>.x,#y{display:none}</style><div class='q x'>no</div><b id=y>no</b><i hidden>no</i><span style='visibility: hidden'>no</span>yes", "yes"),
    ("<head><title>t</title><script>if(a<b)</script></head>a &lt; b &amp; c<!-- no -->", "a < b & c"),
    ("<pre>  keep\n   this</pre>", "  keep\n   this"),
    ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    ("<h1>A</h1>b<hr>c</div></p>d", "A\n\nb\n\nc\n\nd"),
    ("plain < text & more", "plain < text & more"),
    ("<script>never ended", ""),
    ("<a title='x>y'>link</a> <img alt=z>in line", "link in line"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
    (None, ""),
    ("", ""),
]


@pytest.mark.parametrize("html,text", HTML)
def test_render(html, text):
    assert htmltext.render(html) == text


def test_render_deep_and_long():
    assert htmltext.render("<div>" * 50_000 + "x") == "x"
    assert htmltext.render("<p>" + "word " * 100_000).count("word") == 100_000
    wide = htmltext.render("<table>" + f"<tr><td>{'w' * 5000}<td>x" + "<tr><td>a<td>b" * 500 + "</table>")
    assert len(wide) < 50_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<td>", "</table>", "<table>", "<tr>", "<li>", "<ul>", "</ul>", "<pre>", "</pre>", "text", " ", "<br>", "<a b='c", "'>", "&amp;", "<!--", "-->", "<details>", "</td>", "<", ">", "</"]), max_size=30))
def test_render_of_anything(parts):
    assert isinstance(htmltext.render("".join(parts)), str)


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], "page_id long, url string, html string")
    assert sorted(map(str, htmltext.extract(pages, keep=("url",)).collect())) == sorted(["Row(page_id=1, url='u', text='a')"] * 2 + ["Row(page_id=None, url=None, text='')"])
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_shared_folder(spark):
    assert shared_dir(spark).startswith("file:") or os.path.isabs(shared_dir(spark))


def test_ten_queries_and_stages():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables absent")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for name, fn in corpus_pipeline.STAGES[:4]:
        now = fn(spark, now, sf)
        assert now.columns == docs.columns, name
        now = corpus_pipeline.stage(now, "t")
        assert 0 < now.select("doc_id").distinct().count() <= docs.count()
    out = corpus_pipeline.pack(spark, now, sf).toPandas()
    assert (out.groupby("sequence_id").length.sum() <= 2048).all()
    assert len(out[out.piece == 0]) == now.count()
