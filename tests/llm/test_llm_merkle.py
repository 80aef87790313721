"""The Merkle manifest against a plain one, and its oracle SQL on odd rows."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, idx int"


def joined(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([joined(*out[-1][k : k + fan]) for k in range(0, len(out[-1]), fan)])
    return out


def way(lev, i, fan):
    out = []
    for nodes in lev[:-1]:
        first = i - i % fan
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fan])))
        i //= fan
    return out


def plain(rows, fan=2):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, text, lang, source, n_chars)."""
    leaf = lambda r, d=0: joined(*(field(x) for x in (r[0], r[3], r[2], None if r[4] is None else r[4] + d, r[1])))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]], fan)
    crown = levels([trees[g][-1][0] for g in names], fan)
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = way(trees[g], i, fan) + way(crown, k, fan)
            h = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for a, b in steps:
                h = joined(a, h, b)
            out.append((r[0], leaf(r), trees[g][-1][0], crown[-1][0], joined(*(a + b for a, b in steps)), h, h == crown[-1][0]))
    return sorted(out, key=str)


def odd_rows():
    """Null, negative, sparse, repeated and huge ids; null and single groups; groups of one to thousands of leaves."""
    ids = [None, None, -1, -(2**63), 2**63 - 1, 0, 63, 64, 65, 1 << 16, (1 << 16) - 1, 1 << 33, 5, 5, 5, 5, 700, 700]
    rows = [(i, f"té {k % 4}" if k % 5 else None, "en", "s", k % 3 or None) for k, i in enumerate(ids)]
    rows += [(i * 37 % 4099, f"x{i}", "de", f"s{i % 3}", i) for i in range(2500)]
    rows += [(1, "a" * 70_000, "ﬁ", None, 9), (7, "", None, "", 0), (7, "", None, "", 0), (8, "b", "Z", "q", 1), (9, "b", "é", "q", 1)]
    return rows


def test_proofs_are_those_of_a_plain_tree(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "other", 1) for r in rows], SCHEMA)
    got = merkle.digest(docs)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    assert merkle.digest(docs.limit(0)).count() == 0
    one = docs.filter("lang = 'Z'")
    assert [tuple(r) for r in merkle.digest(one).collect()] == plain([r for r in rows if r[2] == "Z"])


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_any_fan_and_small_arrays(spark, monkeypatch, fan):
    monkeypatch.setattr(merkle, "SLOTS", 20)
    rows = [r for r in odd_rows() if r[2] != "de" or r[0] < 900]
    docs = spark.createDataFrame([(*r, "other", 1) for r in rows], SCHEMA)
    leaf = merkle.leaf_hash(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    out = merkle.manifest(docs, "lang", "doc_id", leaf, {"text": F.col("text")}, fan)
    got = out.select("id", "leaf", "subroot", "root", merkle.proof_hash().alias("p"), merkle.fold(F.col("leaf")).alias("f"), "text").collect()
    assert all(r.f == r.root for r in got)
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted([w[:5] for w in plain(rows, fan)], key=str)


def test_places_are_ranks(spark):
    """Without repeated ids the bitmaps alone say where a leaf stands."""
    rows = spark.range(0, 90_000, 7).select(F.col("id").alias("id"), (F.col("id") % 3).cast("string").alias("g"), F.lit("h").alias("digest"))
    placed, sizes = merkle.place(rows, "g", "id", "digest")
    for g, x in placed.toPandas().groupby("g"):
        assert x.sort_values("id").idx.tolist() == list(range(len(x)))
    assert sum(r.n for r in sizes.collect()) == rows.count()


def test_oracle_sql_on_odd_rows():
    rows = [r for r in odd_rows() if (r[2] != "de" or r[0] < 200) and r[4] != 2**63 - 1]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    got = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle.SQL})").fetchall()
    assert sorted(got, key=str) == plain(rows)
