"""Conversation repair against a plain dynamic program, on odd conversations and long ones."""

import hashlib
import random
import zlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, pos string, code int"
NEXT = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
WHO = {"0": "user", "s": "user", "a": "user", "u": "assistant"}


def cheapest(rows):
    """(cost, edits, lines) over rows of (role, text, fault), from the last row back."""
    after = {p: (0, "", ()) if p in "0a" else None for p in "0sua"}

    def with_inserts(now):
        out = {}
        for p in "0sua":
            ways, q, lines = [now[p]] if now[p] else [], p, ()
            for k in range(1, 4):
                lines += (WHO[q] + ":",)
                q = WHO[q][0]
                if now[q]:
                    ways.append((5 * k + now[q][0], "I" * k + now[q][1], lines + now[q][2]))
            out[p] = min(ways)
        return out

    f = with_inserts(after)
    for role, text, fault in reversed(rows):
        d = {}
        for p in "0sua":
            ways = [(2 + f[p][0], "D" + f[p][1], f[p][2])]
            if fault not in ("blank", "duplicate"):
                more, q = 5 * (fault == "truncated"), NEXT[p].get(role[:1])
                if q:
                    ways.append((more + f[q][0], "K" + f[q][1], (f"{role}:{text}", *f[q][2])))
                q = WHO[p][0]
                ways.append((1 + more + f[q][0], "R" + f[q][1], (f"{WHO[p]}:{text}", *f[q][2])))
            d[p] = min(ways)
        f = with_inserts(d)
    return f["0"]


def plain(table):
    """The contract's columns by conversation."""
    convs = {}
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        m = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows = convs.setdefault(conv, [])
        if m == 4:
            role = "user"
        text = "" if m == 1 else text.translate(str.maketrans("", "", ".!?")) if m == 2 else text
        rows += [(turn, role, text)] * (0 if m == 0 else 2 if m == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, judged = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            judged.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, lines = cheapest(judged)
        count = [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_table():
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(90)]:
        turn = rng.randrange(-2, 3)
        for _ in range(rng.choice([1, 2, 4, 9, 30])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "user", "assistant", "tool", "", None, "u", "Ünal"])
            text = rng.choice(["Yes.", "no", "so!", "Why? ", "", None, " \t", "end.\n", "x" + str(rng.randrange(9)), "é.", "\xa0"])
            rows.append((conv, None if rng.random() < 0.05 else turn, role, text))
            turn += rng.choice([0, 1, 1, 1, 1, 3])
    rows += [(500, t, ("user", "assistant")[t % 2], "a." * 40_000 + str(t) + ".") for t in range(3)]
    return rows


def check(spark, table):
    rows = spark.createDataFrame([(*r, "p", 1) for r in table], SCHEMA)
    assert sorted(map(tuple, repair.digest(rows).collect()), key=str) == plain(table)


def test_repair_of_odd_conversations(spark):
    table = odd_table()
    check(spark, table)
    assert repair.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_and_repeated_conversations(spark, monkeypatch):
    """Stretches shorter than a conversation, and conversations that share them."""
    monkeypatch.setattr(repair, "SEGMENT", 16)
    rng = random.Random(6)
    body = [(t, "suauaaut"[rng.randrange(8)], rng.choice(["ok.", "no", "", f"t{t}."])) for t in range(300)]
    name = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    check(spark, [(c, t // 2, name[r], x) for c in range(6) for t, r, x in body])


def test_all_rows_lost(spark):
    lost = [(c, t) for c in range(40) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert lost
    check(spark, [(c, t, "user", "hi.") for c, t in lost])


def test_oracle_sql_on_odd_conversations():
    table = [r for r in odd_table() if r[0] != 500]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", table)
    got = con.execute(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({repair.SQL})").fetchall()
    assert sorted(got, key=str) == plain(table)


def test_repaired_rows(spark):
    table = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (2, 0, "assistant", "only.")]
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    plans = repair.plan_edits(repair.faults(rows))
    got = {}
    for r in repair.repaired(rows, plans).orderBy("conv_id", "nth").collect():
        got.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert got[1] == [("K", "user", "b."), ("K", "assistant", "c.")] and got.get(2) is None
    assert {r.conv_id: r.audit for r in plans.collect()} == {1: "DKK", 2: "D"}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=[chr(65 + k) for k in range(16)], min_size=1, max_size=12), st.lists(st.text(alphabet=[chr(65 + k) for k in range(16)], min_size=2, max_size=2), max_size=4))
def test_rules_change_nothing(codes, rules):
    def best(b):
        return min((b.cost[q], repair.text_of(b.audit[q])) for q in (0, 3) if b.cost[q] < repair.INF)

    rows = [("suat"[(ord(c) - 65) % 4], "x", ("", "truncated", "blank", "duplicate")[(ord(c) - 65) // 4]) for c in codes]
    with_rules = repair.block_of(codes, (*rules, codes[:2].ljust(2, "B"), "AĀ"))
    assert best(with_rules) == best(repair.block_of(codes)) == cheapest(rows)[:2]
    assert with_rules.counts == repair.block_of(codes).counts and with_rules.illegal == repair.block_of(codes).illegal


def test_grammar_covers_common_shapes(spark):
    shapes = spark.createDataFrame([("ABC" + "BC" * k, 10) for k in range(40)] + [("A", 1)], "codes string, n long")
    rules = repair.re_pair(shapes)
    assert "BC" in rules and max(len(repair.parsed("ABC" + "BC" * k, rules)) for k in range(40)) <= 12
