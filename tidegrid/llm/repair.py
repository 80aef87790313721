"""Conversation repair: least edits to a lawful order of roles, by min-plus matrices over a Re-Pair grammar."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import BLANKS, stage
from tidegrid.operators.scan import number_rows

SEGMENT = 4096  # rows of a conversation whose matrix is made at once
MOST_RULES = 4096  # of the grammar; what it doesn't cover is multiplied symbol by symbol
SAVING = 0.005  # share of the symbols that a pair must save to become a rule
STATES = 4  # nothing yet, system, user, assistant
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5  # costs
INF = 1 << 60
CLASSES = "sua?"  # first letters of roles, anything else last
FAULTS = ("", "truncated", "blank", "duplicate")
#: From a state by a user's, and by a role of each class: where the row leads, -1 if it may not stand there.
_BY_CLASS = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1), "?": (-1, -1, -1, -1)}
_MADE = (2, 2, 3, 2)  # by an inserted or re-roled row: an assistant's after a user's, else a user's

Rope = str | tuple  # a text, or two ropes


def text_of(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            todo += [r[1], r[0]]
    return "".join(out)


class Block:
    """What a run of rows does: the cheapest way from each state to each with its edits, and its counts."""

    __slots__ = ("cost", "audit", "counts", "illegal", "first", "last")

    def __init__(self, cost, audit, counts=(0, 0, 0, 0), illegal=0, first="", last=""):
        self.cost, self.audit, self.counts, self.illegal, self.first, self.last = cost, audit, counts, illegal, first, last

    def then(self, nxt: Block) -> Block:
        """Min-plus product; of equal costs the ASCII-least edits. At equal cost no way over the same rows between
        the same states begins another (what is left over would be insertions, which cost), so the order of
        texts goes through products and a product keeps one way per pair of states."""
        cost, audit = [INF] * 16, [None] * 16
        for p in range(STATES):
            for q in range(STATES):
                at = 4 * p + q
                best, ways = INF, []
                for r in range(STATES):
                    c = self.cost[4 * p + r] + nxt.cost[4 * r + q]
                    if c < best:
                        best, ways = c, [r]
                    elif c == best < INF:
                        ways.append(r)
                if best < INF:
                    ropes = [(self.audit[4 * p + r], nxt.audit[4 * r + q]) for r in ways]
                    cost[at], audit[at] = best, ropes[0] if len(ropes) == 1 else min(ropes, key=text_of)
        counts = tuple(a + b for a, b in zip(self.counts, nxt.counts))
        seam = int(bool(self.last and nxt.first) and self.last + nxt.first not in ("su", "ua", "au"))
        return Block(cost, audit, counts, self.illegal + nxt.illegal + seam, self.first or nxt.first, nxt.last or self.last)


def _block(ways: Iterable[tuple[int, int, int, str]], **more) -> Block:
    cost, audit = [INF] * 16, [None] * 16
    for p, q, c, letters in ways:
        if (c, letters) < (cost[4 * p + q], audit[4 * p + q] or "~"):
            cost[4 * p + q], audit[4 * p + q] = c, letters
    return Block(cost, audit, **more)


#: Rows inserted between two others: more than two never help.
_INSERTS = _block([(p, p, 0, "") for p in range(STATES)] + [(p, _MADE[p], INSERT, "I") for p in range(STATES)] + [(p, _MADE[_MADE[p]], 2 * INSERT, "II") for p in range(STATES)])


def symbol(role: Column, blank: Column, duplicate: Column, truncated: Column) -> Column:
    """One letter per row: class of the role and first fault."""
    head = F.substring(role, 1, 1)
    of_class = F.when(head == "s", 0).when(head == "u", 1).when(head == "a", 2).otherwise(3)
    of_fault = F.when(blank, 2).when(duplicate, 3).when(truncated, 1).otherwise(0)
    return F.char(F.lit(65) + of_fault * 4 + of_class)


def _of_symbol(c: str) -> Block:
    fault, kind = divmod(ord(c) - 65, 4)
    kind = CLASSES[kind]
    ways = [(p, p, DELETE, "D") for p in range(STATES)]
    if FAULTS[fault] in ("", "truncated"):
        more = TRUNCATED if fault else 0
        ways += [(p, q, more, "K") for p, q in enumerate(_BY_CLASS[kind]) if q >= 0]
        ways += [(p, _MADE[p], REROLE + more, "R") for p in range(STATES)]
    return _block(ways, counts=tuple(int(k == fault) for k in range(4)), first=kind, last=kind).then(_INSERTS)


@lru_cache(maxsize=4)
def _blocks(rules: tuple[str, ...]) -> dict[str, Block]:
    """The block of each letter and, from the bottom up, of each rule: made once per worker, whatever shares it."""
    found = {chr(65 + k): _of_symbol(chr(65 + k)) for k in range(16)}
    for k, pair in enumerate(rules):
        found[chr(256 + k)] = found[pair[0]].then(found[pair[1]])
    return found


def parsed(codes: str, rules: tuple[str, ...]) -> str:
    for k, pair in enumerate(rules):
        codes = codes.replace(pair, chr(256 + k))  # from the left, without overlaps
    return codes


def block_of(codes: str, rules: tuple[str, ...] = ()) -> Block:
    """The block of a sequence of letters; the same whatever the rules are."""
    blocks, out = _blocks(rules), _INSERTS
    for c in parsed(codes, rules):
        out = out.then(blocks[c])
    return out


def re_pair(shapes: DataFrame) -> tuple[str, ...]:
    """Rules of two symbols each over (codes, n): the most frequent pairs become symbols, in rounds.

    A round counts the pairs of all distinct sequences in their tasks and brings at most 64 sums to the driver; pairs that
    share no symbol become rules together. It ends when no pair saves 0.5 % of the symbols that are left."""
    rules: tuple[str, ...] = ()
    while len(rules) < MOST_RULES:

        def count(batches: Iterator[pa.RecordBatch], rules=rules) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            for b in batches:
                for codes, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    left = parsed(codes, rules)
                    seen[""] += n * len(left)
                    for pair, k in Counter(map(str.__add__, left, left[1:])).items():
                        seen[pair] += n * k
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pair", "n"])

        sums = shapes.select("codes", "n").mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = sums.orderBy(F.col("pair") != "", F.desc("n"), "pair").limit(65).collect()
        left = next((r.n for r in top if r.pair == ""), 0)
        new, used = [], set()
        for r in top:
            if r.pair and r.n >= max(2, SAVING * left) and not used & set(r.pair):
                new.append(r.pair)
                used |= set(r.pair)
        if not new:
            break
        rules += tuple(new)
    return rules[:MOST_RULES]


def evaluate(shapes: DataFrame) -> DataFrame:
    """(codes, cost, audit, blank, duplicate, truncated, illegal, first, last) of each distinct sequence: matrices of
    16 costs (null: no way) and edits, by rows of the state before."""
    rules = re_pair(shapes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                for codes in b.column(0)[at : at + 256].to_pylist():
                    x = block_of(codes, rules)
                    rows.append({"codes": codes, "cost": [None if c == INF else c for c in x.cost], "audit": [None if a is None else text_of(a) for a in x.audit], "truncated": x.counts[1], "blank": x.counts[2], "duplicate": x.counts[3], "illegal": x.illegal, "first": x.first, "last": x.last})
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    shape = pa.schema([("codes", pa.string()), ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string()))] + [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")] + [("first", pa.string()), ("last", pa.string())])
    return shapes.select("codes").mapInArrow(run, "codes string, cost array<bigint>, audit array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, pos, code) of each row (conv_id, turn, role, text), none of role and text null.

    Rows are in order of turn (nulls first), role and md5 of the text; ``pos`` counts them in their conversation.
    A duplicate is not the first of its role and text; so it is judged by the first place of that pair, a sum per pair."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    done = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1).isin(".", "!", "?")
    slim = rows.select("conv_id", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("h"), blank.alias("blank"), (~done).alias("truncated"))
    placed = stage(number_rows(stage(slim, "turns"), ["conv_id"], ["turn", "role", "h"], "pos"), "placed")
    pairs = placed.filter(~F.col("blank")).groupBy("conv_id", "role", "h").agg(F.min("pos").alias("_p0"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    pairs = pairs.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h").alias("_h"), "_p0")
    met = placed.join(pairs, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("h") == F.col("_h")), "left")
    return met.select("conv_id", "turn", "role", "h", "pos", symbol(F.col("role"), F.col("blank"), F.coalesce(F.col("pos") > F.col("_p0"), F.lit(False)), F.col("truncated")).alias("code"))


def plan_edits(coded: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation with rows.

    Conversations are cut into stretches of 4,096 rows; equal stretches are worked out once, by the grammar, and
    a conversation is the product of its stretches in order, of which four ways are held at a time."""
    per = coded.groupBy("conv_id", F.floor(F.col("pos") / SEGMENT).alias("seg")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("s"),
        F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.size(F.collect_set("turn")).cast("long").alias("turns"),
    )
    segs = stage(per.select("conv_id", "seg", "lo", "hi", "turns", F.array_join("s.code", "").alias("codes")), "stretches")
    shapes = stage(segs.groupBy("codes").agg(F.count(F.lit(1)).alias("n")), "shapes")
    values = stage(evaluate(shapes), "blocks")
    rows = segs.join(values, "codes").drop("codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, live = [], None
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                for r in b.slice(lo, 256).to_pylist():
                    if live is None or r["conv_id"] != live.conv:
                        if live is not None:
                            out.append(live.result())
                        live = _Running(r["conv_id"])
                    live.add(r)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=shape)
                    out = []
        if live is not None:
            yield pa.RecordBatch.from_pylist([*out, live.result()], schema=shape)

    shape = pa.schema([(n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return ordered.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


class _Running:
    """A conversation up to some stretch: the cheapest ways from the start to each state."""

    def __init__(self, conv):
        self.conv, self.cost, self.audit, self.last = conv, [0, INF, INF, INF], ["", None, None, None], ""
        self.n, self.lo, self.hi, self.turns = [0] * 4, None, None, 0

    def add(self, r: dict) -> None:
        cost, audit = [INF] * STATES, [None] * STATES
        for q in range(STATES):
            ways = [(self.cost[p] + r["cost"][4 * p + q], p) for p in range(STATES) if self.cost[p] < INF and r["cost"][4 * p + q] is not None]
            if ways:
                cost[q] = min(ways)[0]
                ropes = [(self.audit[p], r["audit"][4 * p + q]) for c, p in ways if c == cost[q]]
                audit[q] = ropes[0] if len(ropes) == 1 else min(ropes, key=text_of)
        self.cost, self.audit = cost, audit
        seam = bool(self.last) and self.last + r["first"] not in ("su", "ua", "au")
        self.n = [a + b for a, b in zip(self.n, (r["blank"], r["duplicate"], r["truncated"], r["illegal"] + seam))]
        self.last = r["last"]
        if r["lo"] is not None:
            self.turns += r["turns"] - (self.hi == r["lo"])
            self.lo, self.hi = r["lo"] if self.lo is None else self.lo, r["hi"]

    def result(self) -> dict:
        cost, audit = min((self.cost[q], text_of(self.audit[q])) for q in (0, 3) if self.cost[q] < INF)
        gaps = 0 if self.lo is None else self.hi - self.lo + 1 - self.turns
        return dict(zip(("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), (self.conv, gaps, *self.n, cost, audit)))


def _with_plans(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's edits and then its rows, sorted as in ``faults``."""
    none = F.lit(None).cast("string")
    each = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("h"), "text", none.alias("audit"))
    heads = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"), none.alias("role"), none.cast("binary").alias("h"), none.alias("text"), "audit")
    both = heads.unionAll(each).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "h")
    return both.select("conv_id", "kind", "role", "text", "audit")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edit, role, text) of the rows that stay or are put in; a conversation begins with an edit of None."""
    conv, audit, k, state = None, "", 0, 0

    def inserts():
        nonlocal k, state
        while audit[k : k + 1] == "I":
            state, k = _MADE[state], k + 1
            yield conv, "I", ("user", "assistant")[state - 2], ""

    for b in batches:
        for lo in range(0, b.num_rows, 512):
            for r in b.slice(lo, 512).to_pylist():
                yield from inserts()
                if r["kind"] == 0:
                    conv, audit, k, state = r["conv_id"], r["audit"], 0, 0
                    yield conv, None, None, None
                    continue
                edit, k = audit[k], k + 1
                if edit == "R":
                    state = _MADE[state]
                    yield conv, edit, ("user", "assistant")[state - 2], r["text"]
                elif edit == "K":
                    state = _BY_CLASS[r["role"][:1]][state]
                    yield conv, edit, r["role"], r["text"]
    yield from inserts()


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, nth, edit, role, text): the rows that stay or are put in, in order, with the edit of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, nth = [], 0
        for conv, edit, role, text in _replay(batches):
            if edit is None:
                nth = 0
                continue
            out.append({"conv_id": conv, "nth": nth, "edit": edit, "role": role, "text": text})
            nth += 1
            if len(out) >= 512:
                yield pa.RecordBatch.from_pylist(out, schema=shape)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    shape = pa.schema([("conv_id", pa.int64()), ("nth", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return _with_plans(rows, plans).mapInArrow(run, "conv_id long, nth long, edit string, role string, text string")


def repaired_hashes(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the repaired ``role:text`` lines, joined by newlines, as a hash.

    A hash is made in order, so a conversation's rows pass through one task, a batch at a time; no more than its
    edits (a letter a row) is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sha, first = [], None, True
        for conv, edit, role, text in _replay(batches):
            if edit is None:
                if sha is not None:
                    out.append({"conv_id": at, "repaired_sha256": sha.hexdigest()})
                at, sha, first = conv, hashlib.sha256(), True
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, schema=shape)
                    out = []
                continue
            sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False
        if sha is not None:
            out.append({"conv_id": at, "repaired_sha256": sha.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    shape = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    return _with_plans(rows, plans).mapInArrow(run, "conv_id long, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults; null roles and texts become one space, as null keys do in the hash."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    m = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    d = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), m.alias("m")).filter("m <> 0")
    d = d.withColumns({"role": F.when(F.col("m") == 4, "user").otherwise(F.col("role")), "text": F.when(F.col("m") == 1, "").when(F.col("m") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))})
    once = F.array(F.lit(1))
    return d.withColumn("copy", F.explode(F.when(F.col("m") == 3, F.array(F.lit(1), F.lit(2))).otherwise(once))).drop("m", "copy")


def digest(conversations: DataFrame) -> DataFrame:
    """What repair finds and does in each conversation after damage; conversations that lost all rows have zeros.

    Null conversation ids are one conversation; rows equal in turn are in order of role and md5 of the text, rows
    that repeat are duplicates. A role that is empty or begins with another letter than s, u and a cannot stay.
    Texts of any length are single rows; no rows give none. Columns besides the four named are not read."""
    rows = damage(conversations)
    plans = stage(plan_edits(faults(rows)), "plans")
    hashes = repaired_hashes(rows, plans)
    found = plans.join(hashes.select(F.col("conv_id").alias("_c"), "repaired_sha256"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    every = conversations.select(F.col("conv_id").cast("long").alias("_c")).distinct()
    out = every.join(found, F.col("_c").eqNullSafe(F.col("conv_id")), "left")
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(F.col("_c").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _step(p: str, nxt: str) -> str:
    """Cheapest edits from state p of one row and all after it, as a struct that sorts by cost and edits."""
    keep = {"0": "CASE c WHEN 's' THEN fs WHEN 'u' THEN fu END", "s": "CASE c WHEN 'u' THEN fu END", "u": "CASE c WHEN 'a' THEN fa END", "a": "CASE c WHEN 'u' THEN fu END"}[p]
    made = "assistant" if p == "u" else "user"
    add = lambda f, cost, letter, line: f"struct_pack(c := ({f}).c + {cost}, e := '{letter}' || ({f}).e, t := {f'[{line}] || ' if line else ''}({f}).t)"
    return f"""list_min([{add('f' + p, DELETE, 'D', '')},
      CASE WHEN fault < 2 AND ({keep}) IS NOT NULL THEN {add(keep, 'fault * 5', 'K', "role || ':' || text")} END,
      CASE WHEN fault < 2 THEN {add('f' + nxt, '1 + fault * 5', 'R', f"'{made}:' || text")} END])"""


def _insert(p: str, d: dict[str, str]) -> str:
    add = lambda f, cost, letters, lines: f"struct_pack(c := ({f}).c + {cost}, e := '{letters}' || ({f}).e, t := {lines} || ({f}).t)"
    if p == "u":
        return f"list_min([{d['u']}, {add(d['a'], 5, 'I', "['assistant:']")}])"
    if p == "a":
        return f"list_min([{d['a']}, {add(d['u'], 5, 'I', "['user:']")}])"
    return f"list_min([{d[p]}, {add(d['u'], 5, 'I', "['user:']")}, {add(d['a'], 10, 'II', "['user:', 'assistant:']")}])"


_D = {p: f"d{p}" for p in "0sua"}
_END = {"0": "struct_pack(c := 0, e := '', t := []::VARCHAR[])", "s": "struct_pack(c := 10, e := 'II', t := ['user:', 'assistant:'])", "u": "struct_pack(c := 5, e := 'I', t := ['assistant:'])", "a": "struct_pack(c := 0, e := '', t := []::VARCHAR[])"}

SQL = f"""
WITH RECURSIVE bits(b, k, r) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM bits WHERE k < 8
), tbl AS (SELECT b, r FROM bits WHERE k = 8
), src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations
), crc(s, k, c) AS (
  SELECT DISTINCT s, 0, 4294967295::BIGINT FROM src
  UNION ALL SELECT s, k + 1, xor(c >> 8, r) FROM crc JOIN tbl ON b = xor(c & 255, ord(s[k + 1])) WHERE k < length(s)
), code AS (SELECT s, xor(c, 4294967295) % 20 AS m FROM crc WHERE k = length(s)
), dam AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text,
    unnest(range(CASE m WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM src JOIN code USING (s)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM dam
), judged AS (
  SELECT *, left(role, 1) AS c, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS was, CASE
      WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 2
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3
      WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault
  FROM ranked
), rec(conv_id, i, f0, fs, fu, fa) AS (
  SELECT DISTINCT conv_id, n + 1, {_END['0']}, {_END['s']}, {_END['u']}, {_END['a']} FROM judged
  UNION ALL
  SELECT conv_id, i, {', '.join(_insert(p, _D) for p in '0sua')}
  FROM (SELECT j.conv_id, j.i, {_step('0', 'u')} AS d0, {_step('s', 'u')} AS ds, {_step('u', 'a')} AS du, {_step('a', 'u')} AS da
        FROM rec JOIN judged j ON j.conv_id IS NOT DISTINCT FROM rec.conv_id AND j.i = rec.i - 1)
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 2) AS blank, count(*) FILTER (WHERE fault = 3) AS duplicate,
    count(*) FILTER (WHERE fault = 1) AS truncated, count(*) FILTER (WHERE was IS NOT NULL AND was || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(f0.c, 0)::BIGINT AS cost, coalesce(f0.e, '') AS audit, sha256(coalesce(array_to_string(f0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN rec ON rec.conv_id IS NOT DISTINCT FROM o.conv_id AND rec.i = 1
"""
