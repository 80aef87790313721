"""Merkle manifest of a table: leaves placed by ranks in bitmaps, levels reduced by keyed slot arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import stage
from tidegrid.operators.scan import number_rows

SLOTS = 1024  # nodes of one array, at most

_SHAPE = "before array<string>, after array<string>"


def leaf_hash(*fields: Column) -> Column:
    """Lowercase hex sha256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def rank_directory(rows: DataFrame, group: str, id_col: str) -> DataFrame:
    """(g, word, bits, n, before): the bitmap of a group's ids, one row per 64-bit word that is not empty.

    Words are merged map-side; ``n`` rows have their id in the word, ``before`` of the group's rows have a smaller word.
    Counts are summed in a directory of three levels above the words (2^16, 2^32 and 2^48 ids a step), so that no window
    sees more than 65,536 steps, whatever the ids are. Null ids are a word of their own, before all others."""
    i = F.col(id_col)
    bit = F.expr(f"shiftleft(1L, CAST(`{id_col}` & 63 AS INT))")
    words = rows.groupBy(F.col(group).alias("g"), F.shiftright(i, 6).alias("word")).agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n"))
    words = stage(words, "words")
    steps = [words.withColumns({"c1": F.shiftright("word", 10), "c2": F.shiftright("word", 26), "c3": F.shiftright("word", 42)})]
    for key in (["c1", "c2", "c3"], ["c2", "c3"], ["c3"]):
        steps.append(steps[-1].groupBy("g", *key).agg(F.sum("n").alias("n")))
    found = None
    for k in (3, 2, 1, 0):  # from the coarsest: rows before a step are those before its parent and its elder siblings
        own, parent = ("c3", "c2", "c1", "word")[3 - k], ("c3", "c2", "c1")[2 - k] if k < 3 else None
        elder = Window.partitionBy("g", *([parent] if parent else [])).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
        here = steps[k].withColumn("_elder", F.coalesce(F.sum("n").over(elder), F.lit(0)))
        if found is not None:
            above = found.select(F.col("g").alias("_g"), F.col(parent).alias("_p"), F.col("before").alias("_above"))
            here = here.join(above, F.col("g").eqNullSafe(F.col("_g")) & F.col(parent).eqNullSafe(F.col("_p"))).drop("_g", "_p")
        else:
            here = here.withColumn("_above", F.lit(0))
        found = here.withColumn("before", F.col("_above") + F.col("_elder")).drop("_above", "_elder")
    return stage(found.select("g", "word", "bits", "n", "before"), "directory")


def place(rows: DataFrame, group: str, id_col: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (a stored table) with ``idx``, the place of each in its group by ascending id, and (g, n) of the groups.

    A rank query counts the bits below an id in its word: no sort. Only words in which an id repeats, and null ids, are
    numbered, by id and ``tie``, through sampled bounds, so a repeated id may hold any share of the rows."""
    words = rank_directory(rows, group, id_col)
    sizes = stage(words.groupBy("g").agg(F.sum("n").alias("n")), "sizes")
    d = words.withColumnsRenamed({"g": "_g", "word": "_w", "n": "_n"})
    w = F.shiftright(id_col, 6)
    met = rows.join(d, F.col(group).eqNullSafe(F.col("_g")) & w.eqNullSafe(F.col("_w")))
    below = F.expr(f"bit_count(bits & ~shiftleft(-1L, CAST(`{id_col}` & 63 AS INT)))")
    plain = F.coalesce(F.bit_count("bits") == F.col("_n"), F.lit(False))
    sole = met.filter(plain).withColumn("idx", F.col("before") + below).select(*rows.columns, "idx")
    if not words.filter(~F.coalesce(F.bit_count("bits") == F.col("n"), F.lit(False))).limit(1).count():
        return sole, sizes
    again = stage(met.filter(~plain).select(*rows.columns, "_g", "_w", "before"), "repeated")
    again = number_rows(again, ["_g", "_w"], [id_col, tie], "_nth").withColumn("idx", F.col("before") + F.col("_nth"))
    return sole.unionByName(again.select(*rows.columns, "idx")), sizes


def _up(nodes: list[str], levels: int, fan: int) -> list[list[str]]:
    """A block's levels, the given nodes first; every ``fan`` consecutive ones, the last run fewer, become their hash."""
    out = [nodes]
    for _ in range(levels):
        now = out[-1]
        out.append([hashlib.sha256("".join(now[k : k + fan]).encode()).hexdigest() for k in range(0, len(now), fan)])
    return out


def _levels(n: int, fan: int, most: int) -> int:
    """Levels until one of n nodes is left, ``most`` at a time."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // fan), k + 1
    return k


@dataclass
class Tree:
    """Slot arrays of each stretch of levels, from the leaves up, and the top node of each group."""

    slots: list[DataFrame]  # (g, blk, n, slots array<struct<idx, digest, ...>>): n nodes in the group at this stretch
    tops: DataFrame  # (g, digest)
    fan: int
    depth: int


def build(nodes: DataFrame, sizes: DataFrame, fan: int = 2) -> Tree:
    """The tree over (g, idx, digest, ...): nodes meet by key in arrays of up to 1,024 slots, and an array becomes its top
    node in one task's hands, so ten levels (fan of 2) cost one shuffle. Arrays are stored."""
    depth = _levels(SLOTS, fan, SLOTS) if fan < SLOTS else 1
    while fan**depth > max(SLOTS, fan):
        depth -= 1
    block, slots = fan**depth, []

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for n, s in zip(b.column("n").to_pylist(), b.column("slots")):
                found.append(_up(s.values.field("digest").to_pylist(), _levels(n, fan, depth), fan)[-1][0])
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("blk"), pa.array(found, pa.string())], ["g", "idx", "digest"])

    kind = dict(nodes.dtypes)["g"]
    while True:
        rest = [c for c in nodes.columns if c not in ("g", "idx", "digest")]
        arrays = nodes.groupBy("g", F.floor(F.col("idx") / block).alias("blk")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest", *rest))).alias("slots"))
        n = sizes.select(F.col("g").alias("_g"), "n")
        slots.append(stage(arrays.join(n, F.col("g").eqNullSafe(F.col("_g"))).drop("_g"), "slots"))
        nodes = slots[-1].mapInArrow(tops, f"g {kind}, idx long, digest string")
        if (sizes.agg(F.max("n")).first()[0] or 0) <= block:
            return Tree(slots, stage(nodes.select("g", "digest"), "tops"), fan, depth)
        sizes = sizes.withColumn("n", F.ceil(F.col("n") / block))


def paths(tree: Tree, above: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """The leaves' rows, without digest, with ``before`` and ``after``: for each level up to the root, what stands to the
    left and to the right of a node in its run (joined; empty for a run of one).

    ``above`` has (g, before, after) from the groups' tops on, and string columns ``names`` that come down with it."""
    fan, depth = tree.fan, tree.depth
    suffix = above.select("g", F.lit(0).cast("long").alias("blk"), "before", "after", *names)
    for k in reversed(range(len(tree.slots))):
        slots = tree.slots[k]
        struct = slots.schema["slots"].dataType.elementType
        rest = [f for f in struct.fields if f.name not in ("idx", "digest")]
        out = ", ".join([f"g {dict(slots.dtypes)['g']}, idx long, digest string, {_SHAPE}", *(f"{n} string" for n in names), *(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)])

        def down(batches: Iterator[pa.RecordBatch], rest=[f.name for f in rest]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    s = b.column("slots")[r].values
                    levels = _up(s.field("digest").to_pylist(), _levels(b.column("n")[r].as_py(), fan, depth), fan)[:-1]
                    ends = b.column("before")[r].as_py(), b.column("after")[r].as_py()
                    left, right = [], []
                    for i in range(len(s)):
                        at = i
                        lo, hi = [], []
                        for now in levels:
                            first = at - at % fan
                            lo.append("".join(now[first:at]))
                            hi.append("".join(now[at + 1 : first + fan]))
                            at //= fan
                        left.append(lo + ends[0])
                        right.append(hi + ends[1])
                    same = pa.array([r] * len(s))
                    yield pa.RecordBatch.from_arrays(
                        [b.column("g").take(same), s.field("idx"), s.field("digest"), pa.array(left, pa.list_(pa.string())), pa.array(right, pa.list_(pa.string())), *(b.column(n).take(same) for n in names), *(s.field(n) for n in rest)],
                        ["g", "idx", "digest", "before", "after", *names, *rest],
                    )

        up = suffix.select(F.col("g").alias("_g"), F.col("blk").alias("_blk"), "before", "after", *names)
        met = slots.join(up, F.col("g").eqNullSafe(F.col("_g")) & (F.col("blk") == F.col("_blk"))).drop("_g", "_blk")
        rows = met.mapInArrow(down, out)
        suffix = rows.select("g", F.col("idx").alias("blk"), "before", "after", *names)
    return rows


def manifest(docs: DataFrame, group: str, id_col: str, leaf: Column, carry: dict[str, Column] | None = None, fan: int = 2) -> DataFrame:
    """One row per row of docs: (g, id, idx, leaf, subroot, root, before, after) and the columns of ``carry``.

    A group's leaves ascend by id; its top node is the subroot, and the subroots, in order of the groups (null first,
    strings by UTF-8 bytes), have the root above them. ``before`` and ``after`` are the proof: what stands beside the
    node in its run on each level, see ``fold``. Null ids come first; rows that share an id stand in order of
    their leaves, equal rows in any. A null group is a group. Only integers, hashes and ``carry`` are moved, never the
    columns under the leaf; columns of docs that are not named play no part. An empty table gives no rows."""
    carry = carry or {}
    slim = docs.select(F.col(group).alias("g"), F.col(id_col).cast("long").alias("id"), leaf.alias("digest"), *[c.alias(f"c_{n}") for n, c in carry.items()])
    placed, sizes = place(stage(slim, "leaves"), "g", "id", "digest")
    tree = build(placed, sizes, fan)
    one = tree.tops.withColumn("_all", F.lit(0))
    tops = number_rows(one, ["_all"], ["g"], "idx").select(F.col("_all").alias("g"), "idx", "digest", F.col("g").alias("group"))
    crown = build(tops, tops.groupBy("g").agg(F.count(F.lit(1)).alias("n")), fan)
    none = F.array().cast("array<string>")
    over = paths(crown, crown.tops.select("g", none.alias("before"), none.alias("after"), F.col("digest").alias("root")), ("root",))
    above = stage(over.select(F.col("group").alias("g"), "before", "after", F.col("digest").alias("subroot"), "root"), "above")
    rows = paths(tree, above, ("subroot", "root"))
    return rows.select("g", "id", "idx", F.col("digest").alias("leaf"), "subroot", "root", "before", "after", *[F.col(f"c_{n}").alias(n) for n in carry])


def fold(start: Column, before: str = "before", after: str = "after") -> Column:
    """The root that a leaf's hash and its proof lead to."""
    return F.aggregate(F.arrays_zip(before, after), start, lambda h, s: F.sha2(F.concat(s[before], h, s[after]).cast("binary"), 256))


def proof_hash(before: str = "before", after: str = "after") -> Column:
    """sha256 of all that stands beside the path, level by level from left to right."""
    return F.sha2(F.array_join(F.transform(F.arrays_zip(before, after), lambda s: F.concat(s[before], s[after])), "").cast("binary"), 256)


def digest(docs: DataFrame) -> DataFrame:
    """The documents' leaves with their proofs, checked against rows of which some were tampered with."""
    n = F.col("n_chars")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = lambda chars: [F.col("doc_id"), F.col("source"), F.col("lang"), chars, F.col("text")]
    now = F.when(tampered & n.isNotNull(), leaf_hash(*fields(n.cast("decimal(20,0)") + 1)))
    rows = manifest(docs, "lang", "doc_id", leaf_hash(*fields(n)), {"tampered": now})
    rows = rows.withColumns({"proof_sha256": proof_hash(), "folded_root": fold(F.coalesce("tampered", "leaf"))})
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"


def _leaf_sql(chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", chars, "text")) + ")"


#: Needs a CRC-32, which DuckDB lacks: a table of 256 remainders is made and bytes are folded.
SQL = f"""
WITH RECURSIVE bits(b, k, r) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM bits WHERE k < 8
), tbl AS (SELECT b, r FROM bits WHERE k = 8
), ids AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL
), crc(s, k, c) AS (
  SELECT s, 0, 4294967295::BIGINT FROM ids
  UNION ALL SELECT s, k + 1, xor(c >> 8, r) FROM crc JOIN tbl ON b = xor(c & 255, ord(s[k + 1])) WHERE k < length(s)
), hit AS (SELECT s FROM crc WHERE k = length(s) AND xor(c, 4294967295) % 7 = 0
), leaves AS (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, CASE WHEN n_chars IS NOT NULL AND CAST(doc_id AS VARCHAR) IN (SELECT s FROM hit) THEN {_leaf_sql('n_chars + 1')} END AS other
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), lev(k, lang, i, h, n) AS (
  SELECT 0, lang, i, leaf, n FROM placed
  UNION ALL SELECT k + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM lev WHERE n > 1 GROUP BY k, lang, i // 2, n
), subs AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lev WHERE n = 1
), top(k, i, h, n) AS (
  SELECT 0, i, h, n FROM subs
  UNION ALL SELECT k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY k, i // 2, n
), steps AS (
  SELECT p.lang, p.i, l.k, (p.i >> l.k) & 1 AS odd, coalesce(s.h, '') AS sib
  FROM placed p JOIN (SELECT DISTINCT k, lang, n FROM lev WHERE n > 1) l ON l.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN lev s ON s.lang IS NOT DISTINCT FROM p.lang AND s.k = l.k AND s.i = xor(p.i >> l.k, 1)
  UNION ALL
  SELECT p.lang, p.i, 1000 + l.k, (u.i >> l.k) & 1, coalesce(s.h, '')
  FROM placed p JOIN subs u ON u.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT DISTINCT k FROM top WHERE n > 1) l
  LEFT JOIN top s ON s.k = l.k AND s.i = xor(u.i >> l.k, 1)
), ways AS (
  SELECT lang, i, sha256(coalesce(string_agg(sib, '' ORDER BY k), '')) AS proof, list(struct_pack(odd := odd, sib := sib) ORDER BY k) AS way FROM steps GROUP BY lang, i
), folded(lang, i, k, h) AS (
  SELECT lang, i, 0, coalesce(other, leaf) FROM placed
  UNION ALL SELECT f.lang, f.i, f.k + 1, CASE WHEN way[f.k + 1].odd = 1 THEN sha256(way[f.k + 1].sib || f.h) ELSE sha256(f.h || way[f.k + 1].sib) END
  FROM folded f JOIN ways w ON w.lang IS NOT DISTINCT FROM f.lang AND w.i = f.i WHERE f.k < len(way)
)
SELECT p.doc_id, p.leaf, u.h AS subroot, t.h AS root, coalesce(w.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM placed p JOIN subs u ON u.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT h FROM top WHERE n = 1) t ON true
LEFT JOIN ways w ON w.lang IS NOT DISTINCT FROM p.lang AND w.i = p.i
JOIN folded f ON f.lang IS NOT DISTINCT FROM p.lang AND f.i = p.i AND f.k = coalesce(len(w.way), 0)
"""
