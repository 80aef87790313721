"""Exact line dedup: keep bitmaps from hashes in range order. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import BLANKS, ascii_lower, stage

SALTS = 64  # a line held by a third of all documents falls into so many groups


def lines_of(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of each line whose key has ``min_chars`` code points or more.

    96 hash bits stand for a key: XXH64 and CRC32."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(lines_of(text_col)).alias("pos", "line"))
    key = each.filter(F.char_length("line") >= min_chars).select("doc_id", "text_hash", "pos", F.btrim("line", F.lit(BLANKS)).alias("key"))
    key = key.filter(F.char_length("key") >= min_chars).withColumn("key", ascii_lower(F.col("key")))
    return key.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.crc32(F.col("key").cast("binary")).alias("h2"))


def common_lines(hashes: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n_docs, keeper): keys in ``min_docs`` documents or more and the largest id that holds them.

    Hashes are range-partitioned with a salt from the document and sorted by document, largest first, and
    position; the stream's first occurrences in each document are counted, folded per task, then per key."""
    salted = hashes.select("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"), "doc_id", "pos")
    order = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc_id").desc(), "pos")
    stream = salted.repartitionByRange("h1", "h2", "salt").withColumns({"nth": F.row_number().over(order), "before": F.lag("doc_id").over(order)})
    first = stream.filter((F.col("nth") == 1) | ~F.col("doc_id").eqNullSafe(F.col("before")))
    return first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= min_docs)


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_hash, dropped, n_dropped) of each document that loses lines.

    ``dropped`` is a compressed bitmap: the non-zero 64-bit words of the line positions, by word number.
    A null id counts as one document below all others; rows that repeat an id count once."""
    hashes = stage(line_hashes(docs, id_col, text_col, min_chars), "line_hashes")
    common = stage(common_lines(hashes, min_docs), "common_lines")  # a table, so that Spark can split a hot key of the join
    lost = hashes.join(common, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    word = lost.groupBy("doc_id", "text_hash", (F.shiftright("pos", 6)).alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos & 63))").alias("bits"))
    return word.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("dropped"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``__dropped`` (null: nothing lost) and ``__n_dropped``; other columns stay as they are."""
    b = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("dropped").alias("__dropped"), F.col("n_dropped").alias("__n_dropped"))
    on = docs[id_col].eqNullSafe(b["__id"]) & (F.xxhash64(docs[text_col]) == b["__hash"])
    return docs.join(b, on, "left").drop("__id", "__hash")


def kept_text(text_col: str) -> Column:
    """The lines that stay, joined by newlines; expects ``__dropped``."""
    return F.when(F.col("__dropped").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.expr(f"array_join(filter(split(`{text_col}`, '\\n', -1), (x, i) -> (shiftright(coalesce(try_element_at(__dropped, i >> 6), 0L), i & 63) & 1L) = 0L), '\\n')")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the text that stays and its length in ``n_chars`` where docs has that column."""
    out = with_bitmaps(docs, drop_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)
    changed = F.when(F.col("__dropped").isNull(), F.col(text_col)).otherwise(kept_text(text_col))
    out = out.withColumn("__kept", changed)
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("__kept").alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("__dropped").isNull(), F.col("n_chars")).otherwise(F.char_length("__kept")).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)


def digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) per row of docs; null and empty texts are one empty line."""
    own = docs.select("doc_id", "text")
    out = with_bitmaps(own, drop_bitmaps(own, "doc_id", "text", min_chars, min_docs))
    t = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id",
        (F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce("__n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text("text").cast("binary"), 256).alias("kept_sha256"),
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS lost FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
