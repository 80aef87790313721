"""The numbered queries over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import htmltext, langid, linededup, maxent, merkle, mixing, multiindex, packing, pieces, quality, repair, simhash, tokenfile
from tidegrid.llm.common import id_crc_mod

#: Shares of the tokens of a training mix by labelled domain.
MIX = {"good": 0.85, "poor": 0.08, "toxic": 0.07}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.search(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, domains, _ = mixing.mix(_table(spark, sf_dir, "documents"), mixing.domain_labels(_table(spark, sf_dir, "labels")), MIX, keep=("source",))
    return rows.select("doc_id", "source", "n_tokens", *(F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)), "rate", mixing.copies("rate", "doc_id").alias("copies"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """The folder is a parameter; by default the installed files."""
    folder = os.environ.get("TIDEGRID_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digest(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 0, 2048)


def op5_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_table(spark, sf_dir, "documents"), held=id_crc_mod("doc_id", 10) == 0)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"), keep=("url",))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(id_crc_mod("doc_id", 4) == 2, F.lit(False))
    out = langid.identify(docs.select("doc_id", "text"), docs.filter(~held))
    return out.select(F.col("id").alias("doc_id"), F.coalesce(id_crc_mod("id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(_table(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_multi_index, op2_mixing, op3_line_dedup, op4_token_files, op5_maxent, op6_html, op7_quality, op8_simhash, op9_packing, op10_language, op11_merkle, op12_pieces, op13_repair)}
SQL = {"op3_line_dedup": linededup.SQL, "op11_merkle": merkle.SQL, "op13_repair": repair.SQL}
