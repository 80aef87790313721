"""The corpus pipeline: raw documents to packed training sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import linededup, mixing, nearcopy, packing, quality, simhash
from tidegrid.llm.common import stage
from tidegrid.llm.queries import tokenizer_path

#: Tokens of each domain after mixing, as a factor on those before: clean documents stay at a rate of 1 or more.
MIX = {"good": 1.2, "poor": 0.6, "toxic": 0.4}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or lie far from their language and source go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share stay in one of them."""
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: of fingerprints within two bits (SimHash of three-word
    shingles), then of texts alike by five-word shingles (Jaccard similarity of 0.8 and more), which two bits don't reach."""
    return nearcopy.one_of_each(stage(simhash.one_of_each(docs), "simhash_dedup"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or thinned out towards the token targets of their domains."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.resample(docs, mixing.domain_labels(labels), MIX, relative=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place in it."""
    return packing.digest(docs, tokenizer_path("word_bpe_49k.json"), 0, 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Covariance estimates, fingerprints, rates and packing can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, fn) in enumerate(STAGES):
        docs = fn(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name.replace(" ", "_"))
    return docs
