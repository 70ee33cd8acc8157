"""The corpus pipeline: documents in, token ids out.

Each stage calls one operator of ``rankforge.llm`` on all rows that its
predecessor kept; its result is written as Parquet and read again as the
next one's documents.  All stages but the last return the columns of
documents.  Empty tables pass through every stage as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import bpe, decontaminate, exact_dedup, language, near_dedup
from rankforge.llm.common import stored, table

TOKENIZER = "byte_bpe_50k.json"


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language: null texts and texts without a letter."""
    model = language.fit(docs.filter(~language.held_out("doc_id")))
    return language.spoken(docs, model)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of equal texts."""
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    return near_dedup.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that give benchmark items away."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, their number, and whether decoding
    them gives the text back."""
    path = public_tokenizers.path(TOKENIZER)
    coded = docs.select("doc_id", "lang", "source", "text", bpe.round_trip(F.col("text"), path).alias("c"))
    return coded.select("doc_id", "lang", "source", F.size("c.ids").cast("long").alias("n_tokens"), F.col("c.ids").alias("ids"),
                        (F.col("c.back") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("language_id", languages), ("exact_dedup", exact_duplicates), ("near_dedup", near_duplicates),
          ("decontamination", benchmark_leaks), ("bpe", tokens)]

#: No SQL expresses the classifier, the sketches or the tokenizer; the tests
#: hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
