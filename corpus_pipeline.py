"""A training-data pipeline over the table `documents`: five stages, each on all that the one before has kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents; run() writes each stage's
result as a table in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, common, line_dedup, mixing, ngram_join, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document has."""
    kept = line_dedup.dedup_lines(docs)
    return kept.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as many times as the mix does, which may be never."""
    return mixing.taken_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and returns digests of the ids and of the text that they decode to."""
    path, pattern = bpe.default_vocabulary()
    return bpe.encode(docs.select("doc_id", "text"), path, pattern)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: Mixing draws at random and BPE has no SQL: the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from the table documents."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
