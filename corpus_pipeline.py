"""A corpus filter in five stages, each an operator of `tidemark.llm`. `run` applies them to `documents`.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again for the next one.
Decisions are taken per doc_id (null is an id of its own); rows that repeat an id share its decision, and from near
duplicates on one row of each id is left. Null texts are empty. Columns of documents stay as they are, but for redacted
texts and their n_chars.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import leaks, quality, secrets, sentences, simhash
from tidemark.session import scratch_folder


def _chosen(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    ids = ids.select(F.col("doc_id").alias("_chosen_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_chosen_id"]), how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _chosen(docs, quality.quality(docs).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of SimHash links (three-word shingles, at most three differing bits).

    Of rows that repeat an id, the one whose text all stages judge stays: that with the greatest text, then the greatest
    other columns.
    """
    groups = simhash.near_duplicates(docs, shingle=3, budget=3)
    kept = _chosen(docs, groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))))
    if kept.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    order = F.struct(F.coalesce("text", F.lit("")), "text", *[c for c in ("lang", "source", "n_chars") if c in kept.columns])
    chosen = kept.groupBy("doc_id").agg(F.max_by(F.struct(*kept.columns), order).alias("row"))
    return chosen.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    found = leaks.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _chosen(docs, found.select("doc_id").distinct(), "left_anti")


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.redact_rows(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the piece ids and of the text that they decode to, per document."""
    return sentences.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", redaction), ("sentence pieces", sentence_pieces)]

# suffix arrays, fingerprints, latent search and token ids are not expressible in SQL; tests/llm has plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_folder(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
