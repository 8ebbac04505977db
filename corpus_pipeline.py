"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, benchmark contamination goes, personal
data is masked, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs; all
but the last return the columns of documents. The stages' operators state what they do with nulls, empty and very long
texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import bpe, decontaminate, jaccard, pii, toxicity
from glossa.llm.common import spread, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.5 go; the model learns from the labelled rows outside the held-out fold."""
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    return toxicity.without(docs, toxicity.trained(docs, _table(spark, sf_dir, "labels"), train))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles, the one with the least doc_id stays."""
    return jaccard.deduplicated(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter item) go."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows the text."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(docs)


STAGES = [("toxicity", without_toxic), ("ngram_jaccard", without_near_duplicates), ("decontamination", without_benchmark), ("pii", without_personal_data), ("byte_bpe", encoded)]

#: Learnt scores and BPE can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(_table(spark, sf_dir, "documents"))
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
