"""A corpus pipeline of five of the training-data operators, from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` writes each stage's result to the shared folder and reads it
again for the next.  ``ORACLE_SQL`` is None: several stages' decisions are not expressible in SQL
(learned fences feed components, byte removal and BPE), so tests compare with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import bpe_replay, bwt_dedup, decontaminate, jaccard_join, quality_rules
from tidewheel.llm.shared import pinned, released, sieve, unused, written

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null or empty texts fail them; null languages and sources are groups of their own; repeated rows
    are judged alike; extra columns stay, whatever their names; an empty table stays empty.
    """
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates.

    A row without an id stays unless it copies a row with one; of rows that share an id one stays, and
    so of repeated rows; null and empty texts are near nothing; extra columns stay, whatever their
    names; an empty table stays empty.
    """
    joined = pinned(jaccard_join.join(docs))
    # Texts whose id is surely not among the dropped ones stay where they are; only the others are joined.
    dropped = pinned(joined.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept")).filter("not kept").select("doc_id"))
    passes = sieve(dropped, dropped.count())
    count = joined.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"), F.count_distinct("doc_id").alias("own")).first()
    named = docs.filter("doc_id is not null")
    out = passes(named, "doc_id", inside=False).unionByName(passes(named, "doc_id").join(dropped, "doc_id", "left_anti").select(*docs.columns))
    if count["own"] < count["ids"]:
        out = out.dropDuplicates(["doc_id"])
    if count["ids"] < count["n"]:
        sha = unused(docs, "sha")
        texts = docs.filter("doc_id is not null").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias(sha)).distinct()
        lone = docs.filter("doc_id is null").withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256))
        out = out.unionByName(lone.join(texts, sha, "left_anti").drop(sha))
    return out


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat elsewhere, with ``n_chars`` of what is left.

    Null texts stay null, and texts under 200 bytes stay whole; repeated rows, where an earlier stage left any, lose
    their texts, each being the other's copy; extra columns stay, whatever their names; an empty table stays empty.
    """
    return bwt_dedup.remove(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no window of a benchmark item occurs in.

    Null and wordless texts stay, and items without words reject nothing; repeated rows are judged
    alike; extra columns stay, whatever their names; an empty table stays empty.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, benchmark)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; null text has no tokens."""
    return bpe_replay.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        released(spark)
    return docs
