"""A corpus through five stages, each written before the next reads it.

language_id drops documents in which no language is found (null texts, texts
without a letter); near_duplicates keeps of each group of linked documents that
with the smallest doc_id; decontaminate drops documents that hold a benchmark
item; redact replaces secrets in the texts; pack returns the pieces of training
sequences.  All but the last return the columns of ``documents``, other columns
included, with n_chars brought up to date.

A stage decides about rows, not about ids: a row is known by its doc_id and a
hash of all its columns.  Rows of one doc_id with unlike texts are documents
each.  Of rows with the same doc_id and set of shingles in one group, that with
the least hash stays, and of rows equal in all columns, one.  Rows with a null
doc_id are never dropped as duplicates, whatever their text, but are dropped by
language_id and decontaminate like others.  An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, language_id, ngram_join, packing, secret_scan
from quillon.llm._store import Workspace, row_key, unused


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that aren't held out and drops the
    ones whose language is undetermined (null texts, texts without a letter)."""
    Workspace(spark, "pipeline")
    known = docs.where("lang is not null and text is not null and pmod(crc32(coalesce(cast(doc_id as string), '')), 4) <> 2")
    pred, score = unused(docs.columns, "lang_pred", "score")
    return language_id.identify(docs, language_id.learn(known), pred=pred, score=score).where(F.col(pred) != "und").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest doc_id stays."""
    work = Workspace(spark, "pipeline")
    (key,) = unused(docs.columns, "row")
    keyed = docs.withColumn(key, row_key(docs))
    found = ngram_join.jaccard_join(keyed, row=key).where("doc_id is not null and n_shingles > 0").select("doc_id", "row", "sid", "group")
    found = work.table(found, "found")
    # a group's place goes to the row with the least (doc_id, set, hash)
    many = work.table(found.groupBy("group").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "many")
    rows = found.join(work.small(many), "group")
    kept = rows.where("doc_id = first").groupBy("group").agg(F.min(F.struct("sid", "row")).alias("kept")).select("group", F.col("kept.row").alias("kept"))
    kept = work.table(kept, "kept")
    stays = F.max((F.col("doc_id") == F.col("first")) & (F.col("row") == F.col("kept")))
    verdict = rows.join(work.small(kept), "group").groupBy("doc_id", "row").agg(stays.alias("stays"), F.count("*").alias("n"))
    gone = work.table(verdict.where("not stays or n > 1"), "gone")
    again = gone.where("stays").select("doc_id", F.col("row").alias(key))
    out = keyed.join(work.small(gone).select("doc_id", F.col("row").alias(key)), ["doc_id", key], "left_anti").select(docs.columns)
    if again.head(1):
        out = out.unionByName(keyed.join(again, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key]).select(docs.columns))
    return out


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    work = Workspace(spark, "pipeline")
    (key,) = unused(docs.columns, "row")
    keyed = docs.withColumn(key, row_key(docs))
    gone = decontaminate.find(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row=key).select(F.col("row").alias(key)).distinct()
    return keyed.join(work.small(work.table(gone, "gone")), key, "left_anti").select(docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", by_language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("redact", redacted),
    ("pack", packed),
]
#: Shingle similarity, latent retrieval and tokenisation aren't SQL; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return docs
