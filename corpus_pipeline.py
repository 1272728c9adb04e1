"""The corpus pipeline: stages over ``documents``, each written as a table and
read again as the next stage's input.

1. language ID: documents without a recognised language go
2. MinHash near-dedup: of each near-duplicate class the smallest id stays
3. personal data: spans are replaced by their kind in the texts
4. best-fit packing: pieces of what is left, placed in sequences

The first three return the columns of their input; the last returns one row per
packed piece. Rows that repeat a doc_id are separate documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm import catalog, common, langid, minhash, packing, pii


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; ``und`` is rejected."""
    named = docs.select(F.struct(*docs.columns).alias("document"), "text")
    found = langid.predict(named, langid.train(docs), ["document"])
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select("document.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: its smallest id, of rows with
    that id the first read. Rows are told apart by a number of their own, so
    different texts under one id all stay. Rows without an id cannot be named
    and stay."""
    named = docs.filter("doc_id is not null").select(F.struct(*docs.columns).alias("document"), F.monotonically_increasing_id().alias("row"))
    rows = common.materialize(named, "dedup-rows")
    found = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("document.text").alias("text")))
    ids = rows.select("row", F.col("document.doc_id").alias("id"))
    stays = found.select(F.col("doc_id").alias("row"), "component_id").join(ids, "row").groupBy("component_id").agg(
        F.min(F.struct("id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(stays, "row").select("document.*").unionByName(docs.filter("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; ``n_chars``, where
    there is one, follows the text."""
    clean = pii.redact(docs, pii.train(docs))
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(clean.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return catalog.packed_documents(docs)


STAGES = [("language_id", language_id), ("minhash_near_dedup", near_dedup),
          ("redact_personal_data", redact_personal_data), ("best_fit_packing", best_fit_packing)]

#: The stages hold a learned model, shingle hashing and a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
