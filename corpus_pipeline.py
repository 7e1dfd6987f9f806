"""Cleaning and packing of ``documents``: five stages, each one operator of ``tallyscope.llm``.

A stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of documents. Each works on all rows that its predecessor kept:

* toxicity drops the documents predicted toxic, at the threshold of the query;
* minhash keeps one document, that of the smallest id, of each near-duplicate class;
* substring removes repeated 20-word windows from the texts that are left;
* pii replaces personal data by its kind;
* packing lays the texts into sequences, one row per piece.

Rows without doc_id pass every stage, as no decision can name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm import minhash_dedup, packing, pii, substring_dedup, toxicity
from tallyscope.llm.shared import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = ("lang", "source")


def _documents(df: DataFrame, text: str) -> DataFrame:
    rows = df.select("doc_id", F.col(text).alias("text"), *CARRIED)
    return rows.select("doc_id", "text", *CARRIED, F.length("text").cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    scored = docs.withColumn("_score", toxicity.score(model, F.col("text")))
    return scored.filter(F.col("_score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    gone = minhash_dedup.near_duplicates(docs.select("doc_id", "text")).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(substring_dedup.substring_dedup(docs.select(*COLUMNS), carry=CARRIED), "kept_text")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(pii.sanitize(docs.select(*COLUMNS), carry=CARRIED), "sanitized_text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"), packing.default_tokenizer(), with_ids=False).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("pii", hide_personal_data),
    ("packing", pack),
]

# A fitted score, hashing and a tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
