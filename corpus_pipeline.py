"""A corpus pipeline over ``documents``: quality rules, near-duplicates, shared passages, personal data, packing.

Each stage takes all that the one before kept; all but the last return the columns of ``documents``, whatever other
columns come in.  Null texts and empty ones fail the quality rules; the later stages take them all the same, and
texts of any length, ties and empty tables, as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import ngram_join, packing, pii, quality, substring
from docloom.llm._store import materialize
from docloom.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose source does, go."""
    ship(spark)
    return quality.judge(docs, F.col("source"), keep=COLUMNS).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays; rows with a null id stay.

    Rows that share an id are told apart by their texts; of equal rows one stays.
    """
    ship(spark)
    found = ngram_join.near_duplicates(docs, with_hash=True)
    kept = found.filter("doc_id = class_id and text_hash = class_hash").select("doc_id", "text_hash").distinct()
    docs = docs.select(*COLUMNS)
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    one = keyed.join(kept, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return one.select(*COLUMNS).unionByName(docs.filter("doc_id is null"))


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds go, and documents of which nothing is left."""
    ship(spark)
    cut = substring.remove_repeats(docs, carry=("lang", "source"), keep_layout=True).filter("n_removed = 0 or n_removed < n_words")
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets."""
    ship(spark)
    clean = pii.find_pii(docs, carry=("doc_id", "lang", "source"), with_text=True)
    return clean.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    ship(spark)
    return packing.place(docs, carry=("lang", "source"), text_col="text")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("shared passages", shared_passages),
    ("personal data", personal_data),
    ("packing", packed),
]

#: Boosted trees and best-fit packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
