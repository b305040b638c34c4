"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes all rows that the one before kept. Rows and their texts change as the stage decides, and ``n_chars``
follows the text. The last stage returns the pieces of documents in token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, packing, quality, shingle_join, substrings
from cairn.llm.common import Scratch, new_names
from cairn.llm.groups import sieve
from cairn.llm.queries import tokenizer_files

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY_AT_LEAST = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose quality score is high enough. Learns from the labelled rows of docs. A null text is scored as an
    empty one; equal texts have equal scores, so that they stay or go together."""
    trees = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, trees, to="__score").where(F.col("__score") >= QUALITY_AT_LEAST).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows of the smallest id of each group of texts that share 0.8 of their five-word shingles. Rows of one id
    are one document and stay together, equal ones too; texts without words and rows without an id stay."""
    found = shingle_join.join(docs, shingle=5, num=80, den=100)
    scratch = Scratch(spark, "near_duplicates")
    others = scratch.table(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "others")
    (maybe,) = new_names(docs, "maybe")
    marked = sieve(others, ["doc_id"], scratch, "sieve")(docs, maybe, "doc_id")
    unsure = marked.where(F.col(maybe)).join(others, "doc_id", "left_anti")
    return marked.where(~F.col(maybe)).unionByName(unsure).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of strings of 200 bytes and more; the first copy stays, in order of id. All rows stay: a text may
    become empty, a null text remains null, and of rows equal in id and text one keeps its text."""
    cut = substrings.remove(docs, keep_first=True)
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows without a window of ten words of a benchmark item. Null and empty texts have none and stay; equal rows
    stay or go together."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and their place in it. A null or empty text is its end mark alone; equal
    rows are packed one by one."""
    return packing.pack_documents(docs, **tokenizer_files())


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]

#: Boosted trees, suffix arrays and a tokenizer have no counterpart in SQL: the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table. Each stage's rows are written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
