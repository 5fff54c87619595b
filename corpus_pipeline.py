"""The corpus pipeline: quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all
but the last return the columns of ``documents``, and other columns are left
out.  Rows with a null doc_id pass the filters, since no decision can name them;
decisions are by id, so rows that repeat an id stay or go together; null and
empty texts are judged as empty ones; an empty table gives an empty one, and
without labels every document passes the classifier.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import nearcopies, packing, quality, substrings
from lexigrain.llm.common import materialise, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.5 or more)."""
    small_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = quality.score(docs, model).where("score < 0.5 and doc_id is not null").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(materialise(rejected, "rejected"), "doc_id", "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates (0.8 of five-word shingles)."""
    small_batches(spark)
    found = nearcopies.near_copies(docs)
    others = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller id holds."""
    small_batches(spark)
    return substrings.dedup_documents(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as pieces in sequences of at most 2048 tokens."""
    small_batches(spark)
    return packing.tokenise_and_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("substrings", repeated_passages),
    ("packing", packed),
]

# The classifier, the hashes and the tokenizer are not in SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
