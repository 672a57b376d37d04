"""A training corpus from documents: language, near-duplicates, benchmark items, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetrail.llm import decontamination, language_id, near_dedup, packing
from edgetrail.llm.common import new_path, ship

TOKENIZER = "byte_bpe_50k.json"


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised, with it as their lang, by which they are packed; those without a letter go."""
    return language_id.recognised(docs, *language_id.fit(docs.where(~language_id.is_held_out())))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the least doc_id, once. Rows with a null doc_id stay.

    Rows are told apart by doc_id and text, so a copy takes no other text of its doc_id with it.
    """
    own = F.xxhash64("text")
    found = near_dedup.near_duplicates(docs, mark=own)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("_doc_id"), F.col("mark").alias("_mark")).distinct()
    kept = docs.join(gone, (F.col("doc_id") == F.col("_doc_id")) & (own == F.col("_mark")), "left_anti").select(docs.columns)
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id IS NULL"))


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their ids; a sequence holds documents of one language."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), within="lang")


STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("benchmark", drop_benchmark_items),
    ("packing", pack),
]

# Language models, confirmed links and retrieval packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(ship(spark), docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
