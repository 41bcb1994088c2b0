"""Five stages from raw documents to packed sequences; each reads what the stage before it wrote.

Every stage but the last returns the columns of ``documents``. ``run`` writes each stage's rows as Parquet below
``spark.checkpoint.dir`` and reads them again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surveykit.llm import mixing, ngram_join, packing, passages, quality
from surveykit.llm.bpe import public_vocabulary
from surveykit.session import scratch_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle similarity, the one with the smallest id."""
    return ngram_join.keep_one_per_group(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut from the later ones."""
    return passages.cut_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.emit(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed."""
    return packing.pack(docs, public_vocabulary(packing.VOCABULARY), packing.END)


STAGES = [("quality_rules", rules), ("ngram_jaccard_join", near_copies), ("repeated_passages", repeats), ("mix_sources", mixture), ("pack_sequences", sequences)]

#: tokenizing and near-duplicate passages can't be said in SQL; tests/llm checks each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
