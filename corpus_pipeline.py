"""A corpus pipeline over ``documents``: each stage calls one operator of plumbline.llm on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, mixing, ngram_join, quality, sharding
from plumbline.llm.common import checkpoint


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is fitted on the labelled part of what comes in.

    Every row is judged by its own text, null as empty, so rows of equal text share their fate; null and repeated ids, extra columns and very
    long texts make no difference. Without labels all rows score alike, 0.5, and stay. Empty table: no rows.
    """
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest doc_id (null last, ties by place in the table).

    Rows stand for themselves: where ids are null or repeated, the rows are numbered first, in a checkpoint, and joined by number. Null, empty and
    blank texts are no one's duplicates and stay. Extra columns of any name pass through. Empty table: no rows.
    """
    unclear = docs.groupBy("doc_id").agg(F.count("*").alias("__times")).where("doc_id is null or __times > 1")
    if unclear.isEmpty():
        kept = ngram_join.jaccard_join(docs).where("doc_id = class_id").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    rows = checkpoint(docs.withColumn("__row", F.monotonically_increasing_id()))
    classes = ngram_join.jaccard_join(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))
    kept = classes.join(rows.select("__row", "doc_id"), "__row").groupBy("class_id").agg(first.alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, verbatim or with other numbers, names or units.

    Rows of equal text share their fate; null and empty texts stay, and null or repeated ids and extra columns make no difference. An empty
    benchmark or table: all rows stay.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn down or repeated to their targets; rows come in training order.

    A null source is one of its own. Documents without words go; rows equal in id, text and source share their turns. See
    :func:`mixing.mixed` for ties. Empty table: no rows.
    """
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of shards: where each row goes, in Hilbert order.

    Null text counts as empty, null source and language come first; repeated rows each have a place. Empty table: no rows.
    """
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "curve")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]
#: The classifier's scores cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each materialised before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
