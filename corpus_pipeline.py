"""The corpus pipeline: quality rules, line deduplication, SimHash near-deduplication, best-fit packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; ``run`` writes each one as Parquet in the cluster's shared
folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arboretica.llm.line_dedup import dedup_lines
from arboretica.llm.packing import pack_documents
from arboretica.llm.quality import judge_quality
from arboretica.llm.queries import tokenizer
from arboretica.llm.shared import drop_kept, keep
from arboretica.llm.simhash import text_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return judge_quality(docs, carry=("text", "lang", "source", "n_chars")).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; ``n_chars`` follows the text that is left."""
    out = dedup_lines(docs, carry=("lang", "source"))
    return out.select(F.col("doc").alias("doc_id"), F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id. Rows without an id stay, and so do rows that
    share an id but stand in different groups."""
    first = text_groups(docs).where("doc = component").groupBy("root").agg(F.min(F.struct("doc", "text_hash")).alias("m"))
    stays = first.select(F.col("m.doc").alias("doc_id"), "m.text_hash")
    one = docs.withColumn("text_hash", F.xxhash64("text")).join(stays, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return one.select(*COLUMNS).unionByName(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in sequences of 4096 tokens."""
    return pack_documents(docs, tokenizer("word_bpe_49k.json")).withColumnRenamed("doc", "doc_id")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: SQL has no SimHash and no such tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            drop_kept(last)  # the next stage's table holds what it gave
        last = docs
    return docs
