"""From documents to packed sequences: quality, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that it is given, and returns a DataFrame; all but the last
return the columns of documents. Labels and benchmark are read from sf_dir. Between stages the rows are written as
Parquet and read again, by run() as by any other caller.

Cases: documents without text or words pass quality, near duplicates and benchmark, and become a piece of one end token;
rows that repeat an id or all columns are kept or dropped together by quality and near duplicates; without labels only
toxic documents could go, and none do; empty tables give an empty result; other columns, whatever their names, go along
up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.llm.near import near_duplicates
from fathomry.llm.packing import pack
from fathomry.llm.quality import select_quality
from fathomry.llm.scratch import Scratch, unused
from fathomry.llm.tiling import decontaminate

#: Near duplicates: words of a shingle and percent of similarity.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps and that are not toxic."""
    return select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "quality"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Rows that repeat an id stay together,
    and rows without an id stay."""
    scratch = Scratch(spark, "near")
    gone = unused("fathomry_gone", docs.columns)
    out = near_duplicates(docs, scratch, SHINGLE, PERCENT).filter("not kept and doc_id is not null").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(out, docs["doc_id"] == out[gone], "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return pack(docs, Scratch(spark, "packing"))


STAGES = [("quality classifier", quality), ("near duplicates", near_dedup), ("benchmark decontamination", benchmark), ("best-fit packing", packing)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(i))
    return docs
