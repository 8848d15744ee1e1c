"""Files of two public retrieval test sets, as the relations that the metrics take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scifact_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of JSON lines with title and an abstract that is a list of sentences or one string."""
    raw = spark.read.schema("doc_id string, title string, abstract string").json(path)
    body = F.coalesce(F.array_join(F.from_json("abstract", "array<string>"), " "), F.col("abstract"), F.lit(""))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), body)
    return raw.select("doc_id", F.btrim(text, F.lit(". ")).alias("text"))


def scifact_claims(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Queries (qid, text) of the claims with evidence, and their qrels (qid, doc_id, grade 1)."""
    raw = spark.read.schema("id string, claim string, evidence map<string,string>").json(path).filter("size(evidence) > 0")
    grades = raw.select(F.col("id").alias("qid"), F.explode(F.map_keys("evidence")).alias("doc_id"), F.lit(1).alias("grade"))
    return raw.select(F.col("id").alias("qid"), F.col("claim").alias("text")), grades.distinct()


def financebench(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc, question, gold_pages, gold_texts of the questions whose evidence has a page and a text."""
    evidence = "array<struct<evidence_page_num:string,evidence_text:string,evidence_text_full_page:string>>"
    raw = spark.read.schema(f"financebench_id string, doc_name string, question string, evidence {evidence}").json(path)
    pages = F.transform(F.filter("evidence", lambda e: e["evidence_page_num"].isNotNull()), lambda e: e["evidence_page_num"].cast("int"))
    named = F.filter("evidence", lambda e: F.coalesce(e["evidence_text"], F.lit("")) != "")
    texts = F.transform(named, lambda e: F.when(F.coalesce(e["evidence_text_full_page"], F.lit("")) != "", e["evidence_text_full_page"]).otherwise(e["evidence_text"]))
    out = raw.select(F.col("financebench_id").alias("qid"), F.col("doc_name").alias("doc"), "question", F.array_sort(F.array_distinct(pages)).alias("gold_pages"), texts.alias("gold_texts"))
    return out.filter("size(gold_pages) > 0 and size(gold_texts) > 0")
