"""Streams of events: the trip-wire, counters, and the ingest of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import audit, bm25


def windowed_trips(events: DataFrame, minutes: int = 10, least: int = 3, step: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """user_id, start, n of sliding windows with at least ``least`` high or critical events; windows move by ``step``,
    so the count of a window may lag the exact range by a step."""
    high = events.filter(F.col("severity").isin("high", "critical")).withColumn("ts", F.col("ts").cast("timestamp"))
    own = high.withWatermark("ts", late).groupBy("user_id", F.window("ts", f"{minutes} minutes", step).alias("w"))
    return own.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("user_id", F.col("w.start").alias("start"), "n")


def question_counts(asked: DataFrame) -> DataFrame:
    """query_hash, count, last_asked of a stream (query, ts), for complete or update output."""
    return asked.groupBy(F.md5(F.lower(F.trim("query"))).alias("query_hash")).agg(F.count(F.lit(1)).alias("count"), F.max("ts").alias("last_asked"))


def ingest_postings(docs: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append the postings of each batch of documents (doc_id, text) under path, one folder for each batch.

    A batch that runs again overwrites its own folder, so a restart counts nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        bm25.postings(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def merge_counters(asked: DataFrame, read, write, checkpoint: str) -> DataStreamWriter:
    """Upsert counters batch by batch; read() gives the counters so far or None, write(df, number) replaces them."""

    def step(batch: DataFrame, number: int) -> None:
        new, old = audit.counters(batch), read()
        write(new if old is None else audit.merge_counters(old, new), number)

    return asked.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def log_answers(answers: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Write what each batch of answers leaves under path: audit, asked and open, one folder for each batch.

    A batch that runs again overwrites its own folders. Counters of all questions are those of the batches, added up by
    audit.merge_counters."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, rows in zip(("audit", "asked", "open"), audit.answer_logs(batch), strict=True):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return answers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
