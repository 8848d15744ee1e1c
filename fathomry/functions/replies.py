"""Replies of language models captured as lines of their streams, put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(lines: DataFrame, chunk: Column, ends: Column, ends_before: bool) -> DataFrame:
    """Chunks in order up to the first ending line; that line itself counts unless ends_before."""
    w = Window.partitionBy("reply_id").orderBy("line_no")
    last = 0 if ends_before else -1
    seen = F.coalesce(F.sum(F.coalesce(ends, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, last)), F.lit(0))
    kept = lines.select("reply_id", "line_no", chunk.alias("chunk"), seen.alias("seen"))
    part = F.when((F.col("seen") == 0) & (F.col("chunk") != ""), F.struct("line_no", "chunk"))
    return kept.groupBy("reply_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["chunk"]), "").alias("text"))


def from_ndjson(lines: DataFrame) -> DataFrame:
    """reply_id, text of (reply_id, line_no, line): message.content of each JSON line, up to the first with done true.
    Empty lines and lines that are not JSON are passed over."""
    return _joined(lines, F.get_json_object("line", "$.message.content"), F.get_json_object("line", "$.done") == "true", False)


def from_events(lines: DataFrame) -> DataFrame:
    """reply_id, text of (reply_id, line_no, line): the content of the first choice's delta, or of its message where
    there is no delta, of each ``data:`` line before ``[DONE]``."""
    line = F.trim("line")
    data = F.when(F.startswith(line, F.lit("data:")), F.trim(F.substr(line, F.lit(6))))
    delta = F.get_json_object(data, "$.choices[0].delta")
    own = F.get_json_object(data, "$.choices[0].delta.content")
    chunk = F.when(delta.isNull() | (delta == "{}"), F.get_json_object(data, "$.choices[0].message.content")).otherwise(own)
    return _joined(lines, chunk, data == "[DONE]", True)
