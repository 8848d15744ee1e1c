"""Token windows and atomic critical blocks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from ..functions.text import word_list, words
from . import bm25

CORE, HYBRID = (64, 12), (120, 20)
OPEN = r"\[\[\s*critical\s*:\s*([^\]\n]+?)\s*\]\]"
CLOSE = r"\[\[\s*/\s*critical\s*\]\]"


def windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk_no, begin, n_tokens, tokens: windows of size words, each overlap words after the last began less.

    A text without words has no window; the last window is the first that reaches the end.
    """
    step = size - overlap
    toks = docs.select("doc_id", words("text").alias("toks")).filter(F.size("toks") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("toks") - size) / F.lit(float(step)))).cast("int")
    each = toks.select("doc_id", "toks", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    own = F.slice("toks", F.col("chunk_no") * step + 1, F.lit(size))
    return each.select("doc_id", "chunk_no", (F.col("chunk_no") * step).alias("begin"), F.size(own).alias("n_tokens"), own.alias("tokens"))


def best_chunks(docs: DataFrame, queries: DataFrame, size: int, overlap: int) -> DataFrame:
    """qid, doc_id, chunk_no, score for every query (qid, text) and document (doc_id, text) with words: its first window
    with most distinct ASCII words of the query. A task does all queries of its documents, so only the result is large."""
    step = size - overlap
    asked = queries.select("qid", "text").toArrow()
    qids, own = asked.column("qid").combine_chunks(), [{w.lower() for w in re.findall("[a-zA-Z0-9]+", t or "")} for t in asked.column("text").to_pylist()]
    place = {w: i for i, w in enumerate(sorted(set().union(*own)))}
    side = bm25._Asked([(place[w], i) for i, words_of in enumerate(own) for w in words_of], len(own))
    schema = queries.select("qid").schema
    for field in docs.select("doc_id").schema:
        schema = schema.add(field)
    schema = schema.add("chunk_no", IntegerType()).add("score", LongType())

    def find(batches):
        for batch in batches:
            for doc, text in enumerate(batch.column("text").to_pylist()):
                if not (toks := word_list(text or "")):
                    continue
                n = max(0, -(-(len(toks) - size) // step)) + 1
                rows, terms = [], []
                for i in range(n):
                    found = [place[w] for w in set(toks[i * step : i * step + size]) if w in place]
                    rows += [i] * len(found)
                    terms += found
                for block in range(len(side.blocks)):
                    width = min(side.width, len(own) - block * side.width)
                    met = side.sums(block, np.array(rows, np.int64), np.array(terms, np.int64), np.ones(len(rows)), n, width)
                    at = met.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([qids.slice(block * side.width, width), batch.column("doc_id").take(pa.array([doc] * width)), pa.array(at.astype(np.int32)), pa.array(met.max(axis=1).astype(np.int64))], schema.names)

    return bm25.spread(docs.select("doc_id", "text")).mapInArrow(find, schema)


def critical_blocks(text: Column) -> Column:
    """Array of title and body of marked blocks; a block without a close mark is not one."""
    found = F.regexp_extract_all(text, F.lit(f"(?is)({OPEN}.*?{CLOSE})"), F.lit(1))
    return F.transform(found, lambda b: F.struct(F.trim(F.regexp_extract(b, f"(?is){OPEN}", 1)).alias("title"), F.trim(F.regexp_replace(b, f"(?is){OPEN}|{CLOSE}", "")).alias("body")))


def strip_marks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"(?is){OPEN}|{CLOSE}", ""))


def expand_span(begin: Column, end: Column, spans: Column) -> Column:
    """begin, end, title after growing over every span (begin, end, title) that it overlaps, in order; the last title wins."""
    start = F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end"), F.lit(None).cast("string").alias("title"))

    def grow(at: Column, s: Column) -> Column:
        over = (at["begin"] < s["end"]) & (at["end"] > s["begin"])
        return F.struct(F.when(over, F.least(at["begin"], s["begin"])).otherwise(at["begin"]).alias("begin"), F.when(over, F.greatest(at["end"], s["end"])).otherwise(at["end"]).alias("end"), F.when(over, s["title"]).otherwise(at["title"]).alias("title"))

    return F.aggregate(spans, start, grow)


def hybrid_windows(docs: DataFrame, size: int = HYBRID[0], overlap: int = HYBRID[1]) -> DataFrame:
    """doc_id, chunk_no, text, is_critical, critical_title: windows that never cut a critical block.

    Texts without marks take the plain windows; in the others each block is a chunk of its own and the text between
    blocks is windowed by itself.
    """
    text = F.coalesce("text", F.lit(""))
    cut = F.split(F.regexp_replace(text, f"(?is)({OPEN}.*?{CLOSE})", "\u0002$1\u0002"), "\u0002")
    parts = docs.select("doc_id", F.posexplode(cut).alias("part", "piece"))
    critical = F.col("piece").rlike(f"(?is)^{OPEN}.*{CLOSE}$")
    blocks = parts.filter(critical).select("doc_id", "part", F.lit(0).alias("n"), strip_marks(F.col("piece")).alias("text"), F.lit(True).alias("is_critical"), F.nullif(F.trim(F.regexp_extract("piece", f"(?is){OPEN}", 1)), F.lit("")).alias("critical_title"))
    step = size - overlap
    toks = F.regexp_extract_all("piece", F.lit("([a-zA-Z0-9]+|[ऀ-ॿ]+)"), F.lit(1))
    plain = parts.filter(~critical).select("doc_id", "part", toks.alias("toks")).filter(F.size("toks") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("toks") - size) / F.lit(float(step)))).cast("int")
    rest = plain.select("doc_id", "part", "toks", F.explode(F.sequence(F.lit(0), last)).alias("n")).select("doc_id", "part", "n", F.array_join(F.slice("toks", F.col("n") * step + 1, F.lit(size)), " ").alias("text"), F.lit(False).alias("is_critical"), F.lit(None).cast("string").alias("critical_title"))
    return blocks.unionByName(rest).withColumn("chunk_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "n")) - 1).drop("part", "n")


def critical_first(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query's hits (qid, doc_id, rank, is_critical), critical ones before others, else in their order;
    hits should hold more than k to choose from."""
    order = Window.partitionBy("qid").orderBy(F.coalesce("is_critical", F.lit(False)).desc(), "rank", "doc_id")
    return hits.withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= k).withColumn("rank", F.col("new_rank")).drop("new_rank")


def in_folder(path: Column, root: str) -> Column:
    """Whether a normalised path is the critical folder or lies in it; without a folder, none does."""
    root = root.rstrip("/")
    return F.coalesce((path == root) | F.startswith(path, F.lit(root + "/")), F.lit(False)) if root else F.lit(False)
