"""Exact cosine ranking of vectors and pseudo-relevance feedback.

Every query meets every vector, so the number of products grows with both; a search multiplies blocks of them as
matrices and passes on the k best of each batch."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.workspace import Workspace
from .bm25 import small, spread, top

DOUBLES = "array<double>"
#: Bytes of query vectors that go to workers at once, and cells of products that a worker holds; more are done in turn.
AT_ONCE, CELLS, PAIRS = 64 << 20, 1 << 21, 1 << 16
#: Matrix products differ from sums in order by less than this; what is that near the k-th best is summed in order.
NEAR = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def normalised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """doc_id, v: unit vectors in double precision."""
    return vectors.select(F.col(key).alias("doc_id"), unit(F.col(column).cast(DOUBLES)).alias("v"))


def cosine_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, doc_id, score of unit vectors (doc_id, v) and the stated queries (qid, q); queries are the small side.

    Every query meets every vector: the side that is broadcast is the query set, in full when it fits."""
    return vectors.join(small(queries)).select("qid", "doc_id", F.round(dot(F.col("v"), F.col("q")), 9).alias("score"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _in_order(a: np.ndarray, row: np.ndarray, b: np.ndarray, col: np.ndarray) -> np.ndarray:
    """For rows of a and of b the scores of cosine_scores(), summed in the same order."""
    out = np.zeros(len(row))
    for at in range(0, len(row), PAIRS):
        part = slice(at, at + PAIRS)
        for i in range(a.shape[1]):
            out[part] += a[row[part], i] * b[col[part], i]
    return np.round(out, 9)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, at_once: int | None = None) -> DataFrame:
    """qid, doc_id, score, rank of unit vectors (doc_id, v) for queries (qid, q), all of one length."""
    spark = vectors.sparkSession
    tables = Workspace(spark, "dense")
    queries = tables.save(queries.select("qid", "q").filter("q is not null"))
    at_once = at_once or AT_ONCE
    size = queries.agg(F.sum(8 * F.size("q"))).first()[0] or 0
    if (slices := -(-size // at_once)) > 1:
        own = [queries.filter(F.pmod(F.xxhash64("qid"), F.lit(slices)) == i) for i in range(slices)]
        return reduce(DataFrame.unionByName, [tables.save(search(vectors, q, k, 1 << 60)) for q in own])
    asked = queries.toArrow().combine_chunks()
    qids, q = asked.column("qid").combine_chunks(), _matrix(asked.column("q").combine_chunks())
    vectors = spread(vectors.select("doc_id", "v").filter("v is not null"))
    schema = queries.select("qid").schema
    for field in vectors.select("doc_id").schema:
        schema = schema.add(field)
    schema = schema.add("score", DoubleType())

    def rank(batches):
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            batch = batch.take(pc.sort_indices(batch.column("doc_id"), null_placement="at_start"))
            v, n = _matrix(batch.column("v")), batch.num_rows
            width = max(1, CELLS // n)
            for at in range(0, len(q), width):
                block = q[at : at + width]
                close = block @ v.T
                least = np.partition(close, n - k, axis=1)[:, n - k, None] - NEAR if n > k else -np.inf
                row, col = np.nonzero(close >= least)
                exact = _in_order(v, col, block, row)
                order = np.lexsort((col, -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(row[kept] + at)), batch.column("doc_id").take(pa.array(col[kept])), pa.array(exact[kept])], schema.names)

    return top(vectors.mapInArrow(rank, schema), k)


def feedback(vectors: DataFrame, queries: DataFrame, alpha: float = 0.5, depth: int = 3) -> DataFrame:
    """qid, q: each query moved by alpha towards the centroid of its best vectors, and of unit length again."""
    first = vectors.join(small(Workspace(vectors.sparkSession, "feedback").save(search(vectors, queries, depth))), "doc_id")
    centre = first.select("qid", F.posexplode("v").alias("i", "x")).groupBy("qid", "i").agg(F.avg("x").alias("x"))
    mean = centre.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    moved = queries.join(mean, "qid", "left").withColumn("m", F.coalesce(F.zip_with("q", "c", lambda a, b: a + alpha * b), F.col("q")))
    return moved.select("qid", unit(F.col("m")).alias("q"))
