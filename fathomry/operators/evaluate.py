"""Ranking metrics, significance and hits of known passages."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import Workspace
from .bm25 import small


def _gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade.cast("double")) - 1.0


def ndcg_by_query(runs: DataFrame, qrels: DataFrame, k: int = 10, keys: tuple[str, ...] = (), groups: DataFrame | None = None) -> DataFrame:
    """keys, qid, ndcg of runs (keys, qid, doc_id, rank) against qrels (qid, doc_id, grade); queries of qrels without a
    run count 0."""
    own = Window.partitionBy("qid").orderBy(F.col("grade").desc(), "doc_id")
    ideal = qrels.filter("grade > 0").withColumn("r", F.row_number().over(own)).filter(F.col("r") <= k).groupBy("qid").agg(F.sum(_gain(F.col("grade")) / F.log2(F.col("r") + 1.0)).alias("ideal"))
    wanted = qrels.select("qid").distinct()
    if groups is not None:
        wanted = wanted.join(F.broadcast(groups))
    met = runs.filter(F.col("rank") <= k).join(qrels, ["qid", "doc_id"]).groupBy(*keys, "qid").agg(F.sum(_gain(F.col("grade")) / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    both = wanted.join(met, [*keys, "qid"], "left").join(ideal, "qid", "left")
    return both.select(*keys, "qid", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def ndcg(runs: DataFrame, qrels: DataFrame, k: int = 10, keys: tuple[str, ...] = (), groups: DataFrame | None = None) -> DataFrame:
    """keys, ndcg: the mean over queries."""
    return ndcg_by_query(runs, qrels, k, keys, groups).groupBy(*keys).agg(F.round(F.avg("ndcg"), 9).alias("ndcg"))


def metrics(runs: DataFrame, qrels: DataFrame, k: int = 10, depth: int = 100) -> DataFrame:
    """One row: ndcg at k, recall at depth, reciprocal rank at k, averaged over the queries of qrels."""
    good = qrels.filter("grade > 0")
    totals = good.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    found = runs.join(good, ["qid", "doc_id"]).groupBy("qid").agg(F.count_if(F.col("rank") <= depth).alias("hit"), F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias("first"))
    each = ndcg_by_query(runs, qrels, k).join(totals, "qid", "left").join(found, "qid", "left")
    zero = F.lit(0.0)
    return each.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg("ndcg"), 6).alias("ndcg"),
        F.round(F.avg(F.coalesce(F.col("hit") / F.col("n"), zero)), 6).alias("recall"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), zero)), 6).alias("mrr"),
    )


def bootstrap(differences: DataFrame, rounds: int, seed: str = "b") -> DataFrame:
    """One row: n, mean, p: the share of resamples of differences (i from 0, d) whose mean is not above 0.

    Resample r draws, for each place i, the place md5(seed, r, i) modulo n, so any engine repeats it.
    """
    differences = Workspace(differences.sparkSession, "bootstrap").save(differences)
    n = differences.count()
    hexes = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("r"), F.col("i"))), 1, 8)
    # resamples are spread over the places, so that no row of the plan holds all of them
    drawn = differences.select("i").crossJoin(F.broadcast(differences.sparkSession.range(rounds).withColumnRenamed("id", "r")))
    drawn = drawn.select("r", F.pmod(F.conv(hexes, 16, 10).cast("long"), F.lit(max(n, 1))).alias("j"))
    means = drawn.join(small(differences.withColumnRenamed("i", "j")), "j").groupBy("r").agg(F.round(F.avg("d"), 9).alias("m"))
    p = means.agg(F.avg(F.when(F.col("m") <= 0, 1.0).otherwise(0.0)).alias("p"))
    return differences.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean")).join(p).select("n", "mean", F.round("p", 6).alias("p"))


#: Bytes of a passage that are looked up at every place of a text, and bytes of texts that are looked through at once.
ANCHOR, LOOKED = 16, 4 << 20
#: Bytes of passages that go to workers at once; more are done in slices.
PASSAGES = 64 << 20


def _marks(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place of data on."""
    n = max(len(data) - ANCHOR + 1, 0)
    groups = len(data) // 8 + 2
    words, padded = np.empty(8 * groups, np.uint64), np.zeros(8 * groups + 8, np.uint8)
    padded[: len(data)] = data
    for i in range(8):  # eight bytes from each place on
        words[i::8] = padded[i : i + 8 * groups].copy().view(np.uint64)
    mixed = words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (words[8 : 8 + n] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def holders(docs: DataFrame, passages: DataFrame, at_once: int = PASSAGES) -> DataFrame:
    """Distinct qid, doc_id of documents (doc_id, text) whose text has a passage (qid, text) in it, wherever it begins.

    Each passage is known by ANCHOR of its bytes, the rarest among the passages; every place of a text is looked up, and
    the whole passage is compared where they are found, so the cost grows with the texts and not with the passages."""
    size = passages.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if (slices := -(-size // at_once)) > 1:
        return reduce(DataFrame.unionByName, [holders(docs, passages.filter(F.pmod(F.xxhash64("qid"), F.lit(slices)) == i), 1 << 60) for i in range(slices)])
    known = passages.filter("text is not null").select("qid", "text").toArrow()
    qids, texts = known.column("qid").combine_chunks(), [t.encode() for t in known.column("text").to_pylist()]
    long = [i for i, t in enumerate(texts) if len(t) >= ANCHOR]
    marks = [_marks(np.frombuffer(texts[i], np.uint8)) for i in long]
    seen, n = np.unique(np.concatenate(marks), return_counts=True) if marks else (np.zeros(0, np.uint64), np.zeros(0, int))
    places = [int(np.argmin(n[np.searchsorted(seen, m)])) for m in marks]
    anchors: dict[int, list[tuple[int, int]]] = {}
    for i, m, at in zip(long, marks, places, strict=True):
        anchors.setdefault(int(m[at]), []).append((i, at))
    wanted = np.array(sorted(anchors), np.uint64)
    schema = passages.select("qid").schema
    for field in docs.select("doc_id").schema:
        schema = schema.add(field)

    def find(batches):
        gate = np.zeros(1 << 16, bool)
        gate[wanted >> np.uint64(48)] = True
        for batch in batches:
            column = batch.column("text").cast(pa.large_binary())
            out: set[tuple[int, int]] = set()
            for i, t in enumerate(texts):
                if len(t) < ANCHOR:
                    out.update((i, int(r)) for r in np.nonzero(pc.fill_null(pc.match_substring(column, t), False).to_numpy(zero_copy_only=False))[0])
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            row = 0
            while row < len(column) and len(wanted):
                to = max(row + 1, int(np.searchsorted(ends, ends[row] + LOOKED, "right")) - 1)
                marks = _marks(data[ends[row] : ends[to]])
                for at in np.nonzero(gate[marks >> np.uint64(48)])[0]:
                    for i, offset in anchors.get(int(marks[at]), ()):
                        begin = int(ends[row] + at) - offset
                        own = int(np.searchsorted(ends, begin + offset, "right")) - 1
                        if begin >= ends[own] and begin + len(texts[i]) <= ends[own + 1] and data[begin : begin + len(texts[i])].tobytes() == texts[i]:
                            out.add((i, own))
                row = to
            pairs = np.array(sorted(out), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(pairs[:, 0])), batch.column("doc_id").take(pa.array(pairs[:, 1]))], ["qid", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(find, schema).distinct()
