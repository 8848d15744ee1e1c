"""Reciprocal-rank fusion of runs and the search for its weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bm25 import top
from .evaluate import ndcg

RRF_K = 60


def fuse(runs: DataFrame, weights: dict[str, float], keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """keys, doc_id, score of runs (run, keys, doc_id, rank from 1); a run of weight 0 does not count."""
    spark = runs.sparkSession
    known = spark.createDataFrame([(r, float(w)) for r, w in weights.items() if w], "run string, weight double")
    part = F.col("weight") / (F.lit(float(RRF_K)) + F.col("rank") - 1)
    return runs.join(F.broadcast(known), "run").groupBy(*keys, "doc_id").agg(F.round(F.sum(part), 12).alias("score"))


def grid(runs: DataFrame, qrels: DataFrame, names: list[str], steps: tuple[float, ...] = (0.0, 0.5, 1.0), k: int = 10) -> DataFrame:
    """grid_no, weight per run, ndcg of every combination of weights but the one without any; one job for all."""
    axes = [F.explode(F.array(*[F.lit(s) for s in steps])).alias(n) for n in names]
    combos = runs.sparkSession.range(1).select(F.lit(0).alias("z"))
    for a in axes:
        combos = combos.select("*", a)
    rank = sum((F.array_position(F.array(*[F.lit(s) for s in steps]), F.col(n)) - 1) * len(steps) ** (len(names) - 1 - i) for i, n in enumerate(names))
    combos = combos.drop("z").withColumn("grid_no", rank.cast("int")).filter(" or ".join(f"{n} > 0" for n in names))
    long = combos.select("grid_no", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names))).alias("run", "weight"))
    part = F.col("weight") / (F.lit(float(RRF_K)) + F.col("rank") - 1)
    fused = runs.join(F.broadcast(long.filter("weight > 0")), "run").groupBy("grid_no", "qid", "doc_id").agg(F.round(F.sum(part), 12).alias("score"))
    ranked = top(fused, k, ("grid_no", "qid"))
    return ndcg(ranked, qrels, k, ("grid_no",), combos.select("grid_no")).join(combos, "grid_no")
