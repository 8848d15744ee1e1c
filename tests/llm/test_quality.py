"""Importance resampling against plain counts, its seeds, and what it does to labelled rows."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.llm import quality as Q
from fathomry.llm.scratch import Scratch
from tests.llm.test_models_and_scans import plain_words

SF = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def buckets(text):
    """Feature buckets of one text, by the operator's hash of a text on its own."""
    import pyarrow as pa

    from fathomry.llm.words import chunks, split

    _, _, raw, offsets = next(chunks(pa.array([text or ""])))
    found = Q.features(split(raw, offsets))[0].tolist()
    n = len(plain_words(text))
    assert len(found) == n + max(n - 1, min(n, 1))  # words, and pairs (one word is a pair of its own)
    return found


def test_ratios_and_keys_against_plain_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    low, bad = {}, {}
    for r in labels.collect():
        low[r.doc_id], bad[r.doc_id] = min(low.get(r.doc_id, 1), r.quality), max(bad.get(r.doc_id, 0), r.toxic)
    raw, target = collections.Counter(), collections.Counter()
    feats = [buckets(t) for _, t in rows]
    for (i, _), own in zip(rows, feats, strict=True):
        raw.update(own)
        if low.get(i) == 1 and bad.get(i) == 0:
            target.update(own)
    n, t = sum(raw.values()), sum(target.values())
    smooth = {b: (target[b] + Q.PRIOR) / (t * c / n + Q.PRIOR) for b, c in raw.items()}
    total = math.fsum(raw[b] / n * x for b, x in smooth.items())
    scratch = Scratch(spark, "t")
    model = Q.fit(docs, labels, scratch)
    scored = Q.with_scores(docs.select("doc_id", "text"), model, "q", seed=5).select("doc_id", "q.*", F.xxhash64("doc_id", F.lit(5)).alias("h")).collect()
    for (_, own), got in zip(zip(rows, feats, strict=True), scored, strict=True):
        expected = Q.LENGTH * math.fsum(math.log(smooth[b] / total) for b in own) / max(len(own), 1)
        assert got.n_features == len(own) and math.isclose(got.log_importance, expected, rel_tol=1e-9, abs_tol=1e-9)
        drawn = (((got.h % (1 << 64)) >> 11) + 0.5) / (1 << 53)
        assert math.isclose(got.key, expected - math.log(-math.log(drawn)), rel_tol=1e-9, abs_tol=1e-9)


def test_k_and_seeds(spark, tables):
    docs, labels = tables
    scratch = Scratch(spark, "t")
    model = Q.fit(docs, labels, scratch)
    scores = scratch.save(Q.with_scores(docs.select("doc_id", "text"), model, "q").select("doc_id", "q.*"), "s")
    clean = scores.filter("not toxic")
    samples = []
    for seed in (1, 2, 3):
        drawn = clean.withColumn("key", Q.gumbel_key(F.col("log_importance"), seed))
        keys = sorted((r.key for r in drawn.collect()), reverse=True)
        for k in (1, 100, 500):
            assert drawn.filter(F.col("key") >= Q.last_key(drawn, model, k)).count() == k == sum(x >= keys[k - 1] for x in keys)
        samples.append({r.doc_id for r in drawn.filter(F.col("key") >= Q.last_key(drawn, model, 500)).collect()})
        assert Q.last_key(drawn, model, 0) == np.inf and Q.last_key(drawn, model, 10**6) == -np.inf
    # seeds change the sample; most of it is decided by importance
    assert all(20 < len(a ^ b) < 700 for a, b in zip(samples, samples[1:], strict=False))


def test_inclusion_follows_importance(spark):
    """Gumbel top-1 takes a row with the odds of its importance."""
    odds = [1.0, 2.0, 5.0]
    draws = spark.range(3).crossJoin(spark.range(4000).withColumnRenamed("id", "seed")).select(F.col("id").alias("doc_id"), "seed")
    weight = F.element_at(F.array(*map(F.lit, odds)), (F.col("doc_id") + 1).cast("int"))
    drawn = (F.shiftrightunsigned(F.xxhash64("doc_id", "seed"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    best = draws.withColumn("key", F.log(weight) - F.log(-F.log(drawn))).groupBy("seed").agg(F.max_by("doc_id", "key").alias("w")).groupBy("w").count().collect()
    for r in best:
        assert abs(r["count"] / 4000 - odds[r.w] / 8) < 0.03


def test_good_rows_stay_and_bad_ones_go(spark, tables):
    """Half of the labels are held out: what happens to their rows."""
    docs, labels = tables
    known = labels.filter(F.xxhash64("doc_id") % 2 == 0)
    kept = Q.select_quality(docs, known, Scratch(spark, "t")).select("doc_id").withColumn("kept", F.lit(1))
    held = labels.join(known.select("doc_id"), "doc_id", "left_anti").join(kept, "doc_id", "left").groupBy("quality", "toxic").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()
    share = {(r.quality, r.toxic): r.share for r in held}
    assert share[1, 0] >= 0.9 and share[0, 0] <= 0.3 and share[1, 1] <= 0.6


def test_clashing_names_ties_and_odd_rows(spark):
    long_text = "good words stand here " * 100_000
    rows = [(1, "a good text of words", 0), (1, "a good text of words", 1), (2, long_text, 2), (3, "", 3), (4, None, 4), (None, "words of a good text", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fathomry_quality int").withColumn("Fathomry_quality_", F.lit("x")).withColumn("key", F.lit(1)).withColumn("toxic", F.lit(True)).withColumn("good", F.lit(1)).withColumn("half", F.lit(0))
    labels = spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 0, 1)], LABELS)
    kept = Q.select_quality(docs, labels, Scratch(spark, "t"))
    assert kept.columns == docs.columns and sorted(r.fathomry_quality for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
    nothing = spark.createDataFrame([], LABELS)
    assert Q.select_quality(docs, nothing, Scratch(spark, "t"), k=0).count() == 0
    empty = Q.select_quality(docs.limit(0), labels, Scratch(spark, "t"))
    assert empty.columns == docs.columns and empty.count() == 0
