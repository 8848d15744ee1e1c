"""Quality selection by importance resampling, with a toxicity test of the same kind.

1. Words and word pairs of a text are hashed to ``BUCKETS``. A generative model of the target (labelled good and not
   toxic) and one of the raw texts (all of them) are bucket frequencies. A text's log importance is the sum over its
   features of log p_target - log p_raw, scaled to a text of ``LENGTH`` features: the plain sum grows with length, and
   loses long clean texts of rarer kinds before short junk.
2. With Gumbel noise drawn from the seed and doc_id added, the k rows with the largest keys are a sample without
   replacement in proportion to importance. ``k`` is a parameter; where it is None, it is the number of rows that are
   not toxic and have a log importance above a cut, which is fitted so that labelled good rows stay above it. Labelled
   texts of one half are scored for that by a target model of the other half, so that they are judged like unseen ones.
3. Presence models of words in toxic and in other labelled texts give each word a log ratio; a text whose strongest
   word reaches the fitted cut is toxic and is not drawn.

The models are fitted on at most ``LABELLED`` labelled rows (those with the smallest hash of doc_id); raw counts, the
selection and all scores cover every row. The driver holds BUCKETS counts and the words that several toxic ones of the
labelled rows share. Every text is read by Python twice: for counts, and for scores, which are written out.

Cases: a null or wordless text has no features, a log importance of 0 and no toxic word; a null doc_id has no label and
draws its noise from its null; rows of one doc_id draw equal noise, so repeated rows have equal keys and are kept or
dropped together (equal keys at the end of the sample may lift the number kept above k); a k of at least the number of
rows keeps all that are not toxic, 0 keeps none; rows with null labels teach nothing; contradicting labels of a doc_id
count as bad and toxic; without labelled good rows every log importance is 0; without labelled good or without labelled bad rows there is no
cut, and everything that is not toxic is kept;
an empty table gives no rows; ``select_quality`` keeps all columns of its rows, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, unused
from .words import Words, chunks, mix, shingles, split

BUCKETS, LENGTH, LABELLED, SEED = 1 << 16, 100, 20_000, 20240229
#: Lost good rows weigh this much against kept bad ones when cuts are fitted.
GOOD_WEIGHT = 20.0
#: A toxic word stands in at least so many labelled toxic texts.
TOXIC_SUPPORT = 3
#: Counts that a bucket's target model has beforehand, at the raw rate.
PRIOR = 2.0


class Model(NamedTuple):
    ratio: np.ndarray  # log p_target - log p_raw by bucket
    cut: float
    toxic_hash: np.ndarray  # sorted
    toxic_ratio: np.ndarray
    toxic_cut: float


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and word pairs in a row, and the text of each."""
    pairs, bounds = shingles(words, 2)
    one = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    two = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    drawn = np.concatenate([mix(words.hashes ^ np.uint64(1)), mix(pairs ^ np.uint64(2))])
    return (drawn & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([one, two])


def labelled_rows(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id, good, toxic of at most ``most`` documents."""
    each = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return each.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).alias("good"), (F.col("toxic") > 0).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def bucket_counts(docs: DataFrame) -> DataFrame:
    """bucket, raw, one, two: feature counts of docs (text, half): of all, and of those whose half is 1 or 2."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, BUCKETS), np.int64)
        for batch in batches:
            half = batch.column("half").to_numpy()
            for first, end, raw, offsets in chunks(batch.column("text")):
                bucket, owner = features(split(raw, offsets))
                sums[0] += np.bincount(bucket, minlength=BUCKETS)
                for i in (1, 2):
                    chosen = half[first:end] == i
                    if chosen.any():
                        sums[i] += np.bincount(bucket[chosen[owner]], minlength=BUCKETS)
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x[some]) for x in sums)], ["bucket", "raw", "one", "two"])

    counted = docs.select("text", "half").mapInArrow(count, "bucket long, raw long, one long, two long")
    return counted.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", "one", "two")])


def word_presence(docs: DataFrame) -> DataFrame:
    """h, toxic, other: in how many of the distinct labelled texts (text, toxic) of either kind a word stands."""

    def present(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            found: dict[int, list[np.ndarray]] = {0: [], 1: []}
            for first, _, raw, offsets in chunks(batch.column("text")):
                words = split(raw, offsets)
                for i in range(len(words.bounds) - 1):
                    found[int(kind[first + i])].append(np.unique(words.hashes[words.bounds[i] : words.bounds[i + 1]]))
            for k, own in found.items():
                h, n = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n * k), pa.array(n * (1 - k))], ["h", "toxic", "other"])

    once = docs.groupBy("text").agg(F.max("toxic").alias("toxic"))
    return once.mapInArrow(present, "h long, toxic long, other long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Bucket log ratios. A bucket's target rate is drawn to its raw rate by PRIOR counts, so that a bucket of which few
    target features are expected says little when it has none."""
    p_raw = raw / max(raw.sum(), 1)
    expected = target.sum() * p_raw
    p_target = p_raw * (target + PRIOR) / (expected + PRIOR)
    return np.where(raw > 0, np.log((target + PRIOR) / (expected + PRIOR)) - np.log(max(p_target.sum(), 1e-300)), 0.0)


def best_cut(good: np.ndarray, bad: np.ndarray, default: float) -> float:
    """The cut that keeps good scores at or above it and bad ones below, at GOOD_WEIGHT; halfway to the next score."""
    if not len(good) or not len(bad):
        return default
    at = np.unique(np.concatenate([good, bad]))
    lost = np.searchsorted(np.sort(good), at, "left") / len(good)
    stay = 1 - np.searchsorted(np.sort(bad), at, "left") / len(bad)
    i = int(np.argmin(GOOD_WEIGHT * lost + stay))
    return float(at[i] + at[i - 1]) / 2 if i else float(at[0])


def judge(model: Model) -> Column:
    """The scores of text: log_importance, n_features, toxic_ratio."""

    @F.arrow_udf("log_importance double, n_features long, toxic_ratio double")
    def run(texts: pa.Array) -> pa.Array:
        out: list[list[np.ndarray]] = [[], [], []]
        for first, end, raw, offsets in chunks(texts):
            n = end - first
            words = split(raw, offsets)
            bucket, owner = features(words)
            size = np.bincount(owner, minlength=n)
            out[0].append(np.bincount(owner, weights=model.ratio[bucket], minlength=n) * (LENGTH / np.maximum(size, 1)))
            out[1].append(size)
            worst = np.full(n, -np.inf)
            if len(model.toxic_hash):
                i = np.minimum(np.searchsorted(model.toxic_hash, words.hashes), len(model.toxic_hash) - 1)
                hit = np.flatnonzero(model.toxic_hash[i] == words.hashes)
                np.maximum.at(worst, np.searchsorted(words.bounds, hit, "right") - 1, model.toxic_ratio[i[hit]])
            out[2].append(worst)
        flat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1].astype(np.int64)), pa.array(flat[2])], ["log_importance", "n_features", "toxic_ratio"])

    # a filter on the scores must not be pushed below them, which would run Python twice in a task
    return run.asNondeterministic()(F.coalesce("text", F.lit("")))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, most: int = LABELLED) -> Model:
    """The models and cuts; docs (doc_id, text), labels (doc_id, quality, toxic)."""
    known = scratch.save(labelled_rows(labels, most), "labelled")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first_half = F.xxhash64("text") % 2 == 0
    # at most ``most`` rows of a number and two flags
    target = F.coalesce(F.col("good") & ~F.col("toxic"), F.lit(False))
    marked = narrow.join(F.broadcast(known), "doc_id", "left").withColumn("half", F.when(target & first_half, 1).when(target, 2).otherwise(0))
    got = bucket_counts(marked).toArrow()
    counts = np.zeros((3, BUCKETS))
    for i, c in enumerate(("raw", "one", "two")):
        counts[i, got["bucket"].to_numpy()] = got[c].to_numpy()
    raw, one, two = counts
    some = one.sum() + two.sum() > 0
    ratio = log_ratio(one + two, raw) if some else np.zeros(BUCKETS)
    sample = scratch.save(narrow.join(F.broadcast(known), "doc_id"), "sample")

    def toxic_words(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n_toxic, n_other = rows.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
        lift = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
        found = word_presence(rows).filter(F.col("toxic") >= TOXIC_SUPPORT).withColumn("lift", lift).filter("lift > 1").toArrow()
        h, r = found["h"].to_numpy().view(np.uint64), found["lift"].to_numpy().astype(float)
        order = np.argsort(h)
        return h[order], r[order]

    # each half is scored by the models of the other, and a text with many copies counts once
    once = scratch.save(sample.groupBy("text").agg(F.min("good").alias("good"), F.max("toxic").alias("toxic")), "once")
    tried = []
    for half, goal in ((first_half, two), (~first_half, one)):
        fold = Model(log_ratio(goal, raw) if goal.sum() else np.zeros(BUCKETS), 0.0, *toxic_words(sample.filter(~F.coalesce(half, F.lit(True)))), 0.0)
        tried.append(once.filter(F.coalesce(half, F.lit(True))).withColumn("s", judge(fold)).select("s.*", "good", "toxic").toArrow())
    good, toxic, score, worst = (np.concatenate([t[c].to_numpy() for t in tried]) for c in ("good", "toxic", "log_importance", "toxic_ratio"))
    good, toxic, worst = good.astype(bool), toxic.astype(bool), np.maximum(worst, -1e3)
    cut = best_cut(score[good & ~toxic], score[~good & ~toxic], -np.inf)
    toxic_cut = -best_cut(-worst[~toxic], -worst[toxic], -np.inf)
    return Model(ratio, cut, *toxic_words(sample), max(toxic_cut, 1.0))


def kth_largest(scored: DataFrame, column: str, k: int, rounds: int = 5, bins: int = 1024) -> float:
    """A value that at least k rows reach, next to the k-th largest one; each round sends at most bins counts to the driver."""
    low, high, n = scored.agg(F.min(column), F.max(column), F.count(column)).first()
    if low is None or k >= n:
        return -np.inf
    if k < 1:
        return np.inf
    above = 0
    for _ in range(rounds):
        width = (high - low) / bins
        if not width > 0:
            break
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
        counts = dict(scored.filter((F.col(column) >= low) & (F.col(column) <= high)).groupBy(place.alias("b")).count().collect())
        for b in range(bins - 1, -1, -1):
            if above + counts.get(b, 0) >= k:
                break
            above += counts.get(b, 0)
        low, high = low + b * width, low + (b + 1) * width
    return low - abs(low) * 1e-12


def gumbel_key(importance: Column, seed: int) -> Column:
    """log importance and Gumbel noise drawn from the seed and doc_id."""
    drawn = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return importance - F.log(-F.log(drawn))


def with_scores(docs: DataFrame, model: Model, column: str, seed: int = SEED) -> DataFrame:
    """docs with the struct column: log_importance, n_features, toxic_ratio, toxic, key."""
    judged = docs.withColumn(column, judge(model))
    toxic = F.col(f"{column}.toxic_ratio") >= model.toxic_cut
    return judged.withColumn(column, F.struct(f"{column}.*", toxic.alias("toxic"), gumbel_key(F.col(f"{column}.log_importance"), seed).alias("key")))


def last_key(scores: DataFrame, model: Model, k: int | None) -> float:
    """The key of the last row drawn of scores (log_importance, key, toxic)."""
    clean = scores.filter("not toxic")
    if k is None:
        k = clean.filter(F.col("log_importance") >= model.cut).count()
    return kth_largest(clean, "key", k)


def select_quality(docs: DataFrame, labels: DataFrame, scratch: Scratch, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs that are drawn, with all their columns."""
    model = fit(docs, labels, scratch)
    column = unused("fathomry_quality", docs.columns)
    scored = scratch.save(with_scores(docs, model, column, seed), "scored")
    least = last_key(scored.select(f"{column}.*"), model, k)
    return scored.filter((F.col(f"{column}.key") >= least) & ~F.col(f"{column}.toxic")).drop(column)


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and decision for every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scratch = Scratch(spark, "op2")
    model = fit(docs, labels, scratch)
    scores = scratch.save(with_scores(docs.select("doc_id", "text"), model, "q").select("doc_id", "q.*"), "scores")
    least = last_key(scores, model, None)
    clean = F.when(F.col("toxic_ratio") > -1e3, F.col("toxic_ratio"))
    return scores.select("doc_id", "n_features", "log_importance", F.col("key").alias("gumbel_key"), clean.alias("toxic_ratio"), "toxic", ((F.col("key") >= least) & ~F.col("toxic")).alias("kept"))
