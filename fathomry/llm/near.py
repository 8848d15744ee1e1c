"""Near duplicates: min-max hashing, exact confirmation, connected components.

1. A text's set is its distinct k-word shingles (with fewer words, the whole sequence as one). Texts with equal sets
   (128-bit digest) form a class with a number of its own, which one row stands for.
2. Under each of ``permutations`` hash functions both the smallest and the largest value of a set are kept, so a
   signature of 2 * permutations values needs half as many hash evaluations. Bands of ``rows`` values are bucket keys.
   With 100 functions and bands of five, a pair at similarity 0.8 shares no bucket with a chance of about 1e-7.
3. In a bucket, every class is compared with the one of the smallest number (its hub), on full sets. Components of the
   links follow. A bucket whose classes all are in one component needs no more pairs. In the others, for some rounds,
   every class is compared with the bucket's central member (the one that meets most others over all its buckets), and
   components are taken again. Members of a bucket that are still in different components are then all compared, block
   by block, by counts of shared shingles: nothing but set sizes rules a pair out. No bucket or partner is capped.
4. Components of all links, and of the classes that rows of one doc_id are in, give each document the smallest document
   id that it reaches.

A hub's set goes to every block of its partners once, and blocks are cut by bytes and by members, so that a task holds
two blocks at most, however large a bucket is.

Cases: a null or wordless text has an empty set, is its own component and is kept; repeated rows get the same
component; rows of one doc_id with different texts, wordless ones too, fall in one component; a row whose doc_id is null gets a null component and is kept unless a
document with an equal set has an id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .scratch import Scratch, shuffle_partitions
from .words import chunks, mix, shingles, split

PERMUTATIONS, ROWS = 100, 5
#: Ids and digests of candidate documents (32 bytes each) go to every executor up to this count, beyond it by a shuffle.
BROADCAST_IDS = 500_000
#: Rounds of comparing with a central member of each bucket before members are compared with each other.
ROUNDS = 2
#: Members and bytes of sets of a block; a task compares two blocks at a time.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Shingles of a pair of blocks that more members have are counted by a matrix product, the others pair by pair.
COMMON = 64
_STEP = 1 << 12


def functions_of(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return tuple(rng.integers(0, 1 << 63, permutations, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def min_max(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest values under each function, then largest ones, of a set of hashes."""
    low, high = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64)
    for i in range(0, len(values), _STEP):
        x = values[None, i : i + _STEP] * a[:, None]
        x += b[:, None]
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    bands = signature[: len(signature) // rows * rows].reshape(-1, rows)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, j])
    return key.view(np.int64)


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, raw, offsets in chunks(texts):
        hashes, bounds = shingles(split(raw, offsets), k)
        for i in range(len(bounds) - 1):
            yield np.unique(hashes[bounds[i] : bounds[i + 1]])


def signatures(df: DataFrame, k: int, permutations: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, two halves of the set's digest, bucket keys."""
    a, b = functions_of(permutations)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, keys = [], [], [], []
            for own in _sets(batch.column("text"), k):
                n.append(len(own))
                first, second = digest(own)
                one.append(first)
                two.append(second)
                signature = min_max(own, a, b)
                keys.append(band_keys(signature, rows) if len(own) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), as_lists(keys)],
                ["doc_id", "n_shingles", "one", "two", "keys"],
            )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, one long, two long, keys array<long>")


def as_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def digest(own: np.ndarray) -> tuple[int, int]:
    return int(own.sum(dtype=np.uint64).view(np.int64)), int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def sets_of(cids: DataFrame, classes: DataFrame, docs: DataFrame, k: int, scratch: Scratch, name: str) -> DataFrame:
    """cid, own: the whole set of the shingle hashes of each of the classes cids (distinct).

    The rows that stand for them are found by doc_id: broadcast up to BROADCAST_IDS, else both sides are shuffled."""
    wanted = scratch.save(classes.join(cids, "cid", "left_semi").select(F.col("rep").alias("wanted_id"), "cid", "one", "two"), f"{name}-wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted.hint("merge")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, F.col("doc_id") == F.col("wanted_id"))

    def full(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            goal = list(zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True))
            keep, owns = [], []
            for i, own in enumerate(_sets(batch.column("text"), k)):
                if digest(own) == goal[i]:  # a doc_id may have rows of other classes too
                    keep.append(i)
                    owns.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("cid").take(pa.array(keep, pa.int64())), as_lists(owns)], ["cid", "own"])

    out = scratch.save(rows.select("text", "cid", "one", "two").mapInArrow(full, "cid long, own array<long>"), f"{name}-sets")
    scratch.discard(f"{name}-wanted")
    return out.dropDuplicates(["cid"])  # repeated rows have equal sets


def grouped(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with equal first n_keys columns (longs or ints, without nulls)."""
    group, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(n_keys)], 1)
        cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]).any(1)) + 1).tolist(), len(g)]
        for b, e in zip(cuts, cuts[1:], strict=False):
            now = tuple(g[b].tolist())
            if now != group:
                if held:
                    yield group, held
                group, held = now, []
            held.append(batch.slice(b, e - b))
    if held:
        yield group, held


def lists_of(column: pa.Array) -> list[np.ndarray]:
    """Each row's list as an array."""
    return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy())[:-1])


def blocks_of(n: Column, shingles_: Column) -> Column:
    """Blocks of a group of n members with so many shingles together."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(8 * shingles_ / BLOCK_BYTES), F.lit(1)).cast("int")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have 100 * intersection >= percent * union; a has few values.

    Partners b are dealt into blocks for each a, and a's set goes once to each of them."""
    pairs = scratch.save(pairs, f"{name}-pairs")
    cids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    sets = sets_of(cids, classes, docs, k, scratch, name)
    sized = pairs.join(classes.select(F.col("cid").alias("b"), "n_shingles"), "b")
    size = scratch.save(sized.groupBy("a").agg(blocks_of(F.count(F.lit(1)), F.sum("n_shingles")).alias("blocks")), f"{name}-blocks")
    members = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), "b")
    members = members.join(sets.select(F.col("cid").alias("b"), "own"), "b").select("a", "block", F.lit(1).alias("side"), "b", "own")
    hubs = size.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(sets.select(F.col("cid").alias("a"), "own"), "a").select("a", "block", F.lit(0).alias("side"), F.col("a").alias("b"), "own")
    dealt = hubs.union(members).repartition(shuffle_partitions(docs.sparkSession), "a", "block").sortWithinPartitions("a", "block", "side")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hub = None, None
        for batch in batches:
            links: list[tuple[int, int]] = []
            for a, block, side, b, own in zip(*(batch.column(c).to_numpy() for c in range(4)), lists_of(batch.column("own")), strict=True):
                if (a, block) != group:
                    if side:
                        raise ValueError("a block without the set of its hub")
                    group, hub = (a, block), own
                elif side:
                    both = len(np.intersect1d(hub, own, assume_unique=True)) if 100 * min(len(hub), len(own)) >= percent * max(len(hub), len(own)) else 0
                    if (100 + percent) * both >= percent * (len(hub) + len(own)):
                        links.append((int(a), int(b)))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["a", "b"])

    out = scratch.save(dealt.mapInArrow(run, "a long, b long"), f"{name}-links")
    for part in ("pairs", "sets", "blocks"):
        scratch.discard(f"{name}-{part}")
    return out


def still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (key, cid, ...) of the keys whose members are in more than one component, with their labels."""
    own = labels.select(F.col("node").alias("cid"), F.col("label").alias("found"))
    labelled = rows.join(own, "cid", "left").withColumn("label", F.coalesce("found", "cid")).drop("found")
    keys = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    return labelled.join(keys, "key", "left_semi")


def apart(percent: int) -> Column:
    """Rows x and y are in different components, and their sizes leave the similarity possible."""
    sizes = F.least("x.n_shingles", "y.n_shingles") * 100 >= percent * F.greatest("x.n_shingles", "y.n_shingles")
    return (F.col("x.label") != F.col("y.label")) & sizes


def shared_counts(own: list[np.ndarray]) -> np.ndarray:
    """How many values each two of some sets share. Values of many sets are counted by a matrix product, the others by
    the pairs of sets that have them."""
    n, sizes = len(own), np.array([len(x) for x in own])
    values, owner = np.concatenate(own), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    often = np.diff(np.concatenate([starts, [len(values)]]))
    exact = np.float32 if sizes.max(initial=0) < 1 << 24 else np.float64
    out = np.zeros((n, n), exact)
    common = np.flatnonzero(often > COMMON)
    for i in range(0, len(common), 2048):
        some = common[i : i + 2048]
        rows = np.zeros((len(some), n), exact)
        at = np.repeat(starts[some], often[some]) + np.arange(often[some].sum()) - np.repeat(np.cumsum(often[some]) - often[some], often[some])
        rows[np.repeat(np.arange(len(some)), often[some]), owner[at]] = 1
        out += rows.T @ rows
    held: list[np.ndarray] = []

    def flush() -> None:
        if held:
            cell = np.bincount(np.concatenate(held), minlength=n * n).reshape(n, n)
            out[:] += cell + cell.T
            held.clear()

    waiting = 0
    for f in np.unique(often[(often > 1) & (often <= COMMON)]).tolist():
        some = starts[often == f]
        x, y = np.triu_indices(f, 1)
        step = max(1, (1 << 20) // len(x))
        for i in range(0, len(some), step):
            members = owner[some[i : i + step, None] + np.arange(f)]
            held.append((members[:, x] * n + members[:, y]).ravel())
            waiting += len(held[-1])
            if waiting > 1 << 21:
                flush()
                waiting = 0
    flush()
    return out


def linked_in_buckets(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the links of members of a bucket with different labels; rows (key, cid, n_shingles, label), sets (cid, own).

    A bucket is dealt into blocks and one task has two blocks at a time, so a large bucket is spread over many tasks
    and its pairs never leave them unless they are links.
    """
    size = rows.groupBy("key").agg(blocks_of(F.count(F.lit(1)), F.sum("n_shingles")).alias("blocks"))
    own_block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    dealt = rows.join(size, "key").withColumn("block", own_block).select("key", "cid", "label", "block", F.explode(pairs).alias("t"))
    dealt = dealt.select("key", "t.i", "t.j", "block", "cid", "label").join(sets, "cid")
    ordered = dealt.select("key", "i", "j", "block", "cid", "label", "own").repartition(shuffle_partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), held in grouped(batches, 3):
            block, cid, label = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in (3, 4, 5))
            if (label == label[0]).all():
                continue
            own = [x for h in held for x in lists_of(h.column("own"))]
            n = np.array([len(x) for x in own])
            linked = (100 + percent) * shared_counts(own).astype(np.float64) >= percent * (n[:, None] + n)
            linked &= label[:, None] != label
            if i != j:
                linked &= block[:, None] != block
            x, y = np.nonzero(np.triu(linked, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[x], cid[y])), pa.array(np.maximum(cid[x], cid[y]))], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    signed = scratch.save(signatures(docs, k, permutations, rows), "signed")
    same = ["one", "two", "n_shingles"]
    classes = signed.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_rows"))
    # numbers are drawn once, when the table is written
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    reps = classes.filter("rep is not null")
    buckets = signed.join(reps.select(F.col("rep").alias("doc_id"), *same, "cid"), ["doc_id", *same]).select("cid", "n_shingles", F.explode("keys").alias("key"))
    # only buckets of two or more classes go on
    shared = buckets.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("last")).filter("hub <> last").select("key", "hub")
    buckets = scratch.save(buckets.join(shared, "key"), "buckets")
    first = buckets.filter("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    links = confirm(first, reps, docs, k, percent, scratch, "hubs")
    # classes that rows of one doc_id are in
    several = signed.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*same)).alias("low"), F.max(F.struct(*same)).alias("high")).filter("low <> high").select("doc_id")
    several = scratch.save(several, "several")
    mixed = not several.isEmpty()
    if mixed:
        in_classes = signed.join(several, "doc_id", "left_semi").join(classes, same).select("doc_id", "cid").distinct()
        links = links.union(in_classes.join(in_classes.groupBy("doc_id").agg(F.min("cid").alias("a")), "doc_id").filter("cid <> a").select("a", F.col("cid").alias("b")))
        links = scratch.save(links, "hubs-and-ids")
    labels = components(links, scratch, "by-hubs")
    rows_open = scratch.save(still_open(buckets.drop("hub").dropDuplicates(["key", "cid"]), labels), "open")
    as_pair = (F.col("y.cid").alias("a"), F.col("x.cid").alias("b"))
    turn = 0
    while turn < ROUNDS and not rows_open.isEmpty():
        turn += 1
        met = rows_open.join(rows_open.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").groupBy("cid").agg(F.sum("n").alias("met"))
        central = rows_open.join(met, "cid").groupBy("key").agg(F.max_by("cid", F.struct("met", "cid")).alias("cid"))
        central = rows_open.join(central, ["key", "cid"], "left_semi")
        pairs = rows_open.alias("x").join(central.alias("y"), (F.col("x.key") == F.col("y.key")) & apart(percent)).select(*as_pair).distinct()
        more = confirm(pairs, reps, docs, k, percent, scratch, f"central-{turn}")
        if more.isEmpty():
            break
        links = links.union(more)
        labels = components(links, scratch, f"by-central-{turn}")
        rows_open = scratch.save(still_open(rows_open.drop("label"), labels), f"open-{turn}")
    if not rows_open.isEmpty():
        opened = sets_of(rows_open.select("cid").distinct(), reps, docs, k, scratch, "open")
        more = scratch.save(linked_in_buckets(rows_open, opened, percent).distinct(), "rest-links")
        if not more.isEmpty():
            labels = components(links.union(more), scratch, "by-rest")
    scratch.discard("buckets")
    placed = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    low = placed.groupBy("label").agg(F.min("rep").alias("component_id"))
    members = placed.join(low, "label").select(*same, "component_id")
    found = signed.select("doc_id", *same).join(members, same, "left")
    if mixed:  # a wordless row goes with the other rows of its id
        of_id = found.filter("n_shingles > 0").join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
        found = found.join(of_id, "doc_id", "left")
    alone = F.coalesce("of_id", "doc_id") if mixed else F.col("doc_id")
    out = found.withColumn("component_id", F.when(F.col("n_shingles") == 0, alone).otherwise(F.col("component_id")))
    kept = F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("doc_id") == F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op6_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by sets of two-word shingles at a similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op6"), k=2)
