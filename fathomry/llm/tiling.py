"""Benchmark decontamination by greedy string tiling.

1. Seeds are rolling hashes of ``MIN_MATCH`` words in a row. To cover THRESHOLD of an item of n words by tiles of that
   length or more, a text must share ceil(THRESHOLD * n / MIN_MATCH) places of the item; so all but that many less one
   of its places are indexed, and those left out are the ones whose seeds stand in most items. A common phrase
   thus joins a text with few items or none.
2. Documents' seeds that pass a bit map of the indexed ones (``FILTER_BITS``, whatever the benchmark) are joined with
   them. The pairs of text and item that come out are the only ones that are compared; equal texts are one text.
3. Each pair is tiled by running Karp-Rabin: for a search length, hashes of unmarked runs of words are rolled over both
   sides, equal hashes are verified word by word and extended, and the longest matches are marked, ties at the smaller
   word of the item, then of the text; then the search length is halved, down to MIN_MATCH. Tiles may stand in any
   order, so reordered passages are caught. Search lengths change no tile: the result is that of plain greedy tiling.
4. An item's coverage is the share of its words under tiles; a text is contaminated when it covers THRESHOLD of some item.

Both sides are lower-cased as Unicode text first, so a passage in capitals is found.

The driver holds the bit map only. Benchmark and matches are broadcast where their size is known to be within
``BROADCAST_BYTES``, else joined by shuffle.

Cases: null or wordless texts and items share nothing; an item of fewer than MIN_MATCH words is covered by a text of
these words and no others; repeated items are one; items of equal id and other words are compared each; a null item_id
is reported as null; repeated rows give repeated results; a text of any length is compared whole; without benchmark
nothing is contaminated; ``decontaminate`` keeps all columns of the rows it keeps, whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, plan_bytes, shuffle_partitions, unused
from .words import BASE, BASE_INVERSE, Words, chunks, mix, powers_of, split

MIN_MATCH, THRESHOLD = 5, 0.8
FILTER_BITS, BROADCAST_BYTES = 24, 32 << 20
#: Search length of the first round, and pairs of places that are compared at a time.
SEARCH, STEP = 20, 1 << 16
TILES = "tiles: array<struct<item_word: int, doc_word: int, words: int>>"
_TILE = pa.struct([("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k values: a running sum of values times powers of a base, from which the hash of
    a run follows from that of the run before it by one step."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers_of(BASE, n)[:n], out=run[1:])
    return (run[k:] - run[:-k]) * powers_of(BASE_INVERSE, n)[: n - k + 1]


def seeds(words: Words, k: int = MIN_MATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed, text and place of every run of k words; a text of fewer words has one seed, its words and their number."""
    counts = np.diff(words.bounds)
    h = rolling(words.hashes, k)
    owner = np.repeat(np.arange(len(counts)), counts)[: len(h)]
    inside = np.arange(len(h)) + k <= words.bounds[owner + 1]
    at = np.flatnonzero(inside)
    found, text, place = [mix(h[at] ^ np.uint64(k))], [owner[at]], [at - words.bounds[owner[at]]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = words.hashes[words.bounds[i] : words.bounds[i + 1]]
        found.append(mix(rolling(own, len(own)) ^ np.uint64(len(own))))
        text.append(np.array([i]))
        place.append(np.array([0]))
    return np.concatenate(found), np.concatenate(text), np.concatenate(place)


def seed_rows(df: DataFrame, keep: bytes | None = None) -> DataFrame:
    """key, seed, place, n_words of df (key, text); with keep, distinct seeds of a batch that pass its bits."""
    shipped = df.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shipped.value is None else np.frombuffer(shipped.value, np.uint8)
        for batch in batches:
            for first, end, raw, offsets in chunks(batch.column("text")):
                words = split(raw, offsets)
                h, text, place = seeds(words)
                if bits is not None:
                    low = h & np.uint64((1 << FILTER_BITS) - 1)
                    some = (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1
                    at = np.flatnonzero(some)
                    h, text, place = h[at], text[at], place[at]
                keys = batch.column("key").slice(first, end - first).take(pa.array(text, pa.int64()))
                sizes = np.diff(words.bounds)[text]
                yield pa.RecordBatch.from_arrays([keys, pa.array(h.view(np.int64)), pa.array(place, pa.int32()), pa.array(sizes, pa.int32())], ["key", "seed", "place", "n_words"])

    return df.select("key", "text").mapInArrow(run, "key string, seed long, place int, n_words int")


def lowered(text: str = "text") -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def indexed_seeds(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item, seed: of each item (key, text), the seeds of which a text that covers threshold of it must share one."""
    rows = seed_rows(items)
    often = rows.groupBy("seed").agg(F.count_distinct("key").alias("n_items"))
    order = Window.partitionBy("key").orderBy("n_items", "seed", "place")
    k = F.least("n_words", F.lit(MIN_MATCH))
    least = F.ceil(F.ceil(threshold * F.col("n_words")) / k)
    ranked = rows.join(often, "seed").withColumn("r", F.row_number().over(order))
    return ranked.filter(F.col("r") <= F.col("n_words") - k + 2 - least).select(F.col("key").alias("item"), "seed").distinct()


def bit_map(indexed: DataFrame) -> bytes:
    """Bits of seeds, by their low FILTER_BITS bits; at most 2 ** FILTER_BITS numbers come to the driver."""
    at = indexed.select(F.col("seed").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("int").alias("b")).distinct().toArrow()["b"].to_numpy()
    bits = np.zeros(1 << FILTER_BITS, np.uint8)
    bits[at] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint where its known size is within BROADCAST_BYTES."""
    return F.broadcast(df) if plan_bytes(df) <= BROADCAST_BYTES else df


class Marks:
    """Which words of one side are marked."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.taken = ids, np.zeros(len(ids), bool)

    def free_runs(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and rolling hashes of the runs of s words without a mark."""
        h = rolling(mix(self.ids.astype(np.uint64)), s)
        n = np.concatenate([[0], np.cumsum(self.taken)])
        at = np.flatnonzero(n[s:] == n[:-s]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]


def matches(item: Marks, text: Marks, s: int) -> list[tuple[int, int, int]]:
    """(-words, item word, text word) of the maximal matches of at least s unmarked words."""
    p, hp = item.free_runs(s)
    t, ht = text.free_runs(s)
    order = np.argsort(hp, kind="stable")
    p, hp = p[order], hp[order]
    low, high = np.searchsorted(hp, ht, "left"), np.searchsorted(hp, ht, "right")
    hit = np.flatnonzero(high > low)
    found = []
    sizes = np.cumsum((high - low)[hit])
    begin = 0
    while begin < len(hit):
        base = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, base + STEP, "right")))
        some = hit[begin:end]
        n = (high - low)[some]
        tt = np.repeat(t[some], n)
        pp = p[np.repeat(low[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        # only the first words of maximal matches
        inner = (pp > 0) & (tt > 0)
        before_p, before_t = np.maximum(pp - 1, 0), np.maximum(tt - 1, 0)
        inner &= (item.ids[before_p] == text.ids[before_t]) & ~item.taken[before_p] & ~text.taken[before_t]
        for a, b in zip(pp[~inner].tolist(), tt[~inner].tolist(), strict=True):
            size = extent(item, text, a, b)
            if size >= s:  # the words themselves, not only their hashes
                found.append((-size, a, b))
        begin = end
    return found


def extent(item: Marks, text: Marks, p: int, t: int) -> int:
    """Equal unmarked words from p and t on."""
    size, step = 0, 64
    most = min(len(item.ids) - p, len(text.ids) - t)
    while size < most:
        a, b = slice(p + size, p + min(size + step, most)), slice(t + size, t + min(size + step, most))
        odd = (item.ids[a] != text.ids[b]) | item.taken[a] | text.taken[b]
        if odd.any():
            return size + int(odd.argmax())
        size, step = min(size + step, most), step * 2
    return size


def tile(item: np.ndarray, text: np.ndarray, k: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (item word, text word, words) of two rows of word ids, in the order in which they are marked."""
    a, b, tiles = Marks(item), Marks(text), []
    s = max(k, min(SEARCH, len(item), len(text)))
    while True:
        queue = matches(a, b, s)
        longest = -min(queue, default=(0,))[0]
        if longest > 2 * s:
            s = longest
            queue = [m for m in queue if -m[0] >= s]
        heapq.heapify(queue)
        while queue:
            size, p, t = heapq.heappop(queue)
            taken = np.flatnonzero(a.taken[p : p - size] | b.taken[t : t - size])
            if not len(taken):
                tiles.append((p, t, -size))
                a.taken[p : p - size] = b.taken[t : t - size] = True
                continue
            for begin, end in itertools.pairwise([-1, *taken.tolist(), -size]):  # what is left between marked words
                if end - begin - 1 >= s:
                    heapq.heappush(queue, (begin + 1 - end, p + begin + 1, t + begin + 1))
        if s == k:
            return tiles
        s = max(k, s // 2)


def word_ids(item: Words, text: Words) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal words of two texts, by the words themselves; -1 for words that only the text has."""
    known: dict[bytes, int] = {}

    def bytes_of(words: Words, i: int) -> bytes:
        return words.data[words.starts[i] : words.ends[i]].tobytes()

    own = np.array([known.setdefault(bytes_of(item, i), len(known)) for i in range(len(item.hashes))], np.int64)
    other = np.full(len(text.hashes), -1, np.int64)
    for i in np.flatnonzero(np.isin(text.hashes, item.hashes)).tolist():
        other[i] = known.get(bytes_of(text, i), -1)
    return own, other


def _words(text: str) -> Words:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return split(raw, np.array([0, len(raw)]))


def tiled(pairs: DataFrame) -> DataFrame:
    """key, item_id, coverage, tiles of pairs (key, text, item_id, item_text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words = None, None
        for batch in batches:
            cover, found = [], []
            for i in range(batch.num_rows):
                if key != (now := batch.column("key")[i].as_py()):
                    key, words = now, _words(batch.column("text")[i].as_py())
                item = _words(batch.column("item_text")[i].as_py())
                n, k = len(item.hashes), min(MIN_MATCH, len(item.hashes))
                tiles = tile(*word_ids(item, words), k) if n >= MIN_MATCH or n == len(words.hashes) else []
                cover.append(sum(x[2] for x in tiles) / n)
                found.append([{"item_word": a, "doc_word": b, "words": c} for a, b, c in tiles])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("item_id"), pa.array(cover, pa.float64()), pa.array(found, pa.list_(_TILE))], ["key", "item_id", "coverage", "tiles"])

    n = shuffle_partitions(pairs.sparkSession)
    placed = pairs.select("key", "text", "item_id", "item_text").repartition(n, "key", "item_id").sortWithinPartitions("key")
    return placed.mapInArrow(run, f"key string, item_id long, coverage double, {TILES}")


def text_key(text: str = "text") -> Column:
    return F.md5(lowered(text))


def all_tiles(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """key (of a text), item_id, coverage, tiles: for every pair of a text and an item that may reach threshold."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), lowered().alias("text")).distinct()
    items = scratch.save(items.withColumn("key", F.md5(F.concat(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.lit("\x1f"), "text"))), "items")
    indexed = scratch.save(indexed_seeds(items, threshold), "indexed")
    texts = docs.select(text_key().alias("key"), lowered().alias("text"))
    met = seed_rows(texts, bit_map(indexed)).select("key", "seed").distinct().join(small(indexed), "seed").select("key", "item").distinct()
    met = scratch.save(met, "met")
    keys = scratch.save(met.select("key").distinct(), "met-keys")
    wanted = texts.join(small(keys), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    named = items.select(F.col("key").alias("item"), "item_id", F.col("text").alias("item_text"))
    return scratch.save(tiled(met.join(wanted, "key").join(small(named), "item")), "tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that cover no item of the benchmark, with all their columns."""
    key = unused("fathomry_key", docs.columns)
    bad = scratch.save(all_tiles(docs, benchmark, scratch, threshold).filter(F.col("coverage") >= threshold).select(F.col("key").alias(key)).distinct(), "bad")
    return docs.withColumn(key, text_key()).join(small(bad), key, "left_anti").drop(key)


def op3_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document: whether it is contaminated, by which items, and the largest coverage and number of tiles of
    the items that it might have covered."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    scratch = Scratch(spark, "op3")
    hit = F.col("coverage") >= THRESHOLD
    found = all_tiles(docs, benchmark, scratch).groupBy("key").agg(
        F.max(hit).alias("contaminated"),
        F.array_sort(F.collect_set(F.when(hit, F.col("item_id")))).alias("item_ids"),
        F.max("coverage").alias("coverage"),
        F.sum(F.size("tiles")).alias("n_tiles"),
    )
    placed = docs.select("doc_id", text_key().alias("key")).join(small(scratch.save(found, "found")), "key", "left")
    return placed.select(
        "doc_id",
        F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("n_tiles", F.lit(0)).cast("long").alias("n_tiles"),
    )
