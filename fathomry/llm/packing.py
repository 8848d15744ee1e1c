"""Packing of documents into sequences of a fixed number of tokens by length patterns.

1. Each text becomes ids (an end id closes it); only a longer document is cut, into pieces of the capacity, of which
   the first may be shorter.
2. The histogram of piece lengths (at most ``capacity`` numbers) goes to the driver. Patterns of one to three lengths
   that fill a sequence exactly are enumerated, their repeat counts are fitted to the histogram by non-negative
   least squares, rounded down, and the pieces left over are packed best fit, longest first, by counts.
3. Pieces of a length are ranked across salted groups, and a rank names its place in the plan.

Cases: a null text counts as empty (its end id only); a null document id is kept; repeated rows are pieces of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_partitions
from .tokens import default_vocabulary, encoder, merged, with_end

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[int]:
    """Where the pieces of n ids begin; the last element is n."""
    return [0, *range(n - (n - 1) // capacity * capacity, n + 1, capacity)] if n else [0]


def cut_pieces(df: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """PIECES of df's (doc_id, text)."""
    vocabulary = vocabulary or default_vocabulary()

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in merged(batches):
            ids, at = with_end(*encoder(vocabulary).encode(part.column("text")), end_id)
            wide = ids.astype("<u4")
            rows = []
            for j, doc_id in enumerate(part.column("doc_id").to_pylist()):
                own = wide[at[j] : at[j + 1]]
                edges = cut(len(own), capacity)
                rows += [(doc_id, k, b, e - b, zlib.crc32(own[b:e].tobytes())) for k, (b, e) in enumerate(zip(edges, edges[1:], strict=False))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of one to three of the lengths that sum to capacity; rows of three, filled up with 0."""
    has = np.zeros(capacity + 1, bool)
    has[lengths] = True
    out = [np.array([[capacity, 0, 0]])] if has[capacity] else []
    small = lengths[lengths < capacity]
    pair = small[(2 * small >= capacity) & has[capacity - small]]
    out.append(np.stack([pair, capacity - pair, 0 * pair], 1))
    for a in small[3 * small >= capacity]:
        b = small[(small <= a) & (2 * small >= capacity - a) & (small < capacity - a)]
        b = b[has[capacity - a - b]]
        out.append(np.stack([np.full(len(b), a), b, capacity - a - b], 1))
    return np.concatenate(out).astype(np.int64)


def fit_counts(rows: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares of pattern counts to the histogram, by projected scaled gradient steps."""
    size = len(histogram)
    used = np.bincount(rows.ravel(), minlength=size).astype(float)
    used[0] = 0
    weight = np.divide(1.0, used, out=np.zeros(size), where=used > 0)
    scale = 1.0 / (rows > 0).sum(1)
    x = y = np.zeros(len(rows))
    momentum = 1.0
    for _ in range(rounds):
        gap = histogram - np.bincount(rows.ravel(), weights=np.repeat(y, 3), minlength=size)
        gap *= weight
        gap[0] = 0
        new = np.maximum(0, y + scale * gap[rows].sum(1))
        turn = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = np.maximum(0, new + (momentum - 1) / turn * (new - x))
        x, momentum = new, turn
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack counts of lengths, longest first, each into the fullest open sequences that it fits; (lengths, repeats)."""
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, bool)
    for size in np.flatnonzero(left)[::-1].tolist():
        count = int(left[size])
        while count:
            fits = size + int(np.argmax(filled[size:]))
            if not filled[fits]:
                each = capacity // size
                for k, n in ((each, count // each), (count % each, 1)):
                    if k and n:
                        room[capacity - k * size].append(((size,) * k, n))
                        filled[capacity - k * size] = True
                break
            have, n = room[fits].pop()
            take = min(n, count)
            if n > take:
                room[fits].append((have, n - take))
            filled[fits] = bool(room[fits])
            room[fits - size].append(((*have, size), take))
            filled[fits - size] = True
            count -= take
    return [g for at in room for g in at]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) that use up the histogram (index: length).

    The fit is rounded down at four scales, which leave more or fewer pieces to best fit; the fewest sequences win.
    """
    rows = patterns(np.flatnonzero(histogram), capacity)
    x = fit_counts(rows, histogram.astype(float)) if len(rows) else np.zeros(0)
    best: list[tuple[tuple[int, ...], int]] | None = None
    for share in (1.0, 0.9, 0.7, 0.4):
        left, groups = histogram.copy(), []
        whole = np.floor(x * share + 1e-6).astype(np.int64)
        for i in np.flatnonzero(whole)[np.argsort(-whole[whole > 0], kind="stable")].tolist():
            own = tuple(int(v) for v in rows[i] if v)
            n = min(int(whole[i]), *(int(left[v]) // own.count(v) for v in own))
            if n > 0:
                groups.append((own, n))
                for v in own:
                    left[v] -= n
        groups += best_fit(left, capacity)
        if best is None or sum(n for _, n in groups) < sum(n for _, n in best):
            best = groups
    return best or []


def pack(df: DataFrame, scratch: Scratch, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """PIECES of df's (doc_id, text) with sequence_id and offset, in as few sequences as the plan needs."""
    spark = df.sparkSession
    salts = shuffle_partitions(spark)
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    pieces = scratch.save(cut_pieces(df, capacity, vocabulary, end_id), "pieces").withColumn("salt", salt)
    counts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most capacity rows
        histogram[length] = n
    keys, first, places = [], [], []
    used, sequences = np.zeros(capacity + 1, np.int64), 0
    for lengths, n in plan(histogram, capacity):
        at = 0
        for v in lengths:
            keys.append((v << 44) + int(used[v]))
            first.append(sequences)
            places.append(at)
            used[v] += n
            at += v
        sequences += n
    order = np.argsort(np.array(keys, np.int64))
    slots = spark.sparkContext.broadcast(tuple(np.array(c, np.int64)[order] for c in (keys, first, places)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, begin, offset = slots.value
        want = (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64)
        i = np.searchsorted(key, want, "right") - 1
        return pd.DataFrame({"sequence_id": begin[i] + want - key[i], "offset": offset[i]})

    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("own", own).join(before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["length", "salt"])
    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", place("length", (F.col("before") + F.col("own")).cast("long")).alias("at"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op7"))
