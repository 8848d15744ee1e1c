"""Homomorphic multiset fingerprints of texts.

A fingerprint is the sum, lane by lane and modulo a power of two, of one wide vector for each paragraph (line with a
word), so the order of paragraphs does not matter and a paragraph can be added or taken away without the rest. A
paragraph's vector has

* ``EQUAL`` lanes modulo 2**32 from BLAKE2b of the paragraph: equal multisets have equal lanes, others do not but by
  a chance of about 2**-512;
* a count of its shingles modulo 2**32 and ``LIKE`` lanes modulo 2**16, where each five-word shingle of the paragraph
  (with fewer words, the whole) adds +1 or -1 to a lane drawn by its hash. The squared length of the difference of two
  such sums estimates the number of shingles that only one of the texts has, so likeness is
  1 - |a - b|^2 / (count a + count b), between 0 and 1, and exactly 1 for equal fingerprints.

The string is Base64 of the little-endian lanes. Texts without words have no shingles: they are like each other (1) and
like no other text (0).

Cases: a null text counts as empty; a null document id comes after all others and keeps its row; rows that repeat a
document id are neighbours, ordered by their texts' hash and text; the only row of a table is its own next document;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import block_of, filled, key_bounds
from .scratch import block_count, bounded_batches
from .words import CHUNK_BYTES, mix, shingles, split

EQUAL, LIKE, SHINGLE = 16, 256, 5


class Fingerprint:
    """A multiset of paragraphs; + and - take and give whole multisets."""

    __slots__ = ("count", "equal", "like")

    def __init__(self, equal: np.ndarray | None = None, count: int = 0, like: np.ndarray | None = None):
        self.equal = np.zeros(EQUAL, np.uint32) if equal is None else equal
        self.like = np.zeros(LIKE, np.uint16) if like is None else like
        self.count = count % (1 << 32)

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        return fingerprints([text or ""])[0]

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal + other.equal, self.count + other.count, self.like + other.like)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal - other.equal, self.count - other.count, self.like - other.like)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and str(self) == str(other)

    def __hash__(self) -> int:
        return hash(str(self))

    def __str__(self) -> str:
        return base64.b64encode(self.equal.astype("<u4").tobytes() + np.uint32(self.count).tobytes() + self.like.astype("<u2").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw, "<u4", EQUAL), int(np.frombuffer(raw, "<u4", 1, 4 * EQUAL)[0]), np.frombuffer(raw, "<u2", LIKE, 4 * EQUAL + 4))

    def likeness(self, other: Fingerprint) -> float:
        if np.array_equal(self.equal, other.equal):
            return 1.0
        total = self.count + other.count
        if not total:
            return 1.0
        gap = (self.like - other.like).view(np.int16).astype(np.int64)
        return max(0.0, 1.0 - float((gap * gap).sum()) / total)


def fingerprints(texts: list[str]) -> list[Fingerprint]:
    """The fingerprint of each text, shingled together in NumPy."""
    out = []
    for first, end in _runs(texts):
        lines, counts = [], []
        for t in texts[first:end]:
            own = [x for x in t.encode("utf-8", "surrogatepass").split(b"\n") if x and not x.isspace()]
            lines += own
            counts.append(len(own))
        digests = np.frombuffer(b"".join(hashlib.blake2b(x).digest() for x in lines), "<u4").reshape(-1, EQUAL)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
        hashes, bounds = shingles(split(np.frombuffer(b"".join(lines), np.uint8), offsets), SHINGLE)
        edge = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        bounds = bounds[edge]
        drawn = mix(hashes ^ np.uint64(0xA24BAED4963EE407))
        owner = np.repeat(np.arange(end - first), np.diff(bounds))
        cell = owner * LIKE + (drawn & np.uint64(LIKE - 1)).astype(np.int64)
        sign = ((drawn >> np.uint64(40)) & np.uint64(1)).astype(float) * 2 - 1
        like = np.bincount(cell, weights=sign, minlength=(end - first) * LIKE).astype(np.int64).astype(np.uint16).reshape(-1, LIKE)
        total = np.concatenate([np.zeros((1, EQUAL), np.uint32), np.cumsum(digests, 0, dtype=np.uint32)])
        equal = total[edge[1:]] - total[edge[:-1]]
        out += [Fingerprint(equal[i], int(bounds[i + 1] - bounds[i]), like[i]) for i in range(end - first)]
    return out


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > CHUNK_BYTES // 2:
            yield first, i
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, len(texts)


def edited(text: str, following: str) -> str:
    """text with its second half (rounded down) replaced by as many characters from the start of following, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """OUT for each row of docs (doc_id, text); the next document is the one with the next smaller id, and after the
    last the first. Texts are shuffled once, by ranges of doc_id; each range also gets the row that follows it."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), filled("doc_id").alias("key"))
    bounds = key_bounds(narrow, "key", block_count(narrow))
    low, high = narrow.agg(F.min("key"), F.max("key")).first()
    n = len(bounds) + 1
    # keys are cut as (.., bounds[0]], (bounds[0], bounds[1]], ...: a bound is the largest key of its block, and so it
    # follows the smallest key of the block above; the largest key of all follows the smallest
    block = block_of(F.col("key"), bounds)
    ghost = F.when(F.col("key") == high, F.lit(0)).when(F.col("key").isin(bounds) if n <= 64 else block_of(F.col("key") + 1, bounds) > block_of(F.col("key"), bounds), block_of(F.col("key"), bounds) + 1)
    placed = narrow.withColumn("block", block).withColumn("ghost", ghost)
    both = placed.select("doc_id", "text", "key", F.explode(F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("ghost")), F.struct(F.col("ghost").alias("block"), F.lit(True).alias("ghost")))).alias("at")).filter("at.block is not null")
    # a single key: its rows follow each other round in the one block
    both = both.select("doc_id", "text", "key", F.col("at.block").alias("block"), F.col("at.ghost").alias("ghost"))
    ordered = both.repartitionById(n, "block").sortWithinPartitions("ghost", F.col("key").desc(), F.xxhash64("text"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose next document is still to come: id, text, fingerprint
        done = False
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                ids, texts, ghosts = (part.column(c).to_pylist() for c in ("doc_id", "text", "ghost"))
                if True in ghosts:  # the first row of the following block ends this one
                    cut = ghosts.index(True) + 1
                    ids, texts, done_now = ids[:cut], texts[:cut], True
                else:
                    done_now = False
                if done:
                    continue
                prints = fingerprints(texts)
                rows = ([held] if held else []) + list(zip(ids, texts, prints, strict=True))
                held, done = (None, True) if done_now else (rows[-1], False)
                pairs = list(zip(rows, rows[1:], strict=False))
                changed = [edited(a[1], b[1]) for a, b in pairs]
                marks = fingerprints(changed)
                out = [
                    (a[0], len(a[1]), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), str(a[2]), str(f), a[2].likeness(f), a[2].likeness(b[2]))
                    for (a, b), c, f in zip(pairs, changed, marks, strict=True)
                ]
                columns = list(zip(*out, strict=True)) or [()] * len(KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], [x.split()[0] for x in OUT.split(", ")])

    return ordered.mapInArrow(run, OUT)


def op8_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    bounded_batches(spark)
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
