"""Words of whole Arrow batches by NumPy: splitting, hashing and shingles without a Python loop over words.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``; ASCII letters are lower-cased. UTF-8 sequences never
contain those bytes, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CHUNK_BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    key = str(int(base))
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        _powers[key] = have = np.cumprod(have, dtype=np.uint64)
    return have


class Words(NamedTuple):
    """Words of some texts: a 64-bit hash each, their byte spans in ``data``, and each text's range of words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # of len(texts) + 1
    data: np.ndarray

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts (null: empty) and their offsets."""
    if texts.null_count:
        texts = texts.fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, where, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets): texts in runs of about size bytes; a longer text is a run of its own."""
    raw, offsets = text_buffer(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def split(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Lower-cased words of the texts at offsets in raw."""
    data = _LOWER[raw]
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = ~_BLANK[data]
    first = solid[:-1].copy()
    first[1:] &= ~solid[:-2]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] |= solid[edge]
    last = solid[:-1] & ~solid[1:]
    last[edge - 1] |= solid[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, offsets, "left")
    total = np.zeros(len(data) + 1, np.uint64)
    powers = powers_of(BASE, len(data) + 1)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=total[1:])
    sums = total[ends] - total[starts]
    hashes = mix(sums * powers_of(BASE_INVERSE, len(data) + 1)[starts] ^ (ends - starts).astype(np.uint64))
    return Words(hashes, starts, ends, bounds, data)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles in order, and their bounds; with fewer words, all words as one shingle."""
    h, bounds = words.hashes, words.bounds
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(bounds[:-1] - out_bounds[:-1], n) + np.arange(out_bounds[-1])
    size = np.repeat(np.minimum(counts, k), n)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = size > j
        if inside.all():
            out = mix(out * BASE + h[at + j] + np.uint64(j + 1))
        else:
            out[inside] = mix(out[inside] * BASE + h[at[inside] + j] + np.uint64(j + 1))
    return out, out_bounds
