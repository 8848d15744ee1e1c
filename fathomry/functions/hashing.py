"""Signed hash vectors of words: places and signs drawn from BLAKE2b, the same on every machine."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM, NNZ, STEM_NNZ, PAIR_NNZ, CONTEXT_NNZ = 2048, 64, 32, 16, 16
#: Spaces of vectors: words, word pairs, stems.
WORD_SPACE, PAIR_SPACE, STEM_SPACE = 0, 1, 2


def hash_vector(message: str, nnz: int = NNZ, dim: int = DIM) -> dict[int, int]:
    """nnz distinct places of dim with signs; a shorter vector is the beginning of a longer one."""
    out: dict[int, int] = {}
    block = 0
    while len(out) < nnz:
        d = hashlib.blake2b(message.encode() + block.to_bytes(4, "little")).digest()
        for k in range(21):
            out.setdefault((d[3 * k] * 256 + d[3 * k + 1]) % dim, 1 if d[3 * k + 2] % 2 else -1)
            if len(out) == nnz:
                break
        block += 1
    return out


@lru_cache(maxsize=100_000)
def vector(token: str, space: int = WORD_SPACE, nnz: int = NNZ) -> tuple[tuple[int, int], ...]:
    return tuple(hash_vector(f"{space}\x1f{token}", nnz).items())


BLOCK = 21  # places in one digest


def arrays(messages: list[str], nnz: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of hash_vector() of many messages, a row of nnz for each."""
    blocks = -(-nnz * 21 // 16 // BLOCK)
    raw = b"".join([hashlib.blake2b(m + b).digest() for m in map(str.encode, messages) for b in [i.to_bytes(4, "little") for i in range(blocks)]])
    cut = np.frombuffer(raw, np.uint8).reshape(len(messages), blocks, 64)[:, :, : 3 * BLOCK].reshape(len(messages), blocks * BLOCK, 3)
    place = (cut[:, :, 0].astype(np.int32) * 256 + cut[:, :, 1]) % DIM
    sign = np.where(cut[:, :, 2] % 2, 1, -1).astype(np.int32)
    out = place[:, :nnz].copy(), sign[:, :nnz].copy()
    ordered = np.sort(out[0], axis=1)
    rows = np.nonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1))[0]
    if len(rows):  # a place twice: the first one holds
        order = np.argsort(place[rows], axis=1, kind="stable")
        again = np.zeros(order.shape, bool)
        by_place = np.take_along_axis(place[rows], order, axis=1)
        again[:, 1:] = by_place[:, 1:] == by_place[:, :-1]
        first = np.empty_like(again)
        np.put_along_axis(first, order, ~again, axis=1)
        first &= np.cumsum(first, axis=1) <= nnz
        full = first.sum(axis=1) == nnz
        for x, y in zip(out, (place, sign), strict=True):
            x[rows[full]] = y[rows[full]][first[full]].reshape(-1, nnz)
        for row in rows[~full]:
            own = hash_vector(messages[row], nnz)
            out[0][row], out[1][row] = list(own), list(own.values())
    return out


class Drawn:
    """Vectors of a space in a worker; those of the last words are kept, MOST at most."""

    MOST = 50_000

    def __init__(self, space: int, nnz: int):
        self.space, self.nnz, self.seat = space, nnz, {}
        self.places, self.signs = np.zeros((0, nnz), np.int32), np.zeros((0, nnz), np.int32)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and signs, a row for each word."""
        if new := [w for w in dict.fromkeys(words) if w not in self.seat]:
            if len(self.seat) + len(new) > self.MOST and self.seat:
                self.__init__(self.space, self.nnz)
                return self.of(words)
            drawn = arrays([f"{self.space}\x1f{w}" for w in new], self.nnz)
            at, to = len(self.seat), len(self.seat) + len(new)
            if to > len(self.places):  # room for as many again, so that words can come one by one
                more = np.zeros((to, self.nnz), np.int32)
                self.places, self.signs = np.concatenate([self.places[:at], more]), np.concatenate([self.signs[:at], more])
            self.places[at:to], self.signs[at:to] = drawn
            self.seat.update(zip(new, range(at, to), strict=True))
        at = np.array([self.seat[w] for w in words], np.int64)
        return self.places[at], self.signs[at]


def vector_of(token: Column, space: Column, nnz: Column) -> Column:
    """Array of (pos, sign). For distinct words only: join the result to their uses."""

    @F.arrow_udf("array<struct<pos: int, sign: int>>")
    def draw(token: pa.Array, space: pa.Array, nnz: pa.Array) -> pa.Array:
        rows = [vector(t, k, n) for t, k, n in zip(token.to_pylist(), space.to_pylist(), nnz.to_pylist(), strict=True)]
        flat = np.array([e for r in rows for e in r], np.int32).reshape(-1, 2)
        ends = np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["pos", "sign"]))

    return draw(token, space, nnz)
