"""Contiguous blocks of a key, for outputs in key order without a sort in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_bounds(df: DataFrame, key: str, blocks: int) -> list[int]:
    """Some keys that df has, in order, which cut it into about equal blocks; reads only the key column.

    The driver holds one number for each block. A null key counts as the smallest 64-bit integer.
    """
    if blocks < 2:
        return []
    at = [i / blocks for i in range(1, blocks)]
    got = df.agg(F.percentile_approx(filled(key), at, max(10_000, 20 * blocks))).first()[0]
    return sorted(set(got or []))


def filled(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))


def block_of(key: Column, bounds: list[int]) -> Column:
    """The block of a key: the number of bounds that are smaller. Only the key goes to Python."""
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(np.int64), "left").astype(np.int32))

    return place(key)
