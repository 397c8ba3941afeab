"""Vector expressions and the default embedder."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-8
#: Tokens that a worker counts at once.
SLICE = 250_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + TINY)


def slices(sizes: np.ndarray, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows of at most ``rows`` rows that add up to at most ``most``; one row at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        to = min(max(full, at + 1), at + rows)
        yield at, to
        at = to


def list_sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def buckets(terms: pa.Array, dims: int) -> np.ndarray:
    """The bucket to which each term hashes: the first two bytes of its md5, modulo ``dims``."""
    digests = b"".join([md5(t, usedforsecurity=False).digest() for t in terms.cast(pa.binary()).to_numpy(zero_copy_only=False)])
    return np.frombuffer(digests, ">u2").reshape(-1, 8)[:, 0].astype(np.int64) % dims


def with_hashed(df: DataFrame, tokens: Column, dims: int = 64, name: str = "vector") -> DataFrame:
    """Default embedder: how many tokens hash to each of ``dims`` buckets. Whole numbers, so products are exact. Null tokens: null.

    A worker takes a batch of rows in slices of bounded tokens, hashes each distinct token of a slice once, and numpy counts the buckets.
    """
    @F.arrow_udf("array<double>")
    def counted(lists: pa.Array) -> pa.Array:
        sizes = list_sizes(lists)
        counts = np.zeros((len(sizes), dims))
        for low, high in slices(sizes, len(sizes), SLICE):
            coded = lists.slice(low, high - low).flatten().dictionary_encode()
            if len(coded):
                cell = np.repeat(np.arange(high - low) * dims, sizes[low:high]) + buckets(coded.dictionary, dims)[coded.indices.to_numpy()]
                counts[low:high] = np.bincount(cell, minlength=(high - low) * dims).reshape(-1, dims)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * dims, pa.int32()), pa.array(counts.ravel()), mask=lists.is_null())

    return df.withColumn(name, counted(tokens))
