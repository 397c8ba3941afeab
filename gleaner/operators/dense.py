"""Exact dense search: blocks of queries meet blocks of chunks, and only each block's best leave a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import TINY, cosine
from gleaner.operators.lexical import ranked
from gleaner.params import Params

#: Chunks and queries in a block, and queries of a block that meet its chunks at once. Chunk blocks of a group, about: there are as many groups as that gives, whatever the cluster.
CHUNK_BLOCK, QUERY_BLOCK, AT_ONCE, GROUP_BLOCKS = 2048, 1024, 128, 32


def dealt(chunk_blocks: DataFrame, query_blocks: DataFrame, groups: int) -> DataFrame:
    """Each chunk block beside each query block. Chunk blocks are dealt to groups as they come; each query block goes to every group. What a Python worker gets at once is bounded in bytes by Spark."""
    left = chunk_blocks.withColumn("group", F.pmod(F.monotonically_increasing_id() + 7 * F.spark_partition_id(), F.lit(groups)).cast("int"))
    return query_blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(left, "group")


def _packed(rows: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Rows packed as (name_keys, name_matrix) in partition order."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                keys = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(0))
                matrix = piece.column(1).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([keys, pa.array([matrix.tobytes()], pa.binary())], [f"{name}_keys", f"{name}_matrix"])

    own = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    return own.mapInArrow(pack, f"{name}_keys array<{rows.schema[key].dataType.simpleString()}>, {name}_matrix binary")


def search(questions: DataFrame, chunks: DataFrame, query: str, key: str, query_vector: str = "vector", vector: str = "vector", params: Params = Params(), n: int | None = None, above: float | None = 0.0, not_itself: bool = False) -> DataFrame:
    """(query, key, score, rank): cosine with TINY on each length; scores not above ``above`` are left out after the cut to n."""
    packed = _packed(chunks, key, vector, CHUNK_BLOCK, "c")
    return search_blocks(questions, packed, chunks.count(), query, key, query_vector, params, n, above, not_itself)


def search_blocks(questions: DataFrame, blocks: DataFrame, n_chunks: int, query: str, key: str, query_vector: str = "vector", params: Params = Params(), n: int | None = None, above: float | None = 0.0, not_itself: bool = False) -> DataFrame:
    """``search`` of chunks in blocks: (c_keys, c_matrix), the keys and their vectors one after the other."""
    n = n or params.candidates
    kinds = f"{query} {questions.schema[query].dataType.simpleString()}, {key} {blocks.schema['c_keys'].dataType.elementType.simpleString()}, score double"
    groups = max(1, questions.sparkSession._jsc.sc().defaultParallelism(), n_chunks // (CHUNK_BLOCK * GROUP_BLOCKS))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ck, cm, qk, qm = (batch.column(x)[i] for x in range(4))
                chunk_keys, query_keys = ck.values, qk.values
                c, every = np.frombuffer(cm.as_buffer()).reshape(len(chunk_keys), -1), np.frombuffer(qm.as_buffer()).reshape(len(query_keys), -1)
                length = np.sqrt((c * c).sum(1)) + TINY
                place = np.empty(len(chunk_keys), np.int64)
                place[pc.sort_indices(chunk_keys).to_numpy()] = np.arange(len(chunk_keys))
                for at in range(0, len(every), AT_ONCE):
                    q, asked = every[at : at + AT_ONCE], query_keys.slice(at, AT_ONCE)
                    scores = (q @ c.T) / ((np.sqrt((q * q).sum(1)) + TINY)[:, None] * length[None, :])
                    rounded = np.round(scores, 6)
                    if not_itself:
                        rounded[asked.to_numpy(zero_copy_only=False)[:, None] == chunk_keys.to_numpy(zero_copy_only=False)[None, :]] = -np.inf
                    rows, columns = [], []
                    for j in range(len(q)):
                        least = np.partition(rounded[j], len(place) - n)[len(place) - n] if len(place) > n else -np.inf
                        some = np.flatnonzero((rounded[j] >= least) & np.isfinite(rounded[j]))
                        columns.append(some[np.lexsort((place[some], -rounded[j][some]))[:n]])
                        rows.append(np.full(len(columns[-1]), j))
                    r, k = np.concatenate(rows), np.concatenate(columns)
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(r)), chunk_keys.take(pa.array(k)), pa.array(scores[r, k])], [query, key, "score"])

    met = dealt(blocks.select("c_keys", "c_matrix"), _packed(questions, query, query_vector, QUERY_BLOCK, "q"), groups)
    best = ranked(met.select("c_keys", "c_matrix", "q_keys", "q_matrix").mapInArrow(meet, kinds), query, [key], n)
    return best if above is None else best.filter(F.round("score", 6) > above)


def unpacked(blocks: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, vector) of blocks, a row for each chunk."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, flat = batch.column(0)[i].values, np.frombuffer(batch.column(1)[i].as_buffer())
                ends = np.arange(len(keys) + 1) * (len(flat) // max(1, len(keys)))
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], [key, vector])

    return blocks.select("c_keys", "c_matrix").mapInArrow(rows, f"{key} {blocks.schema['c_keys'].dataType.elementType.simpleString()}, {vector} array<double>")


def lookup(keys: DataFrame, vectors: DataFrame, on: list[str], vector: str = "vector") -> DataFrame:
    """The vectors of candidate keys; null where there is none."""
    return keys.join(vectors.select(*on, vector), on, "left")


def pair_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("similarity", cosine(F.col(a), F.col(b)))
