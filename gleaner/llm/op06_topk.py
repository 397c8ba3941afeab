"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Every component x counts as floor(scale * x), so scores are integers and ties are exact. Vectors are rotated onto the principal axes of all
vectors, which moves most of a product into its first HEAD terms. Candidates are packed into blocks in descending order of length. The
longest ones are scored first against all queries; each query's k-th score there is a bound from below for its result. Then each block of queries meets
each block of candidates: a candidate whose length times the query's can't reach the bound is passed over, with all that follow it;
so is one whose head product plus the product of the two remaining lengths can't; only the others are scored in full, in integers.
Bounds are widened by more than rounding can add, and an equal score is never pruned, so the result is exact.

Queries grow with the table and are therefore blocks of rows too, sent to blocks of candidates by a join on the block number; neither side is broadcast.

Nulls and odd input: vectors that are null, empty, of another length than most (the most common length, the larger of two), or hold null or non-finite components take no part,
and neither do rows with a null id; rows with one id are separate candidates but never answer a query with their id; of rows that share a query's id the largest vector asks; a table of fewer
than k other vectors returns all; an empty table gives an empty result; other columns are ignored. Scores beyond 2**53 are
summed as Python integers and must fit a signed 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, without_clashes

K, SCALE, EVERY = 5, 256, 50
#: Leading rotated dimensions of the first bound, vectors in a block, and candidates scored to begin with.
HEAD, BLOCK, SEED_ROWS = 16, 4096, 2048
BLOCKS = "block long, ids binary, vectors binary"
#: Candidate blocks whose extents meet a block of queries at once, and the end of 64-bit integers.
EXTENTS, LIMIT = 4096, 2**63


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, vector, norm) packed in their order; block numbers differ between partitions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else 0
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                vectors = np.asarray(piece.column(1).flatten(), np.float64)
                row = {"block": pa.array([(part << 32) + n], pa.int64()), "ids": pa.array([piece.column(0).to_numpy().tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary())}
                yield pa.RecordBatch.from_pydict(row)
                n += 1

    return rows.withColumn("part", F.spark_partition_id()).select("id", "vector", "part").mapInArrow(pack, BLOCKS)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products, in 64 bits: those beyond count as the greatest or the least. float64 is exact while every partial sum stays below 2**53."""
    if len(vectors) and np.abs(vectors).max() * np.abs(query).max() * len(query) < 2**53:
        return (vectors @ query).astype(np.int64)
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(v, query, strict=True)), -LIMIT), LIMIT - 1) for v in vectors], np.int64)


def reaches(queries: np.ndarray, floors: np.ndarray, extents: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """(queries, blocks): whether a block may hold a score that reaches a query's floor. ``extents``: of each block the greatest length and tail, then the least and the greatest of each head dimension."""
    asked, width = queries @ rotation, (extents.shape[1] - 2) // 2
    head, length, tail = asked[:, :width], np.sqrt((queries**2).sum(axis=1)), np.sqrt((asked[:, width:] ** 2).sum(axis=1))
    low, high = extents[:, 2 : 2 + width], extents[:, 2 + width :]
    bound = np.maximum(head, 0) @ high.T + np.minimum(head, 0) @ low.T + np.outer(tail, extents[:, 1])
    bound = np.minimum(bound, np.outer(length, extents[:, 0]))
    # Rounding grows with the lengths.
    slack = 1e-9 * np.outer(length, extents[:, 0]) + 1e-6
    return bound >= open_floors(floors)[:, None] - slack


def open_floors(floors: np.ndarray) -> np.ndarray:
    """Floors that scores cut to 64 bits can't tell from others bar nothing."""
    return np.where(floors <= -LIMIT / 2, -np.inf, np.minimum(floors, LIMIT / 2))


def search(query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of what can be among each query's k best of these candidates. ``vectors`` descend by length."""
    turned, asked = vectors @ rotation, queries @ rotation
    length, tail = np.sqrt((vectors**2).sum(axis=1)), np.sqrt((turned[:, HEAD:] ** 2).sum(axis=1))
    q_length, q_tail = np.sqrt((queries**2).sum(axis=1)), np.sqrt((asked[:, HEAD:] ** 2).sum(axis=1))
    out, floors = [], open_floors(floors)
    for i in range(len(queries)):
        slack = 1e-9 * q_length[i] * (length[0] if len(length) else 0) + 1e-6
        reach = int(np.searchsorted(-(length * q_length[i]), -(floors[i] - slack), side="right"))
        if not reach:
            continue
        bound = turned[:reach, :HEAD] @ asked[i, :HEAD] + tail[:reach] * q_tail[i]
        left = np.flatnonzero((bound >= floors[i] - slack) & (ids[:reach] != query_ids[i]))
        if len(left):
            scores = exact_scores(vectors[left], queries[i])
            top = best(scores, ids[left], k)
            out.append((np.full(len(top), i), left[top], scores[top]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_k(table: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates. ``is_query`` is a condition on the id, as column id."""
    scratch = Scratch(table.sparkSession, "topk")
    own = without_clashes(table, id_col, vector_col).toDF("vec_id", "v").filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    doubles = F.transform("v", lambda x: x.cast("double"))
    own = own.filter((F.size("v") > 0) & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    width = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score long"
    if not width:
        return table.sparkSession.createDataFrame([], schema)
    own = own.filter(F.size("v") == width[0]["n"]).select(F.col("vec_id").cast("long").alias("id"), F.transform(doubles, lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("vector"))
    own = own.withColumn("norm", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    n = int(width[0]["n"])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, n)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"row": pa.array(np.arange(n)), "sums": pa.array(list(total))})

    # One n x n matrix of second moments, added up by row in Spark; its axes are the right singular vectors of all rows.
    added = own.select("vector").mapInArrow(moments, "row long, sums array<double>").groupBy("row").agg(*[F.sum(F.col("sums")[j]).alias(f"c{j}") for j in range(n)])
    second = np.array([[r[f"c{j}"] for j in range(n)] for r in added.orderBy("row").collect()])
    rotation = np.linalg.eigh(second)[1][:, ::-1].copy()

    order = [F.desc("norm"), F.asc("id")]
    parts = max(table.sparkSession._jsc.sc().defaultParallelism(), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = own.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    packed = scratch.write(blocks(ranged, block), "candidates")
    asked = own.filter(F.coalesce(is_query, F.lit(False))).groupBy("id").agg(F.max("vector").alias("vector"))
    asked = scratch.write(blocks(asked.repartitionByRange(parts, "id").sortWithinPartitions("id"), block).withColumnsRenamed({"block": "asked", "ids": "query_ids", "vectors": "queries"}), "queries")

    seeds = own.orderBy(*order).limit(SEED_ROWS).toPandas()  # a fixed number of rows
    seed_ids, seed_vectors = seeds["id"].to_numpy(np.int64), np.stack(seeds["vector"].to_numpy()).astype(np.float64)

    def floors(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            made = []
            for ids, vectors in zip(batch["query_ids"], batch["queries"], strict=True):
                q = np.frombuffer(vectors).reshape(-1, n)
                own_ids, low = np.frombuffer(ids, np.int64), np.full(len(q), -np.inf)
                for i in range(len(q)):
                    scores = exact_scores(seed_vectors[seed_ids != own_ids[i]], q[i])
                    if len(scores) >= k:
                        low[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
                made.append(low.tobytes())
            yield batch.assign(floors=made)

    asked = asked.mapInPandas(floors, "asked long, query_ids binary, queries binary, floors binary")

    def extents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """EXTENTS blocks as one row: their numbers, and what bounds them."""
        for batch in batches:
            made = []
            for vectors in batch["vectors"]:
                x = np.frombuffer(vectors).reshape(-1, n)
                turned = x @ rotation
                head = turned[:, :HEAD]
                made.append(np.concatenate([[np.sqrt((x**2).sum(axis=1)).max(), np.sqrt((turned[:, HEAD:] ** 2).sum(axis=1)).max()], head.min(axis=0), head.max(axis=0)]))
            for at in range(0, len(made), EXTENTS):
                yield pd.DataFrame({"blocks": [batch["block"].tolist()[at : at + EXTENTS]], "extents": [np.array(made[at : at + EXTENTS]).tobytes()]})

    bounds = packed.select("block", "vectors").mapInPandas(extents, "blocks array<long>, extents binary")
    bounds = scratch.write(bounds.withColumn("pack", F.monotonically_increasing_id()), "extents")
    # One number for each task that read candidates, or each EXTENTS blocks, comes to the driver; nothing of the vectors themselves.
    packs = [r["pack"] for r in bounds.select("pack").collect()]

    def cut(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """To each block go only the queries whose floor it may reach."""
        for batch in rows:
            for x in batch.itertuples():
                ids, q, low = np.frombuffer(x.query_ids, np.int64), np.frombuffer(x.queries).reshape(-1, n), np.frombuffer(x.floors)
                may = reaches(q, low, np.frombuffer(x.extents).reshape(len(x.blocks), -1), rotation)
                for b in np.flatnonzero(may.any(axis=0)):
                    mine = may[:, b]
                    yield pd.DataFrame({"block": [int(x.blocks[b])], "query_ids": [ids[mine].tobytes()], "queries": [q[mine].tobytes()], "floors": [low[mine].tobytes()]})

    sent = asked.drop("asked").withColumn("pack", F.explode(F.array(*[F.lit(x).cast("long") for x in packs])))
    sent = sent.join(bounds, "pack").drop("pack").mapInPandas(cut, "block long, query_ids binary, queries binary, floors binary")

    def meet(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for x in batch.itertuples():
                ids, own_ids = np.frombuffer(x.ids, np.int64), np.frombuffer(x.query_ids, np.int64)
                q, c, s = search(own_ids, np.frombuffer(x.queries).reshape(-1, n), np.frombuffer(x.floors), ids, np.frombuffer(x.vectors).reshape(-1, n), rotation, k)
                yield pd.DataFrame({"query_id": own_ids[q], "vec_id": ids[c], "score": s})

    found = sent.join(packed, "block").mapInPandas(meet, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % EVERY == 0)


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= {K}
"""
