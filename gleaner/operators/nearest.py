"""Exact dense search that skips blocks of vectors by their centroids and radii.

Vectors of one dimension (the commonest; others, nulls and those with null or non-finite components take no part) are assigned to the nearest of a bounded sample
of pivots and laid out in ranges of pivot, distance and key, so a block's vectors lie close together however many share a pivot. A block keeps its centroid and radius
over vectors of length 1, so no vector of it can be more similar to a query than query * centroid + radius.

Queries first meet centroids only, which are BLOCK times fewer than vectors. Each query then visits its most promising blocks, and its n-th result becomes a floor; blocks whose
bound is under it are never visited. Floors rise round by round (VISITS blocks a query, then all that are left). Only the queries that visit a block are shipped to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import TINY
from gleaner.operators.lexical import ranked
from gleaner.params import Params

#: Vectors in a block, queries and centroids that meet in a task, the sample of pivots, and the blocks that a query visits in each round but the last.
BLOCK, TOGETHER, PIVOTS, VISITS = 512, 1024, 256, (1, 4)
#: Bounds and scores are told apart to this.
SLACK = 1e-6


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): vectors of the commonest dimension (the smaller, if tied) whose components are all finite."""
    own = rows.filter(F.col(vector).isNotNull()).select(key, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    own = own.filter(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    most = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return own.filter(F.size("v") == (most["d"] if most else 0))


def unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / (np.sqrt((matrix * matrix).sum(axis=1)) + TINY)[:, None]


def matrix_of(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def blocks(rows: DataFrame, key: str, vector: str, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(block, keys, matrix, centroid, radius): written, so bounds are read without matrices."""
    own, kind = keep(usable(rows, key, vector), "usable"), rows.schema[key].dataType.simpleString()
    # A sample of bounded size, the same on every run.
    pivots = own.orderBy(F.xxhash64(key), key).limit(PIVOTS).select("v").toPandas()["v"]
    pivots = unit(np.stack(pivots.to_numpy()).astype(np.float64)) if len(pivots) else np.zeros((1, 1))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = unit(matrix_of(batch["v"])) @ pivots.T
                yield batch.assign(pivot=near.argmax(axis=1).astype(np.int32), away=-near.max(axis=1))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in cuts(batch["pivot"].to_numpy()):
                piece = batch.iloc[at]
                matrix = matrix_of(piece["v"])
                u = unit(matrix)
                centre = u.mean(axis=0)
                radius = np.sqrt(((u - centre) ** 2).sum(axis=1)).max()
                yield pd.DataFrame({"keys": [piece["k"].tolist()], "matrix": [matrix.tobytes()], "centroid": [centre.tobytes()], "radius": [radius]})

    def cuts(pivot: np.ndarray) -> Iterator[slice]:
        edges = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1], True]) if len(pivot) else []
        for low, high in zip(edges, edges[1:]):
            for at in range(low, high, BLOCK):
                yield slice(at, min(at + BLOCK, high))

    parts = max(1, own.sparkSession._jsc.sc().defaultParallelism(), own.count() // (32 * BLOCK))
    placed = own.withColumnRenamed(key, "k").mapInPandas(assign, f"k {kind}, v array<double>, pivot int, away double")
    placed = placed.repartitionByRange(parts, "pivot", "away", "k").sortWithinPartitions("pivot", "away", "k")
    made = placed.mapInPandas(pack, f"keys array<{kind}>, matrix binary, centroid binary, radius double")
    return keep(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def packed(rows: DataFrame, columns: list[str], vector: str, name: str) -> DataFrame:
    """Rows of TOGETHER packed as one: the columns as arrays, and the vectors as one matrix."""
    kinds = ", ".join(f"{name}_{c} array<{rows.schema[c].dataType.simpleString()}>" for c in columns)
    binary = rows.schema[vector].dataType.simpleString() == "binary"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                piece = batch.iloc[at : at + TOGETHER]
                data = b"".join(piece[vector]) if binary else matrix_of(piece[vector]).tobytes()
                yield pd.DataFrame({f"{name}_{c}": [piece[c].tolist()] for c in columns} | {f"{name}_matrix": [data]})

    return rows.select(*columns, vector).mapInPandas(pack, f"{kinds}, {name}_matrix binary")


def search(
    questions: DataFrame, chunks: DataFrame, query: str, key: str, keep: Callable[[DataFrame, str], DataFrame], query_vector: str = "vector", vector: str = "vector", params: Params = Params(), n: int | None = None,
    above: float | None = 0.0, not_itself: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """((query, key, score, rank), (blocks, visited)): as ``dense.search``, and the pairs of a query and a block that there are, and that met. Vectors of another dimension than the chunks' commonest have score 0 with none: they take no part."""
    n = n or params.candidates
    rows = blocks(chunks, key, vector, keep)
    q_kind, k_kind = questions.schema[query].dataType.simpleString(), chunks.schema[key].dataType.simpleString()
    first = rows.select(F.length("centroid").alias("d")).first()
    asked = questions.filter(F.col(query_vector).isNotNull()).select(query, F.transform(query_vector, lambda x: x.cast("double")).alias("v"))
    asked = keep(asked.filter((F.size("v") == (first["d"] // 8 if first else 0)) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))), "asked")
    groups = max(1, rows.count() // TOGETHER)
    metas = packed(rows.select("block", "radius", "centroid").repartition(groups), ["block", "radius"], "centroid", "m").withColumn("group", F.monotonically_increasing_id())
    groups = keep(metas, "metas")
    numbers = [x[0] for x in groups.select("group").collect()]  # one for each TOGETHER blocks

    def meet(floors: DataFrame | None, most: int | None) -> DataFrame:
        """(query, block, bound): the ``most`` best blocks of each query in each pack, or all whose bound reaches the query's floor."""
        own = asked.withColumn("floor", F.lit(float("-inf"))) if floors is None else asked.join(floors, query, "left").select(query, "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        packs = packed(own, [query, "floor"], "v", "q").withColumn("group", F.explode(F.array(*[F.lit(x) for x in numbers]) if numbers else F.array().cast("array<bigint>")))

        def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for x in batch.itertuples():
                    q = unit(np.frombuffer(x.q_matrix).reshape(len(x.q_floor), -1))
                    bounds = q @ np.frombuffer(x.m_matrix).reshape(len(x.m_block), -1).T + np.asarray(x.m_radius)[None, :]
                    if most is None:
                        r, c = np.nonzero(bounds >= np.asarray(x.q_floor)[:, None] - SLACK)
                    else:
                        c = np.argsort(-bounds, axis=1, kind="stable")[:, :most]
                        r, c = np.repeat(np.arange(len(c)), c.shape[1]), c.ravel()
                    yield pd.DataFrame({query: np.asarray(getattr(x, f"q_{query}"))[r], "block": np.asarray(x.m_block)[c], "bound": bounds[r, c]})

        return packs.join(groups, "group").drop("group").mapInPandas(bound, f"{query} {q_kind}, block long, bound double")

    def visit(pairs: DataFrame) -> DataFrame:
        """(query, key, score): the n best of each visited block."""
        # Queries of one block come together in packs; a hot block has many packs, not a large one.
        sent = pairs.select(query, "block").join(asked, query)
        parts = max(1, sent.sparkSession._jsc.sc().defaultParallelism(), int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        sent = sent.repartition(parts, "block", F.pmod(F.xxhash64(query), F.lit(16))).sortWithinPartitions("block")

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                block = batch["block"].to_numpy()
                edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else []
                for low, high in zip(edges, edges[1:]):
                    for at in range(low, high, TOGETHER):
                        piece = batch.iloc[at : min(at + TOGETHER, high)]
                        yield pd.DataFrame({"block": [int(block[low])], "q_keys": [piece[query].tolist()], "q_matrix": [matrix_of(piece["v"]).tobytes()]})

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for x in batch.itertuples():
                    ck, qk = np.asarray(x.keys), np.asarray(x.q_keys)
                    c, q = np.frombuffer(x.matrix).reshape(len(ck), -1), np.frombuffer(x.q_matrix).reshape(len(qk), -1)
                    scores = (q @ c.T) / ((np.sqrt((q * q).sum(1)) + TINY)[:, None] * (np.sqrt((c * c).sum(1)) + TINY)[None, :])
                    rounded = np.round(scores, 6)
                    if not_itself:
                        rounded[qk[:, None] == ck[None, :]] = -np.inf
                    r, k = [], []
                    for i in range(len(qk)):
                        least = np.partition(rounded[i], len(ck) - n)[len(ck) - n] if len(ck) > n else -np.inf
                        some = np.flatnonzero((rounded[i] >= least) & np.isfinite(rounded[i]))
                        k.append(some[np.lexsort((ck[some], -rounded[i][some]))[:n]])
                        r.append(np.full(len(k[-1]), i))
                    r, k = np.concatenate(r), np.concatenate(k)
                    yield pd.DataFrame({query: qk[r], key: ck[k], "score": scores[r, k]})

        packs = sent.mapInPandas(pack, f"block long, q_keys array<{q_kind}>, q_matrix binary")
        met = packs.join(rows.select("block", "keys", "matrix"), "block").drop("block")
        return met.mapInPandas(score, f"{query} {q_kind}, {key} {k_kind}, score double")

    order = sum(VISITS)
    best_first = keep(ranked(meet(None, order), query, ["block"], order, score="bound"), "promising")
    hits, floors, done, low = None, None, None, 0
    for number, many in enumerate((*VISITS, None)):
        if many is None:
            pairs = meet(floors, None).select(query, "block").join(done, [query, "block"], "left_anti")
        else:
            pairs = best_first.filter((F.col("rank") > low) & (F.col("rank") <= low + many))
            pairs = pairs if floors is None else pairs.join(floors, query, "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK))
            low += many
        pairs = keep(pairs.select(query, "block"), f"pairs-{number}")
        done = pairs if done is None else done.union(pairs)
        found = visit(pairs)
        hits = keep(ranked(found if hits is None else hits.drop("rank").union(found), query, [key], n), f"hits-{number}")
        floors = hits.filter(F.col("rank") == n).select(query, F.round("score", 6).alias("floor"))
    effort = done.agg(F.lit(asked.count() * rows.count()).alias("blocks"), F.count("*").alias("visited"))
    return (hits if above is None else hits.filter(F.round("score", 6) > above)), effort
