"""Fusion of two ranked lists, normalisation, boosts, filters and backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.numbers import round_even
from gleaner.params import PRESETS, Params


def minmax(value: Column, by: list[str]) -> Column:
    """(v - min) / (max - min) within ``by``; 1 where all are equal."""
    w = W.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, F.lit(1.0)).otherwise((value - low) / (high - low))


def minmax_of_groups(rows: DataFrame, value: str, by: list[str], name: str = "norm") -> DataFrame:
    """``rows`` with ``minmax`` of ``value`` as ``name``, for groups of any size: bounds are added up before the shuffle and joined back. Nulls are a group."""
    ends = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    norm = F.when(F.col("__high") == F.col("__low"), F.lit(1.0)).otherwise((F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low")))
    return rows.join(ends, same).select(*[F.col(c) for c in rows.columns], norm.alias(name))


def _both(dense: DataFrame, sparse: DataFrame, query: str, key: str) -> DataFrame:
    """One row per query and key with each channel's rank and score (null where it didn't find the key)."""
    sides = [d.select(query, key, *[(F.col(c) if own == name else F.lit(None).cast(t)).alias(f"{name}_{c}") for name in ("dense", "sparse") for c, t in (("rank", "int"), ("score", "double"))]) for own, d in (("dense", dense), ("sparse", sparse))]
    both = sides[0].unionByName(sides[1])
    return both.groupBy(query, key).agg(*[F.max(c).alias(c) for c in ("dense_rank", "dense_score", "sparse_rank", "sparse_score")])


def reciprocal_rank(dense: DataFrame, sparse: DataFrame, query: str = "query_id", key: str = "key", params: Params = Params(), top: int | None = None) -> DataFrame:
    """Sum of 1 / (k + rank) over the channels that found a key, in descending order; what dense search found goes first among equals."""
    part = lambda c: F.when(F.col(c).isNotNull(), 1.0 / (params.rrf_k + F.col(c))).otherwise(0.0)
    kind = F.when(F.col("dense_rank").isNull(), "sparse").when(F.col("sparse_rank").isNull(), "dense").otherwise("both")
    out = _both(dense, sparse, query, key).select(
        query, key, F.round(part("dense_rank") + part("sparse_rank"), 6).alias("rrf_raw"), kind.alias("score_type"), "dense_rank", "sparse_rank",
        F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("sparse_score", F.lit(0.0)).alias("sparse_score"),
    )
    order = [F.desc("rrf_raw"), F.asc_nulls_last("dense_rank"), F.asc("sparse_rank"), key]
    out = out.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*order)))
    return out if top is None else out.filter(F.col("rank") <= top)


def display_score(hits: DataFrame, query: str = "query_id", weights: tuple[float, float] = PRESETS["balanced"]) -> DataFrame:
    """score: weighted min-max of both channels within the query. It never reorders."""
    w = [F.lit(float(x)) for x in weights]
    return hits.withColumn("score", round_even(w[0] * minmax(F.col("dense_score"), [query]) + w[1] * minmax(F.col("sparse_score"), [query]), 4))


def weighted(dense: DataFrame, sparse: DataFrame, query: str = "query_id", key: str = "key", weights: tuple[float, float] = PRESETS["balanced"], top: int = 8) -> DataFrame:
    """Fusion by weighted min-max scores: each channel is normalised on its own, then they are added up on the key."""
    norm = lambda d: d.withColumn("score", minmax(F.col("score"), [query]))
    both = _both(norm(dense), norm(sparse), query, key)
    score = round_even(weights[0] * F.coalesce("dense_score", F.lit(0.0)) + weights[1] * F.coalesce("sparse_score", F.lit(0.0)), 4)
    order = [F.desc("score"), F.asc(key)]
    return both.select(query, key, score.alias("score")).withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*order))).filter(F.col("rank") <= top)


def boost(hits: DataFrame, query: str = "query_id", key: str = "key", params: Params = Params()) -> DataFrame:
    """Raises rrf_raw of hits whose section_type is among the query's intents; order among equals stays."""
    raised = F.when(F.coalesce(F.array_contains("intents", F.col("section_type")), F.lit(False)), F.col("rrf_raw") * params.section_boost).otherwise(F.col("rrf_raw"))
    out = hits.withColumn("rrf_raw", raised).withColumnRenamed("rank", "rank_before")
    return out.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.round("rrf_raw", 9).desc(), "rank_before"))).drop("rank_before")


def project_filter(hits: DataFrame, project: str = "project", target: str = "target") -> DataFrame:
    """is_backup: the hit is of another project than the query asks for. Without a target none is."""
    return hits.withColumn("is_backup", F.coalesce(F.col(target).isNotNull() & ~F.col(project).eqNullSafe(F.col(target)), F.lit(False)))


def backfill(kept: DataFrame, backup: DataFrame, query: str = "query_id", key: str = "key", params: Params = Params()) -> DataFrame:
    """Kept hits (stage 0), then demoted ones (stage 1), then hits of other projects (stage 2), up to top_k, each key once."""
    every = kept.select(query, key, "stage", "position").unionByName(backup.select(query, key, F.lit(2).alias("stage"), F.col("rank").alias("position")))
    once = every.groupBy(query, key).agg(F.min(F.struct("stage", "position")).alias("s")).select(query, key, "s.*")
    out = once.withColumn("position", F.row_number().over(W.partitionBy(query).orderBy("stage", "position", key)))
    return out.filter(F.col("position") <= params.top_k)
