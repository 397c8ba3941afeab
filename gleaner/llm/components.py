"""Connected components of links, by rounds of large-star and small-star joins. Nothing comes to the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs neighbours onto the least of each node's neighbourhood: larger ones (large) or smaller ones."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u")
    if large:
        out = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b): component is the least id reachable."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, before, n = scratch.write(edges, f"{name}-0"), None, 0
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before, n = tuple(state), n + 1
        edges = scratch.write(_stars(_stars(edges, True), False), f"{name}-{n}")
        scratch.drop(f"{name}-{n - 1}")
