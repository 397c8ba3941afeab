"""Changes between two snapshots of files, and consistency of index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("added", "deleted", "modified", "unchanged")


def detect_changes(current: DataFrame, previous: DataFrame, name: str = "name", digest: str = "md5") -> DataFrame:
    """(name, status) of every name in either snapshot."""
    both = current.select(name, F.col(digest).alias("now")).join(previous.select(name, F.col(digest).alias("was")), name, "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("was"), "modified").otherwise("unchanged")
    return both.select(name, status.alias("status"))


def digests(snapshot: DataFrame, name: str = "name", digest: str = "md5", buckets: int = 4096) -> DataFrame:
    """(bucket, n, total): order-free sums over the names of each bucket. Two snapshots with equal sums in a bucket are equal there, but for a chance of about 2**-62."""
    parts = [F.sum(F.xxhash64(F.lit(seed), name, digest).cast("decimal(38,0)")).alias(f"sum_{seed}") for seed in (1, 2)]
    return snapshot.groupBy(bucket_of(name, buckets).alias("bucket")).agg(F.count("*").alias("n"), *parts)


def bucket_of(name: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def differing(current: DataFrame, previous: DataFrame, name: str = "name", digest: str = "md5", buckets: int = 4096) -> DataFrame:
    """(bucket): those in which two snapshots differ; a table of ``buckets`` rows at most."""
    now, was = (digests(x, name, digest, buckets) for x in (current, previous))
    both = now.select("bucket", F.struct("n", "sum_1", "sum_2").alias("now")).join(was.select("bucket", F.struct("n", "sum_1", "sum_2").alias("was")), "bucket", "full_outer")
    return both.filter(~F.col("now").eqNullSafe(F.col("was"))).select("bucket")


def detect_changes_by_digest(current: DataFrame, previous: DataFrame, name: str = "name", digest: str = "md5", buckets: int = 4096) -> DataFrame:
    """As ``detect_changes``: only names in buckets whose digests differ are shuffled and joined; all others are unchanged as they stand. The list of buckets is bounded, so it is broadcast."""
    differ = F.broadcast(differing(current, previous, name, digest, buckets))
    near = lambda x: x.select(name, digest).withColumn("bucket", bucket_of(name, buckets)).join(differ, "bucket", "left_semi").drop("bucket")
    same = current.select(name).withColumn("bucket", bucket_of(name, buckets)).join(differ, "bucket", "left_anti").select(name, F.lit("unchanged").alias("status"))
    return detect_changes(near(current), near(previous), name, digest).union(same)


def change_report(changes: DataFrame, name: str = "name") -> DataFrame:
    """(status, files, changed): counts by status; changed says whether the status calls for a rebuild."""
    return changes.groupBy("status").agg(F.count("*").alias("files"), F.min(name).alias("first_name"), F.max(name).alias("last_name")).withColumn("changed", F.col("status") != "unchanged")


def changed_names(changes: DataFrame, name: str = "name") -> DataFrame:
    """(status, name) of all that was added, deleted or modified: the lists of the report, as rows, since a list may be as long as the corpus."""
    return changes.filter("status <> 'unchanged'").select("status", name)


def has_changes(changes: DataFrame) -> bool:
    return not changes.filter("status <> 'unchanged'").isEmpty()


def incremental(existing: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: keys that aren't there yet. What is there isn't refreshed."""
    return made.join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, made: DataFrame, changes: DataFrame, source: str = "source", name: str = "name") -> DataFrame:
    """The table with deleted and modified sources taken out and added and modified ones put in."""
    gone = changes.filter(F.col("status").isin("deleted", "modified")).select(F.col(name).alias(source))
    fresh = changes.filter(F.col("status").isin("added", "modified")).select(F.col(name).alias(source))
    return existing.join(gone, source, "left_anti").unionByName(made.join(fresh, source, "left_semi"))


def audit(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, missing): keys that some table lacks, with the names of those tables. One aggregation over all of them."""
    every = None
    for t, df in tables.items():
        one = df.select(*keys).distinct().withColumn("has", F.lit(t))
        every = one if every is None else every.unionByName(one)
    names = F.array(*[F.lit(t) for t in sorted(tables)])
    missing = F.sort_array(F.array_except(names, F.collect_set("has")))
    return every.groupBy(*keys).agg(F.array_join(missing, ",").alias("missing")).filter("missing <> ''")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(artefact, n, agrees): rows of each table, and whether that is the count most have (the first in name order, if tied)."""
    every = None
    for t, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(t).alias("artefact"), "n")
        every = one if every is None else every.unionByName(one)
    most = every.groupBy("n").agg(F.count("*").alias("votes"), F.min("artefact").alias("first")).orderBy(F.desc("votes"), "first").limit(1).select(F.col("n").alias("most"))
    return every.join(F.broadcast(most)).select("artefact", "n", (F.col("n") == F.col("most")).alias("agrees"))


def repair(tables: dict[str, DataFrame], keys: list[str]) -> dict[str, DataFrame]:
    """Each table with only the keys that all have; empty tables are left out of the comparison."""
    full = {t: df for t, df in tables.items() if not df.isEmpty()}
    out = dict(tables)
    for t in full:
        for other in full:
            if other != t:
                out[t] = out[t].join(full[other].select(*keys).distinct(), keys, "left_semi")
    return out
