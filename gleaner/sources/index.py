"""An index at rest: immutable segments under one manifest.

``segments/<id>/<table>`` are Parquet tables that are never changed. ``manifests/<number>.json`` names the segments of a version in order; the one with
the highest number is the index. A build writes its segment first and then one manifest, in full under another name and put in place by one rename, so a reader sees the old
version or the new one, and what a build that died has left is in no manifest. Two builds at once can't both put the same number in place; the second fails.

A segment holds new rows, the sources whose rows in earlier segments are dead (``gone``), and what it adds to and takes from the statistics (``df``, ``size``),
so document frequencies are sums over segments and old postings aren't read again. Dead rows are left out on reading, by a join with the few that are gone; ``compact`` rewrites
the living rows as one segment.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import impact, lexical
from gleaner.params import Params

KEYS = ["source", "chunk_index"]
#: Rows of sources, by table; ``blocks`` has them within its rows.
BY_SOURCE = ("chunks", "vectors", "lengths", "hashes")
#: Segments of an index before it is compacted.
MOST_SEGMENTS = 8


class Index:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifests"))] if self._fs.exists(self._path(f"{self.root}/manifests")) else []
        self.version = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
        self.segments: list[str] = json.loads(spark.read.text(self._manifest(self.version), wholetext=True).first()[0])["segments"] if self.version else []

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def new_segment(self) -> str:
        return uuid.uuid4().hex

    def place(self, segment: str, table: str) -> str:
        return f"{self.root}/segments/{segment}/{table}"

    def commit(self, segments: list[str]) -> Index:
        """Puts the next manifest in place; returns the index at that version."""
        draft, final = self._path(f"{self.root}/manifests/draft-{uuid.uuid4().hex}"), self._path(self._manifest(self.version + 1))
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps({"segments": segments}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {self.version + 1} is there already: another build came first")
        return Index(self.spark, self.root)

    def _union(self, table: str) -> DataFrame:
        every = None
        for number, segment in enumerate(self.segments):
            one = self.spark.read.parquet(self.place(segment, table)).withColumn("segment", F.lit(number))
            every = one if every is None else every.unionByName(one)
        if every is None:
            raise FileNotFoundError(f"{self.root} holds no index")
        return every

    def alive(self, rows: DataFrame) -> DataFrame:
        """Rows (source, segment) without those of sources that a later segment replaced or took out."""
        if len(self.segments) < 2:
            return rows
        gone = self._union("gone").groupBy("source").agg(F.max("segment").alias("before"))
        return rows.join(gone.withColumnRenamed("source", "gone_source"), (F.col("source") == F.col("gone_source")) & (F.col("segment") < F.col("before")), "left_anti")

    def read(self, table: str) -> DataFrame:
        """chunks, vectors, lengths or hashes, living rows only."""
        return self.alive(self._union(table)).drop("segment")

    def blocks(self) -> DataFrame:
        """Posting blocks of all segments, dead postings included: their hits carry the segment, for ``alive``."""
        rows = self._union("blocks")
        hit = F.transform("hits", lambda h: F.struct(h["source"].alias("source"), h["chunk_index"].alias("chunk_index"), h["tf"].alias("tf"), h["dl"].alias("dl"), F.col("segment").alias("segment")))
        return rows.withColumn("hits", hit).drop("segment")

    def postings(self) -> DataFrame:
        return self.alive(impact.postings(self.blocks(), [*KEYS, "segment"])).drop("segment")

    def corpus_stats(self) -> DataFrame:
        """(n, avgdl), sums of what each segment added and took."""
        return self._union("size").agg(F.sum("n").alias("n"), (F.sum("dl") / F.sum("n")).alias("avgdl"))

    def term_stats(self, params: Params = Params()) -> DataFrame:
        df = self._union("df").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        return lexical.idf(df, self.corpus_stats(), params)

    def write(self, segment: str, made: DataFrame, vectors: DataFrame, posts: DataFrame, lengths: DataFrame, hashes: DataFrame, gone: DataFrame) -> str:
        """One segment of new rows; ``gone`` (source) are those whose earlier rows are dead."""
        save = lambda df, table: df.write.mode("overwrite").parquet(self.place(segment, table))
        mine = lambda table: self.spark.read.parquet(self.place(segment, table))
        save(made, "chunks")
        save(vectors, "vectors")
        save(lengths, "lengths")
        save(hashes, "hashes")
        save(gone.select("source").distinct(), "gone")
        chunks = mine("lengths").count()
        # A folder for each bucket of terms: a search prunes to those of its terms.
        impact.blocks(posts, KEYS, chunks).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(self.place(segment, "blocks"))
        counts = impact.postings(mine("blocks"), KEYS).groupBy("term").agg(F.count("*").alias("df"))
        size = mine("lengths").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"))
        if self.segments:
            dead = mine("gone")
            lost = self.alive(impact.postings(self.blocks(), [*KEYS, "segment"])).join(dead, "source", "left_semi")
            counts = counts.union(lost.groupBy("term").agg((-F.count("*")).alias("df")))
            size = size.union(self.read("lengths").join(dead, "source", "left_semi").agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("dl")))
        save(counts, "df")
        save(size, "size")
        return segment

    def compact(self) -> Index:
        """The living rows as one segment and a version of their own; older versions keep reading theirs until ``vacuum``."""
        whole = Index(self.spark, self.root)
        fresh = Index(self.spark, self.root)
        fresh.segments = []
        none = self.spark.createDataFrame([], "source string")
        segment = fresh.write(self.new_segment(), whole.read("chunks"), whole.read("vectors"), whole.postings(), whole.read("lengths"), whole.read("hashes"), none)
        return self.commit([segment])

    def vacuum(self) -> list[str]:
        """Deletes segments that the present version doesn't name, those of builds that died among them. Not while a build or an older reader runs."""
        base = self._path(f"{self.root}/segments")
        lost = [x.getPath() for x in self._fs.listStatus(base) if x.getPath().getName() not in self.segments]
        for path in lost:
            self._fs.delete(path, True)
        return sorted(p.getName() for p in lost)
