"""Job: documents in, a version of the index out (chunks, vectors, posting blocks, lengths, hashes and statistics, in segments: see ``sources/index.py``).

    python -m gleaner.jobs.build_index DOCUMENTS OUT [--mode full|sync|incremental|status]

``sync`` compares hashes with those of the last build and builds all if something changed; ``incremental`` adds a segment of the changed files; ``status`` is the
dry run: it only reports.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import vectors
from gleaner.operators import chunking, lexical, sync
from gleaner.params import Params
from gleaner.sources import files
from gleaner.sources.index import KEYS, MOST_SEGMENTS, Index
from gleaner.sources.tables import Workspace, spread


def segment(documents: DataFrame, hashes: DataFrame, gone: DataFrame, index: Index, params: Params = Params()) -> str:
    """Writes a segment of ``documents`` (source, text). Chunks and their tokens are written once, and what follows reads them."""
    work = Workspace(documents.sparkSession, "build")
    chunks = work.write(chunking.build(spread(documents), params), "chunks")
    tokens = work.write(spread(chunks.select(*KEYS, "content")).select(*KEYS, lexical.tokens(F.col("content")).alias("tokens")), "tokens")
    posts = tokens.select(*KEYS, F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term")).groupBy(*KEYS, "term", "dl").agg(F.count("*").alias("tf"))
    lengths = tokens.select(*KEYS, F.size("tokens").cast("long").alias("dl"))
    embedded = vectors.with_hashed(tokens, F.col("tokens"), params.dims).drop("tokens")
    return index.write(index.new_segment(), chunks, embedded, posts, lengths, hashes, gone)


def build(documents: DataFrame, hashes: DataFrame, out: str, params: Params = Params()) -> Index:
    """A new version of all ``documents``, whatever was there."""
    index = Index(documents.sparkSession, out)
    fresh = Index(documents.sparkSession, out)
    fresh.segments = []
    none = documents.sparkSession.createDataFrame([], "source string")
    return index.commit([segment(documents, hashes, none, fresh, params)])


def update(documents: DataFrame, hashes: DataFrame, changes: DataFrame, out: str, params: Params = Params()) -> Index:
    """A new version with one more segment: rows of added and modified sources are made; those of all sources that aren't unchanged are dead in earlier segments."""
    index = Index(documents.sparkSession, out)
    named = changes.filter("status <> 'unchanged'").select(F.col("name").alias("source"), "status")
    changed = named.filter(F.col("status").isin("added", "modified")).select("source")
    own = hashes.withColumn("source", F.col("name")).join(changed, "source", "left_semi")
    made = segment(documents.join(changed, "source", "left_semi"), own, named.select("source"), index, params)
    index = index.commit([*index.segments, made])
    return index.compact() if len(index.segments) > MOST_SEGMENTS else index


def run(spark: SparkSession, folder: str, out: str, mode: str = "sync", params: Params = Params()) -> DataFrame:
    """The change report; builds unless ``mode`` is status, or is sync or incremental and nothing changed."""
    index = Index(spark, out)
    now = files.file_hashes(files.list_files(spark, folder)).withColumn("source", F.col("name"))
    before = index.read("hashes").select("name", "md5") if index.segments else spark.createDataFrame([], "name string, md5 string")
    changes = Workspace(spark, "changes").write(sync.detect_changes(now.drop("source"), before), "changes")
    rows = sync.change_report(changes).collect()  # a row for each of four statuses
    differs = any(r["changed"] for r in rows)
    if mode == "incremental" and differs and index.segments:
        update(files.read_texts(spark, folder), now, changes, out, params)
    elif mode == "full" or (mode in ("sync", "incremental") and differs):
        build(files.read_texts(spark, folder), now, out, params)
    return spark.createDataFrame(rows, "status string, files long, first_name string, last_name string, changed boolean")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("documents")
    parser.add_argument("out")
    parser.add_argument("--mode", default="sync", choices=["full", "sync", "incremental", "status"])
    args = parser.parse_args()
    run(SparkSession.builder.appName("build_index").getOrCreate(), args.documents, args.out, args.mode).show(truncate=False)


if __name__ == "__main__":
    main()
