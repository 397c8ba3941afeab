"""From raw documents to packed training sequences, in five stages.

Every stage works on all that its predecessor kept and returns the columns of ``documents``; the last returns pieces of sequences.
Stages that drop rows drop them by doc_id: a row with a null doc_id is never dropped, and rows that share one go together, if all of them are rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch
from gleaner.llm.op01_near_dedup import near_duplicates
from gleaner.llm.op02_packing import pack
from gleaner.llm.op05_mixing import mix
from gleaner.llm.op07_quality import score_documents
from gleaner.llm.op09_line_dedup import dedup_lines

#: Near-duplicate stage: words in a shingle, and the similarity as a fraction.
SHINGLE_WORDS, OVER, UNDER = 5, 80, 100


def without(docs: DataFrame, verdicts: DataFrame, stays: str) -> DataFrame:
    """``docs`` without the ids for which condition ``stays`` holds in no row of ``verdicts``."""
    gone = verdicts.groupBy("doc_id").agg(F.max(F.expr(stays).cast("int")).alias("stays")).filter("stays = 0").select("doc_id")
    return docs.join(Scratch(docs.sparkSession, "gone").write(gone, "ids"), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return without(docs, score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "predicted = 1")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines of any length go, and documents that had words and have none left."""
    out = dedup_lines(docs, short_repeats=True)
    blank = F.length(F.btrim("text", F.lit(" \t\r\n\f\v"))) == 0
    out = out.filter(~(F.coalesce(blank, F.lit(False)) & (F.col("n_removed") > 0)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return without(docs, near_duplicates(docs, SHINGLE_WORDS, OVER, UNDER), "kept")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities stay."""
    return mix(docs).filter("mix_kept").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("mixing", mixture),
    ("packing", packing),
]

#: A trained network and a packing by linear program: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
