"""Job: a table of questions in, hits and prompts out, over the index of build_index.

    python -m gleaner.jobs.answer INDEX QUESTIONS_JSON OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import rules, vectors
from gleaner.operators import context, dense, impact, lexical, search
from gleaner.params import Params
from gleaner.sources import files, tables
from gleaner.sources.index import KEYS, Index
from gleaner.sources.tables import Workspace


def candidates(questions: DataFrame, index: Index, n: int, work: Workspace, params: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dense hits, sparse hits, asked): the n best of each channel for questions (query_id, text), and the questions with intents and target. Written, and searched once.

    A chunk's key is its source and number in one string; vectors are searched alone, without tags or texts.
    """
    key = F.concat_ws("#", "source", "chunk_index").alias("key")
    asked = work.write(questions.withColumns({"intents": rules.intents(F.col("text")), "target": rules.target_project(F.col("text"))}), "asked")
    embedded = vectors.with_hashed(asked, lexical.tokens(F.col("text")), params.dims)
    near = dense.search(embedded, index.read("vectors").select(key, "vector"), "query_id", "key", params=params, n=n)
    stats = work.write(index.corpus_stats(), "stats")
    found, _ = impact.search(asked, index.blocks(), index.term_stats(params), stats, KEYS, work.under("sparse"), params, n, alive=index.alive)
    return work.write(near, "near"), work.write(found.select("query_id", key, "score", "rank"), "found"), asked


def finish(near: DataFrame, found: DataFrame, asked: DataFrame, index: Index, work: Workspace, params: Params = Params()) -> DataFrame:
    """Final hits with content. Only the candidates' keys, which are few, meet the chunks' tags and vectors, and only final hits their content."""
    key = F.concat_ws("#", "source", "chunk_index").alias("key")
    some = work.write(near.select("key").union(found.select("key")).distinct(), "some")
    tags = index.read("chunks").select(key, *KEYS, "project", "section_type").join(some, "key", "left_semi")
    known = index.read("vectors").select(key, "vector").join(some, "key", "left_semi").join(tags, "key")
    out = search.finish(near, found, work.write(known, "known"), asked, params=params)
    return out.join(index.read("chunks").select(key, "source", "project", "section_type", "file_type", "content"), "key")


def hits(questions: DataFrame, index: str, params: Params = Params()) -> DataFrame:
    """Final hits of questions (query_id, text) with content."""
    work, at = Workspace(questions.sparkSession, "answer"), Index(questions.sparkSession, index)
    near, found, asked = candidates(questions, at, params.per_channel(), work, params)
    return finish(near, found, asked, at, work, params)


def run(questions: DataFrame, index: str, role: str, rule_text: str, params: Params = Params()) -> DataFrame:
    """(query_id, text, prompt, answer, sources, used_files): answer is set where nothing was found."""
    asked, _ = context.validate(questions)
    out = context.with_fallback(asked, context.assemble(hits(asked, index, params)))
    return out.withColumn("prompt", context.prompt(F.col("context"), F.col("text"), role, rule_text))


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("index")
    parser.add_argument("questions")
    parser.add_argument("out")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("answer").getOrCreate()
    asked = files.read_questions(spark, args.questions).select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    tables.write(run(asked, args.index, "You answer from the context.", "Use nothing but the context."), args.out)


if __name__ == "__main__":
    main()
