"""Job: a question set in, the quality of the real search out (hit rates, reciprocal rank, statistics, a record for each question).

    python -m gleaner.jobs.evaluate INDEX QUESTIONS_JSON OUT
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.jobs import answer
from gleaner.operators import evaluation
from gleaner.params import Params
from gleaner.sources import files, tables
from gleaner.sources.index import Index
from gleaner.sources.tables import Workspace


#: Results at which hits are counted, and those that the reciprocal rank looks at.
KS, DEPTH = (1, 3, 5), 10


def run(questions: DataFrame, index: str, out: str, params: Params = Params()) -> dict[str, DataFrame]:
    """``questions`` has query_id, text, category and keywords. Tables are written under ``out`` and read back.

    The depth of a search sets how many candidates each channel gives, so hits at k are those of a search for k results, and the reciprocal rank is that of a search for DEPTH.
    What a channel gives for k are the first of what it gives for more, so channels are searched once, and fused, filtered and filled for each depth. Channel
    counts are of the channels' own first ``params.candidates`` hits.
    """
    spark = questions.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        tables.write(df, f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    at, depths = Index(spark, index), sorted({*KS, DEPTH, params.top_k})
    work = Workspace(spark, "evaluate")
    near, found, asked = answer.candidates(questions.select("query_id", "text"), at, max(params.per_channel(k) for k in depths), work, params)

    def searched(k: int) -> DataFrame:
        few = lambda hits: hits.filter(F.col("rank") <= params.per_channel(k))
        return answer.finish(few(near), few(found), asked, at, Workspace(spark, f"depth-{k}"), replace(params, top_k=k))

    hits = {k: written(searched(k), f"hits_{k}" if k != params.top_k else "hits") for k in depths}
    relevant = written(union([evaluation.relevance(hits[k], questions).withColumn("k", F.lit(k)) for k in depths]), "relevant")
    first = lambda channel: channel.filter(F.col("rank") <= params.candidates)
    stats = written(evaluation.retrieval_stats(questions, hits[params.top_k], first(near), first(found)), "stats")
    told = stats.join(questions.select("query_id", F.col("text").alias("question"), "category"), "query_id")
    made = {
        "hit_rate": evaluation.hit_rate(relevant.filter(F.col("k").isin(*KS))), "mrr": evaluation.mean_reciprocal_rank(relevant.filter(F.col("k") == DEPTH)),
        "by_category": evaluation.by_category(told), "overall": evaluation.overall(stats), "summary": evaluation.summary(stats), "records": evaluation.report(told),
        "index_quality": evaluation.index_quality(at.read("chunks"), at.read("vectors")),
    }
    return {"hits": hits[params.top_k], "stats": stats} | {name: written(df, name) for name, df in made.items()}


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("index")
    parser.add_argument("questions")
    parser.add_argument("out")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("evaluate").getOrCreate()
    asked = files.read_questions(spark, args.questions).select(F.col("id").alias("query_id"), F.col("question").alias("text"), "category", "keywords")
    made = run(asked, args.index, args.out)
    for name in ("hit_rate", "mrr", "by_category", "overall"):
        made[name].show(truncate=False)


if __name__ == "__main__":
    main()
