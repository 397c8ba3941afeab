"""Retrieval quality: hit rate, reciprocal rank, statistics by category and preset, index quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.numbers import plain, round_even
from gleaner.params import PRESETS
from gleaner.sources.tables import Workspace

#: Stretches of a range of values that are counted in one round.
BINS = 1024


def has_keyword(content: Column, keywords: Column) -> Column:
    low = F.lower(content)
    return F.coalesce(F.exists(keywords, lambda k: F.contains(low, F.lower(k))), F.lit(False))


def relevance(hits: DataFrame, questions: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, first): the position of the first hit with a keyword, null if none; only for questions with keywords."""
    asked = questions.filter(F.size("keywords") > 0).select(query, "keywords")
    seen = hits.join(asked, query).filter(has_keyword(F.col("content"), F.col("keywords"))).groupBy(query).agg(F.min("position").alias("first"))
    return asked.select(query).join(seen, query, "left")


def hit_rate(relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(k, questions, hits, rate). ``relevant`` is one search at the largest k, or has a column k for a search of its own at each."""
    n = F.greatest(F.count("*"), F.lit(1))
    rows = relevant.select("first", "k") if "k" in relevant.columns else relevant.select("first", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    hits = F.coalesce(F.sum(F.when(F.col("first") <= F.col("k"), 1).otherwise(0)), F.lit(0))
    return rows.groupBy("k").agg(F.count("*").alias("questions"), hits.alias("hits"), round_even(hits / n, 4).alias("rate"))


def mean_reciprocal_rank(relevant: DataFrame) -> DataFrame:
    return relevant.agg(F.count("*").alias("questions"), round_even(F.coalesce(F.sum(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1)), 4).alias("mrr"))


def retrieval_stats(questions: DataFrame, final: DataFrame, dense: DataFrame, sparse: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, total_results, dense_hits, sparse_hits, both_hits, top_score, mean_score, scores in order)."""
    count = lambda d, name: d.groupBy(query).agg(F.count("*").alias(name))
    own = final.groupBy(query).agg(
        F.count("*").alias("total_results"), F.count_if(F.col("score_type") == "both").alias("both_hits"), F.sort_array(F.collect_list(F.struct("position", "score"))).alias("s"), F.sum(F.round(F.col("score") * 10_000).cast("long")).alias("sum"),
    )
    out = questions.select(query).join(own, query, "left").join(count(dense, "dense_hits"), query, "left").join(count(sparse, "sparse_hits"), query, "left")
    # Scores have four decimals; whole numbers are added and rounded, so ties at the sixth place don't depend on the order.
    mean = F.expr("div(200 * sum + total_results, 2 * total_results)") / 1_000_000
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(query, zero("total_results"), zero("dense_hits"), zero("sparse_hits"), zero("both_hits"), F.get("s", F.lit(0))["score"].alias("top_score"), mean.alias("mean_score"), F.coalesce(F.transform("s", lambda x: x["score"]), F.array().cast("array<double>")).alias("scores"))


def summary(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count("*").alias("questions"), F.round(F.avg("total_results"), 6).alias("mean_results"), F.round(F.avg("mean_score"), 6).alias("mean_score"),
        F.round(F.avg(F.col("both_hits") / F.greatest("total_results", F.lit(1))), 6).alias("both_share"),
    )


def order_statistics(rows: DataFrame, by: list[str], value: str, share: float, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(by, n, low, high, weight): the values at both sides of the place ``share`` of each group, and how far between them it lies. Null values are left out; the others are finite.

    No task holds a group. Each round counts the values of a range by BINS stretches of it and goes on with the stretch that holds the wanted place, between the least and the greatest value
    found there; a range of one value is done. Only counts are shuffled: a row for each group, stretch and task.
    """
    own = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    ends = keep(own.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")), "ends")
    place = F.lit(share) * (F.col("n") - 1)
    wanted = ends.select(*by, F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("k"), F.col("least").alias("low"), F.col("most").alias("high"))
    # k counts from the low end of the range.
    wanted, done, number = keep(wanted.withColumn("at", F.col("k")), "wanted-0"), None, 0
    while True:
        closed = wanted.filter("low = high").select(*by, "k", F.col("low").alias("v"))
        done = closed if done is None else done.union(closed)
        wanted, number = wanted.filter("low < high"), number + 1
        if wanted.isEmpty():
            break
        asked = wanted.select(*[F.col(c).alias(f"w_{c}") for c in by], "k", "low", "high", "at")
        met = own.join(asked, [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in by]).filter("v BETWEEN low AND high")
        # Halves first: the width of a range of doubles may be no double.
        part = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS), F.lit(BINS - 1))
        counts = met.groupBy(*by, "k", "at", part.alias("part")).agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("m").over(W.partitionBy(*by, "k").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # BINS rows at most
        inside = counts.withColumn("before", before).filter((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("m")))
        wanted = keep(inside.select(*by, "k", "low", "high", (F.col("at") - F.col("before")).alias("at")), f"wanted-{number}")
    values = done.groupBy(*by).agg(F.min_by("v", "k").alias("low"), F.max_by("v", "k").alias("high"))
    same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in by]
    return ends.join(values.withColumnsRenamed({c: f"w_{c}" for c in by}), same).select(*by, "n", "low", "high", (place - F.floor(place)).alias("weight"))


def latency(log: DataFrame, by: list[str], value: str, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Mean and exact 99th percentile, interpolated; ``keep`` writes a table that several steps read."""
    keep = keep or Workspace(log.sparkSession, "latency").write
    means = log.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_ms"))
    at = order_statistics(log, by, value, 0.99, keep).withColumnsRenamed({c: f"w_{c}" for c in by}).drop("n")
    p99 = F.round((1 - F.col("weight")) * F.col("low") + F.col("weight") * F.col("high"), 6)
    return means.join(at, [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in by], "left").select(*by, "n", "mean_ms", p99.alias("p99_ms"))


def api_summary(stats: DataFrame, latency_col: str = "latency_ms") -> DataFrame:
    n = F.greatest(F.count("*"), F.lit(1))
    return stats.agg(F.count("*").alias("total"), F.round(F.coalesce(F.sum("total_results"), F.lit(0)) / n, 6).alias("mean_results"), F.round(F.coalesce(F.sum(latency_col), F.lit(0.0)) / n, 6).alias("mean_latency"))


def by_category(stats: DataFrame, category: str = "category") -> DataFrame:
    """A question without hits counts as top score 0."""
    return stats.groupBy(category).agg(
        F.count("*").alias("questions"), round_even(F.avg(F.coalesce("top_score", F.lit(0.0))), 4).alias("mean_top"), round_even(F.avg("total_results"), 1).alias("mean_results"),
        round_even(F.avg("both_hits"), 1).alias("mean_both"), round_even(F.avg("sparse_hits"), 1).alias("mean_sparse"),
    )


def overall(stats: DataFrame) -> DataFrame:
    """Mean top score over questions that have hits only."""
    return stats.agg(F.count("*").alias("questions"), round_even(F.avg("top_score"), 4).alias("mean_top"), round_even(F.avg("total_results"), 1).alias("mean_results"), round_even(F.avg("both_hits"), 1).alias("mean_both"))


def categories_and_overall(stats: DataFrame, category: str = "category") -> DataFrame:
    """``by_category`` and ``overall`` from one aggregate: a row for each category, and one (``is_total``) for all. A question without hits counts as top score 0 in its category and not at all in the total."""
    stats = stats.withColumn("category", F.col(category))
    made = stats.groupingSets([["category"], []], "category").agg(
        F.grouping("category").alias("total"), F.count("*").alias("questions"), F.avg(F.coalesce("top_score", F.lit(0.0))).alias("own_top"), F.avg("top_score").alias("all_top"), round_even(F.avg("total_results"), 1).alias("mean_results"),
        round_even(F.avg("both_hits"), 1).alias("mean_both"), round_even(F.avg("sparse_hits"), 1).alias("mean_sparse"),
    )
    top = round_even(F.when(F.col("total") == 1, F.col("all_top")).otherwise(F.col("own_top")), 4)
    return made.select("category", (F.col("total") == 1).alias("is_total"), "questions", top.alias("mean_top"), "mean_results", "mean_both", "mean_sparse")


def compare_presets(hits: DataFrame, relevant: DataFrame | None = None, stats: DataFrame | None = None, query: str = "query_id", presets: dict[str, tuple[float, float]] = PRESETS) -> DataFrame:
    """(preset, questions, mean_top, mean_score) of fused hits with norms of both channels; with ``relevant`` also hit_rate_1, _3, _5 and mrr, with ``stats`` also mean_both and mean_sparse.

    Weights change the shown score only, so one search serves all and presets differ in their scores alone. ``relevant`` is one search, or has a column k for a
    search of its own at each of 1, 3, 5 and 10, the last for mrr.
    """
    table = hits.sparkSession.createDataFrame([(k, *map(float, v)) for k, v in presets.items()], "preset string, w_dense double, w_sparse double")
    from gleaner.operators.fusion import minmax

    scored = hits.withColumns({"nd": minmax(F.col("dense_score"), [query]), "ns": minmax(F.col("sparse_score"), [query])}).crossJoin(F.broadcast(table))
    scored = scored.withColumn("score", round_even(F.col("w_dense") * F.col("nd") + F.col("w_sparse") * F.col("ns"), 4))
    per = scored.groupBy("preset", query).agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.avg("score").alias("mean"))
    out = per.groupBy("preset").agg(F.count("*").alias("questions"), round_even(F.avg("top"), 4).alias("mean_top"), round_even(F.avg("mean"), 4).alias("mean_score"))
    if relevant is not None:
        at = lambda k: F.col("k") == k if "k" in relevant.columns else F.lit(True)
        mean = lambda value, k: round_even(F.coalesce(F.sum(F.when(at(k), value)), F.lit(0.0)) / F.greatest(F.count_if(at(k)), F.lit(1)), 4)
        rates = [mean(F.when(F.col("first") <= k, 1.0).otherwise(0.0), k).alias(f"hit_rate_{k}") for k in (1, 3, 5)]
        out = out.join(F.broadcast(relevant.agg(*rates, mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 10).alias("mrr"))))
    if stats is not None:
        out = out.join(F.broadcast(stats.agg(round_even(F.avg("both_hits"), 1).alias("mean_both"), round_even(F.avg("sparse_hits"), 1).alias("mean_sparse"))))
    return out


def index_quality(chunks: DataFrame, vectors: DataFrame | None = None, source: str = "source", content: str = "content", vector: str = "vector") -> DataFrame:
    """One row: counts and sizes of chunks, and the dimension of ``vectors``, where given."""
    n = F.length(content)
    between = lambda low, high: F.count_if((n >= low) & (n < high)) if high else F.count_if(n >= low)
    out = chunks.agg(
        F.count("*").alias("chunks"), F.count_distinct(source).alias("files"), F.floor(F.avg(n)).cast("long").alias("mean_chars"), F.max(n).cast("long").alias("most_chars"), F.min(n).cast("long").alias("least_chars"),
        between(0, 200).alias("under_200"), between(200, 350).alias("from_200"), between(350, 500).alias("from_350"), between(500, None).alias("from_500"),
    )
    return out if vectors is None else out.join(F.broadcast(vectors.agg(F.max(F.size(vector)).alias("dimension"))))


def per_file(chunks: DataFrame, source: str = "source", content: str = "content") -> DataFrame:
    return chunks.groupBy(source).agg(F.count("*").alias("chunks"), F.sum(F.length(content)).cast("long").alias("chars"))


def document_list(chunks: DataFrame, source: str = "source") -> DataFrame:
    """(source, chunks, file_type of its first chunk)."""
    return chunks.groupBy(source).agg(F.count("*").alias("chunks"), F.min_by("file_type", "chunk_index").alias("file_type"))


def report(stats: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, record): one JSON record for each question, with its text, category and scores where ``stats`` has them. Numbers are written without exponents, and what isn't known as null."""
    have = lambda *names: [c for c in names if c in stats.columns]
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    text = [F.regexp_replace(F.to_json(F.struct(c), {"ignoreNullFields": "false"}), r"\A\{|\}\z", "") for c in have("question", "category")]
    scores = [field(c, F.concat(F.lit("["), F.array_join(F.transform(c, plain), ","), F.lit("]"))) for c in have("scores")]
    waited = [field(c, F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in have("latency_ms")]
    counts = [field(name, F.col(c).cast("string")) for name, c in (("total", "total_results"), ("both", "both_hits"))]
    means = [field(name, plain(round_even(F.col(c), 4))) for name, c in (("top", "top_score"), ("mean", "mean_score"))]
    return stats.select(query, F.concat(F.lit("{"), F.concat_ws(",", *text, *scores, *waited, *counts, *means), F.lit("}")).alias("record"))
