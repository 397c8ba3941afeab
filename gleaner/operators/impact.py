"""Exact BM25 search that reads only postings that can matter: posting blocks with impact bounds, as joins and sums.

A chunk belongs to a block by its length and a hash, so a block holds about BLOCK_CHUNKS chunks of like length. A term's postings in one block are a row with
its highest tf and least length, from which no posting of the row scores more than a bound, whatever the mean length has become since. The search has three steps:

1. Each query's rarest terms are scored, and the best chunks that they find are scored by all other terms too, from these chunks' blocks alone. Their n-th score is a floor.
2. Terms whose bounds add up to less than the floor can't lift a chunk over it by themselves. The others are scored; that gives all candidates, and from the best of them, scored in full like before, a higher floor.
3. A candidate stays if its score and the bounds of the left-out terms in its block reach the floor. Only blocks that hold such candidates are read for these terms.

Metadata (a row per term and block) is read without the postings. What is left out can't be among the n best, so rows equal those of the full sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators.lexical import ranked, tokens
from gleaner.params import Params

BLOCK_CHUNKS, BUCKETS = 32, 64
#: Postings for each wanted result that the first step reads at least, where a query's terms have as many, and chunks for each that it scores in full.
PROBE, SAMPLE = 8, 2
#: Sums in another order may differ by this much; ranks are by six places.
SLACK = 1e-6


def rise(tf: Column, dl: Column, params: Params) -> Column:
    """What a posting adds for each unit of idf."""
    return tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * dl / F.col("avgdl")))


def block_of(keys: list[str], chunks: int, block_chunks: int = BLOCK_CHUNKS) -> Column:
    """The block of a chunk with length ``dl``."""
    # Halves of powers of two: a block's least length is near all of its lengths.
    size = F.floor(2 * F.log2(F.col("dl") + 1)).cast("long")
    return size * (1 << 40) + F.pmod(F.xxhash64(*keys), F.lit(max(1, chunks // (4 * block_chunks))))


def blocks(posts: DataFrame, keys: list[str], chunks: int, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """(bucket, term, block, n, most_tf, least_dl, hits) from postings (keys, term, tf, dl) of about ``chunks`` chunks. No row has more than the chunks of its block.

    Postings that are dealt out by ``block_of`` already, as a column ``block``, aren't shuffled.
    """
    own = posts if "block" in posts.columns else posts.withColumn("block", block_of(keys, chunks, block_chunks))
    rows = own.groupBy("term", "block").agg(
        F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.collect_list(F.struct(*keys, "tf", "dl")).alias("hits"),
    )
    return rows.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"), *rows.columns)


def blocks_of_tokens(chunks: DataFrame, keys: list[str], count: int, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """``blocks`` from (keys, tokens): the tokens go to their blocks, and terms are counted and gathered there, so that no posting is shuffled."""
    placed = chunks.select(*keys, F.size("tokens").cast("long").alias("dl"), "tokens").withColumn("block", block_of(keys, count, block_chunks)).repartition("block")
    posts = placed.select(*keys, "dl", "block", F.explode("tokens").alias("term")).groupBy("block", *keys, "term", "dl").agg(F.count("*").alias("tf"))
    return blocks(posts, keys, count, block_chunks)


def postings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, tf, dl): blocks as plain postings."""
    return rows.select("term", F.explode("hits").alias("h")).select(*[f"h.{k}" for k in keys], "term", "h.tf", "h.dl")


def search(
    questions: DataFrame, rows: DataFrame, terms: DataFrame, stats: DataFrame, keys: list[str], keep: Callable[[DataFrame, str], DataFrame], params: Params = Params(), n: int | None = None,
    query: str = "query_id", text_col: str = "text", alive: Callable[[DataFrame], DataFrame] = lambda hits: hits, **how,
) -> tuple[DataFrame, DataFrame]:
    """((query, keys, score, rank), (query, postings, read)): the n best of each query, and how many postings its terms have and how many were read for it.

    ``rows`` come from ``blocks``. ``keep`` writes a table that several steps read (Workspace.write). ``alive`` takes out exploded hits that are no longer in the index; bounds hold without it.
    """
    n = n or params.candidates
    asked = questions.select(query, F.explode(tokens(F.col(text_col), **how)).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qf"))
    asked = keep(asked.join(terms, "term").select(query, "term", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"), (F.col("qf") * F.col("idf")).alias("weight")), "asked")
    bound = F.greatest(F.col("weight"), F.lit(0.0)) * rise(F.col("most_tf"), F.col("least_dl"), params)
    # A term of negative weight lifts nothing; floors are full scores, so what it takes away needs no bound.
    meta = asked.join(rows.select("bucket", "term", "block", "n", "most_tf", "least_dl"), ["bucket", "term"]).join(F.broadcast(stats.select("avgdl")))
    meta = keep(meta.select(query, "bucket", "term", "block", "n", "weight", bound.alias("up")), "bounds")
    by_term = meta.groupBy(query, "bucket", "term", "weight").agg(F.sum("n").alias("n"), F.max("up").alias("up"))
    ahead = W.partitionBy(query).orderBy(F.col("weight") <= 0, "n", "term").rowsBetween(W.unboundedPreceding, -1)
    by_term = keep(by_term.withColumn("probed", (F.col("weight") > 0) & (F.coalesce(F.sum("n").over(ahead), F.lit(0)) < PROBE * n)), "terms")

    def scored(wanted: DataFrame, on: list[str]) -> DataFrame:
        """(query, block, keys, score) of what ``wanted`` (query, weight, columns ``on``) adds."""
        met = wanted.join(rows, on).select(query, "weight", "block", F.explode("hits").alias("h"))
        met = alive(met.select(query, "weight", "block", "h.*")).join(F.broadcast(stats.select("avgdl")))
        return met.groupBy(query, "block", *keys).agg(F.sum(F.col("weight") * rise(F.col("tf"), F.col("dl"), params)).alias("score"))

    def floor(scores: DataFrame, rest: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """((query, floor), what was read): the n-th score of the best chunks of ``scores``, for which the terms of ``rest`` are read from their blocks; nothing where there are fewer."""
        best = keep(ranked(scores, query, keys, SAMPLE * n).select(query, "block", *keys, "score"), f"{name}-best")
        others = meta.join(rest.select(query, "term"), [query, "term"], "left_semi").join(best.select(query, "block").distinct(), [query, "block"], "left_semi")
        others = keep(others.select(query, "bucket", "term", "block", "n", "weight"), f"{name}-read")
        more = scored(others.drop("n"), ["bucket", "term", "block"]).join(best.select(query, *keys), [query, *keys], "left_semi")
        total = best.unionByName(more).groupBy(query, *keys).agg(F.sum("score").alias("score"))
        return keep(ranked(total, query, keys, n).filter(F.col("rank") == n).select(query, F.col("score").alias("floor")), name), others

    first, read_1 = floor(scored(by_term.filter("probed").select(query, "bucket", "term", "weight"), ["bucket", "term"]), by_term.filter("NOT probed"), "floor-1")
    upto = W.partitionBy(query).orderBy("up", "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    split = by_term.join(first, query, "left").withColumn("essential", F.sum("up").over(upto) >= F.coalesce("floor", F.lit(0.0)) - SLACK)
    split = keep(split.select(query, "bucket", "term", "weight", "n", "floor", "probed", "essential"), "split")
    found = keep(scored(split.filter("essential").select(query, "bucket", "term", "weight"), ["bucket", "term"]), "found")
    second, read_2 = floor(found, split.filter("NOT essential"), "floor-2")
    second = second.unionByName(first).groupBy(query).agg(F.max("floor").alias("floor"))
    rest = meta.join(split.filter("NOT essential").select(query, "term"), [query, "term"], "left_semi")
    most = rest.groupBy(query, "block").agg(F.sum("up").alias("more"))
    left = found.join(second, query, "left").join(most, [query, "block"], "left")
    left = keep(left.filter((F.col("score") + F.coalesce("more", F.lit(0.0)) >= F.coalesce("floor", F.lit(0.0)) - SLACK) | F.col("floor").isNull()).select(query, "block", *keys, "score"), "left")
    wanted = keep(rest.join(left.select(query, "block").distinct(), [query, "block"], "left_semi").select(query, "bucket", "term", "block", "n", "weight"), "wanted")
    more = scored(wanted.drop("n"), ["bucket", "term", "block"]).withColumnRenamed("score", "added")
    total = left.join(more, [query, "block", *keys], "left").select(query, *keys, (F.col("score") + F.coalesce("added", F.lit(0.0))).alias("score"))
    best = ranked(total.filter(F.round("score", 6) > params.sparse_threshold), query, keys, n)
    # A term that was both probed and scored later counts for both.
    read = split.select(query, F.col("n").alias("postings"), (F.col("n") * (F.col("probed").cast("int") + F.col("essential").cast("int"))).alias("read"))
    read = read.union(wanted.union(read_1).union(read_2).select(query, F.lit(0).cast("long"), "n")).groupBy(query).agg(F.sum("postings").alias("postings"), F.sum("read").alias("read"))
    return best, read
