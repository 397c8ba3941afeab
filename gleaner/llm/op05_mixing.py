"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Tokens are counted by cell (source, language, topic). Raking scales the cells to the target share of each source, then of
each language, then of each topic, again and again. A document's probability is its cell's factor, at most 1; it stays if a uniform number from its id lies below.
The bound is part of the raking: a margin is measured with factors cut at 1, so what full cells can't give the others of the margin do. Cells are few, one for each combination that occurs; documents
meet them by a join that Spark can split where one source holds a third of all rows.

Topics are learnt within each language, over all rows. Of the words that at most one in COMMON of its documents holds, the VOCABULARY with the most documents are its topic words; the first THEMES
of them found a theme each, and every other joins the founder whose documents hold it most often. A document belongs to the theme with most of its words, each counted once and weighed by the documents of the language
over those that hold the word. Themes are named by the founder's rank, so the commonest themes of all languages are one category and topics tell languages apart as little as can be; ``topic_relation`` measures how much.
Words are runs of letters in lower case (any character beyond ASCII counts as a letter). ``topic_col`` names a column with better topics, if there is one.

Targets. By default they flatten what is there: shares in proportion to tokens to the power FLATTEN. No category is asked for more than MOST of its tokens; the others of its dimension share the rest.
``marginals`` reports what was asked and what is expected, so that combinations that can't be met show by name.

Nulls and odd input: null and empty source or language are one category; a null or empty text has no tokens and topic "empty", a text without topic words, or in a language
too small to have any, "other"; equal counts go to the word, and equal scores to the theme, that comes first; documents without tokens get probability 1; rows with one doc_id share one number; null ids share one too; an
empty table gives an empty result; a target for a category that doesn't occur is left out and the others share its part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from gleaner.llm.common import Scratch, documents, without_clashes

FLATTEN, FRACTION, ROUNDS, MOST = 0.7, 0.6, 15, 0.75
#: Each step of the raking goes further than to its goal by this power (over-relaxation), which halves the rounds.
STRIDE = 1.7
#: Rounds of raking in one plan; then the cells are written and read again. CAPS: times that a dimension's targets are cut and shared anew.
ROUNDS_A_PLAN, CAPS = 3, 8
SALT = "mix"
DIMENSIONS = ("source", "lang", "topic")
#: Topic words of a language, themes among them, and the part of its documents (one in COMMON) beyond which a word is nobody's topic.
VOCABULARY, THEMES, COMMON = 32, 8, 4
BETWEEN_WORDS = r"[^a-z\x{80}-\x{10FFFF}]+"
Targets = dict[str, dict[str, float]]


def words_of(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS)


def with_hits(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``rows`` (__lang, __words, ...) with the columns of ``lists`` and __hits, the ranks of the topic words in the text. Texts aren't shuffled: ``lists`` has one short row a language."""
    hits = F.array_intersect("__words", "__list")
    return rows.join(lists, "__lang", "left").withColumn("__found", hits).withColumn("__hits", F.coalesce(F.expr("transform(__found, w -> int(array_position(__list, w)))"), F.expr("array()"))).drop("__found", "__words")


def topic_words(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(__lang, word, rank, held, weight): the topic words of each language. Only counts of words are shuffled, and each task sends on its first VOCABULARY words of a language at most."""
    sizes = scratch.write(rows.groupBy("__lang").agg(F.count("*").alias("texts")), "languages")
    held = rows.select("__lang", F.explode(F.array_distinct("__words")).alias("word")).filter("word <> ''").groupBy("__lang", "word").agg(F.count("*").alias("held"))
    order = F.row_number().over(W.partitionBy("__lang").orderBy(F.desc("held"), "word"))
    first = held.join(sizes, "__lang").filter(F.col("held") * COMMON <= F.col("texts")).withColumn("rank", order).filter(F.col("rank") <= VOCABULARY)
    return scratch.write(first.select("__lang", "word", "rank", "held", F.expr("texts div held").alias("weight")), "words")


def listed(words: DataFrame, *columns: str) -> DataFrame:
    """One row a language: __list of its topic words by rank, and a list of each of ``columns``."""
    entries = words.groupBy("__lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word", *columns))).alias("e"))
    return entries.select("__lang", F.col("e.word").alias("__list"), *[F.col(f"e.{c}").alias(f"__{c}") for c in columns])


def themes(hits: DataFrame, words: DataFrame) -> DataFrame:
    """``words`` with the theme of each: the founder whose documents hold the word most often. A document gives a row for each of its founders and other topic words, at most THEMES x VOCABULARY."""
    seen = hits.select("__lang", F.col("__hits").alias("h")).select("__lang", "h", F.explode(F.filter("h", lambda x: x <= THEMES)).alias("theme"))
    pairs = seen.select("__lang", "theme", F.explode(F.filter("h", lambda x: x > THEMES)).alias("rank")).groupBy("__lang", "theme", "rank").agg(F.count("*").alias("both"))
    founders = words.select("__lang", F.col("rank").alias("theme"), F.col("held").alias("founder"))
    best = pairs.join(founders, ["__lang", "theme"]).groupBy("__lang", "rank").agg(F.max(F.struct((F.col("both") / F.col("founder")).alias("part"), (-F.col("theme")).alias("t"))).alias("best"))
    theme = F.when(F.col("rank") <= THEMES, F.col("rank")).otherwise(F.coalesce(-F.col("best.t"), F.lit(0)))
    return words.join(best, ["__lang", "rank"], "left").select("__lang", "word", "rank", "weight", theme.alias("theme"))


def with_topic(rows: DataFrame) -> DataFrame:
    """``rows`` (__hits, __theme, __weight, __blank) with __topic in their place."""
    scores = F.array(*[F.expr(f"aggregate(__hits, 0L, (a, x) -> a + if(__theme[x - 1] = {t}, __weight[x - 1], 0L))") for t in range(1, THEMES + 1)])
    scored = rows.withColumn("__scores", scores).withColumn("__best", F.array_max("__scores"))
    topic = F.when(F.col("__blank"), "empty").when(F.col("__best") <= 0, "other").otherwise(F.concat(F.lit("theme "), F.array_position("__scores", F.col("__best")).cast("string")))
    return scored.withColumn("__topic", topic).drop("__hits", "__theme", "__weight", "__blank", "__list", "__scores", "__best")


def uniform(key: Column) -> Column:
    """A number from 0 up to 1 that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SALT), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def goals(cells: DataFrame, d: str, targets: Targets | None, flatten: float, fraction: float) -> DataFrame:
    """(d, goal_d): tokens that each category of dimension ``d`` should have."""
    every = W.partitionBy(F.lit(1))
    sizes = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("has"))
    if targets and d in targets:
        asked = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d} string, share double")
        sizes = sizes.join(asked, d, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    else:
        sizes = sizes.withColumn("share", F.pow("has", F.lit(flatten)))
    total = F.sum("has").over(every) * fraction
    sizes = sizes.withColumn("most", F.col("has") * MOST).withColumn("budget", total)
    for _ in range(CAPS):
        sizes = sizes.withColumn("share", F.least("most", F.col("share") * F.col("budget") / F.sum("share").over(every)))
    return sizes.select(d, F.col("share").alias(f"goal_{d}"))


def rake(cells: DataFrame, scratch: Scratch, targets: Targets | None, flatten: float, fraction: float, rounds: int) -> DataFrame:
    """``cells`` (DIMENSIONS, tokens) with the factor of each, not cut at 1, and the goal_ of each dimension. Sums stay in Spark."""
    out = cells.withColumn("factor", F.lit(float(fraction)))
    for d in DIMENSIONS:
        out = out.join(goals(cells, d, targets, flatten, fraction), d)
    out = scratch.write(out, "goals")
    for done in range(0, rounds, ROUNDS_A_PLAN):
        for _ in range(min(ROUNDS_A_PLAN, rounds - done)):
            for d in DIMENSIONS:
                here = F.sum(F.col("tokens") * F.least(F.lit(1.0), "factor")).over(W.partitionBy(d))
                out = out.withColumn("factor", F.when(here > 0, F.col("factor") * F.pow(F.col(f"goal_{d}") / here, F.lit(STRIDE))).otherwise(0.0))
        out = scratch.write(out, f"round-{done}")
        scratch.drop("goals" if done == 0 else f"round-{done - ROUNDS_A_PLAN}")
    return out


def marked(docs: DataFrame, scratch: Scratch, text: Column, source: Column, lang: Column, topic_col: str | None, carried: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs`` with __source, __lang, __topic and __tokens, and the same without other columns. Where topics are learnt, ``carried`` (all columns, if None) are written beside the hits, so that texts are split twice only."""
    tokens = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    named = docs.withColumns({"__source": F.coalesce(source, F.lit("")), "__lang": F.coalesce(lang, F.lit("")), "__tokens": tokens})
    cell = [f"__{d}" for d in DIMENSIONS] + ["__tokens"]
    if topic_col:
        named = named.withColumn("__topic", F.coalesce(F.col(topic_col).cast("string"), F.lit("")))
        return named, named.select(*cell)
    named = named.withColumns({"__words": words_of(text), "__blank": F.length(F.coalesce(text, F.lit(""))) == 0})
    words = topic_words(named.select("__lang", "__words"), scratch)
    carried = [F.col(f"`{c}`") for c in docs.columns] if carried is None else carried
    hits = scratch.write(with_hits(named.select(*carried, "__source", "__lang", "__tokens", "__blank", "__words"), listed(words)).drop("__list"), "hits")
    learnt = listed(scratch.write(themes(hits, words), "topics"), "theme", "weight")
    rows = with_topic(hits.join(learnt, "__lang", "left"))
    return rows, rows.select(*cell)


def raked(narrow: DataFrame, scratch: Scratch, targets: Targets | None, flatten: float, fraction: float, rounds: int) -> DataFrame:
    cells = narrow.groupBy(*[F.col(f"__{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("__tokens").alias("tokens")).filter("tokens > 0")
    return rake(scratch.write(cells, "cells"), scratch, targets, flatten, fraction, rounds)


def mix(docs: DataFrame, targets: Targets | None = None, flatten: float = FLATTEN, fraction: float = FRACTION, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with its columns (or ``columns`` of them) and, beside them, mix_tokens, mix_probability and mix_kept."""
    scratch = Scratch(docs.sparkSession, "mix")
    own = lambda c: F.col(f"__row.`{c}`")
    beside = [c for c in (docs.columns if columns is None else columns) if c not in ("mix_tokens", "mix_probability", "mix_kept")]
    # Parquet has no columns without a type; their values are all null.
    untyped = {x.name for x in docs.schema if isinstance(x.dataType, NullType)}
    back = lambda c: F.lit(None) if c in untyped else own(c)
    fields = [own(c).alias(c) for c in dict.fromkeys([*beside, id_col]) if c not in untyped]
    carried = [F.struct(*fields).alias("__row")] if fields else []
    rows, narrow = marked(docs.select(F.struct("*").alias("__row")), scratch, own(text_col), own(source_col), own(lang_col), f"__row.`{topic_col}`" if topic_col else None, carried)
    cells = raked(narrow, scratch, targets, flatten, fraction, rounds).select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], F.least(F.lit(1.0), "factor").alias("__p"))
    cells = scratch.write(cells, "probabilities")
    scratch.keep("probabilities", "topics", "hits")
    joined = rows.join(cells, [f"__{d}" for d in DIMENSIONS], "left").withColumn("__p", F.when(F.col("__tokens") == 0, 1.0).otherwise(F.coalesce("__p", F.lit(0.0))))
    kept = uniform(back(id_col)) < F.col("__p")
    return joined.select(*[back(c).alias(c) for c in beside], F.col("__tokens").alias("mix_tokens"), F.col("__p").alias("mix_probability"), kept.alias("mix_kept"))


def marginals(docs: DataFrame, targets: Targets | None = None, flatten: float = FLATTEN, fraction: float = FRACTION, rounds: int = ROUNDS, topic_col: str | None = None) -> DataFrame:
    """(dimension, category, has, goal, expected, met): tokens of each category, those asked for and those expected, and whether they agree within 1 %."""
    scratch = Scratch(docs.sparkSession, "marginals")
    narrow = marked(docs.select(F.struct("*").alias("__row")), scratch, F.col("__row.text"), F.col("__row.source"), F.col("__row.lang"), f"__row.`{topic_col}`" if topic_col else None, [])[1]
    cells = raked(narrow, scratch, targets, flatten, fraction, rounds)
    expected = F.sum(F.col("tokens") * F.least(F.lit(1.0), "factor"))
    out = None
    for d in DIMENSIONS:
        one = cells.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("category")).agg(F.sum("tokens").alias("has"), F.first(f"goal_{d}").alias("goal"), expected.alias("expected"))
        out = one if out is None else out.union(one)
    return out.withColumn("met", F.abs(F.col("expected") - F.col("goal")) <= F.col("goal") * 0.01)


def topic_relation(docs: DataFrame) -> DataFrame:
    """(texts, mutual_bits, lang_bits): one row with the mutual information of topic and language, and the entropy of language, by documents."""
    narrow = marked(docs.select(F.struct("*").alias("__row")), Scratch(docs.sparkSession, "relation"), F.col("__row.text"), F.col("__row.source"), F.col("__row.lang"), None, [])[1]
    both = narrow.groupBy("__lang", "__topic").agg(F.count("*").alias("n"))
    sums = both.groupBy("__lang").agg(F.sum("n").alias("of_lang")), both.groupBy("__topic").agg(F.sum("n").alias("of_topic"))
    out = both.join(sums[0], "__lang").join(sums[1], "__topic").crossJoin(both.agg(F.sum("n").alias("texts")))
    part = F.col("n") / F.col("texts")
    mutual = F.sum(part * F.log2(F.col("n") * F.col("texts") / (F.col("of_lang") * F.col("of_topic"))))
    return out.groupBy("texts").agg(mutual.alias("mutual_bits"), F.sum(-part * F.log2(F.col("of_lang") / F.col("texts"))).alias("lang_bits"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(without_clashes(documents(spark, sf_dir), "doc_id", "text", "source", "lang"), columns=["doc_id"])
    return out.select("doc_id", F.col("mix_tokens").alias("tokens"), F.round("mix_probability", 6).alias("probability"), F.col("mix_kept").alias("kept"))


def oracle() -> str:
    sql = rf"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS x, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM documents
), o AS MATERIALIZED (SELECT r, lang, unnest(string_split_regex(lower(x), '{BETWEEN_WORDS}')) AS word FROM x),
u AS (SELECT DISTINCT r, lang, word FROM o WHERE word <> ''),
n AS (SELECT lang, count(*) AS texts FROM x GROUP BY lang),
v AS MATERIALIZED (
  SELECT lang, word, held, texts // held AS weight, row_number() OVER (PARTITION BY lang ORDER BY held DESC, word) AS rank
  FROM (SELECT lang, word, count(*) AS held FROM u GROUP BY ALL) JOIN n USING (lang) WHERE held * {COMMON} <= texts QUALIFY rank <= {VOCABULARY}
), h AS MATERIALIZED (SELECT r, lang, rank, held, weight AS score FROM u JOIN v USING (lang, word)),
b AS (
  SELECT lang, w.rank, f.rank AS theme, count(*) / any_value(f.held) AS part FROM h w JOIN h f USING (r, lang) WHERE w.rank > {THEMES} AND f.rank <= {THEMES} GROUP BY ALL
), t AS (SELECT lang, rank, theme FROM b QUALIFY row_number() OVER (PARTITION BY lang, rank ORDER BY part DESC, theme) = 1),
s AS (SELECT r, CASE WHEN h.rank <= {THEMES} THEN h.rank ELSE t.theme END AS theme, sum(score) AS score FROM h LEFT JOIN t USING (lang, rank) GROUP BY ALL),
best AS (SELECT r, theme FROM s WHERE theme IS NOT NULL QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, theme) = 1),
d AS (
  SELECT doc_id, source, lang, tokens, CASE WHEN length(x) = 0 THEN 'empty' WHEN theme IS NULL THEN 'other' ELSE 'theme ' || theme END AS topic FROM x LEFT JOIN best USING (r)
), w0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens, {FRACTION}::DOUBLE AS factor FROM d GROUP BY ALL HAVING sum(tokens) > 0)
"""
    for x in DIMENSIONS:
        sql += f", g_{x}0 AS (SELECT {x}, has * {MOST}::DOUBLE AS most, pow(has, {FLATTEN}) AS share, sum(has) OVER () * {FRACTION}::DOUBLE AS budget FROM (SELECT {x}, sum(tokens)::DOUBLE AS has FROM w0 GROUP BY {x}))\n"
        for i in range(CAPS):
            sql += f", g_{x}{i + 1} AS MATERIALIZED (SELECT * REPLACE (least(most, share * budget / sum(share) OVER ()) AS share) FROM g_{x}{i})\n"
    shares = ", ".join(f"g_{x}{CAPS}.share AS goal_{x}" for x in DIMENSIONS)
    sql += f", r0 AS MATERIALIZED (SELECT w0.*, {shares} FROM w0 " + " ".join(f"JOIN g_{x}{CAPS} USING ({x})" for x in DIMENSIONS) + ")"
    n = 0
    for _ in range(ROUNDS):
        for x in DIMENSIONS:
            sql += f"\n, r{n + 1} AS MATERIALIZED (SELECT * REPLACE (factor * pow(goal_{x} / sum(tokens * least(1.0::DOUBLE, factor)) OVER (PARTITION BY {x}), {STRIDE}) AS factor) FROM r{n})"
            n += 1
    return sql + f"""
SELECT doc_id, d.tokens, round(CASE WHEN d.tokens = 0 THEN 1.0 ELSE least(1.0, r{n}.factor) END, 6)::DOUBLE AS probability,
  ('0x' || substr(md5('{SALT}' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {16**13}.0::DOUBLE < CASE WHEN d.tokens = 0 THEN 1.0 ELSE least(1.0, r{n}.factor) END AS kept
FROM d LEFT JOIN r{n} USING (source, lang, topic)
"""
