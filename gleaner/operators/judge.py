"""Tables around a judge model: its prompts, its replies, who is asked again, and the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.numbers import round_even

SCORES = ("accuracy", "relevance", "completeness")
REPLY = "accuracy int, relevance int, completeness int, comment string"
#: Characters shown of a source and of an answer, sources shown, and the text for none.
SOURCE_CHARS, ANSWER_CHARS, SOURCES = 300, 1200, 3
NO_SOURCES = "（无参考资料）"
FAILED = "unreadable reply"
SEPARATOR = "\n\n---\n\n"


def judge_context(sources: Column) -> Column:
    """The first sources, shortened, in one text."""
    part = lambda s: F.concat(F.lit("[来源: "), s["source"], F.lit("]\n"), F.substring(s["content"], 1, SOURCE_CHARS))
    out = F.array_join(F.transform(F.slice(sources, 1, SOURCES), part), SEPARATOR)
    return F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, out).otherwise(F.lit(NO_SOURCES))


def short_answer(answer: Column) -> Column:
    return F.substring(answer, 1, ANSWER_CHARS)


def fenced(reply: Column) -> Column:
    """What stands inside the first fence, a JSON fence before others; without one the whole reply."""
    inside = lambda mark: F.regexp_extract(reply, f"(?s){mark}(.*?)(```|$)", 1)
    return F.trim(F.when(F.contains(reply, F.lit("```json")), inside("```json")).when(F.contains(reply, F.lit("```")), inside("```")).otherwise(reply))


def parse(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds ``judged``: the scores. A reply that is no JSON object scores 0 everywhere; a key that isn't there stays null."""
    body = F.regexp_replace(fenced(F.coalesce(F.col(reply), F.lit(""))), r"^[\s]+|[\s]+$", "")
    read = F.from_json(body, f"{REPLY}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    bad = read.isNull() | read["broken"].isNotNull() | ~F.startswith(body, F.lit("{"))
    zero = F.struct(*[F.lit(0).alias(s) for s in SCORES], F.lit(FAILED).alias("comment"))
    return replies.withColumn("judged", F.when(F.coalesce(bad, F.lit(True)), zero).otherwise(F.struct(*[read[s].alias(s) for s in (*SCORES, "comment")])))


def asks_again(judged: Column) -> Column:
    """Low accuracy or relevance; a missing score counts as 5."""
    return (F.coalesce(judged["accuracy"], F.lit(5)) < 3) | (F.coalesce(judged["relevance"], F.lit(5)) < 4)


def summary(first: DataFrame, second: DataFrame | None = None, key: str = "id") -> DataFrame:
    """One row: means of each score and over all; the same for those asked again (null if none). No rows give zeros."""
    joined = first.select(key, *[F.coalesce(F.col(f"judged.{s}"), F.lit(0)).alias(s) for s in SCORES])
    if second is not None:
        joined = joined.join(second.select(key, *[F.coalesce(F.col(f"judged.{s}"), F.lit(0)).alias(f"retry_{s}") for s in SCORES], F.lit(1).alias("again")), key, "left")
    means = [round_even(F.coalesce(F.avg(s), F.lit(0.0)), 2).alias(s) for s in SCORES]
    every = round_even(F.coalesce((F.avg("accuracy") + F.avg("relevance") + F.avg("completeness")) / 3, F.lit(0.0)), 2).alias("overall")
    retried = [F.count("again").alias("retried"), *[round_even(F.avg(f"retry_{s}"), 2).alias(f"retry_{s}") for s in SCORES]] if second is not None else []
    return joined.agg(F.count("*").alias("n"), *means, every, *retried)


def sample(questions: DataFrame, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """n questions in an order that the id and seed alone decide."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")).cast("binary"))
    return questions.orderBy(order, key).limit(n)
