"""Questions checked, context strings, prompts and source lists, one row per question."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.rules import OTHER_PROJECT, SECTION_LABELS
from gleaner.functions.text import strip

SEPARATOR = "\n\n---\n\n"
LONGEST = 2000
#: The answer where nothing was found, and the label of unknown section types.
NO_HITS = "抱歉，我的知识库中暂时没有与您问题相关的信息。请尝试换个问法，或者联系我补充相关资料。"
OTHER_LABEL = "综合"
TEMPLATE = "{role}\n\n{rules}\n\n---\n{context}\n\n---\n{question}"


def validate(questions: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted, with the text stripped; rejected, with a reason)."""
    t = F.col(text_col)
    n = F.coalesce(F.length(t), F.lit(0))
    reason = F.when(n == 0, "empty").when(n > LONGEST, "too long").when(strip(t) == "", "blank")
    marked = questions.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason").withColumn(text_col, strip(t)), marked.filter("reason IS NOT NULL")


def label(section_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SECTION_LABELS.items() for x in pair])
    return F.coalesce(F.element_at(table, F.coalesce(section_type, F.lit("general"))), F.lit(OTHER_LABEL))


def assemble(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, context, sources, used_files) from hits (position, project, source, section_type, content, file_type, score)."""
    part = F.concat(F.lit("[项目: "), F.coalesce("project", F.lit(OTHER_PROJECT)), F.lit(" | 来源: "), F.col("source"), F.lit(" | 章节: "), label(F.col("section_type")), F.lit("]\n"), F.col("content"))
    rows = hits.select(query, F.struct("position", part.alias("part"), "content", "source", "file_type", "score").alias("h"))
    ordered = rows.groupBy(query).agg(F.sort_array(F.collect_list("h")).alias("hs"))
    return ordered.select(
        query,
        F.array_join(F.transform("hs", lambda h: h["part"]), SEPARATOR).alias("context"),
        F.transform("hs", lambda h: F.struct(h["content"].alias("content"), h["source"].alias("source"), h["file_type"].alias("file_type"), h["score"].alias("score"))).alias("sources"),
        F.array_distinct(F.transform("hs", lambda h: h["source"])).alias("used_files"),
    )


def with_fallback(questions: DataFrame, assembled: DataFrame, query: str = "query_id") -> DataFrame:
    """Every question; those without hits get the fixed answer and empty lists."""
    out = questions.join(assembled, query, "left")
    return out.withColumns({"answer": F.when(F.col("context").isNull(), NO_HITS), "sources": F.coalesce("sources", F.expr("array()").cast(assembled.schema["sources"].dataType)), "used_files": F.coalesce("used_files", F.array().cast("array<string>"))})


def prompt(context: Column, question: Column, role: str, rules: str, template: str = TEMPLATE) -> Column:
    """The template filled in. It is cut at its placeholders once, so a placeholder inside a document stays text."""
    values = {"role": F.lit(role), "rules": F.lit(rules), "context": context, "question": question}
    parts = re.split(r"\{(role|rules|context|question)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])
