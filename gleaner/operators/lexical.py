"""Tokens, posting tables and BM25 search."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.params import Params

#: Terms that are kept whole.
PROTECTED = [
    "大模型", "强化学习", "深度学习", "机器学习", "自然语言处理", "计算机视觉", "图像处理", "数据分析", "数据挖掘", "特征工程", "神经网络", "卷积神经网络",
    "循环神经网络", "目标检测", "人脸识别", "语音识别", "模型训练", "模型部署", "模型优化", "推理引擎", "向量数据库", "知识图谱", "FastAPI", "Streamlit",
    "Docker", "PyTorch", "TensorFlow", "LangChain", "ChromaDB", "SentenceTransformer", "YOLOv5", "OpenCV", "Scikit-learn", "GitHub Actions", "CI/CD", "RAG",
    "LLM", "Python", "C++", "Java", "TypeScript", "JavaScript", "SQL", "PostgreSQL", "MySQL", "Redis", "MongoDB", "Elasticsearch", "RabbitMQ", "Kafka",
    "自我介绍", "项目经历", "工作经历", "教育背景", "技术栈", "团队协作", "沟通能力", "领导力", "问题解决", "系统架构", "微服务", "全栈开发", "后端开发", "前端开发",
    "数据分析师", "算法工程师", "视觉开发工程师", "软件工程师", "测试工程师", "本科", "硕士", "博士", "GPA",
]
#: Words that carry no meaning for search.
STOPWORDS = (
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们 那 些 所 为 所以 因为 但是 然而 虽然 如果 可以 "
    "这个 那个 这些 那些 什么 怎么 怎样 哪 吗 啊 呢 吧 嘛 哦 嗯 哈 呀 与 及 或 等 从 被 把 让 向 对 以 之 其 中 而 且 但 却 只 仅 还 又 再 更 最 非常 比较 十分 "
    "the a an is are was were be been being have has had do does did will would could should may might can shall i me my we our you your he him his she her "
    "it its they them their this that these those in on at to for of with by from as into through during before after above below between and but or nor not "
    "so yet both each every all any few more most other some such no only own same than too very just about over also"
).split()


def token_pattern(protected: list[str] = PROTECTED) -> str:
    """Protected terms first, longest first; then single Han characters; then runs of letters and digits.

    Terms are tried only where one of their first characters stands, and Latin letters and digits are known without a look at their script.
    """
    terms = "|".join(re.escape(t).replace("\\ ", " ") for t in sorted(protected, key=lambda t: (-len(t), t)))
    # A class of many characters beyond Latin is a chain of tests for each character of a text, so their range stands for them.
    near, far = ([c for c in {t[0] for t in protected} if (ord(c) < 256) == low] for low in (True, False))
    first = "".join(re.escape(c) for c in sorted(near)) + (rf"\x{{{ord(min(far)):X}}}-\x{{{ord(max(far)):X}}}" if far else "")
    # What is likeliest is tried first and by itself: small letters by one range, ASCII by one lookup; blanks and stops get no further than four comparisons.
    latin = r"[\p{Alnum}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]"
    run = rf"(?![ .,\n])(?:{latin}++|[\x{{80}}-\x{{10FFFF}}&&[\p{{L}}\p{{N}}]&&[^\p{{IsHan}}]]++)++"
    small = "" if any("a" <= t[0] <= "z" for t in protected) else f"[a-z]++(?:{run})?+|"
    return small + (f"(?=[{first}])(?:{terms})|" if terms else "") + rf"[\x{{100}}-\x{{10FFFF}}&&\p{{IsHan}}]|{run}"


def tokens(text: Column, stopwords: list[str] | None = STOPWORDS, protected: list[str] = PROTECTED, segmenter: Callable[[Column], Column] | None = None) -> Column:
    """Tokens in order, case kept. ``segmenter`` may replace the pattern; single marks and stopwords go either way."""
    found = segmenter(text) if segmenter else F.regexp_extract_all(text, F.lit(token_pattern(protected)), F.lit(0))
    if segmenter or not all(t == t.strip(" ") and (len(t) > 1 or t.isalnum()) for t in protected):  # else the pattern finds no blanks and no single marks
        found = F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: (t != "") & ((F.length(t) > 1) | F.rlike(t, F.lit(r"[\p{L}\p{N}]"))))
    if stopwords:
        found = F.filter(found, lambda t: ~F.lower(t).isin(stopwords))  # a set lookup, not a scan of the list
    return F.coalesce(found, F.array().cast("array<string>"))


def postings(chunks: DataFrame, keys: list[str], text_col: str = "content", **how) -> DataFrame:
    """(keys, term, tf). A task counts the terms of its chunks before anything is moved."""
    return chunks.select(*keys, F.explode(tokens(F.col(text_col), **how)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def chunk_lengths(chunks: DataFrame, keys: list[str], text_col: str = "content", **how) -> DataFrame:
    return chunks.select(*keys, F.size(tokens(F.col(text_col), **how)).cast("long").alias("dl"))


def postings_and_lengths(chunks: DataFrame, keys: list[str], text_col: str = "content", **how) -> DataFrame:
    """(keys, term, tf, dl) from one pass over the texts: a chunk's length comes from the tokens that are counted."""
    # Tokens and their number come from one value, before the tokens become rows, so that no row carries all of them.
    counted = F.transform(F.array(tokens(F.col(text_col), **how)), lambda t: F.struct(t.alias("t"), F.size(t).cast("long").alias("dl")))
    own = chunks.select(*keys, F.explode(counted).alias("x")).select(*keys, "x.t", "x.dl").select(*keys, F.explode("t").alias("term"), "dl")
    return own.groupBy(*keys, "term", "dl").agg(F.count("*").alias("tf")).select(*keys, "term", "tf", "dl")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n chunks and their mean length."""
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(posts: DataFrame, stats: DataFrame, params: Params = Params()) -> DataFrame:
    """(term, df, idf). Where more than half of the chunks have a term, its idf is a share of the mean over all terms."""
    return idf(posts.groupBy("term").agg(F.count("*").alias("df")), stats, params)


def idf(df: DataFrame, stats: DataFrame, params: Params = Params()) -> DataFrame:
    """``term_stats`` of (term, df)."""
    raw = df.join(F.broadcast(stats.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).drop("n")
    floor = raw.agg((F.avg("raw") * params.epsilon).alias("floor"))  # one row
    return raw.join(F.broadcast(floor)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def ranked(scores: DataFrame, query: str, keys: list[str], n: int, score: str = "score") -> DataFrame:
    """The n best of each query by score rounded to 6 places, then key. Each task keeps its n best before the shuffle."""
    order = [F.round(score, 6).desc(), *keys]
    out = scores.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*order)))
    return out.filter(F.col("rank") <= n)


def search(questions: DataFrame, posts: DataFrame, lengths: DataFrame | None, terms: DataFrame, stats: DataFrame, keys: list[str], params: Params = Params(), n: int | None = None, query: str = "query_id", text_col: str = "text", **how) -> DataFrame:
    """(query, keys, score, rank): BM25 over posting tables. A repeated query term counts as often as it is there.

    The side of the query terms is small or large as the table of questions is; Spark picks the join by its size. Postings that carry ``dl`` need no join with ``lengths``.
    """
    asked = questions.select(query, F.explode(tokens(F.col(text_col), **how)).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qf"))
    wanted = asked.join(terms, "term")
    met = posts.join(wanted, "term")
    hits = (met if "dl" in posts.columns else met.join(lengths, keys)).join(F.broadcast(stats))
    rise = F.col("tf") * (params.k1 + 1) / (F.col("tf") + params.k1 * (1 - params.b + params.b * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy(query, *keys).agg(F.sum(F.col("qf") * F.col("idf") * rise).alias("score"))
    return ranked(scored.filter(F.round("score", 6) > params.sparse_threshold), query, keys, n or params.candidates)
