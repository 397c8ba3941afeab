"""Small cases with results worked out by hand, and brute-force checks of the helpers."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner import queries
from gleaner.functions import rules, text, vectors
from gleaner.operators import chunking, context, dense, diversity, evaluation, fusion, impact, judge, lexical, nearest, rulebook, search, sparse, sync
from gleaner.params import Params, preset
from gleaner.sources import files, tables
from gleaner.sources.index import Index
from tests import plain_chunker


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_file_type_and_project(spark):
    got = lambda n: one(spark, rules.file_type(F.col("n")), n=n)
    assert got("02_x.md") == "项目" and got("My_Resume.txt") == "简历" and got("notes.md") == "其他文档"
    assert one(spark, rules.project(F.col("n")), n="mamacare.md") == "其他"
    assert one(spark, rules.project(F.col("n")), n="MamaCare.md") == "MamaCare孕期智能守护助手"


@pytest.mark.parametrize(("bad", "ratio", "is_garbage"), [(29, 0.29, False), (30, 0.30, False), (31, 0.31, True)])
def test_garbage(spark, bad, ratio, is_garbage):
    t = "�" * (bad - 1) + "\u0001" + "x" * (100 - bad)
    assert one(spark, text.garbage_ratio(F.col("t")), t=t) == pytest.approx(ratio)
    assert one(spark, text.garbage_ratio(F.col("t")) > 0.30, t=t) is is_garbage
    assert one(spark, text.garbage_ratio(F.col("t")), t="") == 1.0


def test_parse_cascade(spark):
    long_ = "word " * 12
    got = lambda a, b, c: one(spark, text.parsed(F.col("a"), F.col("b"), F.col("c")), a=a, b=b, c=c)
    assert got(long_, "b" * 60, "c") == long_.strip()
    assert got("short", "b" * 60, "c") == "b" * 60
    assert got("short", "short", "third") == "third"
    assert got("�" * 60, "b" * 60, "third") == "third"
    assert got("�" * 60, "", " ") == "�" * 60


def test_clean_text(spark):
    assert one(spark, text.clean_text(F.col("t")), t="12\n  kept \n.6\n\n-\n1234\n　\nend") == "kept \n1234\nend"


def test_sentences_and_sections(spark):
    assert one(spark, chunking.sentences(F.col("t")), t="A b. C 3.8 d!\n　E") == ["A b.", "C 3.", "8 d!", "E"]
    assert one(spark, chunking.filled(chunking.sections(F.col("t"))), t="intro\n1. one\n- two\n# three") == ["intro", "1. one", "- two", "# three"]
    assert one(spark, chunking.paragraphs(F.col("t")), t="a\n \nb\nc\n\n\nd") == ["a", "b\nc", "d"]


def test_headings_and_section_type(spark):
    rows = one(spark, text.headings(F.col("t")), t="# Top\n【Box】\n1.1 Deep\n1. ab\nplain")
    assert [(r["line"], r["text"]) for r in rows] == [(0, "Top"), (1, "Box"), (2, "1 Deep")]
    assert one(spark, rules.section_type(F.col("t")), t="我的教育背景") == "education"
    assert one(spark, rules.section_type(F.col("t")), t="GitHub") == "general"


def test_code_and_table_blocks():
    code = [f"# line {i}" for i in range(5)]
    assert plain_chunker.blocks(["x", *code, "y"], plain_chunker.is_code, 5) == [["x"], code, ["y"]]
    assert plain_chunker.blocks(["x", *code[:4], "y"], plain_chunker.is_code, 5) == [["x", *code[:4], "y"]]
    assert plain_chunker.blocks(["a", "|b|c|", "|---|", "d"], plain_chunker.is_table, 1) == [["a"], ["|b|c|", "|---|"], ["d"]]


def test_packing_and_merging():
    assert plain_chunker.packed("aa. bb. cc.", 6) == ["aa.bb.", "cc."]
    assert plain_chunker.packed("x" * 20 + ". y.", 6) == ["x" * 20 + ".", "y."]
    assert plain_chunker.merged(["a" * 10, "b" * 10], 15, 30) == ["a" * 10 + "\n" + "b" * 10]
    assert plain_chunker.merged(["a" * 10, "b" * 28], 15, 30) == ["a" * 10 + "\n" + "b" * 5, "b" * 23]


def test_chunks_cover_the_text_and_overlap_keeps_their_number(spark):
    rng = random.Random(3)
    t = "\n\n".join(" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(3, 200))) + "." for _ in range(30))
    plain = plain_chunker.chunk_text(t)
    assert "".join("".join(plain).split()) == "".join(t.split())
    docs = spark.createDataFrame([("a.md", t), ("b.md", None), ("c.md", " ")], "source string, text string")
    rows = chunking.build(docs).orderBy("chunk_index").collect()
    assert len(rows) == len(plain) and {r["total_chunks"] for r in rows} == {len(plain)}
    for i in range(1, len(plain)):
        tail = plain[i - 1][-100:] + "\n" if len(plain[i - 1]) > 100 else ""
        assert rows[i]["content"] == (tail + plain[i]).strip()


def test_tokens(spark):
    got = lambda t, **k: one(spark, lexical.tokens(F.col("t"), **k), t=t)
    assert got("The C++ and FastAPI, 机器学习 x 5!") == ["C++", "FastAPI", "机器学习", "x", "5"]
    assert got("The x", stopwords=None) == ["The", "x"]


def test_bm25_against_the_formula(spark):
    docs = [(1, "cat dog dog"), (2, "cat fish"), (3, "bird bird bird cat")]
    c = spark.createDataFrame(docs, "key long, content string")
    q = spark.createDataFrame([(9, "dog bird dog")], "query_id long, text string")
    posts, lengths = lexical.postings(c, ["key"]), lexical.chunk_lengths(c, ["key"])
    stats = lexical.corpus_stats(lengths)
    got = {r["key"]: r["score"] for r in lexical.search(q, posts, lengths, lexical.term_stats(posts, stats), stats, ["key"]).collect()}
    df, n, avg = {"cat": 3, "dog": 1, "fish": 1, "bird": 1}, 3, 3.0
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    score = lambda t, qs: sum(idf[w] * t.split().count(w) * 2.5 / (t.split().count(w) + 1.5 * (0.25 + 0.75 * len(t.split()) / avg)) for w in qs)
    want = {k: score(t, ["dog", "bird", "dog"]) for k, t in docs}
    assert got == {k: pytest.approx(v) for k, v in want.items() if round(v, 6) > 0.05}


def test_tokens_by_a_quick_pattern_are_those_of_the_plain_one(spark):
    import re

    plain = "|".join(re.escape(t).replace("\\ ", " ") for t in sorted(lexical.PROTECTED, key=lambda t: (-len(t), t))) + r"|\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"
    r = random.Random(5)
    parts = [*"aZ9é ß×÷ªµº²½.·_-+/\t\n", "大", "模型", "大模型", "强化学习", "〇", "々", "Python", "C++", "CI/CD", "GitHub Actions", "GitHub", "я", "٣", "𠀀", "😀", "カ", "한", "LLMs", "Ⅷ", "①"]
    rows = spark.createDataFrame([("".join(r.choice(parts) for _ in range(r.randint(0, 60))),) for _ in range(2000)], "text string")
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    assert rows.filter(found(plain) != found(lexical.token_pattern())).count() == 0
    long = spark.createDataFrame([("aя" * 60_000,)], "text string").select(lexical.tokens(F.col("text")).alias("t")).first()["t"]
    assert long == ["aя" * 60_000]


def test_every_character_gives_the_tokens_of_the_plain_pattern(spark):
    """Alone, between and after letters; also with protected terms that begin with a small letter, which then come before other words."""
    import re

    every = spark.range(1, 0x20000).filter("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    rows = every.select(F.concat(F.lit("ab"), "c", F.lit("cd "), "c", F.lit(" Xy"), "c", F.lit("9 x"), "c", "c", F.lit("grepC++ grep")).alias("text"))
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    for protected in (lexical.PROTECTED, ["grepC++", "C++", "大模型"], []):
        plain = "|".join([*(re.escape(t).replace("\\ ", " ") for t in sorted(protected, key=lambda t: (-len(t), t))), r"\p{IsHan}", r"[\p{L}\p{N}&&[^\p{IsHan}]]+"])
        assert rows.filter(found(plain) != found(lexical.token_pattern(protected))).count() == 0


def test_tokens_are_trimmed_only_where_they_may_need_it(spark):
    one_row = spark.createDataFrame([(" C++ + a",)], "text string")
    plan = lambda **how: one_row.select(lexical.tokens(F.col("text"), **how))._jdf.queryExecution().optimizedPlan().toString()
    assert "trim(" not in plan() and "trim(" in plan(protected=["+ "]) and "trim(" in plan(segmenter=lambda t: F.split(t, ","))
    assert one_row.select(lexical.tokens(F.col("text"), protected=["+", " C"]).alias("t")).first()["t"] == ["C"]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_blockwise_bm25_equals_the_sum_over_postings(spark, monkeypatch, kind):
    """Blocks of a few rows, terms and cells; texts that are equal, empty and null; questions with repeated and unknown words, or none."""
    for name, value in {"CHUNKS": 7, "TOKENS": 60, "QUERIES": 5, "TERMS": 12, "CELLS": 9, "POSTINGS": 4}.items():
        monkeypatch.setattr(sparse, name, value)
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    say = lambda n: " ".join(words[min(int(r.expovariate(0.12)), 39)] for _ in range(n))
    texts = [say(r.randint(1, 30)) for _ in range(90)]
    texts = texts + texts[:20] + ["", None, say(200)]
    c = spark.createDataFrame(list(enumerate(texts)), "key long, content string").select(F.col("key").cast(kind).alias("key"), "content")
    q = spark.createDataFrame([(i, say(r.randint(1, 9))) for i in range(30)] + [(30, "w1 w1 w1 unknown"), (31, ""), (32, None)], "query_id long, text string")
    posts = lexical.postings_and_lengths(c, ["key"])
    made = c.select("key", lexical.tokens(F.col("content")).alias("tokens")).repartition(3)
    stats = made.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    terms = lexical.term_stats(posts, stats)
    rows = lambda hits: sorted((x["query_id"], x["rank"], x["key"], round(x["score"], 6)) for x in hits.collect())
    want = rows(lexical.search(q, posts, None, terms, stats, ["key"], n=4))
    assert rows(sparse.search(q, made, terms, stats, "key", n=4)) == want and len(want) > 100


def test_blocks_send_on_only_what_may_be_among_the_best(spark, monkeypatch):
    """A task sends few rows for many blocks, and the hits are those of the full sum."""
    monkeypatch.setattr(sparse, "CHUNKS", 8)
    sent = []
    monkeypatch.setattr(sparse, "ranked", lambda scored, *how, ranked=sparse.ranked: (sent.append(scored.count()), ranked(scored, *how))[1])
    r = random.Random(5)
    say = lambda n: " ".join(f"w{min(int(r.expovariate(0.08)), 80)}" for _ in range(n))
    c = spark.createDataFrame([(i, say(r.randint(1, 25))) for i in range(320)], "key long, content string")
    q = spark.createDataFrame([(i, say(r.randint(3, 9))) for i in range(40)], "query_id long, text string")
    posts = lexical.postings_and_lengths(c, ["key"])
    made = c.select("key", lexical.tokens(F.col("content")).alias("tokens")).repartition(2)
    stats = made.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    terms = lexical.term_stats(posts, stats)
    rows = lambda hits: sorted((x["query_id"], x["rank"], x["key"], round(x["score"], 6)) for x in hits.collect())
    assert rows(sparse.search(q, made, terms, stats, "key", n=2)) == rows(lexical.search(q, posts, None, terms, stats, ["key"], n=2))
    assert 80 <= sent[0] < 40 * 40  # 40 blocks that send 2 rows each for most of the 40 questions would be 3,120


@pytest.mark.parametrize("rare", [0, 1, 4, 1 << 40])
def test_terms_that_wait_are_added_where_they_matter(monkeypatch, rare):
    """Blocks of any width, ties, slices of a few postings; terms that wait are added for single chunks, or for all where too many may be among the best."""
    rng = np.random.default_rng(rare % 97)
    for _ in range(40):
        for name, choices in {"CELLS": [9, 50, 1000], "POSTINGS": [4, 50, 1000], "COMMON": [1, 3, 100], "WAITS": [0.1, 0.5, 0.9, 2.0]}.items():
            monkeypatch.setattr(sparse, name, rng.choice(choices).item())
        monkeypatch.setattr(sparse, "RARE", rare)
        n_terms, n_queries, n_chunks, n = (int(rng.integers(a, b)) for a, b in ((2, 40), (1, 30), (1, 150), (1, 6)))
        often = 1 / np.arange(1, n_terms + 1)
        rise = np.where(rng.random((n_chunks, n_terms)) < often * 2, np.round(rng.random((n_chunks, n_terms)) * 2 + 0.1, 1), 0)
        weight = np.where(rng.random((n_queries, n_terms)) < often * 1.5, rng.choice([0.25, 0.5, 2.5, 3.3], (n_queries, n_terms)), 0)
        keys, scores, rows = rng.permutation(n_chunks), weight @ rise.T, []
        for at in range(0, n_queries, 7):
            q, t = np.nonzero(weight[at : at + 7])
            rows.append((pa.array([f"q{i}" for i in range(at, min(at + 7, n_queries))]), pa.array([f"t{x}" for x in t], pa.string()), weight[at : at + 7][q, t], q))
        held, got, at = sparse.Held(rows, n, 0.05), {}, 0
        while at < n_chunks:
            own = rise[at : at + int(rng.integers(1, 60))]
            term, doc = np.nonzero(own.T)
            some, df = np.unique(term, return_counts=True)
            out = held.meet(pa.array(keys[at : at + len(own)]), pa.array([f"t{x}" for x in some], pa.string()), np.concatenate([[0], np.cumsum(df)]), doc.astype(np.int32), own.T[term, doc])
            for q, k, s in zip(*(x.to_pylist() for x in out), strict=True):
                got.setdefault(q, []).append((-round(s, 6), k))
            at += len(own)
        for i in range(n_queries):
            assert sorted(got.get(f"q{i}", []))[:n] == sorted((-round(s, 6), k) for s, k in zip(scores[i].tolist(), keys.tolist(), strict=True) if round(s, 6) > 0.05)[:n]


def test_term_statistics_shuffle_no_postings(spark, tmp_path, monkeypatch):
    """Only statistics are written and shuffled for ``bm25_stats``: no table of postings is made."""
    made = []
    monkeypatch.setattr(tables.Workspace, "once", lambda self, name, make, once=tables.Workspace.once: (made.append(name), once(self, name, make))[1])
    c = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, None)], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    c.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["term"]: r["df"] for r in queries.queries()["bm25_stats"](spark, str(tmp_path)).collect()}
    assert got == {"red": 1, "blue": 2, "green": 1} and "postings" not in made


def test_blocks_hold_statistics_and_vectors_of_their_tokens(spark, monkeypatch):
    """Small blocks of texts that are equal, empty and null, and of one long text: what both channels read equals what is made of the tokens row by row."""
    r = random.Random(8)
    texts = [" ".join(r.choice(["cat", "Dog", "fish", "大模型", "C++", f"w{r.randint(0, 99)}"]) for _ in range(r.randint(0, 25))) for _ in range(80)] + ["", None, "a b " * 300, "cat", "cat"]
    tokens = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(3).select("key", lexical.tokens(F.col("text")).alias("tokens"))
    plain = vectors.with_hashed(tokens, F.col("tokens"), 16).select("key", "vector").collect()
    for module, name, value in ((sparse, "CHUNKS", 7), (sparse, "TOKENS", 40), (vectors, "SLICE", 30)):
        monkeypatch.setattr(module, name, value)
    made = sparse.blocks(tokens, "key", 16)
    assert made.count() > 12
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(dense.unpacked(made, "key")) == sorted(map(tuple, plain)) == rows(vectors.with_hashed(tokens, F.col("tokens"), 16).select("key", "vector"))
    assert rows(sparse.document_counts(made)) == rows(tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").count())
    assert rows(sparse.corpus_stats(made)) == rows(tokens.agg(F.count("*"), F.avg(F.size("tokens"))))
    assert rows(sparse.corpus_stats(sparse.blocks(tokens.limit(0), "key"))) == [(0, None)]


def test_both_channels_read_one_table_and_no_tokens_are_written(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(tables.Workspace, "once", lambda self, name, make, once=tables.Workspace.once, **how: (made.append(name), once(self, name, make, **how))[1])
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, None), (4, "green tea")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "red tea")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {(r["query_id"], r["key"]) for r in queries.queries()["display_score"](spark, str(tmp_path)).collect()} >= {(7, 1), (7, 4)}
    assert "inverted" in made and not {"tokens", "postings", "vectors"} & set(made)


def test_row_groups_of_large_rows_are_small(spark, tmp_path, monkeypatch):
    """Else a reader takes a whole file of blocks into memory at once."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(tables, "shared_dir", lambda spark: f"file://{tmp_path}")
    big = spark.range(40).coalesce(1).select("id", F.expr("array_join(transform(sequence(1, 20000), i -> md5(string(i * 41 + id))), '')").alias("x"))
    assert tables.Workspace(spark, "w").write(big, "t", **tables.LARGE_ROWS).count() == 40
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in tmp_path.glob("*/t/*.parquet")]
    assert len(groups) == 1 and groups[0] >= 2


def test_dense_search_against_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(-3, 4, (60, 8)).astype(float)
    v[5] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, vector array<double>").repartition(3)
    asked = rows.filter("key < 4").withColumnRenamed("key", "query_id")
    got = {(r["query_id"], r["rank"]): r["key"] for r in dense.search(asked, rows, "query_id", "key", n=7).collect()}
    norm = np.linalg.norm(v, axis=1) + vectors.TINY
    for i in range(4):
        s = np.round(v @ v[i] / (norm * norm[i]), 6)
        want = [k for k in sorted(range(60), key=lambda k: (-s[k], k))[:7] if s[k] > 0]
        assert [got[i, r + 1] for r in range(len(want))] == want and (i, len(want) + 1) not in got


def test_fusion(spark):
    d = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.5)], "query_id long, key long, rank int, score double")
    s = spark.createDataFrame([(1, 11, 1, 7.0), (1, 12, 2, 3.0)], "query_id long, key long, rank int, score double")
    rows = fusion.display_score(fusion.reciprocal_rank(d, s)).orderBy("rank").collect()
    assert [(r["key"], r["score_type"]) for r in rows] == [(11, "both"), (10, "dense"), (12, "sparse")]
    assert rows[0]["rrf_raw"] == round(1 / 62 + 1 / 61, 6)
    assert rows[0]["score"] == round(0.5 * 0.5 / 0.9 + 0.5, 4)
    other = fusion.reciprocal_rank(s, d).orderBy("rank").collect()
    assert [r["rrf_raw"] for r in other] == [r["rrf_raw"] for r in rows]
    assert [r["key"] for r in fusion.weighted(d, s).orderBy("rank").collect()] == [10, 11, 12]
    same = spark.createDataFrame([(1, 0.0), (1, 0.0)], "q int, v double").select(fusion.minmax(F.col("v"), ["q"]).alias("x")).collect()
    assert [r["x"] for r in same] == [1.0, 1.0]
    with pytest.raises(ValueError, match="balanced"):
        preset("none")


def test_minmax_of_large_groups_keeps_nulls_and_single_rows(spark):
    rows = spark.createDataFrame([(1, None, 2.0), (2, None, 4.0), (3, "a", 1.0), (4, "b", None)], "i int, g string, v double")
    got = {x["i"]: x["norm"] for x in fusion.minmax_of_groups(rows, "v", ["g"]).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 1.0, 4: None}


def test_greedy_choice_against_a_plain_loop():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n, k, p = 20, 6, Params()
        v = rng.normal(size=(n, 4))
        rel, src = np.sort(rng.random(n))[::-1], rng.integers(0, 4, n).astype(str)
        sim = diversity.similarities(list(v))
        out, left = [0], list(range(1, n))
        while len(out) < k:
            worth = [round(0.7 * rel[i] - 0.3 * max(0, max(sim[i, j] for j in out)) - 100 * (sum(src[j] == src[i] for j in out) >= 2), 9) for i in left]
            out.append(left.pop(int(np.argmax(worth))))
        assert diversity.choose(rel, sim, src, k, p) == out
    assert diversity.choose(np.ones(3), np.zeros((3, 3)), np.array(["a"] * 3), 5, Params()) == [0, 1, 2]


def test_demotion_and_backfill(spark):
    sim = np.array([[1, 0.9, 0.9], [0.9, 1, 0.9], [0.9, 0.9, 1]])
    assert diversity.demoted([0, 1, 2], sim, np.array(["a", "a", "b"]), 0.85).tolist() == [False, False, True]
    kept = spark.createDataFrame([(1, 5, 0, 1), (1, 6, 1, 2), (1, 7, 0, 3)], "query_id long, key long, stage int, position int")
    backup = spark.createDataFrame([(1, 8, 1), (1, 7, 2)], "query_id long, key long, rank int")
    assert [r["key"] for r in fusion.backfill(kept, backup).orderBy("position").collect()] == [5, 7, 6, 8]


def test_hybrid_search_end_to_end(spark):
    c = spark.createDataFrame([(i, f"common words number{i} topic{i % 3}", f"s{i % 2}", "p", "x") for i in range(12)], "key long, content string, source string, project string, section_type string")
    q = spark.createDataFrame([(1, "topic1 number4 words", ["x"], None)], "query_id long, text string, intents array<string>, target string")
    posts, lengths = lexical.postings(c, ["key"]), lexical.chunk_lengths(c, ["key"])
    stats = lexical.corpus_stats(lengths)
    sparse = lexical.search(q, posts, lengths, lexical.term_stats(posts, stats), stats, ["key"], n=32)
    emb = lambda d, col: vectors.with_hashed(d, lexical.tokens(F.col(col)))
    hits = search.finish(dense.search(emb(q, "text"), emb(c, "content"), "query_id", "key", n=32), sparse, emb(c, "content"), q).orderBy("position").collect()
    assert hits[0]["key"] == 4 and [h["position"] for h in hits] == list(range(1, len(hits) + 1)) and len({h["key"] for h in hits}) == len(hits)
    assert all(0 <= h["score"] <= 1 for h in hits)


def test_changes_and_repair(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, md5 string")
    was = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4")], "name string, md5 string")
    got = {r["name"]: r["status"] for r in sync.detect_changes(now, was).collect()}
    assert got == {"a": "added", "b": "unchanged", "c": "modified", "d": "deleted"} and sync.has_changes(sync.detect_changes(now, was))
    assert not sync.has_changes(sync.detect_changes(now, now))
    up = sync.upsert(was.withColumnRenamed("name", "source"), now.withColumnRenamed("name", "source"), sync.detect_changes(now, was))
    assert sorted(map(tuple, up.collect())) == [("a", "1"), ("b", "2"), ("c", "3")]
    t = {"x": spark.createDataFrame([(1,), (2,)], "k long"), "y": spark.createDataFrame([(2,), (3,)], "k long"), "z": spark.createDataFrame([], "k long")}
    assert sorted(r["missing"] for r in sync.audit(t, ["k"]).collect()) == ["x,z", "y,z", "z"]
    assert [r["k"] for r in sync.repair(t, ["k"])["x"].collect()] == [2]


def test_context_and_fallback(spark):
    hits = spark.createDataFrame([(1, 2, "p", "s2", "skills", "B", "t", 0.5), (1, 1, None, "s1", None, "A", "t", 0.9)], "query_id long, position int, project string, source string, section_type string, content string, file_type string, score double")
    qs = spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, text string")
    rows = {r["query_id"]: r for r in context.with_fallback(qs, context.assemble(hits)).collect()}
    assert rows[1]["context"] == "[项目: 其他 | 来源: s1 | 章节: 综合]\nA\n\n---\n\n[项目: p | 来源: s2 | 章节: 技能]\nB" and rows[1]["used_files"] == ["s1", "s2"] and rows[1]["answer"] is None
    assert rows[2]["answer"] == context.NO_HITS and rows[2]["sources"] == []
    assert one(spark, context.prompt(F.col("c"), F.col("q"), "R", "{question}"), c="{role}", q="Q") == "R\n\n{question}\n\n---\n{role}\n\n---\nQ"
    good, bad = context.validate(spark.createDataFrame([(" a ",), ("",), ("  ",), ("x" * 2001,), (None,)], "text string"))
    assert [r["text"] for r in good.collect()] == ["a"] and sorted(r["reason"] for r in bad.collect()) == ["blank", "empty", "empty", "too long"]


def test_evaluation(spark):
    qs = spark.createDataFrame([(1, ["Foo"]), (2, ["bar"]), (3, [])], "query_id long, keywords array<string>")
    hits = spark.createDataFrame([(1, 1, "nothing"), (1, 2, "a foo"), (3, 1, "x")], "query_id long, position int, content string")
    rel = evaluation.relevance(hits, qs)
    assert {r["k"]: (r["questions"], r["hits"], r["rate"]) for r in evaluation.hit_rate(rel).collect()} == {1: (2, 0, 0.0), 3: (2, 1, 0.5), 5: (2, 1, 0.5)}
    assert evaluation.mean_reciprocal_rank(rel).first()["mrr"] == 0.25
    assert evaluation.mean_reciprocal_rank(rel.filter("false")).first()["mrr"] == 0.0
    lengths = spark.createDataFrame([("a", "x" * n) for n in (199, 200, 349, 350, 499, 500)], "source string, content string")
    row = evaluation.index_quality(lengths).first()
    assert (row["under_200"], row["from_200"], row["from_350"], row["from_500"]) == (1, 2, 2, 1)


def test_judge(spark):
    body = '{"accuracy": 2, "relevance": 5, "completeness": 3, "comment": "c"}'
    rows = spark.createDataFrame([(1, body), (2, f"```json\n{body}\n```"), (3, f"text ```\n{body}\n``` more"), (4, "no {json"), (5, '{"accuracy": 4}'), (6, None)], "id long, reply string")
    got = {r["id"]: r["judged"] for r in judge.parse(rows).collect()}
    assert all(got[i]["accuracy"] == 2 and got[i]["comment"] == "c" for i in (1, 2, 3)) and got[4]["accuracy"] == 0 and got[5]["relevance"] is None and got[6]["relevance"] == 0
    assert sorted(r["id"] for r in judge.parse(rows).filter(judge.asks_again(F.col("judged"))).collect()) == [1, 2, 3, 4, 6]
    none = judge.summary(judge.parse(rows).filter("false")).first()
    assert (none["n"], none["overall"]) == (0, 0.0)


def test_files(spark, tmp_path):
    for name, t in (("00_a.md", "alpha"), ("b.txt", " "), ("c.png", "x")):
        (tmp_path / name).write_text(t)
    got = files.list_files(spark, str(tmp_path))
    assert sorted(r["name"] for r in got.collect()) == ["00_a.md", "b.txt"]
    assert {r["name"] for r in files.file_hashes(got).collect()} == {"00_a.md", "b.txt"}
    good, bad = files.quarantine(files.read_texts(spark, str(tmp_path)).withColumn("error", F.lit(None).cast("string")))
    assert [r["source"] for r in good.collect()] == ["00_a.md"] and [r["reason"] for r in bad.collect()] == ["blank"]
    (tmp_path / "q.json").write_text('{"_meta": {}, "questions": [{"id": "Q1", "category": "c", "question": "x", "expected_keywords": ["k"]}, {"id": "Q2", "question": "x"}]}')
    assert [(r["id"], r["keywords"]) for r in files.read_questions(spark, str(tmp_path / "q.json")).collect()] == [("Q1", ["k"]), ("Q2", [])]
    assert tables.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_registered_names_have_sql_where_sql_can_say_it():
    from gleaner import oracles

    assert set(oracles.oracle_sql()) <= set(queries.queries())
    assert set(queries.queries()) == set(oracles.oracle_sql())


def test_jobs_end_to_end(spark, tmp_path):
    from gleaner.jobs import answer, build_index

    raw, out = tmp_path / "raw", str(tmp_path / "index")
    raw.mkdir()
    (raw / "02_cats.md").write_text("# Cats\nCats sleep all day. " * 20)
    (raw / "dogs.txt").write_text("Dogs bark at night. " * 30)
    report = {r["status"]: r["files"] for r in build_index.run(spark, str(raw), out).collect()}
    assert report == {"added": 2}
    assert {r["status"] for r in build_index.run(spark, str(raw), out, "status").collect()} == {"unchanged"}
    asked = spark.createDataFrame([(1, "Why do dogs bark?"), (2, "   ")], "query_id long, text string")
    rows = answer.run(asked, out, "role", "rules").collect()
    assert len(rows) == 1 and rows[0]["used_files"][0] == "dogs.txt" and "Dogs bark" in rows[0]["prompt"]


def same_index(spark, one, other):
    """Whether two indexes read alike, table by table."""
    def rows(root):
        at = Index(spark, root)
        made = {"chunks": at.read("chunks"), "vectors": at.read("vectors"), "lengths": at.read("lengths"), "hashes": at.read("hashes"), "postings": at.postings(), "size": at.corpus_stats(), "terms": at.term_stats()}
        return {k: sorted(map(repr, df.select(*sorted(df.columns)).collect())) for k, df in made.items()}

    a, b = rows(one), rows(other)
    assert a == b
    return True


def test_incremental_build_and_evaluation(spark, tmp_path):
    """An incremental build leaves the same index as a full one, and the evaluation job reads the real search."""
    from gleaner.jobs import build_index, evaluate

    raw, out, full = tmp_path / "raw", str(tmp_path / "index"), str(tmp_path / "full")
    raw.mkdir()
    (raw / "cats.md").write_text("# Cats\nCats sleep all day. " * 20)
    (raw / "dogs.txt").write_text("Dogs bark at night. " * 30)
    (raw / "gone.txt").write_text("Fish swim. " * 9)
    build_index.run(spark, str(raw), out, "incremental")
    (raw / "gone.txt").unlink()
    (raw / "cats.md").write_text("# Cats\nCats purr loudly. " * 25)
    (raw / "birds.md").write_text("Birds sing in spring. " * 12)
    report = {r["status"]: r["files"] for r in build_index.run(spark, str(raw), out, "incremental").collect()}
    assert report == {"added": 1, "deleted": 1, "modified": 1, "unchanged": 1}
    build_index.run(spark, str(raw), full, "full")
    assert same_index(spark, out, full)
    assert same_index(spark, Index(spark, out).compact().root, full) and len(Index(spark, out).segments) == 1 and len(Index(spark, out).vacuum()) == 2
    asked = spark.createDataFrame([("a", "Which animals purr loudly?", "cats", ["purr"]), ("b", "Who barks at night: dogs?", "dogs", ["nothing like it"]), ("c", "Birds?", "birds", [])], "query_id string, text string, category string, keywords array<string>")
    made = evaluate.run(asked, full, str(tmp_path / "report"))
    assert {r["k"]: (r["questions"], r["hits"]) for r in made["hit_rate"].collect()} == {1: (2, 1), 3: (2, 1), 5: (2, 1)}
    assert made["mrr"].first()["mrr"] == 0.5 and made["overall"].first()["questions"] == 3
    import json

    records = {r["query_id"]: json.loads(r["record"]) for r in made["records"].collect()}
    assert records["a"]["category"] == "cats" and records["a"]["question"].startswith("Which") and records["a"]["scores"][0] == records["a"]["top"]
    assert made["index_quality"].first()["dimension"] == 64


def test_report_numbers(spark):
    """Means round in doubles as in SQL (0.59115 lies below the tie once multiplied), small scores have no exponent, and what isn't known is null."""
    rows = [("a", 'x "y"}', [1.0, 0.0003, 0.0], 3, 1, 1.0, 0.59115), ("b", "{", [], 0, 0, None, None)]
    stats = spark.createDataFrame(rows, "query_id string, question string, scores array<double>, total_results long, both_hits long, top_score double, mean_score double")
    got = {r["query_id"]: r["record"] for r in evaluation.report(stats).collect()}
    assert got["a"] == '{"question":"x \\"y\\"}","scores":[1.0,0.0003,0.0],"total":3,"both":1,"top":1.0,"mean":0.5911}'
    assert got["b"] == '{"question":"{","scores":[],"total":0,"both":0,"top":null,"mean":null}'


def test_compare_presets(spark):
    """Scores differ by preset; hit rates, reciprocal rank and channel means are those of the one search. A search of its own at each k counts at its k."""
    hits = spark.createDataFrame([("a", 1, 0.9, 1.0), ("a", 2, 0.1, 3.0), ("b", 1, 0.5, 0.0)], "query_id string, rank int, dense_score double, sparse_score double")
    stats = spark.createDataFrame([("a", 3, 4), ("b", 0, 1)], "query_id string, both_hits long, sparse_hits long")
    one_search = spark.createDataFrame([("a", 2), ("b", None), ("c", 1)], "query_id string, first int")
    presets = {"d": (1.0, 0.0), "s": (0.0, 1.0)}
    got = {r["preset"]: r for r in evaluation.compare_presets(hits, one_search, stats, presets=presets).collect()}
    assert [(r["mean_top"], r["mean_score"]) for r in (got["d"], got["s"])] == [(1.0, 0.75), (0.5, 0.75)]
    assert {tuple(r[c] for c in ("hit_rate_1", "hit_rate_3", "hit_rate_5", "mrr", "mean_both", "mean_sparse")) for r in got.values()} == {(0.3333, 0.6667, 0.6667, 0.5, 1.5, 2.5)}
    own = spark.createDataFrame([(1, None), (1, 1), (3, 2), (3, 1), (5, 4), (5, 1), (10, 4), (10, 1)], "k int, first int")
    r = evaluation.compare_presets(hits, own, presets=presets).first()
    assert (r["hit_rate_1"], r["hit_rate_3"], r["hit_rate_5"], r["mrr"]) == (0.5, 1.0, 1.0, 0.625) and "mean_both" not in r
    none = evaluation.compare_presets(hits, one_search.limit(0), presets=presets).first()
    assert (none["hit_rate_1"], none["mrr"]) == (0.0, 0.0)


def test_killed_builds_leave_the_old_index(spark, tmp_path, monkeypatch):
    """A build that dies at any table leaves the version before; the next one isn't disturbed. Names hold spaces, percent signs and Chinese letters."""
    from gleaner.jobs import build_index

    raw, out, full = tmp_path / "raw", str(tmp_path / "index"), str(tmp_path / "full")
    raw.mkdir()
    (raw / "02_项目 a.md").write_text("Cats sleep all day. " * 9)
    (raw / "b%20c.txt").write_text("Dogs bark at night. " * 9)
    build_index.run(spark, str(raw), out, "incremental")
    assert {r["source"] for r in Index(spark, out).read("chunks").collect()} == {"02_项目 a.md", "b%20c.txt"}
    before = sorted(map(repr, Index(spark, out).read("chunks").collect()))
    (raw / "02_项目 a.md").write_text("Cats purr. " * 9)
    (raw / "new one.md").write_text("Birds sing. " * 9)
    calls, real = [], impact.blocks

    def dies(*args, **more):
        calls.append(1)
        raise OSError("killed")

    monkeypatch.setattr(impact, "blocks", dies)
    with pytest.raises(OSError):
        build_index.run(spark, str(raw), out, "incremental")
    monkeypatch.setattr(impact, "blocks", real)
    assert calls and sorted(map(repr, Index(spark, out).read("chunks").collect())) == before
    report = {r["status"]: r["files"] for r in build_index.run(spark, str(raw), out, "incremental").collect()}
    assert report == {"added": 1, "modified": 1, "unchanged": 1}
    build_index.run(spark, str(raw), full, "full")
    assert same_index(spark, out, full) and len(Index(spark, out).vacuum()) == 1 and same_index(spark, out, full)
    stale = Index(spark, out)
    Index(spark, out).commit(stale.segments)
    with pytest.raises(RuntimeError):
        stale.commit(stale.segments)


def test_bounded_search_equals_the_full_sum(spark, monkeypatch, tmp_path):
    """With small blocks, common and rare terms, terms of negative weight, and ties."""
    from gleaner.sources.tables import Workspace

    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(["common"] * (i % 3 != 0) + rng.choices(words, weights, k=rng.choice([3, 8, 30]))) for i in range(400)]
    texts[7] = texts[8] = texts[9]
    c = spark.createDataFrame(list(enumerate(texts)), "key long, content string")
    asked = [(i, " ".join(["common"] * (i % 2) + rng.choices(words, k=rng.choice([1, 2, 9])))) for i in range(25)] + [(90, "nothing known"), (91, None), (92, texts[7])]
    q = spark.createDataFrame(asked, "query_id long, text string")
    posts = lexical.postings_and_lengths(c, ["key"])
    stats = lexical.corpus_stats(lexical.chunk_lengths(c, ["key"]))
    terms = lexical.term_stats(posts, stats)
    want = {(r["query_id"], r["rank"]): (r["key"], round(r["score"], 6)) for r in lexical.search(q, posts, None, terms, stats, ["key"], n=5).collect()}
    best, read = impact.search(q, impact.blocks(posts, ["key"], 400, 4), terms, stats, ["key"], Workspace(spark, "bounded").write, n=5)
    assert {(r["query_id"], r["rank"]): (r["key"], round(r["score"], 6)) for r in best.collect()} == want and len(want) > 100
    read = {r["query_id"]: (r["postings"], r["read"]) for r in read.collect()}
    assert sum(b for _, b in read.values()) < 0.9 * sum(a for a, _ in read.values())
    assert sum(b < a for a, b in read.values()) > 0


def test_blocks_of_tokens_are_those_of_postings_and_shuffle_once(spark):
    r = random.Random(8)
    c = spark.createDataFrame([(i, " ".join(f"w{r.randint(0, 30)}" for _ in range(r.randint(0, 40)))) for i in range(300)], "key long, content string")
    made = impact.blocks_of_tokens(c.select("key", lexical.tokens(F.col("content")).alias("tokens")), ["key"], 300, 4)
    rows = lambda d: sorted((*x[:6], sorted(x["hits"])) for x in d.collect())
    assert rows(made) == rows(impact.blocks(lexical.postings_and_lengths(c, ["key"]), ["key"], 300, 4))
    assert made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_files_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([("a b.md", "x\ny"), ("项 %.txt", "é"), ("c%20d.md", "z"), ("empty.md", None)], "name string, text string")
    assert files.write_files(rows, f"file://{tmp_path}/made") == 4
    assert {r["source"]: r["text"] for r in files.read_texts(spark, f"{tmp_path}/made").collect()} == {"a b.md": "x\ny", "项 %.txt": "é", "c%20d.md": "z"}


def test_nearest_skips_blocks_and_equals_dense_search(spark, monkeypatch):
    """Clustered vectors, a third of them equal, with rows that take no part: null, ragged and non-finite vectors."""
    from gleaner.sources.tables import Workspace

    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "TOGETHER", 7)
    monkeypatch.setattr(nearest, "PIVOTS", 12)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (10, 6))
    v = centres[rng.integers(0, 10, 900)] + rng.normal(0, 0.05, (900, 6))
    v[:300] = v[0]
    v[400] = 0
    good = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(2000, None), (2001, [1.0]), (2002, [float("nan")] * 6), (2003, [None] * 6), (2004, [float("inf")] * 6)]
    rows = spark.createDataFrame(good + odd, "key long, vector array<double>").repartition(3)
    asked = rows.filter("key % 45 = 0 OR key >= 2000").withColumnRenamed("key", "query_id")
    plain = spark.createDataFrame(good, "key long, vector array<double>")
    want = {(r["query_id"], r["rank"]): (r["key"], round(r["score"], 6)) for r in dense.search(plain.filter("key % 45 = 0").withColumnRenamed("key", "query_id"), plain, "query_id", "key", n=5, not_itself=True).collect()}
    hits, effort = nearest.search(asked, rows, "query_id", "key", Workspace(spark, "near").write, n=5, not_itself=True)
    assert {(r["query_id"], r["rank"]): (r["key"], round(r["score"], 6)) for r in hits.collect()} == want and len(want) > 60
    effort = effort.first()
    assert effort["visited"] < 0.6 * effort["blocks"], effort
    none, _ = nearest.search(asked.limit(0), rows.limit(0), "query_id", "key", Workspace(spark, "near").write, n=5)
    assert none.collect() == []


def test_chunks_equal_those_of_plain_loops(spark):
    """Random texts of all that the chunker looks at: code, tables, marks, blank lines, long sentences, short items, and white space of many kinds."""
    rng = random.Random(8)
    line = lambda: rng.choice([
        "# head", "## Head two", "#", "##\u3000x", "// note", "def f(): return 1", "x = {", "│ tree", "|a|b|", "|---|:-|", "||", "1. item", "2、 项", "- dash", "（3）x", "第三章 y", "", " ", "\u3000", "\t",
        "plain words here", "Sentence one. Two! 三。 Four? end", "w" * rng.randint(1, 700), "3.8 is a number. " * rng.randint(1, 60), "word " * rng.randint(1, 130), "a\rb\x0bc\u2028d", "import x", "é" * rng.randint(1, 260), "\u0001mark", "return home ",
    ])
    made = ["\n".join(line() for _ in range(rng.choice([0, 1, 3, 10, 40, 120]))) for _ in range(150)] + ["", "\n", "x", "\n\n a \n \n b", "# a\n" * 12]
    rows = spark.createDataFrame(list(enumerate(made)), "id int, text string")
    for params in (Params(), Params(chunk_chars=60, chunk_least=25)):
        for r in rows.select("id", chunking.split(F.col("text"), params).alias("chunks")).collect():
            want = plain_chunker.chunk_text(made[r["id"]], params)
            assert [c["content"] for c in r["chunks"]] == want, repr(made[r["id"]])
            assert [c["line"] for c in r["chunks"]] == plain_chunker.lines_of(made[r["id"]], want)


def test_chunks_are_made_once(spark):
    """The optimizer adds no filter that makes all chunks again to see whether there are any."""
    made = chunking.build(spark.createDataFrame([("a.md", "x"), ("b.md", " "), ("c.md", None)], "source string, text string"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("locate(") == 1
    assert [(r["source"], r["total_chunks"]) for r in made.collect()] == [("a.md", 1)]


def test_trimmed_cuts_what_the_class_of_white_space_holds(spark):
    every = spark.range(1, 0x10000).filter("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    x = F.concat("c", F.lit("a b"), "c", F.lit("\u3000"))
    assert every.filter(chunking.trimmed(x) != F.regexp_replace(x, rf"\A{chunking.WHITE}+|{chunking.WHITE}+\z", "")).count() == 0


def test_order_statistics_equal_sorting(spark):
    """Skewed, tied, tiny and huge values, null groups, null values, single rows."""
    rng = random.Random(6)
    groups = {"a": [rng.gauss(0, 1) * 10 ** rng.randint(-8, 8) for _ in range(3000)], "b": [1.5] * 50, "c": [7.0], "d": [0.0, -0.0, 1e-300, 1e300, -1e308, 1e308], None: [float(i % 7) for i in range(333)], "e": [None, 3.0, None, 4.0]}
    rows = [(g, v) for g, x in groups.items() for v in x] + [("f", None)]
    got = {r["g"]: r for r in evaluation.latency(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v").collect()}
    for g, x in groups.items():
        x = sorted(v for v in x if v is not None)
        p = 0.99 * (len(x) - 1)
        low, high = x[int(p)], x[min(math.ceil(p), len(x) - 1)]
        assert got[g]["p99_ms"] == pytest.approx((1 - (p - int(p))) * low + (p - int(p)) * high, rel=1e-9, abs=1e-6), g
    assert got["f"]["p99_ms"] is None and got["e"]["n"] == 4


def test_changes_by_digest_join_few_names(spark):
    now = [(f"n{i}", f"h{i}") for i in range(2000)] + [("new", "x")]
    was = [(f"n{i}", "other" if i == 77 else f"h{i}") for i in range(2000)] + [("old", "x")]
    tables_ = [spark.createDataFrame(x, "name string, md5 string") for x in (now, was)]
    want = {tuple(r) for r in sync.detect_changes(*tables_).collect()}
    assert {tuple(r) for r in sync.detect_changes_by_digest(*tables_, buckets=256).collect()} == want
    assert sync.differing(*tables_, buckets=256).count() <= 3 and sync.differing(tables_[0], tables_[0]).count() == 0


def test_rulebook_equals_a_chain_of_conditions(spark):
    """Ten thousand rules with keywords inside one another, repeated keywords, and rules that match nothing."""
    rng = random.Random(2)
    keywords = ["".join(rng.choice("abc项") for _ in range(rng.randint(3, 7))) for _ in range(10_000)]
    texts = ["".join(rng.choice("abc项 ") for _ in range(n)) for n in (0, 3, 40, 400)] + [None, "ABC"]
    rules_ = spark.createDataFrame(list(enumerate(keywords)) + [(-1, ""), (None, "a"), (-2, None)], "rule int, keyword string")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["rules"] for r in rows.select("id", rulebook.match(F.col("text"), rules_).alias("rules")).collect()}
    assert got == {i: [n for n, k in enumerate(keywords) if t and k in t] for i, t in enumerate(texts)}
    few = keywords[:30]
    chain = rules.first_of([(F.contains(F.col("text"), F.lit(k)), str(n)) for n, k in enumerate(few)], "none")
    both = rows.select(chain.alias("a"), F.coalesce(F.get(rulebook.match(F.col("text"), rules_.filter("rule < 30")), F.lit(0)).cast("string"), F.lit("none")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)
    assert rows.select(rulebook.match(F.col("text"), rules_.limit(0)).alias("x")).first()["x"] == []
