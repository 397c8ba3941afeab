"""Language identification: the Viterbi pass against a plain one, words against a plain cut, accuracy on rows held out, and odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import op11_language_id as language


def plain_best(scores, switch):
    """The sum of the best path, and of a given path."""
    value = list(scores[0])
    for x in scores[1:]:
        best = max(value)
        value = [max(v, best - switch) + s for v, s in zip(value, x)]
    return max(value)


def sum_of(path, scores, switch):
    return sum(scores[t][k] for t, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("block", [1, 3, 64])
def test_viterbi_finds_best_paths(block, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", block)
    monkeypatch.setattr(language, "STATES", 40)
    rng = np.random.default_rng(block)
    lengths = [0, 1, 2, 64, 65, 200, 0, 7, 128, 3]
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.integers(-9, 9, (first[-1], 4)).astype(np.float32)
    path = language.viterbi(scores, first, 5.0)
    for i, j in zip(first, first[1:]):
        if j > i:
            assert sum_of(path[i:j].tolist(), scores[i:j].tolist(), 5) == plain_best(scores[i:j].tolist(), 5)
    assert language.viterbi(scores[:0], np.zeros(4, np.int64)).tolist() == []


def test_words_are_runs_of_letters_of_one_script():
    texts = ["Ab-cd é", None, "", "привет abcпри", "́x éa", "a" * 60, "12 !", "世界です", "x"]
    words = language.Words(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), 0)
    cut = lambda i: [texts[i][a - words.chars[i] : b - words.chars[i]] for a, b in zip(words.start[words.row == i], words.end[words.row == i])]
    assert [cut(i) for i in range(9)] == [["Ab", "cd", "é"], [], [], ["привет", "abc", "при"], ["x", "éa"], ["a" * 24, "a" * 24, "a" * 12], [], ["世界", "です"], ["x"]]
    assert [language.NAMES[s] for s in words.script[words.row == 3]] == ["cyrillic", "latin", "cyrillic"]
    seen = {}
    for forms, buckets in words.features():
        for form, row in zip(forms.tolist(), buckets.tolist(), strict=True):
            n = int((words.end - words.start)[words.at[form]])
            real = [x for x in row if x < language.KINDS * language.BUCKETS]
            # The word, its letters, and longer pieces of the word with both ends.
            assert len(real) == 1 + n + (n + 1) + n + max(n - 1, 0) and form not in seen
            seen[form] = True
    assert len(seen) == len(words.forms)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, table):
    got = language.op11_language_id(spark, "/root/testdata/sf0.01").join(table.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    right = sum(r["lang"] == r["lang_pred"] for r in test) / len(test)
    assert right >= 0.97, right


def test_labels_of_held_out_rows_are_not_read(spark, table):
    small = table.limit(200)
    spoilt = small.withColumn("lang", F.when(language.held_out(), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    models = [language.learn(t.filter(~language.held_out())) for t in (small, spoilt)]
    assert models[0].keys() == models[1].keys() and all((models[0][k] == models[1][k]).all() for k in models[0])


def test_mixed_texts_have_spans(spark, table):
    model = language.Model(language.learn(table.union(spark.createDataFrame([(-1, "привет мир как дела сегодня", "ru", "s", 0)], table.schema))))
    rows = {r["lang"]: r["text"] for r in table.filter("length(text) BETWEEN 300 AND 1200").dropDuplicates(["lang"]).collect()}
    mixed = f"{rows['en']}\n{rows['de'][:150]} Всем привет! {rows['en']}"
    got = language.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert got["lang_pred"] == "en" and 0.3 < got["score"] < 0.95
    langs = [s["lang"] for s in got["spans"]]
    assert langs[0] == "en" and "de" in langs and [mixed[s["start"] : s["end"]] for s in got["spans"] if s["lang"] == "ru"] == ["Всем привет"]
    assert all(a["end"] <= b["start"] and a["lang"] != b["lang"] for a, b in zip(got["spans"], got["spans"][1:]))


def test_odd_rows(spark, table):
    rng = random.Random(4)
    long_ = " ".join("".join(rng.choice("abcdeöß") for _ in range(5)) for _ in range(40_000))
    rows = [(None, "the and of"), (3, None), (3, ""), (4, "12 34 !?"), (5, long_), (6, "́"), (7, "世界"), (7, "世界"), (8, "x" * 100_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("lang", "score", "spans", "held_out", "lang_pred", "at", "counts", "part")])
    model = language.Model(language.learn(table.limit(100)))
    got = language.identify(odd, model).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["lang_pred"] == "und") for r in got) == sorted((i is None, i or 0, t in (None, "", "12 34 !?", "́")) for i, t in rows)
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    nothing = language.Model(language.learn(spark.createDataFrame([], table.schema)))
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).collect() == []
