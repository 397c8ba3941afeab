"""Cross-tokenizer alignment against a plain count of links."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm import op13_alignment as alignment

A, B = (alignment.public_tokenizers.path(x) for x in (alignment.A_VOCABULARY, alignment.B_VOCABULARY))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """Offsets and groups by plain loops over tokens."""
    code = alignment.coders(A, B)
    made, pairs = [], Counter()
    for doc_id, text in rows:
        a = code.a.encode(f" {text or ''}", add_special_tokens=False).ids if text else []
        b = code.b.encode(text) if text else []
        want = f" {text}".encode("utf-8", "surrogatepass")
        if b"".join(code.a_bytes[i] for i in a) != want or b"".join(code.b_bytes[i] for i in b) != want:
            a, b = [], []
        groups, links, i, j, at_a, at_b, own = [], [], 0, 0, 0, 0, ([], [])
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                own[0].append(a[i])
                at_a += len(code.a_bytes[a[i]])
                i += 1
            else:
                own[1].append(b[j])
                at_b += len(code.b_bytes[b[j]])
                j += 1
            if at_a == at_b:
                links.append((own[0][-1], own[1][-1]))
                groups.append(",".join(map(str, own[0])) + "|" + ",".join(map(str, own[1])))
                own = ([], [])
        pairs.update(links)
        made.append((doc_id, len(a), len(b), groups, links))
    most = {}
    for (_, y), n in pairs.items():
        most[y] = max(most.get(y, 0), n)
    return Counter(
        (d, x, y, len(g), len(li), sum(pairs[p] == most[p[1]] for p in li), sum(pairs[p] for p in li), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, x, y, g, li in made
    ), pairs, most


ODD = [(None, "Straße 世界, naïve café."), (3, None), (4, ""), (4, " "), (5, "a▁b"), (6, "<s> </s> <0x41> <unk> <|endoftext|>"), (7, "x" * 5000), (7, "x" * 5000), (8, "tab\tnew\nline  two   spaces "), (9, "👩‍👩‍👧 \u0000 ﬁ ½"), (10, "don't we'll 12,345.67 ... !!"), (11, "a\u00a0 b \u3000c \x1cd \x1c e\u0085 f"), (12, "é e\u0301 '  's n't 's\ta \n b"), (13, "  lead and trail  "), (14, "12 34 ,. ,5 x ' s")]


def got(table):
    return Counter(tuple(r[c] for c in COLUMNS) for r in table.collect())


@pytest.mark.parametrize(("chunk", "memo"), [(4 << 20, 100_000), (64, 50)])
def test_alignment(spark, chunk, memo, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(alignment, "MEMO", memo)
    monkeypatch.setattr(alignment, "VISITS", 3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).union(spark.createDataFrame(ODD, "doc_id long, text string"))
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("chunk", "links", "stripe", "cells", "n", "first", "n_best")])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, pairs, most = brute(rows)
    rows, best = alignment.align(docs)
    assert got(rows) == want
    assert {(r["b_id"], r["a_id"], r["n"]) for r in best.collect()} == {(b, a, n) for (a, b), n in pairs.items() if n == most[b]}


def test_alignment_of_nothing(spark):
    rows, best = alignment.align(spark.createDataFrame([], "doc_id long, text string"))
    assert rows.collect() == [] and best.collect() == []


def test_segments_give_the_ids_of_whole_texts():
    """Cut at single spaces and put together, the ids are those of the whole text, in both vocabularies."""
    import pyarrow.parquet as pq

    code = alignment.coders(A, B)
    assert code.cuts
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() + [t for _, t in ODD if t]
    for t in texts:
        parts = code.segments(t)
        assert " ".join(parts) == t
        assert all(code.quick(f" {x}") == code.a.encode(f" {x}", add_special_tokens=False).ids for x in parts if alignment.PLAIN.fullmatch(x))
        for whole, ids in ((code.a.encode(f" {t}", add_special_tokens=False).ids, [code.a.encode(f" {x}", add_special_tokens=False).ids for x in parts]), (code.b.encode(t), [code.b.encode(x) for x in parts])):
            assert whole == [i for x in ids for i in x]
