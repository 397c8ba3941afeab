"""Every operator and pipeline stage on one table of odd rows: null and shared ids, repeated rows, null, empty and very long texts, and columns with clashing names."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gleaner.llm import op08_token_output as files
from gleaner.llm import tokens
from gleaner.llm.common import Scratch
from gleaner.llm.op01_near_dedup import near_duplicates
from gleaner.llm.op02_packing import pack
from gleaner.llm.op03_suffix_dedup import suffix_dedup
from gleaner.llm.op04_substring_dedup import substring_dedup
from gleaner.llm.op05_mixing import mix
from gleaner.llm.op06_topk import top_k
from gleaner.llm.op07_quality import score_documents
from gleaner.llm.op09_line_dedup import dedup_lines
from gleaner.llm.op10_exact_dedup import exact_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["doc", "version", "id", "key", "n", "row", "kept", "size", "start", "length", "line", "anchors", "spans", "tokens", "hash", "component", "component_id", "keep_id", "score", "rank", "offset", "content", "factor", "n_words", "n_tokens"]
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
A, B, C, LONG = (" ".join(rng.choice(WORDS) for _ in range(n)) for n in (120, 120, 120, 30_000))
ROWS = [(None, A), (4, A), (4, B), (7, C), (7, C), (12, C), (9, None), (10, ""), (11, LONG), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    made = [(i, t, [None, "en", "de"][n % 3], [None, "s", ""][n % 3], None if t is None else len(t)) for n, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(made, SCHEMA).select("*", *[F.lit("x").alias(c) for c in CLASHES])


def counted(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def ids_of(end):
    t = Tokenizer.from_file(tokens.default_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for _, x in ROWS]


def test_near(docs):
    got = counted(near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    size = lambda t: len({tuple(t.split(" ")[i : i + 3]) for i in range(len(t.split(" ")) - 2)}) if t else 0
    assert got == Counter((i, size(t), 7 if t == C else i, i != 12) for i, t in ROWS)


def test_packing(docs):
    got = pack(docs).collect()
    ids = ids_of(1)
    assert sum(r["length"] for r in got) == sum(map(len, ids))
    for r in got:
        own = [x for (i, _), x in zip(ROWS, ids, strict=True) if i == r["doc_id"] and len(x) == r["doc_tokens"]]
        assert r["ids_crc32"] in {zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) for x in own}
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048
    covered = sorted((r["start"], r["start"] + r["length"]) for r in got if r["doc_id"] == 11)
    assert covered[0][0] == 0 and covered[-1][1] == len(ids[8]) and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))


def test_suffix(docs):
    want = Counter((i, len(t or ""), len(t) if t in (A, C) else 0, int(t in (A, C))) for i, t in ROWS)
    assert counted(suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans") == want


def test_substring(docs):
    """A null id neither loses words nor makes others lose any; equal ids don't affect each other."""
    assert counted(substring_dedup(docs), "doc_id", "n_words", "n_removed") == Counter((i, len((t or "").split()), 120 if i == 12 else 0) for i, t in ROWS)


def test_mixing(docs):
    out = mix(docs)
    got = out.collect()
    assert [*out.columns[: len(docs.columns)]] == docs.columns and len(got) == len(ROWS) and all(r["row"] == "x" for r in got)
    assert all(0 <= r["mix_probability"] <= 1 and (r["text"] or r["mix_probability"] == 1) for r in got)
    assert Counter(r["mix_tokens"] for r in got) == Counter(len((t or "").split()) for _, t in ROWS)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (7, None), (None, 1), (9, 0), (11, 1)], "doc_id long, quality int")
    got = score_documents(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (9, 10)}) == 1


def test_token_files(spark, docs, monkeypatch):
    """A shard for each row, so that ids run over the end of one."""
    monkeypatch.setattr(files, "SHARD_DOCUMENTS", 1)
    scratch = Scratch(spark, "odd-files")
    manifest = scratch.write(files.write_shards(docs, scratch.path("shards")), "manifest")
    assert manifest.count() == len(ROWS)
    got = files.lookup(docs, manifest, scratch.path("shards")).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(ROWS, ids_of(2), strict=True))
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_lines(docs):
    """Rows equal in id and text share a fate; a null id goes first."""
    out = dedup_lines(docs)
    assert counted(out, "doc_id", "n_lines", "n_removed") == Counter((i, 1, int(i == 12 or (i, t) == (4, A))) for i, t in ROWS)
    assert all(r["line"] == r["key"] == "x" for r in out.select("line", "key").collect())


def test_exact(docs):
    keep = {A: (4, 2), B: (4, 1), C: (12, 3), "": (10, 3), LONG: (11, 1)}
    assert counted(exact_duplicates(docs), "doc_id", "keep_id", "group_size", "kept") == Counter((i, *keep[t or ""], i == keep[t or ""][0]) for i, t in ROWS)


def test_top_k_of_few(spark):
    """Fewer candidates than k, shared ids, clashing columns."""
    made = [(0, [1.0, 0.0]), (0, [3.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [9.0, 9.0]), (3, []), (4, None)]
    table = spark.createDataFrame(made, "vec_id long, embedding array<double>").select("*", *[F.lit("x").alias(c) for c in [*CLASHES, "query_id", "vector", "block", "norm"]])
    assert counted(top_k(table, F.col("id") % 50 == 0), "query_id", "rank", "vec_id", "score") == Counter([(0, 1, 1, 768 * 128), (0, 2, 2, 768 * 128)])


@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_stages(spark, docs, tmp_path, rows):
    """Each stage on odd rows and on none: what each must keep, and columns as they were."""
    table = docs if rows else docs.limit(0)
    labels = spark.createDataFrame([(4, 1), (None, None), (7, 1), (9, None)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    want = {
        "quality_classifier": Counter(rows),  # labels of one class reject nothing
        "line_dedup": Counter((i, t) for i, t in rows if i != 12 and (i, t) != (4, A)),  # a text that loses all its lines goes
        "near_dedup": Counter((i, t) for i, t in rows if i != 12),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = Scratch(spark, "odd-stage").write(stage(spark, table, str(tmp_path)), name)
        assert out.columns == table.columns
        got = counted(out, "doc_id", "text")
        assert got == want[name] if name in want else got <= Counter(rows), name
        assert name != "mixing" or all(got[x] == n for x, n in Counter((i, t) for i, t in rows if not t).items())
    packed = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect()
    assert sum(r["length"] for r in packed) == (sum(map(len, ids_of(1))) if rows else 0)
