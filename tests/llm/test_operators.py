"""Operators on small tables against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gleaner.llm import op01_near_dedup as near
from gleaner.llm import op03_suffix_dedup as suffix
from gleaner.llm import queries, tokens
from gleaner.llm.common import Scratch
from gleaner.llm.components import components
from gleaner.llm.op01_near_dedup import near_duplicates
from gleaner.llm.op02_packing import pack
from gleaner.llm.op03_suffix_dedup import suffix_dedup
from gleaner.llm.op04_substring_dedup import substring_dedup
from gleaner.llm.op05_mixing import mix
from gleaner.llm.op06_topk import top_k
from gleaner.llm.op07_quality import score_documents
from gleaner.llm.op08_token_output import lookup, write_shards
from gleaner.llm.op09_line_dedup import dedup_lines
from gleaner.llm.op10_exact_dedup import exact_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near_copy(t, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in t.split(" "))


@functools.cache
def corpus():
    base, passage = prose(150), prose(70)
    texts = [base, base, base, None, "", " \n\t", "one", "two words", prose(2000)]
    texts += [near_copy(base, s) for s in (0.01, 0.02, 0.03, 0.04, 0.2)]
    texts += [prose(20) + " " + passage + " " + prose(15) for _ in range(6)] + ["ab " * 400, prose(30) + "\nA shared line of text here\n" + prose(9), "a shared line of text hers\n" + prose(30)]
    return [(i * 3, t, "en" if i % 2 else None, f"s{i % 3}", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_exact(docs, empty):
    got = {r["doc_id"]: r for r in rows_of(exact_duplicates(docs))}
    by = {}
    for i, t, *_ in corpus():
        by.setdefault(t or "", []).append(i)
    for t, ids in by.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert rows_of(exact_duplicates(empty)) == []


def test_near(docs, empty):
    sets, parent = {}, {}
    for i, t, *_ in corpus():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
        parent[i] = i
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r["doc_id"]: r for r in rows_of(near_duplicates(docs))}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    assert rows_of(near_duplicates(empty)) == []


def test_large_group_of_near_copies(spark):
    base = prose(200)
    made = [(i, near_copy(base, 0.004 * (i % 5))) for i in range(60)] + [(100 + i, prose(40)) for i in range(20)] + [(None, base), (5, base)]
    got = rows_of(near_duplicates(spark.createDataFrame(made, "doc_id long, text string")))
    assert len({r["component_id"] for r in got if r["doc_id"] is not None and r["doc_id"] < 60}) <= 3
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert all(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 100)


def test_near_branches(spark, monkeypatch):
    """Small limits, so that nodes of texts from one template branch and the last level compares."""
    for limit, value in (("LEAF", 4), ("NODE", 4), ("MAX_DEPTH", 1)):
        monkeypatch.setattr(near, limit, value)
    depths, children = [], near.children
    monkeypatch.setattr(near, "children", lambda rows, depth: (depths.append(depth), children(rows, depth))[1])
    shared = prose(150)
    texts = [shared + " " + prose(60) for _ in range(30)]
    texts += [" ".join([*t.split(" ")[:-3], "a", "b", "c"]) for t in texts[::3]]
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in (t.split(" ") for t in texts)]
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = rows_of(near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in range(len(texts))} and len({find(i) for i in range(len(texts))}) == 30
    assert depths == [0, 1]


def test_near_ends_within_the_budget(spark, monkeypatch):
    """A node of few classes that are all apart is compared whole rather than branched, and classes meet a few members without a shuffle of their own."""
    for limit, value in (("LEAF", 2), ("NODE", 8)):
        monkeypatch.setattr(near, limit, value)
    depths, children, plans, groups = [], near.children, [], near.Join.groups
    monkeypatch.setattr(near, "children", lambda rows, depth: (depths.append(depth), children(rows, depth))[1])
    monkeypatch.setattr(near.Join, "groups", lambda self, rows: (out := groups(self, rows), plans.append(out._jdf.queryExecution().optimizedPlan().toString()))[0])
    crowd = prose(150)
    texts = [crowd + " " + prose(60) for _ in range(12)] + [prose(40) for _ in range(40)]
    texts.append(texts[3] + " end")
    got = rows_of(near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {r["doc_id"] for r in got if not r["kept"]} == {len(texts) - 1} and depths == [0]
    assert len(plans) > 2 and all("Generate" not in p for p in plans)


def test_near_with_two_texts_under_one_id(spark):
    """Links of one text don't move the other, and the pipeline's stage loses neither."""
    base, other = prose(200), prose(120)
    words = base.split(" ")
    close = " ".join([*words[:-1], "otherword"])
    made = [(1, base, "en", "s", 0), (5, close, "en", "s", 0), (5, other, "en", "s", 0), (7, " ".join([*other.split(" "), "more"]), "en", "s", 0), (8, prose(30), "en", "s", 0), (8, prose(40), "en", "s", 0)]
    table = spark.createDataFrame(made, SCHEMA)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(near_duplicates(table)))
    assert [(i, c, k) for i, _, c, k in got] == [(1, 1, True), (5, 5, True), (5, 1, False), (7, 5, False), (8, 8, True), (8, 8, True)]
    assert other in {r["text"] for r in corpus_pipeline.near(spark, table, "").collect()}


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 3), (20, 21)] + [(100, x) for x in range(101, 150)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"), "c").collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 6, 7, 8, 9)}, 20: 20, 21: 20, **{i: 100 for i in range(100, 150)}}


def ids_of(texts, end):
    t = Tokenizer.from_file(tokens.default_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


def test_packing(docs, empty):
    rows = corpus()
    ids = dict(zip([r[0] for r in rows], ids_of([r[1] for r in rows], 1), strict=True))
    got = sorted(rows_of(pack(docs)), key=lambda r: (r["sequence_id"], r["offset"]))
    seen, fill = Counter(), Counter()
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(x) for i, x in ids.items()} and max(fill.values()) <= 2048
    assert rows_of(pack(empty)) == []


def test_token_files(spark, docs, empty):
    rows = sorted(corpus())
    ids = ids_of([r[1] for r in rows], 2)
    scratch = Scratch(spark, "files")
    folder = scratch.path("shards")
    manifest = scratch.write(write_shards(docs, folder), "manifest")
    got = sorted(rows_of(lookup(docs, manifest, folder)), key=lambda r: r["doc_id"])
    start = 0
    for r, (i, *_), x in zip(got, rows, ids, strict=True):
        assert r == {"doc_id": i, "start": start, "n_tokens": len(x), "ids_crc32": zlib.crc32(x.tobytes())}
        start += len(x)
    spread = lookup(docs, manifest, folder)
    assert spread.rdd.getNumPartitions() >= min(manifest.count(), 2)
    assert rows_of(lookup(spark.createDataFrame([(1,), (None,), (10**12,)], "doc_id long"), manifest, folder)) == []
    twice = spark.createDataFrame([(4, "a"), (4, "b c"), (None, "d"), (None, None)], "doc_id long, text string")
    other = scratch.path("twice")
    manifest = scratch.write(write_shards(twice, other), "manifest-2")
    assert sorted(r["n_tokens"] for r in rows_of(lookup(twice, manifest, other))) == [1, 2, 2, 3]
    assert rows_of(lookup(empty, scratch.write(write_shards(empty, scratch.path("none")), "manifest-3"), folder)) == []


def removed_windows(text_lists, length, hit):
    """Positions covered by a window for which hit(window, list number) holds."""
    out = []
    for n, x in enumerate(text_lists):
        gone = set()
        for s in range(len(x) - length + 1):
            if hit(x[s : s + length], n):
                gone |= set(range(s, s + length))
        out.append(gone)
    return out


def test_substring(docs, empty):
    rows = sorted(corpus())
    w = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    first = {}
    for n, x in enumerate(w):
        for s in range(len(x) - 49):
            first.setdefault(tuple(x[s : s + 50]), n)
    gone = removed_windows([tuple(x) for x in w], 50, lambda k, n: first[k] < n)
    got = {r["doc_id"]: r for r in rows_of(substring_dedup(docs))}
    for (i, *_), x, g in zip(rows, w, gone, strict=True):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["text"]) == (len(x), len(g), " ".join(v for k, v in enumerate(x) if k not in g))
    assert rows_of(substring_dedup(empty)) == []


@pytest.mark.parametrize("group", [200, 2])
def test_suffix(docs, empty, group, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP", group)
    rows = corpus()
    b = [(r[1] or "").encode() for r in rows]
    n = Counter(x[s : s + 400] for x in b for s in range(len(x) - 399))
    gone = removed_windows(b, 400, lambda k, _: n[k] > 1)
    got = {r["doc_id"]: r for r in rows_of(suffix_dedup(docs))}
    for (i, *_), x, g in zip(rows, b, gone, strict=True):
        spans = sum(1 for p in g if p - 1 not in g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["content"])) == (len(x), len(g), spans, bytes(v for k, v in enumerate(x) if k not in g))
    assert rows_of(suffix_dedup(empty)) == [] if group == 2 else True


def within_one(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def test_lines(spark, empty):
    base = [prose(6) for _ in range(8)]
    made = []
    for i in range(40):
        lines = []
        for _ in range(4):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(s))
                rng.choice([lambda at=at, s=s: s.pop(at), lambda at=at, s=s: s.insert(at, "z"), lambda at=at, s=s: s.__setitem__(at, "é")])()
            lines.append(rng.choice(["", "  "]) + "".join(s) + rng.choice(["", " "]))
        made.append((i, "\n".join([*lines, "short", "short"])))
    made += [(40, None), (41, ""), (42, "\n"), (43, "aaaaaaaaaaaaa"), (44, "aaaaaaaaaaaa"), (45, "AAAAAAAAAAAAAA")]
    seen, want = [], {}
    for i, t in made:
        kept = []
        for x in (t or "").split("\n"):
            k = x.strip(" \t\r\f\v").lower()
            if len(k) < 12 or not any(within_one(k, s) for s in seen):
                kept.append(x)
            if len(k) >= 12:
                seen.append(k)
        want[i] = (None if t is None else "\n".join(kept), len((t or "").split("\n")), len((t or "").split("\n")) - len(kept))
    got = rows_of(dedup_lines(spark.createDataFrame([(*r, "kept", 1) for r in made], "doc_id long, text string, line string, doc int")))
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got} == want and got[0]["line"] == "kept"
    assert rows_of(dedup_lines(empty)) == []


def test_short_lines_of_pipeline(spark):
    """Equal lines under the floor go too, the earliest stays; blank ones stay, and so do short ones that are only near."""
    texts = [None, "les.\n\nand ornd.\nabc\nLES. \nelevenchars", "abd\n \n\n les.\nelevenchars!\nÉ", "é\nsomething else here", "elevenchars!\nsomething else hare\n\u00a0\n\u00a0", "les."]
    seen, want = [], {}
    for i, t in enumerate(texts):
        kept = []
        for x in (t or "").split("\n"):
            k = x.strip(" \t\r\f\v").lower()
            if not k or not any(k == s or (min(len(k), len(s)) >= 12 and within_one(k, s)) for s in seen):
                kept.append(x)
            seen.append(k)
        want[i] = None if t is None else "\n".join(kept)
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = rows_of(corpus_pipeline.lines(spark, table, ""))
    assert {r["doc_id"]: r["text"] for r in got} == {i: t for i, t in want.items() if i != 5} and want[5] == ""
    assert want[1] == "les.\n\nand ornd.\nabc\nelevenchars" and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)


def test_mixing(spark, docs, empty):
    made = [(i, " ".join(["w"] * (1 + i % 7)), ["en", "de"][i % 5 == 0], ["big", "mid", "small"][min(2, i % 10 // 4)], 0) for i in range(600)]
    goal = {"lang": {"en": 0.5, "de": 0.5}, "source": {"big": 0.2, "mid": 0.4, "small": 0.4}}
    got = rows_of(mix(spark.createDataFrame(made, SCHEMA), targets=goal, fraction=0.1))
    total = sum(r["mix_tokens"] for r in got)
    for d in goal:
        for k, share in goal[d].items():
            assert sum(r["mix_tokens"] * r["mix_probability"] for r in got if r[d] == k) == pytest.approx(0.1 * total * share, rel=0.02)
    assert sum(r["mix_kept"] for r in got) == pytest.approx(sum(r["mix_probability"] for r in got), abs=25)
    assert all(r["mix_probability"] == 1 for r in rows_of(mix(docs)) if not (r["text"] or "").strip()) and rows_of(mix(empty)) == []


def test_top_k(spark):
    from pyspark.sql import functions as F

    g = np.random.default_rng(4)
    v = g.normal(size=(300, 6)).round(2)
    v[60:90] = v[50]
    made = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (350, [1.0] * 5), (400, [None] + [1.0] * 5), (450, [float("nan")] + [1.0] * 5), (None, [1.0] * 6), (500, [float("inf")] + [0.0] * 5)]
    got = rows_of(top_k(spark.createDataFrame(made, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0))
    q = np.floor(256 * v).astype(np.int64)
    want = set()
    for i in range(0, 300, 50):
        s = q @ q[i]
        best = sorted((k for k in range(300) if k != i), key=lambda k: (-s[k], k))[:5]
        want |= {(i, n + 1, k, int(s[k])) for n, k in enumerate(best)}
    assert {tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in got} == want
    assert rows_of(top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True))) == []


def test_top_k_in_small_blocks_with_huge_components(spark, monkeypatch):
    """Blocks that can't reach a floor are not visited; scores beyond 64 bits are the greatest or the least."""
    from pyspark.sql import functions as F

    from gleaner.llm import op06_topk as topk

    monkeypatch.setattr(topk, "EXTENTS", 3)
    monkeypatch.setattr(topk, "SEED_ROWS", 40)
    monkeypatch.setattr(topk, "HEAD", 3)
    g = np.random.default_rng(9)
    v = (g.normal(size=(400, 6)) * np.geomspace(1, 100, 400)[g.permutation(400)][:, None]).round(2)
    for scale in (1.0, 1e12):
        w = v * scale
        table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(w)], "vec_id long, embedding array<double>").repartition(3)
        got = {tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in rows_of(top_k(table, F.col("id") % 50 == 0, block=16))}
        q = [[int(np.floor(256 * x)) for x in row] for row in w]
        want = set()
        for i in range(0, 400, 50):
            s = [min(max(sum(a * b for a, b in zip(q[k], q[i], strict=True)), -(2**63)), 2**63 - 1) for k in range(400)]
            want |= {(i, n + 1, k, s[k]) for n, k in enumerate(sorted((k for k in range(400) if k != i), key=lambda k: (-s[k], k))[:5])}
        assert got == want
    # Of blocks in descending order of length, the last can't reach a floor set by the first.
    long_, short = np.full((1, 8), 10.0), np.array([[1.0, 0.0, *[0.5] * 3, *[1.0] * 3]])
    assert topk.reaches(np.eye(6)[:1] * 3, np.array([20.0]), np.vstack([long_, short]), np.eye(6)).tolist() == [[True, False]]


def test_quality(spark, docs, empty):
    good, bad = [(i, prose(60)) for i in range(150)], [(i + 150, " | ".join(["junk!!"] * 40)) for i in range(50)]
    table = spark.createDataFrame([*good, *bad, (900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = rows_of(score_documents(table, labels))
    held = [r for r in got if r["held_out"]]
    assert len(got) == 203 and {r["doc_id"] for r in held} == {i for i in [*range(200), 900, 901] if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all((r["predicted"] == 1) == (r["doc_id"] < 150) for r in held if r["doc_id"] < 200) and all(0 <= r["score"] <= 1 for r in got)
    assert rows_of(score_documents(empty, labels)) == [] and {r["score"] for r in rows_of(score_documents(table, labels.filter("false")))} == {1.0}


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "mixing", "packing"]
    scratch = Scratch(spark, "stages")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.write(stage(spark, docs, sf), name)
        assert out.columns == docs.columns and out.count() <= docs.count() and (seen is None or out.count() <= seen)
        docs, seen = out, out.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_names():
    assert sorted(re.match(r"op\d+", n)[0] for n in queries.queries()) == sorted(f"op{n}" for n in range(1, 14)) and set(queries.oracle_sql()) <= set(queries.queries())


def test_mixing_meets_marginals(spark):
    """At the defaults every marginal is within 1 %, on given documents."""
    from gleaner.llm.op05_mixing import marginals

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = rows_of(marginals(docs))
    assert {r["dimension"] for r in got} == {"source", "lang", "topic"} and all(r["met"] for r in got), [r for r in got if not r["met"]]
    assert sum(r["expected"] for r in got if r["dimension"] == "lang") == pytest.approx(0.6 * sum(r["has"] for r in got if r["dimension"] == "lang"), rel=0.01)
    # A single language can't have more than MOST of what it has, and a given column can stand for the topic.
    asked = rows_of(marginals(docs, targets={"lang": {"es": 1.0, "en": 0.0, "xx": 1.0}}, topic_col="lang", rounds=3))
    assert {r["category"] for r in asked if r["dimension"] == "topic"} == {"en", "de", "fr", "es"} and all(r["goal"] <= 0.751 * r["has"] for r in asked)


def test_topics(spark, empty):
    """Topics equal a plain count over lists, language by language; they say little about the language."""
    from gleaner.llm import op05_mixing as m
    from gleaner.llm.common import Scratch

    texts = [" ".join(rng.choice([f"{x}é{y}" for x in "abcdefgh" for y in "uvwxyz"] + ["THE", "the", f"rare{'pqr'[i % 3]}"]) for _ in range(rng.randrange(0, 16))) + "." for i in range(240)]
    made = [(i, t, [None, "en", "de", "xx"][i % 4 if i < 232 else 3], "s", 0) for i, t in enumerate(texts)] + [(900, None, "en", "s", 0), (901, "", "yy", "s", 0), (901, "alone", "yy", "s", 0), (None, texts[1], "en", "s", 0)]
    split = lambda t: [w for w in re.split(m.BETWEEN_WORDS.replace("\\x{80}-\\x{10FFFF}", "\x80-\U0010ffff"), (t or "").lower()) if w]
    want = Counter()
    for lang in {x or "" for _, _, x, _, _ in made}:
        rows = [(i, t, split(t)) for i, t, x, _, _ in made if (x or "") == lang]
        held = Counter(w for _, _, ws in rows for w in set(ws))
        words = sorted((w for w in held if held[w] * m.COMMON <= len(rows)), key=lambda w: (-held[w], w))[: m.VOCABULARY]
        theme = {w: k for k, w in enumerate(words[: m.THEMES])}
        for w in words[m.THEMES :]:
            part = [sum(w in ws and f in ws for _, _, ws in rows) / held[f] for f in words[: m.THEMES]]
            if max(part):
                theme[w] = part.index(max(part))
        for i, t, ws in rows:
            score = [sum(len(rows) // held[w] for w in set(ws) if theme.get(w) == k) for k in range(m.THEMES)]
            want[i, lang, "empty" if not t else f"theme {score.index(max(score)) + 1}" if max(score) else "other"] += 1
    from pyspark.sql import functions as F

    table = spark.createDataFrame(made, SCHEMA)
    full, narrow = m.marked(table, Scratch(spark, "topics"), F.col("text"), F.col("source"), F.col("lang"), None)
    assert Counter((r["doc_id"], r["__lang"], r["__topic"]) for r in full.collect()) == want and len({t for _, _, t in want}) >= 6
    assert Counter((r["__lang"], r["__topic"]) for r in narrow.collect()) == Counter((lang, t) for (_, lang, t), n in want.items() for _ in range(n))
    assert rows_of(m.topic_relation(empty)) == []
    told = rows_of(m.topic_relation(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))[0]
    assert told["mutual_bits"] < 0.25 * told["lang_bits"]


def test_very_long_lines(spark):
    long_ = "".join(rng.choice("abcdefghij ") for _ in range(200_000))
    made = [(1, long_), (2, long_[:70_000] + "X" + long_[70_000:]), (3, long_[:150_000] + long_[150_001:]), (4, long_[:100] + "YZ" + long_[100:]), (5, None), (None, "null id goes first\nand stays"), (6, "null id goes first\nand stayz")]
    got = {r["doc_id"]: r["n_removed"] for r in rows_of(dedup_lines(spark.createDataFrame(made, "doc_id long, text string")))}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, None: 0, 6: 1}


def test_near_recall(spark):
    """Pairs just above the threshold, 0.85 to 0.87, in a crowd that shares a passage, with nodes so small that they branch."""
    crowd, made, want = prose(60), [], set()
    for i in range(150):
        own = crowd.split(" ") + prose(140).split(" ")
        other = [*own]
        for at in rng.sample(range(70, 190), 5):
            other[at] = "changed"
        a, b = ({tuple(x[j : j + 3]) for j in range(len(x) - 2)} for x in (own, other))
        made += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
        if 100 * len(a & b) >= 85 * len(a | b):
            want.add(2 * i + 1)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(near, "NODE", 16)
        got = rows_of(near_duplicates(spark.createDataFrame(made, "doc_id long, text string")))
    found = {r["doc_id"] for r in got if not r["kept"]}
    assert found == want and len(want) > 30


def test_sample_of_labels_is_bounded(spark):
    table = spark.createDataFrame([(i, prose(5) if i % 2 else "| | x | !!") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    sizes = []
    from gleaner.llm import op07_quality as quality

    with pytest.MonkeyPatch.context() as patch:
        network = quality.Network
        patch.setattr(quality, "Network", lambda x, y: (sizes.append(len(y)), network(x, y))[1])
        got = rows_of(score_documents(table, labels, train_rows=400))
    assert 300 < sizes[0] < 500 and len(got) == 2000 and sum((r["predicted"] == 1) == (r["doc_id"] % 2 == 1) for r in got) > 1900


def test_structured_texts(spark):
    """Thue-Morse words of a and b and their mirror images: a polynomial modulo 2**64 gives both one hash, whatever its base."""
    word, mirror = ("".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(2048)) for flip in (0, 1))
    # Words of two kinds in the same order, so that shingles and windows are structured too.
    texts = [" ".join([word] * 60), " ".join([mirror] * 60), word + mirror, mirror + word, " ".join(("ab", "ba")[x == "b"] for x in word), " ".join(("ab", "ba")[x == "b"] for x in mirror)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} for w in (t.split(" ") for t in texts)]
    got = {r["doc_id"]: r for r in rows_of(near_duplicates(table))}
    assert [got[i]["n_shingles"] for i in range(6)] == [len(s) for s in sets] and [got[i]["component_id"] for i in range(6)] == [0, 1, 2, 3, 4, 4 if sets[4] == sets[5] else 5]
    words = [t.split(" ") for t in texts]
    starts, want = {}, []
    for i, w in enumerate(words):
        for j in range(len(w) - 49):
            starts.setdefault(tuple(w[j : j + 50]), i)
    for i, w in enumerate(words):
        gone = {j + k for j in range(len(w) - 49) if starts[tuple(w[j : j + 50])] < i for k in range(50)}
        want.append((len(w), len(gone)))
    got = {r["doc_id"]: r for r in rows_of(substring_dedup(table))}
    assert [(got[i]["n_words"], got[i]["n_removed"]) for i in range(6)] == want and want[0][1] == want[1][1] == 0
    seen = Counter(t[j : j + 400] for t in texts for j in range(len(t) - 399))
    want = [len({j + k for j in range(len(t) - 399) if seen[t[j : j + 400]] > 1 for k in range(400)}) for t in texts]
    got = {r["doc_id"]: r for r in rows_of(suffix_dedup(table))}
    assert [got[i]["n_removed"] for i in range(6)] == want
