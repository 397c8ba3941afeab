"""The prefix trie against plain loops over whole prefixes."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm import op12_prefix_trie as trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        turns = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    out = Counter()
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        childless = [x for x in below if not any(y[:-1] == x for y in members if len(y) == len(x) + 1)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        parent = min(members[node[:-1]]) if node else None
        out[min(m), len(node), parent, len(m), sum(len(y) == len(node) + 1 for y in below), len(childless), saved, hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()] += 1
    return out


def made(seed):
    rng = random.Random(seed)
    say = lambda: rng.choice(["hello", "yes", "", "é世", None])
    rows = []
    for c in range(40):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), say()))
    same = [(None, "user", "once upon")] + [(t, "bot", f"turn {t % 2}") for t in range(12)]
    rows += [(c, *x) for c in range(100, 130) for x in same]
    # One long conversation, one of equal rows, ids out of the ordinary, and rows without an id.
    rows += [(200, t, "user", f"word {t % 7}") for t in range(300)] + [(204, 1, "a", "b")] * 90 + [(10**12 + 1, 0, "a", "b"), (301, None, None, None), (None, 3, "x", "y")]
    rng.shuffle(rows)
    return rows


def got(table):
    return Counter(tuple(r[c] for c in COLUMNS) for r in table.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "JOINED", 20)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    rows = made(seed)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5).select("*", *[F.lit("x").alias(c) for c in ("depth", "hash", "part", "i", "edge", "path")])
    try:
        assert got(trie.prefix_trie(table)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_small_tries(spark):
    for rows in ([], [(None, 1, "a", "b")], [(1, 0, "a", "b")], [(2, 0, "a", "x"), (2, 1, "b", "y")]):
        assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_ends_of_hot_nodes_stay_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "JOINED", 50)
    rows = [(5 * c, 0, "user", "same") for c in range(700)] + [(7, 0, "user", "other")]
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(6))) == brute(rows)
