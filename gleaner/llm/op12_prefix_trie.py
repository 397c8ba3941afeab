"""The prefix trie of conversations, with sums over its subtrees by heavy paths.

A conversation is rebuilt from the head of another and its own tail, and each distinct prefix of rebuilt turns is a node. A prefix is told
by a polynomial hash modulo the prime 2**127 - 1 with a random base, over turns hashed by SHA-256; hashes of a head and a tail combine, so a
conversation of any length is numbered and hashed in ranges of turns, and only one row a range goes through the driver to carry on what a
range border cuts.

Each node's heavy child is the one with most members (then the smallest conversation). A heavy path ends in a leaf, and the leaf's smallest
member passes through all of the path, so the path is the lower end of that conversation's turns, from its last light node on; no pointers are chased. A
light child has at most half of its parent's members, so there are at most log2(members) + 1 light nodes above any. Paths hang their totals onto their parent paths level by level
from the deepest, a round for each level; then each path's array is suffix-summed once, by ranges of nodes like the turns.

Nulls and odd input: rows with a null conv_id are of no conversation and are left out; null turns come first; turns that tie are ordered by role, then text; repeated
rows are turns of their own; null role or text is empty; ``c % 5`` has the sign of c, as in SQL. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, without_clashes

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:15], "big") | 1
#: Most turns that a conversation takes from another, and conversations that share a head.
HEAD, FAMILY = 8, 5
#: Characters of conversation numbers that are joined before they are sent on.
JOINED = 1 << 16
ROOT = bytes(16)

TURN = "conv_id long, part int, i long, bytes long, hash binary, before binary, edge boolean"


@lru_cache(1 << 16)
def power(n: int) -> int:
    return pow(BASE, n, PRIME)


def packed(values: list[int]) -> pa.Array:
    return pa.array([v.to_bytes(16, "big") for v in values], pa.binary())


def whole(column: pa.Array) -> list[int]:
    return [int.from_bytes(x, "big") for x in column.to_pylist()]


def ranged(df: DataFrame, *order: F.Column) -> DataFrame:
    """Rows in ranges of ``order``, in order, numbered by part."""
    parts = max(df.sparkSession._jsc.sc().defaultParallelism(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def carried(edges: list, key: str, add: Callable, zero: object) -> dict[int, tuple]:
    """What the first key of each part has before that part: part -> (key, sum). ``edges``: of each part, in order, the last key's sum there, and whether it is the first too."""
    out, held, total = {}, None, zero
    for x in edges:
        if held is not None:
            out[x["part"]] = (held, total)
        total = add(total, x) if x["alone"] and held == x[key] else add(zero, x)
        held = x[key]
    return out


def hashed_turns(own: DataFrame) -> DataFrame:
    """Turns of (conv_id, turn, role, text) in order within a part: number, bytes of text, and the prefix hash with and before them, all counted from the part's start. The last row of a part is its edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, i, total, held = None, 0, 0, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 2)]
            rows = []
            for conv, role, text in zip(*columns, strict=True):
                if conv != now:
                    now, i, total = conv, 0, 0
                role, text = role.encode(), text.encode()
                i, before = i + 1, total
                total = (total * BASE + int.from_bytes(hashlib.sha256(b"%d:%s%s" % (len(role), role, text)).digest()[:15], "big") + 1) % PRIME
                rows.append((i, len(text), total, before))
            if rows:
                if held is not None:
                    yield with_edge(held, False)
                n, size, totals, befores = zip(*rows, strict=True)
                held = [batch.column(0), batch.column(3), pa.array(n, pa.int64()), pa.array(size, pa.int64()), packed(totals), packed(befores)]
        if held is not None:
            yield with_edge(held, True)

    def with_edge(columns: list, last: bool) -> pa.RecordBatch:
        edge = np.zeros(len(columns[0]), bool)
        edge[-1] = last
        return pa.RecordBatch.from_arrays([*columns, pa.array(edge)], names=["conv_id", "part", "i", "bytes", "hash", "before", "edge"])

    # The last key deals equal rows, however many, to several ranges.
    own = own.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("tie").asc()]
    return ranged(own, *order).select("conv_id", "role", "text", "part").mapInArrow(run, TURN)


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, i, bytes, hash, before) with numbers and hashes counted from each conversation's first turn."""
    firsts = turns.groupBy("part").agg(F.min("conv_id").alias("low"))
    edges = turns.filter("edge").join(firsts, "part").select("part", "conv_id", "i", "hash", (F.col("low") == F.col("conv_id")).alias("alone")).orderBy("part").collect()
    carry = carried(edges, "conv_id", lambda t, x: (t[0] + x["i"], (t[1] * power(x["i"]) + int.from_bytes(x["hash"], "big")) % PRIME), (0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv, i = batch.column(1).to_numpy(), batch.column(0).to_numpy(), batch.column(2).to_numpy().copy()
            totals, befores = batch.column(4), batch.column(5)
            at = np.flatnonzero([p in carry and carry[p][0] == c for p, c in zip(part.tolist(), conv.tolist(), strict=True)])
            if len(at):
                total, before = whole(totals), whole(befores)
                for k in at.tolist():
                    n, above = carry[int(part[k])][1]
                    total[k] = (above * power(int(i[k])) + total[k]) % PRIME
                    before[k] = (above * power(int(i[k]) - 1) + before[k]) % PRIME
                    i[k] += n
                totals, befores = packed(total), packed(before)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(i), batch.column(3), totals, befores], names=["conv_id", "i", "bytes", "hash", "before"])

    return turns.select("conv_id", "part", "i", "bytes", "hash", "before").mapInArrow(run, "conv_id long, i long, bytes long, hash binary, before binary")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations (conv_id, depth, hash, parent, bytes, last), and (conv_id, depth, hash) of every rebuilt conversation's end."""
    head = turns.filter(F.col("i") <= HEAD).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "hash", "before", "bytes"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.max("i").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    convs = convs.join(head, "conv_id").withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    convs = convs.join(head.select(F.col("conv_id").alias("base"), F.col("head").alias("given")), "base", "left")
    given = F.coalesce(F.col("given"), F.array().cast("array<struct<i:bigint,hash:binary,before:binary,bytes:bigint>>"))
    convs = convs.select("conv_id", "h", F.slice(given, F.lit(1), F.col("h")).alias("given"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("tail"), F.col("n"), F.when(F.col("h") > 0, F.get("head", F.col("h") - 1)["hash"]).alias("cut"))
    at_head = F.coalesce(F.get("given", F.size("given") - 1)["hash"], F.lit(ROOT))
    convs = convs.select("conv_id", "h", "given", F.size("given").alias("m"), (F.size("given") + F.col("tail")).alias("depth"), at_head.alias("at_head"), F.coalesce("cut", F.lit(ROOT)).alias("cut"))
    convs = scratch.write(convs, "convs")
    heads = convs.select("conv_id", "depth", F.explode("given").alias("g")).select("conv_id", F.col("g.i").alias("d"), F.col("g.hash"), F.col("g.before").alias("parent"), "g.bytes", (F.col("g.i") == F.col("depth")).alias("last"))

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A tail's hashes with the head's in place of what was cut: H(head) B**k + H(own) - H(cut) B**k, k turns after the cut."""
        for batch in batches:
            own, parent, above, cut = (whole(batch.column(k)) for k in (2, 3, 5, 6))
            k = batch.column(7).to_pylist()
            total = [(o + (a - c) * power(n)) % PRIME for o, a, c, n in zip(own, above, cut, k, strict=True)]
            before = [(o + (a - c) * power(n - 1)) % PRIME for o, a, c, n in zip(parent, above, cut, k, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(total), packed(before), batch.column(4), batch.column(8)], names=["conv_id", "d", "hash", "parent", "bytes", "last"])

    tails = turns.join(convs.drop("given"), "conv_id").filter("i > h").select("conv_id", (F.col("m") + F.col("i") - F.col("h")).alias("d"), "hash", "before", "bytes", "at_head", "cut", (F.col("i") - F.col("h")).alias("k"), (F.col("m") + F.col("i") - F.col("h") == F.col("depth")).alias("last"))
    rows = scratch.write(heads.union(tails.mapInArrow(shift, "conv_id long, d long, hash binary, parent binary, bytes long, last boolean")).withColumnRenamed("d", "depth"), "rows")
    ends = rows.filter("last").select("conv_id", "depth", "hash").union(convs.filter("depth = 0").select("conv_id", F.lit(0).cast("long"), F.lit(ROOT)))
    return rows, ends


def end_hashes(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(hash, ends_sha256) of nodes at which conversations end. Numbers are joined where they lie in order; a node that a range border cuts goes on in stretches of text through one digest."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("hash", pa.binary()), ("first", pa.int64()), ("numbers", pa.string()), ("whole", pa.bool_())])
        now, first, held, size, fresh, done = None, 0, [], 0, True, []

        def close(complete: bool) -> None:
            # The first node of a part may have begun in the one before.
            done.append((now, first, ",".join(held), complete))

        for batch in batches:
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        close(not fresh)
                        fresh = False
                    now, first, held, size = node, conv, [], 0
                elif size > JOINED:
                    close(False)
                    fresh, first, held, size = True, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        if now is not None:
            close(False)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []
        for batch in batches:
            for node, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256(numbers.encode())
                else:
                    sha.update(b"," + numbers.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["hash", "ends_sha256"])
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pydict({"hash": [now], "ends_sha256": [sha.hexdigest()]})

    joined = ranged(ends.select("hash", "conv_id"), F.col("hash"), F.col("conv_id")).drop("part").mapInArrow(join, "hash binary, first long, numbers string, whole boolean")
    joined = scratch.write(joined, "joined")
    cut = joined.filter("NOT whole").repartition("hash").sortWithinPartitions("hash", "first").select("hash", "numbers")
    return joined.filter("whole").select("hash", F.sha2(F.col("numbers").cast("binary"), 256).alias("ends_sha256")).union(cut.mapInArrow(digest, "hash binary, ends_sha256 string"))


def suffix_sums(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """(hash, n_leaves, saved_tokens): sums of leaves and saved from each node to the end of its path, by ranges of nodes from the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held, above = None, None, np.zeros(2, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield edged(held, False)
            now = batch.column(0).to_numpy()
            first = np.flatnonzero(np.r_[True, now[1:] != now[:-1]])
            sums = np.cumsum(np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()]), axis=1)
            start = np.concatenate([np.zeros((2, 1), np.int64), sums], axis=1)[:, first]
            sums = sums - np.repeat(start, np.diff(np.r_[first, len(now)]), axis=1)
            if path == now[0]:
                sums[:, : first[1] if len(first) > 1 else len(now)] += above[:, None]
            path, above = now[-1], sums[:, -1].copy()
            held = [batch.column(0), batch.column(1), pa.array(sums[0]), pa.array(sums[1]), batch.column(4)]
        if held is not None:
            yield edged(held, True)

    def edged(columns: list, last: bool) -> pa.RecordBatch:
        edge = np.zeros(len(columns[0]), bool)
        edge[-1] = last
        return pa.RecordBatch.from_arrays([*columns, pa.array(edge)], names=["path", "hash", "leaves", "saved", "part", "edge"])

    rows = ranged(placed.select("path", "depth", "hash", "leaves", "saved"), F.col("path"), F.col("depth").desc()).select("path", "hash", "leaves", "saved", "part")
    rows = scratch.write(rows.mapInArrow(run, "path long, hash binary, leaves long, saved long, part int, edge boolean"), "summed")
    firsts = rows.groupBy("part").agg(F.min("path").alias("low"))
    edges = rows.filter("edge").join(firsts, "part").select("part", "path", "leaves", "saved", (F.col("low") == F.col("path")).alias("alone")).orderBy("part").collect()
    carry = carried(edges, "path", lambda t, x: (t[0] + x["leaves"], t[1] + x["saved"]), (0, 0))
    # A row for each part: as many as tasks.
    table = rows.sparkSession.createDataFrame([(p, path, *sums) for p, (path, sums) in carry.items()], "part int, path long, more_leaves long, more_saved long")
    more = lambda c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))
    return rows.join(F.broadcast(table), ["part", "path"], "left").select("hash", more("leaves").alias("n_leaves"), more("saved").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(conversations.sparkSession, "trie")
    own = without_clashes(conversations, "conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    own = own.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = scratch.write(numbered(scratch.write(hashed_turns(own), "hashed")), "turns")
    rows, ends = rebuilt(turns, scratch)
    ended = scratch.write(end_hashes(scratch.write(ends, "ends"), scratch), "digests")
    scratch.drop("hashed", "turns")
    nodes = rows.groupBy("depth", "hash", "parent").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    root = scratch.spark.read.parquet(scratch.path("convs")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    nodes = nodes.union(root.select(F.lit(0).cast("long"), F.lit(ROOT), F.lit(None).cast("binary"), "conv_id", "n_convs", F.lit(0).cast("long")))
    nodes = scratch.write(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")
    below = nodes.filter("depth > 0").groupBy("parent").agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", -F.col("conv_id"), "hash"))["hash"].alias("heavy"))
    nodes = scratch.write(nodes.join(below.withColumnRenamed("parent", "hash"), "hash", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "children")
    above = nodes.select(F.col("hash").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("chosen"))
    nodes = nodes.drop("heavy").join(above, "parent", "left").withColumn("light", F.coalesce(F.col("hash") != F.col("chosen"), F.lit(False)))
    nodes = scratch.write(nodes.drop("chosen"), "lit")
    # Each leaf's smallest member walks its root path; the root itself is added to the path without light nodes below.
    walkers = nodes.filter("n_children = 0").select("conv_id")
    facts = nodes.select("hash", "parent", "light", "own", (F.col("n_children") == 0).cast("long").alias("leaves"))
    walk = scratch.write(rows.join(walkers, "conv_id", "left_semi").select("conv_id", "depth", "hash").join(facts, "hash"), "walk")
    paths = walk.groupBy("conv_id").agg(F.sum(F.col("light").cast("long")).alias("level"), F.coalesce(F.max(F.when(F.col("light"), F.col("depth"))), F.lit(0)).alias("top"))
    paths = scratch.write(paths, "paths")
    placed = walk.join(paths, "conv_id").filter("depth >= top").select(F.col("conv_id").alias("path"), "level", "top", "depth", "hash", "parent", "own", "leaves")
    first = paths.filter("level = 0").agg(F.min("conv_id")).first()[0]
    zero = F.lit(0).cast("long")
    at_root = nodes.filter("depth = 0").select(F.coalesce(F.lit(first).cast("long"), "conv_id").alias("path"), zero.alias("level"), zero.alias("top"), "depth", "hash", "parent", "own", (F.col("n_children") == 0).cast("long").alias("leaves"))
    placed = scratch.write(placed.union(at_root), "placed")
    scratch.drop("walk", "paths", "rows", "convs", "ends", "joined")
    totals = placed.groupBy("path", "level").agg(F.sum("own").alias("own"), F.sum("leaves").alias("leaves"), F.min(F.when(F.col("depth") == F.col("top"), F.col("parent"))).alias("hash"))
    homes = placed.select("hash", F.col("path").alias("home"))
    totals = scratch.write(totals.join(homes, "hash", "left"), "totals")
    hung = _rounds(totals, scratch)
    attached = hung.filter("level > 0").groupBy("hash").agg(F.sum("own").alias("more"), F.sum("leaves").alias("more_leaves"))
    placed = placed.join(attached, "hash", "left").select("path", "depth", "hash", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("own") + F.coalesce("more", F.lit(0))).alias("saved"))
    sums = suffix_sums(scratch.write(placed, "attached"), scratch)
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.join(sums, "hash").join(ended, "hash", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def _rounds(totals: DataFrame, scratch: Scratch) -> DataFrame:
    """Totals of paths with those of all paths below them: from the deepest level, each level's are added to their parent paths'."""
    deepest = totals.agg(F.max("level")).first()[0] or 0
    done, below = [], None
    for level in range(deepest, -1, -1):
        here = totals.filter(F.col("level") == level)
        if below is not None:
            more = below.groupBy("home").agg(F.sum("own").alias("more"), F.sum("leaves").alias("more_leaves")).withColumnRenamed("home", "path")
            here = here.join(more, "path", "left").select("hash", "path", "level", (F.col("own") + F.coalesce("more", F.lit(0))).alias("own"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), "home")
        below = scratch.write(here.select("hash", "path", "level", "own", "leaves", "home"), f"level-{level}")
        done.append(below)
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


#: CRC-32 of a number's digits, bit by bit: in the list, a byte is taken in and each -1 shifts once.
CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, role, text FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own)),
parts AS (SELECT c.conv_id, i, role, text FROM c JOIN own ON own.conv_id = c.base AND own.i <= c.h UNION ALL SELECT c.conv_id, i + 1000000000, role, text FROM c JOIN own ON own.conv_id = c.conv_id AND own.i > c.h),
r AS (SELECT conv_id, row_number() OVER w AS depth, list(sha256(strlen(role) || ':' || role || text)) OVER w AS node, strlen(text) AS bytes FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
k AS (SELECT conv_id, depth, sha256(node::VARCHAR) AS node, bytes FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM c),
p AS (SELECT k.*, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM k),
n AS (SELECT node, min(depth) AS depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
leaves AS (SELECT k.node, count(*) AS n_leaves FROM n ANTI JOIN kids USING (node) JOIN k ON k.conv_id = n.conv_id AND k.depth <= n.depth GROUP BY k.node),
saved AS (SELECT k.node, sum(n.own)::BIGINT AS saved_tokens FROM n JOIN k ON k.conv_id = n.conv_id AND k.depth <= n.depth GROUP BY k.node)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n LEFT JOIN n AS up ON up.node = n.parent LEFT JOIN kids ON kids.node = n.node JOIN leaves ON leaves.node = n.node JOIN saved ON saved.node = n.node
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
