"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of distinct word shingles. Documents with the same set are one class with a number of its own, since different texts may share a doc_id. Each
class has SKETCH minwise tokens, SKETCH / TREES for each of TREES independent trees. A tree starts with one node of all classes; a node sends each of its classes to BRANCH
children, a child for each of the BRANCH tokens that the node chooses and each value found there. Two sets share a token with the probability of their
similarity s, so they meet in a tree with probability f = 1 - (1 - s f)**2 or more at any depth; the trees miss a pair at s = 0.85 once in a million, at s = 0.8 once in 60,000.

Nodes of up to NODE classes (and NODE_BYTES of sets) are small: their pairs are compared exhaustively within a task. A larger node is first cut into blocks of
that size, each with the node's pivots, and every block is compared like a small node; this links what is near to the pivots. Links inside a component change nothing
any more, so a large node is done once its classes are in one component, as those of near copies of one text are. If few of its classes are outside
its largest component - LEAF / 2 blocks at most - they are compared with all, that many blocks at a time, so that rows are sent on in proportion to the node. So are the
cheapest of the other nodes, as long as a level's pairs are no more than 2 * NODE for each class of the input: a level less saves a pass over all texts. The rest branch. After MAX_DEPTH branchings pairs of blocks are compared
at any size, a bounded group at a time. The first tree goes first: nodes of the others whose classes it has brought together are done before anything is sent to them.

A comparison has two steps. Within a node, set sizes and agreeing tokens find candidates (a pair at the threshold falls below the cut once in 300,000); what candidates
connect is a group, and a group that several nodes have found is kept once. Then the full sets of 64-bit shingle hashes of each group come to one task, which confirms links and
passes over pairs that confirmed links have connected already.

Nulls and odd input: null, empty and blank texts have no shingles and are linked with nothing; rows are judged by their own
texts, also where they share a doc_id; a null doc_id is left out of the join (component_id null, kept true); very long texts are whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, binary_rows, documents, pieces, text_bytes, whole_groups, without_clashes
from gleaner.llm.components import components
from gleaner.llm.kernels import distinct_in_rows, mix, prefix_sums, window_hash, words

WORDS, OVER, UNDER = 3, 85, 100
SKETCH, TREES, BRANCH, NODE, LEAF, PIVOTS, MAX_DEPTH = 128, 4, 2, 512, 16, 4, 12
#: Bytes of sets that a node or block may hold on average.
NODE_BYTES = 8 << 20
#: Standard deviations below the threshold at which agreeing tokens rule a pair out.
DEVIATIONS = 4.5
MULTIPLIERS = np.random.default_rng(1).integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: What tells a class: two hashes of its set, and the set's size.
SET = ["set_1", "set_2", "n_shingles"]
#: Rows of nodes, and of groups, that a task looks at together.
NODE_ROWS, GROUP_ROWS = 4096, 256
#: Pairs whose tokens are compared at once.
PAIRS = 16384
#: Bytes of text whose shingles are made at once: what they need then stays near the processor.
TEXT = 1 << 18


def shingles(batch: pa.RecordBatch, column: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, in order, and where each row's begin (one entry more than rows)."""
    data, offsets = text_bytes(batch.column(column))
    hashes, _, _, first = words(data, offsets, lower=True)
    n = np.diff(first)
    many = np.where(n > 0, np.maximum(n - size, 0) + 1, 0)
    begin = np.concatenate([[0], np.cumsum(many)])
    start = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], many)
    return distinct_in_rows(window_hash(prefix_sums(hashes), start, np.minimum(start + size, np.repeat(first[1:], many))), begin)


def set_columns(values: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """The columns SET of each row of ``shingles``: two hashes of its set, and the set's size."""
    n = np.diff(first)
    full = np.flatnonzero(n)
    hashes = np.zeros((2, len(n)), np.uint64)
    if len(full):
        hashes[0, full] = np.add.reduceat(mix(values), first[full])
        hashes[1, full] = np.add.reduceat(mix(values ^ MULTIPLIERS[0]), first[full])
    return [pa.array(hashes[0].view(np.int64)), pa.array(hashes[1].view(np.int64)), pa.array(n.astype(np.int64))]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """Set size, two hashes of the set, the tokens that the trees choose first (keys, 64 bits each) and all tokens (16 bits each) for each row of (doc_id, text)."""
    first_tokens = [t * (SKETCH // TREES) + j for t in range(TREES) for j in range(BRANCH)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1, TEXT):
                values, first = shingles(piece, 1, size)
                n = np.diff(first)
                full = np.flatnonzero(n)
                least = np.zeros((len(n), SKETCH), np.uint64)
                if len(full):
                    for k in range(SKETCH):
                        least[full, k] = np.minimum.reduceat(values * MULTIPLIERS[k], first[full])
                least = mix(least)
                keys = pa.FixedSizeListArray.from_arrays(pa.array(least[:, first_tokens].ravel().view(np.int64)), len(first_tokens)).cast(pa.list_(pa.int64()))
                tokens = binary_rows((least >> np.uint64(48)).astype(np.uint16).ravel(), np.arange(len(n) + 1) * SKETCH)
                yield pa.RecordBatch.from_arrays([piece.column(0), *set_columns(values, first), keys, tokens], names=["doc_id", *SET, "keys", "tokens"])

    return docs.mapInArrow(sketch, "doc_id long, set_1 long, set_2 long, n_shingles long, keys array<long>, tokens binary")


def tree_of(node: F.Column) -> F.Column:
    """The low bits of a node's number tell its tree."""
    return node.bitwiseAND(F.lit(TREES - 1))


def children(rows: DataFrame, depth: int) -> DataFrame:
    """(node, id, n_shingles) for each child that each row (node, id, n_shingles, keys, tokens) goes to."""
    own = SKETCH // TREES
    if depth == 0:
        made = [F.xxhash64(F.lit(i), F.col("keys")[i]).bitwiseAND(F.lit(-TREES)).bitwiseOR(F.lit(i // BRANCH)) for i in range(TREES * BRANCH)]
    else:
        at = lambda j: (tree_of(F.col("node")) * own + F.pmod(F.xxhash64("node", F.lit(j)), F.lit(own))).cast("int")
        made = [F.xxhash64("node", F.lit(j), F.substring("tokens", at(j) * 2 + 1, F.lit(2))).bitwiseAND(F.lit(-TREES)).bitwiseOR(tree_of(F.col("node"))) for j in range(BRANCH)]
    return rows.select(F.explode(F.array_distinct(F.array(*made))).alias("node"), "id", "n_shingles")


def labels(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``count`` things the least one that links (a, b) connect it with."""
    label = np.arange(count)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


class Join:
    """State of one run: classes, sets made so far, and the components of all links found so far."""

    def __init__(self, docs: DataFrame, classes: DataFrame, scratch: Scratch, size: int, over: int, under: int):
        self.docs, self.classes, self.scratch, self.size, self.over, self.under = docs, classes, scratch, size, over, under
        s = over / under
        self.cut = s - DEVIATIONS * (s * (1 - s) / SKETCH) ** 0.5
        self.sets: DataFrame | None = None
        self.parts: DataFrame | None = None
        self.n = 0
        self.budget = 2 * NODE * classes.count()

    def with_part(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component of each id, as part."""
        if self.parts is None:
            return rows.withColumn("part", F.col("id"))
        return rows.join(self.parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")

    def groups(self, rows: DataFrame) -> DataFrame:
        """(group, id) of what candidates connect within the blocks of ``rows`` (node, block, id)."""
        least, over, under = int(np.ceil(self.cut * SKETCH)), self.over, self.under

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in whole_groups(batches, 2, NODE_ROWS):
                node, block, ids, part, n = (batch.column(i).to_numpy() for i in range(5))
                tokens = text_bytes(batch.column(5))[0].view(np.uint16).reshape(-1, SKETCH)
                own = np.cumsum(np.r_[False, (node[1:] != node[:-1]) | (block[1:] != block[:-1])])
                left, right, at, step = [], [], np.arange(len(ids)), 0
                while len(at):  # rows of a block stand by set size, so a row that is too large for another is too large for all before it
                    step += 1
                    at = at[at + step < len(ids)]
                    at = at[(own[at] == own[at + step]) & (n[at] * under >= n[at + step] * over)]
                    ask = at[part[at] != part[at + step]]
                    for i in range(0, len(ask), PAIRS):
                        x = ask[i : i + PAIRS]
                        x = x[np.count_nonzero(tokens[x] == tokens[x + step], axis=1) >= least]
                        left.append(x)
                        right.append(x + step)
                a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
                label = labels(len(ids), a, b)
                some = np.unique(np.concatenate([a, b]))
                name = np.zeros(len(ids), np.uint64)
                np.add.at(name, label[some], mix(ids[some].astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(name[label[some]].view(np.int64)), pa.array(ids[some])], names=["group", "id"])

        known = self.with_part(rows.join(self.classes.select("id", "n_shingles", "tokens"), "id"))
        dealt = known.select("node", "block", "id", "part", "n_shingles", "tokens").repartition("node", "block").sortWithinPartitions("node", "block", "n_shingles", "id")
        return dealt.mapInArrow(compare, "group long, id long").distinct()

    def full_sets(self, groups: DataFrame, name: str) -> DataFrame:
        """The full shingle sets (id, set) of all members of ``groups``, each made once from the texts under its class's smallest doc_id."""
        ids = groups.select("id").distinct()
        if self.sets is not None:
            ids = ids.join(self.sets.select("id"), "id", "left_anti")
        ends = self.scratch.write(self.classes.select("id", "doc_id", *SET).join(ids, "id", "left_semi"), f"{name}-ends")
        size = self.size

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch, 1, TEXT):
                    values, first = shingles(piece, 1, size)
                    yield pa.RecordBatch.from_arrays([*set_columns(values, first), binary_rows(values, first)], names=[*SET, "set"])

        made = self.docs.join(ends.select("doc_id"), "doc_id", "left_semi").mapInArrow(make, "set_1 long, set_2 long, n_shingles long, set binary")
        new = self.scratch.write(made.join(ends, SET).groupBy("id").agg(F.first("set").alias("set")), f"{name}-sets")
        self.scratch.drop(f"{name}-ends")
        self.sets = new if self.sets is None else self.sets.union(new)
        return self.sets

    def links(self, groups: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b): components that confirmed links within ``groups`` connect, as a star around the least of each group's."""
        over, under = self.over, self.under

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in whole_groups(batches, 1, GROUP_ROWS):
                group, part, n = (batch.column(i).to_numpy() for i in range(3))
                data, where = text_bytes(batch.column(3))
                values, where = data.view(np.uint64), where // 8
                edges = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
                a, b = [], []
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    label = part[s:e].copy()
                    for i in range(e - s - 1):
                        end = int(np.searchsorted(n[s:e], n[s + i] * under // over, side="right"))
                        others = np.flatnonzero(label[i + 1 : end] != label[i]) + i + 1
                        if not len(others):
                            continue
                        own = values[where[s + i] : where[s + i + 1]]
                        theirs = np.concatenate([values[where[s + j] : where[s + j + 1]] for j in others])
                        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                        sizes = n[s + others]
                        shared = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
                        near = others[under * shared >= over * (n[s + i] + sizes - shared)]
                        if len(near):
                            label[np.isin(label, label[near])] = label[i]
                            if (label == label[0]).all():
                                break
                    pairs = np.unique(np.stack([label, part[s:e]]), axis=1)
                    root = np.minimum.reduceat(pairs[1], first := np.flatnonzero(np.r_[True, pairs[0, 1:] != pairs[0, :-1]]))
                    root = np.repeat(root, np.diff(np.r_[first, pairs.shape[1]]))
                    keep = root != pairs[1]
                    a.append(root[keep])
                    b.append(pairs[1, keep])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

        rows = self.with_part(groups).join(sets, "id").withColumn("n_shingles", F.expr("octet_length(set) div 8"))
        dealt = rows.select("group", "part", "n_shingles", "set").repartition("group").sortWithinPartitions("group", "n_shingles", "part")
        return dealt.mapInArrow(compare, "a long, b long").distinct()

    def compare(self, rows: DataFrame) -> None:
        """Finds and confirms the links within the blocks of ``rows`` (node, block, id), and joins the components that they connect."""
        self.n += 1
        name = f"compare-{self.n}"
        # Written first, so that Spark knows how small they are and need not shuffle all classes to meet a few.
        groups = self.scratch.write(self.groups(self.scratch.write(rows, f"{name}-rows")), f"{name}-groups")
        links = self.scratch.write(self.links(groups, self.full_sets(groups, name)), f"{name}-links")
        if not links.isEmpty():
            joined = components(links, self.scratch, f"{name}-stars")
            if self.parts is not None:
                moved = joined.select(F.col("id").alias("component"), F.col("component").alias("to"))
                old = self.parts.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
                joined = old.union(joined.join(self.parts.select("id"), "id", "left_anti"))
            self.parts = self.scratch.write(joined, f"{name}-parts")
        self.scratch.drop(f"{name}-rows", f"{name}-groups", f"{name}-links")

    def affordable(self, opened: DataFrame) -> int:
        """The power of two below which all nodes of ``opened`` together take no more pairs than the budget. The driver sees one row for each power."""
        left = self.budget
        for row in opened.groupBy("cost").agg(F.sum(F.col("size") * F.col("others")).alias("pairs")).orderBy("cost").collect():
            left -= row["pairs"]
            if left < 0:
                return row["cost"]
        return 64

    def level(self, members: DataFrame, last: bool) -> DataFrame | None:
        """Compares the nodes of ``members`` (node, id, n_shingles). Returns (node) of those that must branch."""
        name = f"nodes-{self.n}"
        pivots = F.array_distinct(F.array(F.min("id"), *[F.min_by("id", F.xxhash64(F.lit(i), "id")) for i in range(PIVOTS - 1)]))
        blocks = F.greatest(F.ceil(F.count("*") / NODE), F.ceil(F.sum("n_shingles") * 8 / NODE_BYTES)).cast("int")
        nodes = self.with_part(members).groupBy("node").agg(F.count("*").alias("size"), blocks.alias("blocks"), pivots.alias("pivots"), F.min("part").alias("low"), F.max("part").alias("high"))
        nodes = self.scratch.write(nodes.filter("low <> high").drop("low", "high"), name)
        block = lambda count, salt=0: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(count)).cast("int")
        dealt = members.join(nodes.select("node", "blocks"), "node").select("node", block("blocks").alias("block"), "id")
        large = nodes.filter("blocks > 1").select("node", "blocks", "pivots")
        pivots = large.select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "pivots").select("node", "block", F.explode("pivots").alias("id"))
        self.compare(dealt.union(pivots))
        if large.isEmpty():
            return None
        held = self.with_part(members.join(large.select("node", "blocks"), "node").select("node", "id", "blocks"))
        main = held.groupBy("node", "blocks", "part").agg(F.count("*").alias("n")).groupBy("node", "blocks").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("size"), F.count("*").alias("parts"))
        opened = main.filter("parts > 1").select("node", "blocks", F.col("main.part").alias("main"), "size", (F.col("size") - F.col("main.n")).alias("others"))
        opened = self.scratch.write(opened.withColumn("cost", F.floor(F.log2(F.col("size") * F.col("others")))), f"{name}-open")
        opened = opened.withColumn("ends", F.lit(last) | (F.col("others") * 2 <= LEAF * NODE) | (F.col("cost") < self.affordable(opened)))
        across = F.col("blocks") * 2 / LEAF
        ends = opened.filter("ends").select("node", "main", F.ceil(across).alias("across"), F.ceil(across * F.col("others") / F.col("size")).alias("down"))
        if not ends.isEmpty():
            rows = held.drop("blocks").join(ends, "node")
            every = rows.select("node", "id", block("across").alias("x"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"), "down")
            other = rows.filter("part <> main").select("node", "id", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"), block("down", 1).alias("y"), "down")
            self.compare(every.union(other).select("node", (F.col("x") * F.col("down") + F.col("y")).alias("block"), "id"))
        again = opened.filter("NOT ends").select("node")
        return None if again.isEmpty() else again

    def run(self) -> DataFrame | None:
        """(id, component) of all classes that are linked with others."""
        depth, rows = 0, children(self.classes, 0)
        opened = []
        for trees in (tree_of(F.col("node")) == 0, tree_of(F.col("node")) > 0):
            members = rows.filter(trees)
            opened.append((members, self.level(members, depth >= MAX_DEPTH)))
        while True:
            left = [members.join(nodes, "node").select("node", "id") for members, nodes in opened if nodes is not None]
            if not left:
                return self.parts
            depth += 1
            above = left[0] if len(left) == 1 else left[0].union(left[1])
            above = self.scratch.write(above, f"above-{depth}")
            members = children(above.join(self.classes.select("id", "n_shingles", "keys", "tokens"), "id"), depth)
            members = self.scratch.write(members, f"members-{depth}")
            opened = [(members, self.level(members, depth >= MAX_DEPTH))]


def near_duplicates(docs: DataFrame, words_: int = WORDS, over: int = OVER, under: int = UNDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable over links), kept. Linked: intersection / union >= over / under."""
    scratch = Scratch(docs.sparkSession, "near")
    own = without_clashes(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = scratch.write(sketches(own, words_), "sketches")
    classes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*SET).agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("tokens").alias("tokens"))
    classes = scratch.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    parts = Join(own, classes, scratch, words_, over, under).run()
    named = classes.select(*SET, "id", F.col("doc_id").alias("least"))
    if parts is not None:
        linked = scratch.write(parts.join(named.select("id", "least"), "id"), "linked")
        smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
        named = named.join(linked.join(smallest, "component").select("id", "component_id"), "id", "left")
    else:
        named = named.withColumn("component_id", F.lit(None).cast("long"))
    named = scratch.write(named.select(*SET, F.coalesce("component_id", "least").alias("component_id")), "named")
    rows = signed.select("doc_id", *SET).join(named, SET, "left").withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")))
    out = scratch.write(rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "result")
    scratch.keep("result")
    return out


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
