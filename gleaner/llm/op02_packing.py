"""Sequence packing as a cutting-stock problem solved by column generation.

Documents longer than a sequence are cut into full sequences and one rest; the rests are the items. Their lengths, rounded up to a
class of a few tokens, give a histogram whose size doesn't depend on the corpus. Over it a linear program chooses how often each
pattern (a multiset of classes that fits one sequence) is used: the simplex method prices new patterns with a knapsack dynamic
program until none would help. Counts are rounded down and the few items left over, less than one pattern each, are packed first-fit.
Spark ranks the pieces of each class, and a piece's rank alone says which copy of which pattern takes it, so no task packs.

Nulls and odd input: a null text counts as empty and yields one piece with the end id alone; null and repeated doc_ids pass through,
each row packed for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm import tokens
from gleaner.llm.common import Scratch, documents, text_bytes, without_clashes
from gleaner.llm.common import pieces as slices

SEQUENCE = 2048
END_ID = 1
#: Tokens in a length class.
CLASS_TOKENS = 8
#: Columns the linear program may add; any number gives a valid packing.
MAX_COLUMNS = 4000
#: A column enters while it betters the bound by this share: the program ends within it of its optimum.
GAP = 5e-4

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items that fits, by dynamic programming over capacities."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(sizes, room, side="right")
        if fits:
            with_item = best[room - sizes[:fits]] + values[:fits]
            k = int(with_item.argmax())
            if with_item[k] > best[room - 1] + 1e-12:
                best[room], took[room] = with_item[k], k
                continue
        best[room] = best[room - 1]
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), counts


def generate_columns(sizes: np.ndarray, demand: np.ndarray, capacity: int, max_columns: int = MAX_COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often the linear program's solution uses them. ``sizes`` ascend."""
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    amount = inverse @ demand
    for _ in range(max_columns):
        worth = inverse.sum(axis=0)
        value, pattern = knapsack(worth, sizes, capacity)
        if value <= 1 + GAP:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.maximum(step, 1e-9), np.inf)
        out = int(ratio.argmin())
        amount = amount - ratio[out] * step
        amount[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        columns[:, out] = pattern
    return columns.astype(np.int64), np.maximum(amount, 0)


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns as (times, {class: items}) that use up the histogram exactly."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in sizes], np.int64)
    columns, amount = generate_columns(sizes, demand.astype(float), capacity)
    times = np.floor(amount + 1e-6).astype(np.int64)
    left = demand - columns @ times
    while (left < 0).any():  # rounding noise of very large counts
        over = int(np.flatnonzero(left < 0)[0])
        use = int(np.flatnonzero((columns[over] > 0) & (times > 0))[0])
        times[use] -= 1
        left += columns[:, use]
    out = [(int(t), {int(sizes[i]): int(columns[i, j]) for i in np.flatnonzero(columns[:, j])}) for j, t in enumerate(times) if t]
    # What rounding left: fewer items than the patterns hold together. First fit, longest first; equal bins are counted, not listed.
    bins: list[list] = []
    for size, n in zip(sizes[::-1].tolist(), left[::-1].tolist(), strict=True):
        for have in bins:
            while n and have[0] >= size:
                have[0] -= size
                have[1][size] = have[1].get(size, 0) + 1
                n -= 1
        while n:
            take = min(n, capacity // size)
            bins.append([capacity - take * size, {size: take}])
            n -= take
    return out + [(1, have[1]) for have in bins]


def cut(docs: DataFrame, vocabulary: str, sequence: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Encodes whole texts and cuts them into full sequences and a rest."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokens.encoder(vocabulary)
        end = end_id.to_bytes(code.width, "little")
        for piece in (x for batch in batches for x in slices(batch, 1)):
            data, offsets = text_bytes(piece.column(1))
            data, rows = data.tobytes(), []
            for i, key in enumerate(piece.column(0).to_pylist()):
                ids = np.frombuffer(code.encode(data[offsets[i] : offsets[i + 1]]) + end, code.dtype).astype("<u4")
                rows += [(key, at, min(sequence, len(ids) - at), zlib.crc32(ids[at : at + sequence].tobytes()), len(ids)) for at in range(0, len(ids), sequence)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return without_clashes(docs, id_col, text_col).mapInArrow(encode, PIECES)


def assign(ranked: DataFrame, patterns: list[tuple[int, dict[int, int]]]) -> DataFrame:
    """sequence_id and slot of each piece from its class and its rank in it. ``patterns`` is as small as the histogram."""
    taken: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for times, items in patterns:
        slot = 0
        for size, n in sorted(items.items(), reverse=True):
            taken.setdefault(size, []).append((used.get(size, 0), n, base, slot))
            used[size] = used.get(size, 0) + times * n
            slot += n
        base += times
    tables = {size: np.array(x, np.int64) for size, x in taken.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            where, slot = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(kind):
                mine = np.flatnonzero(kind == size)
                table = tables[int(size)]
                row = table[np.searchsorted(table[:, 0], rank[mine], side="right") - 1]
                nth = rank[mine] - row[:, 0]
                where[mine], slot[mine] = row[:, 2] + nth // row[:, 1], row[:, 3] + nth % row[:, 1]
            kept = [batch.column(k) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(where), pa.array(slot)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, slot long")


def pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, class_tokens: int = CLASS_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``class_tokens`` divides ``sequence``."""
    scratch = Scratch(docs.sparkSession, "packing")
    order = ["class", "length", "doc_id", "start"]
    pieces = cut(docs, vocabulary or tokens.default_path(), sequence, end_id, id_col, text_col)
    pieces = scratch.write(pieces.withColumn("class", F.ceil(F.col("length") / class_tokens).cast("int")), "pieces")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rank of each piece among those of its class in this partition; classes come one after another."""
        seen = np.zeros(sequence // class_tokens + 1, np.int64)
        for batch in batches:
            kind = batch.column("class").to_numpy()
            first = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]][: len(kind)])
            counts = np.diff(np.r_[first, len(kind)])
            local = np.arange(len(kind)) - np.repeat(first, counts) + seen[kind]
            seen[kind[first]] += counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], names=[*batch.schema.names, "local"])

    parts = max(docs.sparkSession._jsc.sc().defaultParallelism(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = pieces.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = scratch.write(ranged.mapInArrow(number, f"{PIECES}, class int, part int, local long"), "ranked")
    scratch.keep("ranked")
    counts = ranged.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("class").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # At most sequence / class_tokens rows come to the driver.
    histogram = {int(x["class"]): int(x["n"]) for x in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    patterns = solve(histogram, sequence // class_tokens)
    ranked = ranged.join(bases, ["class", "part"]).withColumn("rank", F.col("base") + F.col("local"))
    placed = assign(ranked, patterns)
    ahead = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
