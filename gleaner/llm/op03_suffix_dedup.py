"""Repeated byte strings by a column-wise suffix construction over many texts at once.

The construction inserts one symbol of every text each round and keeps, for the whole collection, the order of what has been read so far, the
symbols in that order (the column of the Burrows-Wheeler transform), and the length of the prefix that neighbours share. A
string of WINDOW bytes is repeated where neighbours share WINDOW symbols or more. Done naively over whole texts, each round would
rewrite a file as long as all that was read, a round for each byte of the longest text. Three things bound it here:

Alignment. A window's anchor is its least hashed GRAM-byte piece (the leftmost, if equal). Equal windows have equal anchors at equal places, so only windows
with the same anchor can match, and only at the same distance from it. Texts are cut into strings, one for each anchor that occurs at least twice, holding all windows that own it.
Strings of one anchor are lined up on it and go through the rounds together, where only the last round's order is needed (the positional form of the
transform): no more than GRAM, WINDOW and the reach of an anchor allow, about a thousand rounds for any corpus.

Sequential files. Strings lie in Parquet, clustered by anchor; a task streams over its anchors and holds a few thousand strings.

Hot anchors. Equal strings count once, with a weight. An anchor with more than GROUP different strings is split: its windows are put
into classes by distance from the anchor, STEPS[0] distances each, and a class's strings are told apart by the bytes that all its windows share; those still over GROUP are split
again by smaller steps, down to single windows, which are equal or not. So no group is unbounded, and nothing is dropped.

Nulls and odd input: a null text counts as empty; rows with null or repeated doc_ids are documents of their own, equal rows included, so two equal rows
of WINDOW bytes or more lose everything; texts under WINDOW bytes keep everything; an empty table gives an empty result; other columns are ignored.
Removing bytes can split a character, so kept text is bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.anchors import among, keyed, per_doc, shared_anchors
from gleaner.llm.common import Scratch, binary_rows, documents, pieces, text_bytes
from gleaner.llm.kernels import BYTE_VALUE, mix, prefix_sums, quick_hash, quick_sums, window_hash

WINDOW, GRAM = 400, 64
#: Different strings of one anchor that go through the rounds together, and strings a task holds at once.
GROUP, TOGETHER = 200, 3000
STEPS = (64, 8, 1)
NAME = ["key", "sum_1", "sum_2"]
NO_SYMBOL = 256


def owners(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: its place, and the first and the last window that owns it (places in ``data``)."""
    width = WINDOW - GRAM + 1
    n = len(data) - GRAM + 1
    if n < width:
        return (np.empty(0, np.int64),) * 3
    place = np.arange(n)
    # High half of the hash, then the place: the least is the leftmost of equal pieces.
    value = (quick_hash(sums, place, place + GRAM) & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = value
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    window = np.arange(len(data) - WINDOW + 1)
    row_end = offsets[np.searchsorted(offsets, window, side="right")] if len(window) else window
    window = window[window + WINDOW <= row_end]
    anchor = (np.minimum(behind[window], ahead[window + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)])
    last = np.r_[first[1:], len(anchor)][: len(first)] - 1
    return anchor[first], window[first], window[last]


def anchors(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(batch.column(column))
    sums = quick_sums(BYTE_VALUE[data])
    at, _, _ = owners(data, offsets, sums)
    return quick_hash(sums, at, at + GRAM), np.searchsorted(offsets, at, side="right") - 1


def spelled_once(data: np.ndarray, begin: np.ndarray, end: np.ndarray, names: list[np.ndarray], weight: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The strings data[begin:end], each name's only at its first place (else null), and there the sum of ``weight`` of all its places."""
    order = np.lexsort(names[::-1])
    new = np.zeros(len(begin), bool)
    new[:1] = True
    for x in names:
        new[1:] |= x[order][1:] != x[order][:-1]
    first = np.flatnonzero(new)
    total = np.zeros(len(begin), np.int64)
    if len(first):
        total[order[first]] = np.add.reduceat(weight[order], first)
    shown = total > 0
    size = np.where(shown, end - begin, 0)
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)
    strings = binary_rows(data[at], offsets)
    hide = pa.array(~shown)
    return pa.compute.if_else(hide, pa.scalar(None, pa.binary()), strings), pa.array(total, mask=~shown)


def strings_of(docs: DataFrame) -> DataFrame:
    """Each shared anchor's string in each document (column anchors): where it starts, its name, how far in the anchor lies, and, once a batch, its bytes."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 2):
                data, offsets = text_bytes(piece.column(2))
                sums, others = quick_sums(BYTE_VALUE[data]), prefix_sums(BYTE_VALUE[data])
                at, low, high = owners(data, offsets, sums)
                row = np.searchsorted(offsets, at, side="right") - 1
                key = quick_hash(sums, at, at + GRAM)
                keep = among(key, row, piece.column(3))
                at, low, high, row, key = at[keep], low[keep], high[keep], row[keep], key[keep]
                one, two = quick_hash(sums, low, high + WINDOW), window_hash(others, low, high + WINDOW)
                strings, weight = spelled_once(data, low, high + WINDOW, [key, one, two], np.ones(len(at), np.int64))
                where = pa.array(row)
                longs = [pa.array(x.view(np.int64)) for x in (low - offsets[row], key, one, two)]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(where), piece.column(1).take(where), *longs, pa.array((at - low).astype(np.int32)), weight, strings], names=["doc", "version", "start", *NAME, "lead", "weight", "string"])

    return docs.select("doc", "version", "text", "anchors").mapInArrow(spell, "doc long, version long, start long, key long, sum_1 long, sum_2 long, lead int, weight long, string binary")


def rounds(data: np.ndarray, offsets: np.ndarray, lead: np.ndarray, group: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, last) for each run of windows of a string that another string of its group holds too, or that has weight above 1. Groups are numbered from 0 and stand together."""
    size, count = np.diff(offsets), len(lead)
    shift = lead.max() - lead
    columns = int((shift + size).max())
    symbols = np.full((columns, count), NO_SYMBOL, np.uint16)
    which = np.repeat(np.arange(count), size)
    symbols[np.arange(len(data)) - np.repeat(offsets[:-1] - shift, size), which] = data
    repeated = np.zeros((columns - WINDOW + 1, count), bool)
    order, group = np.arange(count), group.astype(np.uint16)
    # apart[p]: the first column of the stretch, ending in this one, on which the p-th string in order agrees with the one before.
    apart = np.zeros(count + 1, np.int32)
    for column in range(columns):
        transform, own = symbols[column][order], group[order]
        moved = np.argsort(transform, kind="stable")
        moved = moved[np.argsort(own[moved], kind="stable")]
        transform, own = transform[moved], own[moved]
        same = np.flatnonzero((own[1:] == own[:-1]) & (transform[1:] == transform[:-1]) & (transform[1:] != NO_SYMBOL))
        after = np.full(count + 1, column + 1, np.int32)
        if len(same):
            spans = np.empty(2 * len(same), np.int64)
            spans[::2], spans[1::2] = moved[same] + 1, moved[same + 1] + 1
            after[same + 1] = np.maximum.reduceat(apart, spans)[::2]
        order, apart = order[moved], after
        if column >= WINDOW - 1:
            long_ = apart <= column - WINDOW + 1
            hit = long_[:-1] | long_[1:]
            if hit.any():
                repeated[column - WINDOW + 1, order[hit]] = True
    twice = np.flatnonzero(weight > 1)
    for i in twice:
        repeated[shift[i] : shift[i] + size[i] - WINDOW + 1, i] = True
    edges = np.zeros((count, len(repeated) + 2), np.int8)
    edges[:, 1:-1] = repeated.T
    change = np.diff(edges, axis=1)
    string, first = np.nonzero(change == 1)
    _, last = np.nonzero(change == -1)
    return string, first - shift[string], last - 1 - shift[string]


def through_rounds(strings: DataFrame) -> DataFrame:
    """(key, sum_1, sum_2, runs) of the strings that hold repeated windows. All strings of a key are in one partition, next to each other."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                held.append(batch.slice(at, TOGETHER))
                if sum(x.num_rows for x in held) >= TOGETHER:
                    table = pa.Table.from_batches(held).combine_chunks()
                    key = table.column(0).to_numpy()
                    whole = int(np.searchsorted(key, key[-1]))
                    if whole:
                        yield work(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
        if held and sum(x.num_rows for x in held):
            yield work(pa.Table.from_batches(held))

    def work(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        key = batch.column(0).to_numpy()
        group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        data, offsets = text_bytes(batch.column(5))
        string, first, last = rounds(data, offsets, batch.column(3).to_numpy(), group, batch.column(4).to_numpy())
        some, start = np.unique(string, return_index=True)
        runs = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["first", "last"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(string)].astype(np.int32)), runs)
        where = pa.array(some)
        return pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), batch.column(2).take(where), lists], names=[*NAME, "runs"])

    return strings.mapInArrow(stream, "key long, sum_1 long, sum_2 long, runs array<struct<first:int,last:int>>")


def split(strings: DataFrame, step: int) -> DataFrame:
    """Strings of hot keys cut into classes of ``step`` windows by distance from the anchor, named by the bytes their windows share."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 5):
                data, offsets = text_bytes(piece.column(5))
                sums, others = quick_sums(BYTE_VALUE[data]), prefix_sums(BYTE_VALUE[data])
                lead, windows = piece.column(3).to_numpy().astype(np.int64), np.diff(offsets) - WINDOW + 1
                row = np.repeat(np.arange(len(windows)), windows)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                kind = (nth - lead[row]) // step
                first = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])][: len(row)])
                last = np.r_[first[1:], len(row)] - 1
                row, kind = row[first], kind[first]
                base = offsets[row] + lead[row] + kind * step
                begin, end = offsets[row] + nth[first], offsets[row] + nth[last] + WINDOW
                key = mix(quick_hash(sums, base + step - 1, base + WINDOW) ^ mix(piece.column(0).to_numpy().view(np.uint64)[row] + kind.view(np.uint64)))
                one, two = quick_hash(sums, begin, end), window_hash(others, begin, end)
                text, weight = spelled_once(data, begin, end, [key, one, two], piece.column(4).to_numpy()[row])
                where = pa.array(row)
                above = [piece.column(i).take(where) for i in range(3)]
                longs = [pa.array(x.view(np.int64)) for x in (nth[first], key, one, two)]
                yield pa.RecordBatch.from_arrays([*above, *longs, pa.array((lead[row] - nth[first]).astype(np.int32)), weight, text], names=["up_key", "up_1", "up_2", "start", *NAME, "lead", "weight", "string"])

    return strings.select(*NAME, "lead", "weight", "string").mapInArrow(cut, "up_key long, up_1 long, up_2 long, start long, key long, sum_1 long, sum_2 long, lead int, weight long, string binary")


def repeated_runs(places: DataFrame, scratch: Scratch, level: int = 0) -> DataFrame:
    """(key, sum_1, sum_2, runs): of each different string of ``places``, the runs of its windows that are repeated."""
    strings = places.filter(F.col("string").isNotNull()).groupBy(*NAME, "lead", "string").agg(F.sum("weight").alias("weight"))
    strings = scratch.write(strings.select(*NAME, "lead", "weight", "string"), f"strings-{level}")
    keys = scratch.write(strings.groupBy("key").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).filter("weight > 1").select("key", (F.col("n") > GROUP).alias("hot")), f"keys-{level}")
    parts = max(strings.sparkSession._jsc.sc().defaultParallelism(), int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cold = strings.join(keys.filter("NOT hot"), "key", "left_semi").repartition(parts, "key").sortWithinPartitions("key")
    found = scratch.write(through_rounds(cold), f"found-{level}")
    if level < len(STEPS) and not keys.filter("hot").isEmpty():
        below = scratch.write(split(strings.join(keys.filter("hot"), "key", "left_semi"), STEPS[level]), f"split-{level}")
        down = repeated_runs(below, scratch, level + 1)
        moved = below.join(down, NAME).select("up_key", "up_1", "up_2", F.transform("runs", lambda r: F.struct((r["first"] + F.col("start")).cast("int").alias("first"), (r["last"] + F.col("start")).cast("int").alias("last"))).alias("runs"))
        found = found.union(moved.groupBy("up_key", "up_1", "up_2").agg(F.flatten(F.collect_list("runs")).alias("runs")))
    return found


def cut_out(docs: DataFrame) -> DataFrame:
    """(doc_id, content, n_bytes, n_removed, n_spans) of documents with a column spans."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                data, offsets = text_bytes(piece.column(1))
                out, removed, spans = [], [], []
                for i, found in enumerate(piece.column(2).to_pylist()):
                    own = data[offsets[i] : offsets[i + 1]]
                    steps = np.zeros(len(own) + 1, np.int64)
                    for x in found or ():
                        steps[x["first"]] += 1
                        steps[x["last"] + WINDOW] -= 1
                    gone = np.cumsum(steps)[:-1] > 0
                    out.append(own[~gone].tobytes())
                    removed.append(int(gone.sum()))
                    spans.append(int((gone & ~np.r_[False, gone[:-1]][: len(gone)]).sum()))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(out, pa.binary()), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names=["doc_id", "content", "n_bytes", "n_removed", "n_spans"])

    return docs.select("doc", "text", "spans").mapInArrow(drop, "doc_id long, content binary, n_bytes long, n_removed long, n_spans long")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, content (the bytes that stay), n_bytes, n_removed, n_spans."""
    scratch = Scratch(docs.sparkSession, "suffix")
    own = keyed(docs, id_col, text_col)
    marked = per_doc(own, shared_anchors(own, anchors, "n > 1", scratch), "inner")
    places = scratch.write(strings_of(marked), "places")
    scratch.drop("shared", "anchors")
    found = repeated_runs(places, scratch)
    here = places.select("doc", "version", "start", *NAME).join(found, NAME).select("doc", "version", F.transform("runs", lambda r: F.struct((r["first"] + F.col("start")).alias("first"), (r["last"] + F.col("start")).alias("last"))).alias("runs"))
    spans = scratch.write(here.groupBy("doc", "version").agg(F.flatten(F.collect_list("runs")).alias("spans")), "spans")
    scratch.keep("spans")
    return cut_out(per_doc(own, spans, "left"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("content", 256).alias("kept_sha256"))
