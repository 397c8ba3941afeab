"""Anchor hashes that several places share: the first, lossless filter of both substring operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, pieces
from gleaner.llm.kernels import distinct_by_row

#: From a batch and the number of its text column: anchor hashes and the row each stands in.
Extract = Callable[[pa.RecordBatch, int], tuple[np.ndarray, np.ndarray]]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, version, text): version tells rows with one id and different texts apart. Null text: empty."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))


def shared_anchors(docs: DataFrame, extract: Extract, condition: str, scratch: Scratch) -> DataFrame:
    """(doc, version, anchors): of each keyed document the anchor hashes for which ``condition`` holds over all documents.

    ``condition`` may use n (occurrences), low and high (least and greatest doc). Tasks send one row for each hash they meet, however often.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).fill_null(0).to_numpy()
            found = [(v, r + at) for piece, at in placed(batch) for v, r in [extract(piece, 1)]]
            if not found:
                continue
            values, rows = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(values, kind="stable")
            values, docs_ = values[order], doc[rows[order]]
            first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
            if len(first):
                columns = [values[first].view(np.int64), np.diff(np.r_[first, len(values)]), np.minimum.reduceat(docs_, first), np.maximum.reduceat(docs_, first)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "n", "low", "high"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 2):
                values, rows = distinct_by_row(*extract(piece, 2))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(at), piece.column(1).take(at), pa.array(values.view(np.int64))], names=["doc", "version", "anchor"])

    counted = docs.select("doc", "text").mapInArrow(count, "anchor long, n long, low long, high long")
    shared = counted.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).filter(condition).select("anchor")
    shared = scratch.write(shared, "shared")
    spelled = docs.mapInArrow(spell, "doc long, version long, anchor long").join(shared, "anchor", "left_semi")
    return scratch.write(spelled.groupBy("doc", "version").agg(F.collect_set("anchor").alias("anchors")), "anchors")


def placed(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Slices of a batch with the number of each one's first row."""
    at = 0
    for piece in pieces(batch, column):
        yield piece, at
        at += piece.num_rows


def among(values: np.ndarray, rows: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value stands in its row's list of longs."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.nan_to_num(np.asarray(lists.value_lengths().fill_null(0), np.float64)).astype(np.int64)
    wanted = np.asarray(lists.flatten(), np.int64).view(np.uint64)
    # A row's number goes into the hash, so that one sorted search answers for all rows.
    salt = lambda r: r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    wanted = np.sort(wanted ^ salt(np.repeat(np.arange(len(sizes)), sizes)))
    asked = values ^ salt(rows)
    at = np.minimum(np.searchsorted(wanted, asked), max(len(wanted) - 1, 0))
    return wanted[at] == asked if len(wanted) else np.zeros(len(values), bool)


def per_doc(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Joins keyed documents with marks for them; a null doc meets a null doc."""
    same = docs["doc"].eqNullSafe(marks["doc"]) & (docs["version"] == marks["version"])
    return docs.join(marks, same, how).drop(marks["doc"]).drop(marks["version"])
