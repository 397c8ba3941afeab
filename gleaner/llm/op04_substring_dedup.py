"""Substring deduplication over words, with difference-cover anchors.

Positions in a text are taken modulo PERIOD, and hashes of LENGTH words only at the positions whose remainder is in COVER. For any two offsets i and j there is a shift below
PERIOD that takes both into the cover, so two equal windows of LENGTH + PERIOD - 1 = 50 words hash at least one equal, equally placed piece: no
long match is missed, with a fifth of all positions hashed. Pieces that different documents share are anchors; each extends to the
windows of 50 words around it, and only these are hashed in full (two 64-bit hashes) and traced to the smallest doc_id they start in.

A word goes if a window over it also starts in a document with a smaller doc_id.

Nulls and odd input: a null or blank text has no words; a document with a null doc_id neither loses words nor makes others lose any; rows that share a
doc_id don't affect each other, but each loses what a smaller doc_id has; very long texts are whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.anchors import among, keyed, per_doc, shared_anchors
from gleaner.llm.common import Scratch, documents, pieces, text_bytes
from gleaner.llm.kernels import mix, prefix_sums, window_hash, words

WINDOW = 50
#: A perfect difference cover, every remainder modulo 31 is a difference of two of these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
LENGTH = WINDOW - PERIOD + 1


def texts(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Prefix sums of word hashes, each word's row and place in it, each row's first word; and the words' bytes."""
    data, offsets = text_bytes(batch.column(column))
    hashes, start, end, first = words(data, offsets)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return hashes, row, np.arange(len(hashes)) - first[row], first, (data, start, end)


def runs(row: np.ndarray, length: int) -> np.ndarray:
    """Words at which ``length`` words of one row begin."""
    return np.flatnonzero(row[: len(row) - length + 1] == row[length - 1 :]) if len(row) >= length else np.empty(0, np.int64)


def covered_pieces(hashes: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the LENGTH words at cover positions, and the words they begin at."""
    start = runs(row, LENGTH)
    start = start[np.isin(place[start] % PERIOD, COVER)]
    return window_hash(prefix_sums(hashes), start, start + LENGTH), start


def anchors(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, row, place, _, _ = texts(batch, column)
    values, start = covered_pieces(hashes, row, place)
    return values, row[start]


def candidate_windows(docs: DataFrame) -> DataFrame:
    """(doc, hash_1, hash_2) of every window that holds an anchor, for documents with a column anchors."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 2):
                hashes, row, place, first, _ = texts(piece, 2)
                values, start = covered_pieces(hashes, row, place)
                start = start[among(values, row[start], piece.column(3))]
                # A window holds the piece if it begins up to WINDOW - LENGTH words before.
                steps = np.zeros(len(row) + 1, np.int64)
                np.add.at(steps, np.maximum(start - (WINDOW - LENGTH), first[row[start]]), 1)
                np.add.at(steps, start + 1, -1)
                window = runs(row, WINDOW)
                window = window[np.cumsum(steps)[window] > 0]
                one, rows = window_hash(prefix_sums(hashes), window, window + WINDOW), row[window]
                two = window_hash(prefix_sums(mix(hashes + np.uint64(1))), window, window + WINDOW)
                order = np.lexsort((one, rows))
                one, two, rows = one[order], two[order], rows[order]
                new = np.r_[True, (one[1:] != one[:-1]) | (rows[1:] != rows[:-1])][: len(one)]
                at = pa.array(rows[new])
                yield pa.RecordBatch.from_arrays([piece.column(0).take(at), pa.array(one[new].view(np.int64)), pa.array(two[new].view(np.int64))], names=["doc", "hash_1", "hash_2"])

    return docs.select("doc", "version", "text", "anchors").mapInArrow(extend, "doc long, hash_1 long, hash_2 long")


def cut(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, n_removed) of documents with columns repeated, the hashes of the windows that go, and whole, whether all go."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                hashes, row, _, first, (data, start, end) = texts(piece, 1)
                window = runs(row, WINDOW)
                one = window_hash(prefix_sums(hashes), window, window + WINDOW)
                whole = np.asarray(piece.column(3).fill_null(False).to_pylist(), bool)
                window = window[among(one, row[window], piece.column(2)) | whole[row[window]]]
                steps = np.zeros(len(row) + 1, np.int64)
                steps[window] += 1
                np.add.at(steps, window + WINDOW, -1)
                gone = np.cumsum(steps)[:-1] > 0
                removed = np.concatenate([[0], np.cumsum(gone)])
                data, n, out = data.tobytes(), np.diff(first), []
                for i in range(piece.num_rows):
                    mine = range(first[i], first[i + 1])
                    if removed[first[i + 1]] > removed[first[i]]:
                        out.append(b" ".join(data[start[w] : end[w]] for w in mine if not gone[w]))
                    else:
                        out.append(b" ".join(data[start[first[i]] : end[first[i + 1] - 1]].split()) if len(mine) else b"")
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(out, pa.binary()).cast(pa.string()), pa.array(n), pa.array(removed[first[1:]] - removed[first[:-1]])], names=["doc_id", "text", "n_words", "n_removed"])

    return docs.select("doc", "text", "repeated", "whole").mapInArrow(drop, "doc_id long, text string, n_words long, n_removed long")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text (kept words joined by a space), n_words, n_removed."""
    scratch = Scratch(docs.sparkSession, "substring")
    own = keyed(docs, id_col, text_col)
    named = own.filter(F.col("doc").isNotNull())
    # Every window of a text also starts in its equal text with the smallest doc_id: the others lose all their windows as they are.
    ids = scratch.write(named.select("doc", "version", F.xxhash64(F.lit("second"), "text").alias("second")), "ids")
    equal = ids.groupBy("version", "second").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low <> high")
    copies = scratch.write(ids.join(equal, ["version", "second"]).filter("doc > low").select("doc", "version").distinct(), "copies")
    found = shared_anchors(named, anchors, "low <> high", scratch).join(copies, ["doc", "version"], "left_anti")
    windows = scratch.write(candidate_windows(per_doc(named, found, "inner")), "windows")
    scratch.drop("shared", "anchors")
    first = windows.groupBy("hash_1", "hash_2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low <> high").drop("high")
    first = scratch.write(first, "first")
    # A window that a smaller doc_id has goes from every row with this doc_id, so rows need not be told apart.
    repeated = windows.join(first, ["hash_1", "hash_2"]).filter("doc > low").groupBy("doc").agg(F.collect_list("hash_1").alias("repeated"))
    repeated = scratch.write(repeated, "repeated")
    scratch.drop("windows", "first")
    whole = copies.withColumn("whole", F.lit(True))
    marks = ids.select("doc", "version").distinct().join(repeated, "doc", "left").join(whole, ["doc", "version"], "left").filter("repeated IS NOT NULL OR whole")
    marks = scratch.write(marks, "marks")
    scratch.keep("marks")
    return cut(per_doc(own, marks, "left"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k FROM t),
m AS (SELECT k, min(doc_id) AS low FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)),
x AS (SELECT h.doc_id, h.s FROM h JOIN m USING (k) WHERE h.doc_id > m.low),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM x),
e AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS v FROM d),
r AS (SELECT e.doc_id, count(g.i) AS n_removed, string_agg(e.v, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS t
  FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(r.n_removed, 0) AS n_removed, sha256(coalesce(r.t, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
