"""Exact deduplication with counting quotient filters.

Every task turns the 64-bit fingerprints of its texts into a counting quotient filter: the high bits (quotient)
name a run, a run lists its remainders in order, each with a count. Filters of different tasks merge without loss,
run by run, by sorted remainders. Fingerprints counted more than once route their texts to a comparison of bytes;
all others are settled without looking at a text again.

Filters travel in blocks of neighbouring quotients, so no task ever holds a whole filter, and a text that a third
of all rows share is one slot with a count in each filter.

Nulls and odd input: a null text counts as empty; equal doc_ids stay separate rows (of equal texts with an equal
largest doc_id, all rows with that doc_id are marked kept); a null doc_id loses to every other, and a class of nulls only
keeps them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, documents, without_clashes

#: Slots that one block of the merged filter should have.
BLOCK_SLOTS = 200_000
PARTS = ("occupied", "lengths", "remainders", "counts")


class QuotientFilter:
    """A counting quotient filter laid out by run: the occupied quotients in order, the length of each one's run, then
    remainders and counts run after run."""

    def __init__(self, quotient_bits: int, occupied: np.ndarray, lengths: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotient_bits, self.occupied, self.lengths, self.remainders, self.counts = quotient_bits, occupied, lengths, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, quotient_bits: int, counts: np.ndarray | None = None) -> QuotientFilter:
        """From fingerprints in any order, each counted once or as often as ``counts`` says."""
        order = np.argsort(fingerprints, kind="stable")
        prints = fingerprints[order]
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]][: len(prints)])
        summed = np.add.reduceat(np.ones(len(prints), np.int64) if counts is None else counts[order], first) if len(first) else np.empty(0, np.int64)
        shift = np.uint64(64 - quotient_bits)
        occupied, lengths = np.unique(prints[first] >> shift, return_counts=True)
        return cls(quotient_bits, occupied, lengths.astype(np.uint32), prints[first] & ((np.uint64(1) << shift) - np.uint64(1)), summed)

    def fingerprints(self) -> np.ndarray:
        """Every fingerprint, in order: its quotient is given back by the run it stands in."""
        return (np.repeat(self.occupied, self.lengths) << np.uint64(64 - self.quotient_bits)) | self.remainders

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """The filter of all fingerprints of ``filters``, without loss: equal remainders of a run add their counts."""
        return cls.build(np.concatenate([x.fingerprints() for x in filters]), filters[0].quotient_bits, np.concatenate([x.counts for x in filters]))

    def blocks(self, block_bits: int) -> Iterator[tuple[int, QuotientFilter]]:
        """The filter cut into 2**block_bits ranges of quotients, without the empty ones."""
        number = (self.occupied >> np.uint64(self.quotient_bits - block_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True][: len(number) + 1]) if len(number) else np.zeros(1, np.int64)
        ends = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            slots = slice(ends[lo], ends[hi])
            yield int(number[lo]), QuotientFilter(self.quotient_bits, self.occupied[lo:hi], self.lengths[lo:hi], self.remainders[slots], self.counts[slots])

    def to_bytes(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.occupied.tobytes(), self.lengths.tobytes(), self.remainders.tobytes(), self.counts.tobytes()

    @classmethod
    def from_bytes(cls, quotient_bits: int, occupied: bytes, lengths: bytes, remainders: bytes, counts: bytes) -> QuotientFilter:
        return cls(quotient_bits, np.frombuffer(occupied, np.uint64), np.frombuffer(lengths, np.uint32), np.frombuffer(remainders, np.uint64), np.frombuffer(counts, np.int64))


def filter_blocks(prints: DataFrame, quotient_bits: int, block_bits: int) -> DataFrame:
    """The filter of each partition of ``prints`` (column fp), cut into blocks."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [QuotientFilter.build(batch.column(0).to_numpy().view(np.uint64), quotient_bits) for batch in batches]
        for number, part in QuotientFilter.merge(parts).blocks(block_bits) if parts else ():
            yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int32())} | {k: pa.array([v], pa.binary()) for k, v in zip(PARTS, part.to_bytes(), strict=True)})

    return prints.select("fp").mapInArrow(build, "block int, " + ", ".join(f"{k} binary" for k in PARTS))


def repeated_fingerprints(blocks: DataFrame, quotient_bits: int) -> DataFrame:
    """Fingerprints that the merged filter counts more than once."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        whole = QuotientFilter.merge([QuotientFilter.from_bytes(quotient_bits, *x) for x in zip(*(rows[k] for k in PARTS), strict=True)])
        return pd.DataFrame({"fp": whole.fingerprints()[whole.counts > 1].view(np.int64)})

    return blocks.groupBy("block").applyInPandas(merged, "fp long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the largest id stays."""
    scratch = Scratch(docs.sparkSession, "exact")
    own = without_clashes(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    marked = own.withColumn("fp", F.xxhash64("text"))
    rows = own.count()
    block_bits = max(8, int(np.ceil(np.log2(max(1, rows) / BLOCK_SLOTS))) if rows else 8)
    quotient_bits = block_bits + 8
    repeated = scratch.write(repeated_fingerprints(filter_blocks(marked, quotient_bits, block_bits), quotient_bits), "repeated")
    # Bytes decide: texts are grouped as they are, and only those whose fingerprint came up again.
    classes = (
        marked.join(repeated, "fp", "left_semi")
        .groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    classes = scratch.write(classes, "classes")
    scratch.keep("classes")
    # By here a text is named by fingerprint and SHA-256 together, so whole texts need not be moved once more.
    named = marked.select("doc_id", "fp", F.sha2("text", 256).alias("text_sha256"))
    return named.join(classes, ["fp", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
