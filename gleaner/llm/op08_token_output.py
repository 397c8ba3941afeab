"""Token-id output: raw binary shards with a minimal perfect hash index for keyed access.

Format. A shard is one file ``<name>.bin``: token ids of its documents end to end, in ascending key order, as
little-endian unsigned 16-bit integers (32-bit where the vocabulary needs them), each document closed by the end id.
``<name>.idx`` holds, for n documents: magic, n, id width, hash seed and level sizes, the bits of a minimal perfect
hash over the keys, then in hash order n fingerprints (u32), n payload offsets (u64, in ids) and n lengths (u64). Keys themselves are not
stored: a key hashes to one slot, the slot's fingerprint says (up to 2**-32) whether the key is there, and offset and
length give its ids with one read. The manifest, a Parquet table, lists shards with key bounds and the number of ids before each.

Files are written under names of their own for each attempt of a task and the manifest names only those of attempts that
succeeded, so retries and lost executors leave no doubt about which files count. Files may lie in any store that pyarrow.fs opens.

Nulls and odd input: a null text counts as empty and yields the end id alone; rows that share a doc_id are told apart by an occurrence number
(equal ids keep no order among themselves); null doc_ids come first and are returned as null; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm import tokens
from gleaner.llm.common import Scratch, documents, text_bytes, without_clashes
from gleaner.llm.kernels import mix

MAGIC = 0x31584449_4E4B4C47
END_ID = 2
GAMMA = 1.5
#: Documents and payload bytes after which a task begins another shard.
SHARD_DOCUMENTS, SHARD_BYTES = 200_000, 256 << 20
NULL_KEY = -(1 << 63)
#: Occurrences of one id that are asked for together, and tasks that read shards.
STRETCH, MOST_PARTS = 65_536, 10_000
MANIFEST = "shard string, part int, piece int, low long, high long, low_occurrence long, documents long, ids long"


def key_hash(keys: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return mix(keys.view(np.uint64) + mix(occurrence.astype(np.uint64) + np.uint64(1)))


class PerfectHash:
    """A minimal perfect hash by levels of bit arrays: a key takes a bit that no other key of its level asks for; the rest try the next level."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @staticmethod
    def place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        """``hashes`` must be distinct."""
        sizes, bits, left = [], [], hashes
        while len(left):
            size = int(len(left) * GAMMA) + 1
            at = cls.place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.empty(0, bool))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, below the number of keys; -1 where no level takes it, so it is no key."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + self.place(hashes[open_], level, int(size))
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        return out


def pack_index(hashes: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    ph = PerfectHash.build(hashes)
    slot = ph.slots(hashes)
    tables = []
    for values, kind in (((hashes >> np.uint64(32)), "<u4"), (offsets, "<u8"), (lengths, "<u8")):
        table = np.empty(len(hashes), kind)
        table[slot] = values
        tables.append(table.tobytes())
    head = np.array([MAGIC, len(hashes), width, len(ph.sizes), *ph.sizes], "<u8").tobytes()
    return head + np.packbits(ph.bits).tobytes() + b"".join(tables)


class Index:
    """An index file in memory."""

    def __init__(self, data: bytes):
        magic, n, self.width, levels = np.frombuffer(data, "<u8", 4).tolist()
        if magic != MAGIC:
            raise ValueError("not an index file")
        sizes = np.frombuffer(data, "<u8", levels, 32).astype(np.int64)
        at = 32 + 8 * levels
        total = int(sizes.sum())
        self.hash = PerfectHash(sizes, np.unpackbits(np.frombuffer(data, np.uint8, (total + 7) // 8, at), count=total).astype(bool))
        at += (total + 7) // 8
        self.prints = np.frombuffer(data, "<u4", n, at)
        self.offsets = np.frombuffer(data, "<u8", n, at + 4 * n)
        self.lengths = np.frombuffer(data, "<u8", n, at + 12 * n)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there, and the offset and length of its ids."""
        slot = self.hash.slots(hashes)
        safe = np.maximum(slot, 0)
        there = (slot >= 0) & (self.prints[safe] == (hashes >> np.uint64(32)).astype(np.uint32)) if len(self.prints) else np.zeros(len(hashes), bool)
        return there, self.offsets[safe].astype(np.int64) if len(self.prints) else safe, self.lengths[safe].astype(np.int64) if len(self.prints) else safe


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes texts and writes shards into ``folder``; returns the manifest. Partition order is key order."""
    vocabulary = vocabulary or tokens.default_path()
    own = without_clashes(docs, id_col, text_col).toDF("doc_id", "text")
    parts = max(docs.sparkSession._jsc.sc().defaultParallelism(), own.rdd.getNumPartitions())
    own = own.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokens.encoder(vocabulary)
        end = end_id.to_bytes(code.width, "little")
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        piece, last, seen = 0, None, 0
        out, name, keys, occurrences, lengths = None, "", [], [], []

        def close(part: int) -> pa.RecordBatch:
            out.close()
            k, o, n = np.array(keys, np.int64), np.array(occurrences, np.int64), np.array(lengths, np.int64)
            with store.open_output_stream(f"{base}/{name}.idx") as index:
                index.write(pack_index(key_hash(k, o), np.cumsum(n) - n, n, code.width))
            row = {"shard": name, "part": part, "piece": piece, "low": keys[0], "high": keys[-1], "low_occurrence": occurrences[0], "documents": len(keys), "ids": int(n.sum())}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.string()), ("part", pa.int32()), ("piece", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("low_occurrence", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())]))

        part = 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            data = data.tobytes()
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for i, key in enumerate(batch.column(0).to_pylist()):
                key = NULL_KEY if key is None else key
                seen = seen + 1 if key == last else 0
                last = key
                if out is None:
                    name = f"{part:06d}-{piece:04d}-{uuid.uuid4().hex}"
                    out, keys, occurrences, lengths, size = store.open_output_stream(f"{base}/{name}.bin"), [], [], [], 0
                ids = code.encode(data[offsets[i] : offsets[i + 1]]) + end
                out.write(ids)
                keys.append(key), occurrences.append(seen), lengths.append(len(ids) // code.width)
                size += len(ids)
                if len(keys) >= SHARD_DOCUMENTS or size >= SHARD_BYTES:
                    yield close(part)
                    out, piece = None, piece + 1
        if out is not None:
            yield close(part)

    return own.mapInArrow(write, MANIFEST)


def lookup(keys: DataFrame, manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Keyed access: for each row of ``keys`` the ids stored under it, as digest columns start, n_tokens, ids_crc32. Absent keys give nothing.

    The manifest has a row for each 256 MB of ids, so the driver may hold its key bounds; keys are sent to their shards by these.
    """
    before = W.orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1)
    shards = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).orderBy("part", "piece").collect()
    own = without_clashes(keys, id_col).toDF("doc_id")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return keys.sparkSession.createDataFrame([], schema)
    # Partition order is key order, so bounds ascend; a doc_id whose rows run over a shard's end is told by occurrence.
    lows = np.array([x["low"] for x in shards], np.int64)
    first = np.array([x["low_occurrence"] for x in shards], np.int64)
    names = [x["shard"] for x in shards]
    starts = [x["start"] for x in shards]
    home = own.withColumn("key", F.coalesce("doc_id", F.lit(NULL_KEY))).groupBy("key").agg(F.count("*").alias("times"))
    # An id that many rows share is asked for a stretch of occurrences at a time.
    home = home.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(STRETCH))).alias("base"), "times").select("key", "base", F.least(F.col("times") - F.col("base"), F.lit(STRETCH)).alias("times"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in (part for batch in batches for part in few(batch)):
            key = np.repeat(rows["key"].to_numpy(), rows["times"])
            times = rows["times"].to_numpy()
            occurrence = np.arange(len(key)) - np.repeat(np.cumsum(times) - times - rows["base"].to_numpy(), times)
            shard = np.searchsorted(lows, key, side="right") - 1
            again = (shard >= 0) & (lows[shard] == key) & (first[shard] > occurrence)
            while again.any():
                shard[again] -= 1
                again = (shard >= 0) & (lows[shard] == key) & (first[shard] > occurrence)
            keep = shard >= 0
            yield pd.DataFrame({"shard": shard[keep], "key": key[keep], "occurrence": occurrence[keep]})

    def few(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows that ask for no more than about 16 stretches together."""
        part = (np.cumsum(batch["times"].to_numpy()) - 1) // (16 * STRETCH)
        for at in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
            yield batch.iloc[at]

    def read(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        store, base = pafs.FileSystem.from_uri(folder)
        number = int(group[0])
        with store.open_input_file(f"{base}/{names[number]}.idx") as f:
            index = Index(f.read())
        key = rows["key"].to_numpy()
        there, offset, length = index.find(key_hash(key, rows["occurrence"].to_numpy()))
        key, offset, length = key[there], offset[there], length[there]
        crc = np.empty(len(key), np.int64)
        with store.open_input_file(f"{base}/{names[number]}.bin") as f:
            for i in np.argsort(offset, kind="stable"):
                f.seek(int(offset[i]) * index.width)
                ids = np.frombuffer(f.read(int(length[i]) * index.width), f"<u{index.width}")
                crc[i] = zlib.crc32(ids.astype("<u4").tobytes())
        out = pd.DataFrame({"doc_id": pd.array(key, "Int64"), "start": starts[number] + offset, "n_tokens": length, "ids_crc32": crc})
        out.loc[out["doc_id"] == NULL_KEY, "doc_id"] = pd.NA
        return out

    # As many parts as shards: a count of our own isn't merged, so shards are read side by side.
    asked = home.mapInPandas(route, "shard long, key long, occurrence long").repartition(min(len(shards), MOST_PARTS), "shard")
    return asked.groupBy("shard").applyInPandas(read, schema)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents, then reads every one back through the index."""
    scratch = Scratch(spark, "token-output")
    docs, folder = documents(spark, sf_dir), scratch.path("shards")
    manifest = scratch.write(write_shards(docs, folder), "manifest")
    return lookup(docs, manifest, folder)
