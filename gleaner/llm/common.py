"""What the operators of this subpackage share: tables in the shared folder, and slicing of Arrow batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where unset and Spark is one process (tests), one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gleaner.scratch.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-gleaner-", dir="/tmp")
        spark.conf.set("gleaner.scratch.dir", path)
    return path.rstrip("/") if "://" in path or path.startswith("file:") else "file://" + path.rstrip("/")


class Scratch:
    """Tables written by one run of one operator. They cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it back; shuffle files of the stages behind it may go."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        self.names.add(name)
        out = self.spark.read.schema(df.schema).parquet(self.path(name))
        del df
        self.release()
        return out

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        self.drop(*(self.names - {*names}))

    def release(self) -> None:
        """Lets Spark's cleaner see that shuffles of finished stages are unreachable, so their files go now."""
        gc.collect()
        self.spark._jvm.System.gc()


#: What operators keep in a worker process for its next task, such as vocabularies.
_caches: list[dict] = []


def worker_cache() -> dict:
    _caches.append({})
    return _caches[-1]


def forget() -> None:
    """Empties these caches. Spark's worker processes live on from stage to stage, and what one operator keeps adds to what the next one needs."""
    for cache in _caches:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def without_clashes(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator needs, so that extra ones can't clash with its own."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def pieces(batch: pa.RecordBatch, column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer single row stays whole."""
    if not batch.num_rows:
        return
    offsets = text_bytes(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row starts (one entry more than rows). Null: empty."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, where, data = array.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32, array.offset + len(array) + 1)[array.offset :].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value for each row: ``values[offsets[i]:offsets[i + 1]]`` as raw bytes."""
    width = values.dtype.itemsize
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.asarray(offsets, np.int64) * width), pa.py_buffer(data)]).cast(pa.binary())


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows that never part rows of one key (the first ``keys`` columns), by which the input stands in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            if sum(x.num_rows for x in held) < rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            differs = np.zeros(table.num_rows - 1, bool)
            for i in range(keys):
                key = table.column(i).to_numpy()
                differs |= key[1:] != key[:-1]
            last = np.flatnonzero(differs)[-1:] + 1
            if len(last):
                yield from table.slice(0, int(last[0])).to_batches()
            held = table.slice(int(last[0]) if len(last) else 0).to_batches()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
