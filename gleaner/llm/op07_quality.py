"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated temperature.

Random indexing. Each word, by hash one of VOCABULARY buckets, has a fixed random index vector of -1, 0 and 1. One pass over all
texts adds to each word's context vector the index vectors of its neighbours; no word pair is ever stored, and the matrix
has the same size for any corpus. A document is the mean of its words' context vectors, beside its length, the
length of the mean (near 1 where a text repeats few words) and mean shape vectors of its words (case, digits, marks).

Network. A tanh layer and a sigmoid, fit by numpy on a bounded sample of labelled rows (about TRAIN_ROWS: all up to that number, else those whose hashed id lies below the
bound that this share of all gives), part of which is left out to choose the temperature. Scores of all documents come from one more pass. Language, source, ids and
labels are never inputs.

Nulls and odd input: a null text counts as empty; empty texts get the score the network gives to no words; a null doc_id is held out of
training and marked not held_out; null labels teach nothing; of repeated rows each is scored; with no label or one class only, every score is the share of label 1 (1 without labels);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, binary_rows, documents, forget, pieces, text_bytes, without_clashes
from gleaner.llm.kernels import IS_SPACE, words

VOCABULARY, WIDTH, SHAPES, REACH = 1 << 16, 32, 64, 2
#: Labelled rows the network is fit on, and the range of the hashes that choose them.
TRAIN_ROWS = 20_000
HASHES = 1 << 30
HIDDEN, EPOCHS, RATE, DECAY, SEED = 32, 60, 0.01, 1e-4, 7
THRESHOLD = 0.3
#: Bytes of text a worker takes at a time: arrays of eight bytes for each of them stay in its process.
PIECE = 1 << 19
FEATURES = WIDTH + SHAPES + 4


def index_vectors() -> np.ndarray:
    """WIDTH x VOCABULARY, a quarter of the entries not zero."""
    return np.random.default_rng(SEED).choice(np.array([-1, 0, 0, 0, 0, 0, 0, 1], np.int8), (WIDTH, VOCABULARY))


def sketch(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and shape of every word, the number of each row's first word, and each row's bytes."""
    data, offsets = text_bytes(batch.column(column))
    hashes, start, end, first = words(data, offsets, lower=True, quick=True)

    def few(kind: np.ndarray) -> np.ndarray:
        """Bytes of a kind in each word, at most two."""
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind, out=sums[1:])
        return np.minimum(sums[end] - sums[start], 2)

    upper, digit = few((data >= 65) & (data <= 90)), few((data >= 48) & (data <= 57))
    mark = few((data < 128) & ~IS_SPACE[data] & ~(((data | 32) >= 97) & ((data | 32) <= 122)) & ~((data >= 48) & (data <= 57)))
    long_ = np.digitize(end - start, (3, 12)) % 2
    shape = ((upper * 3 + digit) * 3 + mark) * 2 + long_
    return (hashes >> np.uint64(48)).astype(np.int64) % VOCABULARY, shape, first, np.diff(offsets)


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The context matrix over all texts, WIDTH x VOCABULARY, rows centred and columns of length 1. Each task sends one partial sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        index, total, any_ = index_vectors(), np.zeros((WIDTH, VOCABULARY)), False
        for batch in batches:
            for piece in pieces(batch, 0, PIECE):
                bucket, _, first, _ = sketch(piece, 0)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                any_ = any_ or len(bucket) > 0
                # 1 where the word so many steps on is in the same text; sums of 2 * REACH entries fit a byte.
                near = [(step, (row[step:] == row[:-step]).astype(np.int8)) for step in range(1, REACH + 1)]
                for k in range(WIDTH):
                    own = index[k][bucket]
                    seen = np.zeros(len(bucket), np.int8)
                    for step, both in near:
                        seen[:-step] += own[step:] * both
                        seen[step:] += own[:-step] * both
                    total[k] += np.bincount(bucket, weights=seen, minlength=VOCABULARY)
        for k in range(WIDTH) if any_ else ():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([k], pa.int32()), "sums": pa.array([total[k].astype(np.float32).tobytes()], pa.binary())})

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(VOCABULARY)
        for x in rows["sums"]:
            total += np.frombuffer(x, np.float32)
        return pd.DataFrame({"dim": [key[0]], "sums": [total.astype(np.float32).tobytes()]})

    own = without_clashes(docs, text_col)
    partial = own.mapInArrow(add, "dim int, sums binary").withColumn("part", F.spark_partition_id())
    # A tree of two levels: no group adds up more partial sums than the square root of the number of tasks.
    branches = max(1, int(np.ceil(np.sqrt(own.rdd.getNumPartitions()))))
    partial = partial.withColumn("branch", F.col("part") % branches).groupBy("dim", "branch").applyInPandas(merge, "dim int, sums binary")
    out = np.zeros((WIDTH, VOCABULARY), np.float32)
    for x in partial.groupBy("dim").applyInPandas(merge, "dim int, sums binary").collect():  # WIDTH rows of VOCABULARY sums
        out[x["dim"]] = np.frombuffer(x["sums"], np.float32)
    out = np.sign(out) * np.sqrt(np.abs(out))
    out /= np.maximum(np.sqrt((out**2).sum(axis=0)), 1e-9)
    return out


def pooled(docs: DataFrame, context: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and features (FEATURES float32 values as bytes) of every text. The closure carries the context matrix, of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(context)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        vectors = shared.value
        for batch in batches:
            for piece in pieces(batch, 1, PIECE):
                bucket, shape, first, size = sketch(piece, 1)
                n = np.diff(first)
                full = np.flatnonzero(n)
                out = np.zeros((len(n), FEATURES), np.float32)
                for k in range(WIDTH):
                    if len(full):
                        out[full, k] = np.add.reduceat(vectors[k][bucket], first[full]) / n[full]
                row = np.repeat(np.arange(len(n)), n)
                counts = np.bincount(row * SHAPES + shape, minlength=len(n) * SHAPES).reshape(len(n), SHAPES)
                out[:, WIDTH : WIDTH + SHAPES] = counts / np.maximum(n, 1)[:, None]
                # Distinct buckets tell texts that repeat themselves from those that don't.
                kinds = np.bincount(np.unique(row * VOCABULARY + bucket) // VOCABULARY, minlength=len(n)) if len(row) else np.zeros(len(n))
                out[:, -4] = np.log1p(n)
                out[:, -3] = np.sqrt((out[:, :WIDTH] ** 2).sum(axis=1))
                out[:, -2] = kinds / np.maximum(n, 1)
                out[:, -1] = np.log1p(size / np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([piece.column(0), binary_rows(out.ravel(), np.arange(len(n) + 1) * FEATURES)], names=["doc_id", "features"])

    return without_clashes(docs, id_col, text_col).toDF("doc_id", "text").mapInArrow(pool, "doc_id long, features binary")


class Network:
    """Standardised features, a tanh layer, a sigmoid, and a temperature chosen on rows that weren't trained on."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.share = float(y.mean()) if len(y) else 1.0
        self.constant = len(y) == 0 or y.min() == y.max()
        if self.constant:
            return
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        test = np.arange(len(y)) % 5 == 0
        if len(np.unique(y[~test])) < 2 or not test.any():
            test[:] = False
        fit_x, fit_y = x[~test], y[~test]
        self.weights = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(fit_y))
            for at in range(0, len(order), 256):
                rows = order[at : at + 256]
                step += 1
                for i, g in enumerate(self._gradient(fit_x[rows], fit_y[rows])):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.weights[i] = self.weights[i] - RATE * (first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8) + DECAY * self.weights[i])
        held_x, held_y = (x[test], y[test]) if test.any() else (fit_x, fit_y)
        logit = self._logit(held_x)
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, np.where(held_y == 1, -logit, logit) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(x @ w1 + b1) @ w2 + b2[0]

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w1, b1, w2, b2 = self.weights
        h = np.tanh(x @ w1 + b1)
        d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -30, 30))) - y) / len(y)
        back = np.outer(d, w2) * (1 - h * h)
        return [x.T @ back, back.sum(axis=0), h.T @ d, np.array([d.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -30, 30)))


def held_out() -> F.Column:
    """Rows of the held-out fold: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. ``labels`` has doc_id and quality; about ``train_rows`` of them at most are used."""
    scratch = Scratch(docs.sparkSession, "quality")
    features = scratch.write(pooled(docs, context_vectors(docs, text_col), id_col, text_col), "features")
    taught = without_clashes(labels, "doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # The bound is chosen first, so that tasks send the driver no more than the sample.
    bound = min(HASHES, HASHES * train_rows // max(taught.count(), 1))
    sample = scratch.write(taught.filter(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) < bound).join(features, "doc_id"), "sample").toPandas()
    sample = sample.sort_values(["doc_id", "features"])
    x = np.frombuffer(b"".join(sample["features"]), np.float32).reshape(len(sample), FEATURES).astype(np.float64)
    model = Network(x, sample["quality"].to_numpy(float))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(batch.num_rows, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x.astype(np.float64)))], names=["doc_id", "score"])

    scored = scratch.write(features.mapInArrow(judge, "doc_id long, score double"), "scores")
    scratch.keep("scores")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
