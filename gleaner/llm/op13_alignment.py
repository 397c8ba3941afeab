"""How two tokenizers cut the same texts, and which of their tokens go together.

A text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B). Where a token of each ends at one byte, the two are linked, and
these places cut both sequences into groups that spell the same bytes. A pair of ids counts as often as it is linked in the whole corpus.

Neither vocabulary joins tokens over a single space between two other characters: A's pattern begins a new word with the space, and no piece of B has
one after another character (checked when a vocabulary is loaded; else texts stay whole). So a text is the segments between such spaces end to end, groups included, and a worker
encodes and links a segment once while it remembers it.

Counting is by stripes of B ids, dealt in turn (id modulo STRIPES). A task that encodes texts lists the different pairs of each chunk of about
CHUNK_BYTES once, in stripe order, with their counts, and stores a document's links as places in that list; so a pair that every document holds
is one entry a chunk, no stripe is hot, and no link is shuffled by its pair. A stripe's counts are added up with ``np.add.at`` into a dense block
of its B ids by all A ids (at most STRIPE_CELLS cells), whose row maxima tell each B id's best A ids. The chunks' lists visit the blocks to
learn counts and maxima, then go back to the links of their chunk, which are summed there, document by document.

Nulls and odd input: texts that are null, empty, not UTF-8, or that a vocabulary doesn't spell byte for byte (with the space it puts before
them) have no tokens: zeros and an empty string. Null and repeated doc_ids pass through, each row counted for itself; an empty table gives an empty
result; other columns are ignored. Special tokens' strings inside texts are ordinary text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm.common import Scratch, documents, pieces, text_bytes, without_clashes

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text of a chunk, stripes of B ids, and the most cells that a stripe's block may have.
CHUNK_BYTES, STRIPES, STRIPE_CELLS = 4 << 20, 512, 1 << 24
#: Segments of a generation that a worker remembers, the longest of them, and characters that are encoded at once. When a generation is full, the one before is forgotten.
MEMO, MEMO_CHARS, AT_ONCE = 220_000, 100, 1 << 16
#: Texts of these letters alone are split and merged alike by both libraries that know A's vocabulary form, so the faster one takes them.
PLAIN = re.compile("[\\x00-\u024f]{1,%d}" % MEMO_CHARS)
#: A space between characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Chunks whose lists visit one copy of a stripe's block.
VISITS = 4096
#: Lists of a stripe after which a task forgets which cells it met twice.
MOST_MET = 512
#: Bits of an id within a pair.
ID_BITS = 18

DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: A row is a document's (links: places in its chunk's list) or a stretch of a chunk's list (first: its first place).
ENCODED = f"{DOCUMENT}, chunk long, links binary, stripe int, first int, cells binary, n binary"

_coders: dict[tuple[str, str], Coders] = {}


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies spell bytes: printable ones as themselves, the others from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return {chr(b) if b in printable else chr(next(others)): b for b in range(256)}


class Coders:
    """Both vocabularies in a worker: ids of texts, and the bytes and decimal names of ids."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        spelled, vocabulary = byte_characters(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(spelled[c] for c in entry) if all(c in spelled for c in entry) else entry.encode()
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        kind = json.loads(self.a.to_str())
        pattern = (kind.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and kind["pre_tokenizer"].get("use_regex", True) and not kind.get("normalizer")
        self.cuts = pattern and not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        # Where ids number the merges in order, ranks are ids.
        merges = [x if isinstance(x, list) else x.split(" ") for x in kind["model"].get("merges", [])]
        self.quick = None
        if pattern and all(vocabulary.get(left + right) == 256 + n for n, (left, right) in enumerate(merges)):
            ranks = {self.a_bytes[i]: i for i in range(256 + len(merges))}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memo: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}
        # The name of an id as it stands within a group, and as the last of its side there.
        self.names = [f"{i}{mark}" for table, last in ((self.a_bytes, "|"), (self.b_bytes, ";")) for mark in (",", last) for i in range(len(table))]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text in both vocabularies; none of either where one doesn't spell it."""
        a: list = [self.quick(f" {t}") if self.quick and PLAIN.fullmatch(t) else None for t in texts]
        rest = [i for i, x in enumerate(a) if x is None]
        for i, x in zip(rest, self.a.encode_batch_fast([f" {texts[i]}" for i in rest], add_special_tokens=False) if rest else [], strict=True):
            a[i] = x.ids
        b = self.b.encode(texts, num_threads=1) if texts else []
        for i, x in enumerate(texts):
            want = f" {x}".encode()
            if b"".join(map(self.a_bytes.__getitem__, a[i])) != want or b"".join(map(self.b_bytes.__getitem__, b[i])) != want:
                a[i], b[i] = [], []
        return a, b

    def segments(self, text: str) -> list[str]:
        return CUT.split(text) if self.cuts else [text]

    def learn(self, segments: set[str]) -> None:
        """Puts segments into the memo: ids of A and of B, links, groups, and the links' ids as bytes. No ids: not spelled."""
        if len(self.memo) > MEMO:
            self.memo, self.before = {}, self.memo
        new = segments - self.memo.keys()
        known = new & self.before.keys()
        self.memo.update((x, self.before[x]) for x in known)
        batch, size = [], 0
        for x in new - known:
            batch.append(x)
            size += len(x)
            if size > AT_ONCE:
                self.meet(batch)
                batch, size = [], 0
        self.meet(batch)

    def meet(self, batch: list[str]) -> None:
        a, b = self.encode(batch)
        of_a, of_b, first, groups = linked(self, a, b)
        pairs = ((of_b << ID_BITS) | of_a).astype("<i8").tobytes()
        for i, x in enumerate(batch):
            self.memo[x] = (len(a[i]), len(b[i]), int(first[i + 1] - first[i]), groups[i], pairs[8 * first[i] : 8 * first[i + 1]])

    def forget_long(self, segments: set[str]) -> None:
        for x in segments:
            if len(x) > MEMO_CHARS:
                self.memo.pop(x, None)

    def text(self, text: str | None) -> tuple[int, int, int, str, bytes]:
        """Ids of A and of B, links, digest of groups, and pairs of a text whose segments are learnt."""
        if not text:
            return 0, 0, 0, "", b""
        n_a, n_b, n, groups, pairs = zip(*map(self.memo.__getitem__, self.segments(text)))
        if 0 in n_a:
            return 0, 0, 0, "", b""
        return sum(n_a), sum(n_b), sum(n), hashlib.sha256(";".join(groups).encode()).hexdigest(), b"".join(pairs)


def coders(a_path: str, b_path: str) -> Coders:
    if (a_path, b_path) not in _coders:
        _coders[a_path, b_path] = Coders(a_path, b_path)
    return _coders[a_path, b_path]


def sizes(a_path: str, b_path: str) -> tuple[int, int]:
    """Ids of A, and B ids in a stripe."""
    a, b = Tokenizer.from_file(a_path).get_vocab_size(with_added_tokens=True), sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    height = -(-b // STRIPES)
    if height * a > STRIPE_CELLS or a >= 1 << ID_BITS:
        raise ValueError(f"vocabularies of {a} and {b} ids need more than {STRIPE_CELLS} cells a stripe")
    return a, height


def linked(code: Coders, a: list[list[int]], b: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(A id, B id) of every link of many texts in order, where each text's links begin (one entry more than texts), and the spelling of their groups."""
    of = lambda x: np.fromiter((i for ids in x for i in ids), np.int64, sum(map(len, x)))
    ids_a, ids_b = of(a), of(b)
    from_a, from_b = (np.concatenate([[0], np.cumsum([len(x) for x in side])]).astype(np.int64) for side in (a, b))
    # Texts stand end to end; both sides end together at the end of each, so no group runs over it.
    end_a, end_b = np.cumsum(code.a_size[ids_a]), np.cumsum(code.b_size[ids_b])
    who = np.full((int(end_a[-1]) if len(end_a) else 0) + 1, -1, np.int64)
    who[end_a] = np.arange(len(ids_a))
    at_b = np.flatnonzero(who[end_b] >= 0)
    at_a = who[end_b[at_b]]
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[at_a], last_b[at_b] = 1, 1
    n_a, n_b = len(code.a_size), len(code.b_size)
    # A token of A comes after all of B in earlier groups; one of B after all of A up to its own group.
    spelled = np.empty(len(ids_a) + len(ids_b), np.int64)
    spelled[np.arange(len(ids_a)) + np.repeat(np.r_[0, at_b[:-1] + 1][: len(at_b)], np.diff(np.r_[-1, at_a]))] = ids_a + last_a * n_a
    spelled[np.arange(len(ids_b)) + np.repeat(at_a + 1, np.diff(np.r_[-1, at_b]))] = 2 * n_a + ids_b + last_b * n_b
    spelled, begins = spelled.tolist(), (from_a + from_b).tolist()
    names = code.names.__getitem__
    groups = ["".join(map(names, spelled[i:j]))[:-1] for i, j in zip(begins, begins[1:])]
    return ids_a[at_a], ids_b[at_b], np.searchsorted(at_a, from_a), groups


def encode(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows ENCODED of (doc_id, text)."""
    columns, height = sizes(a_path, b_path)
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("chunk", pa.int64()), ("links", pa.binary()), ("stripe", pa.int32()), ("first", pa.int32()), ("cells", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, chunk = coders(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, 1, CHUNK_BYTES):
                data, offsets = text_bytes(piece.column(1))
                data = data.tobytes()
                texts = [decoded(data[i:j]) for i, j in zip(offsets, offsets[1:])]
                segments = {x for t in texts if t for x in code.segments(t)}
                code.learn(segments)
                n_a, n_b, count, digests, codes = zip(*map(code.text, texts), strict=True)
                code.forget_long(segments)
                codes, first = np.frombuffer(b"".join(codes), "<i8"), np.concatenate([[0], np.cumsum(count)])
                of_a, of_b = codes & ((1 << ID_BITS) - 1), codes >> ID_BITS
                # Stripe, then place in the stripe's block.
                key = (of_b % STRIPES) * (height * columns) + of_b // STRIPES * columns + of_a
                pairs, place, n = np.unique(key, return_inverse=True, return_counts=True)
                links = place.astype("<u4").tobytes()
                rows = {"doc_id": piece.column(0), "n_a": n_a, "n_b": n_b, "n_groups": count, "n_links": count, "groups_sha256": digests, "links": [links[4 * i : 4 * j] for i, j in zip(first, first[1:])]}
                yield filled(rows, piece.num_rows, schema, chunk)
                stripe = pairs // (height * columns)
                edges = np.flatnonzero(np.r_[True, stripe[1:] != stripe[:-1], True]) if len(pairs) else np.empty(0, np.int64)
                cells, n = (pairs % (height * columns)).astype("<u4").tobytes(), n.astype("<i8").tobytes()
                spans = list(zip(edges.tolist(), edges[1:].tolist()))
                rows = {"stripe": stripe[edges[:-1]].astype(np.int32), "first": edges[:-1].astype(np.int32), "cells": [cells[4 * i : 4 * j] for i, j in spans], "n": [n[8 * i : 8 * j] for i, j in spans]}
                if spans:
                    yield filled(rows, len(spans), schema, chunk)
                chunk += 1

    return docs.mapInArrow(run, ENCODED)


def decoded(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


def filled(rows: dict, n: int, schema: pa.Schema, chunk: int) -> pa.RecordBatch:
    """A batch with nulls in the columns that ``rows`` doesn't have."""
    rows = rows | {"chunk": np.full(n, chunk)}
    return pa.RecordBatch.from_arrays([rows[f.name] if isinstance(rows.get(f.name), pa.Array) else pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(n, f.type) for f in schema], schema=schema)


def together(df: DataFrame, *keys: str, then: tuple = ()) -> DataFrame:
    """Rows of one key in one partition, one key after another."""
    parts = max(df.sparkSession._jsc.sc().defaultParallelism(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *then)


def add_up(lists: DataFrame, cells: int, *keys: str) -> DataFrame:
    """One list (stripe, cells, n) for each key of lists (stripe, cells, n)."""
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now, met = np.zeros(cells, np.int64), None, []

        def close() -> pa.RecordBatch:
            at = np.unique(np.concatenate(met))
            met.clear()
            out = pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([block[at].astype("<i8").tobytes()], pa.binary())], names=["stripe", "cells", "n"])
            block[at] = 0
            return out

        for batch in batches:
            for i, key in enumerate(zip(*[batch.column(k).to_pylist() for k in range(width)], strict=True)):
                if now is not None and key != now:
                    yield close()
                now = key
                some = np.frombuffer(batch.column(width)[i].as_buffer(), "<u4")
                np.add.at(block, some, np.frombuffer(batch.column(width + 1)[i].as_buffer(), "<i8"))
                met.append(some)
                if len(met) >= MOST_MET:
                    met[:] = [np.unique(np.concatenate(met))]
        if now is not None:
            yield close()

    return together(lists.select(*keys, "cells", "n"), *keys).mapInArrow(run, "stripe int, cells binary, n binary")


def pair_counts(encoded: DataFrame, columns: int, height: int) -> DataFrame:
    """(stripe, cells, n): all pairs of the corpus, a row for each stripe, added up in two steps so that no task reads all chunks of a large corpus."""
    lists, branches = encoded.filter("stripe IS NOT NULL"), copies_for(encoded)
    if branches > 1:
        lists = add_up(lists.withColumn("branch", F.pmod("chunk", F.lit(branches))), columns * height, "stripe", "branch")
    return add_up(lists, columns * height, "stripe")


def copies_for(encoded: DataFrame) -> int:
    """One for each VISITS chunks."""
    return max(1, -(-encoded.select("chunk").distinct().count() // VISITS))


def best_pairs(counts: DataFrame, columns: int) -> DataFrame:
    """(b_id, a_id, n): for each B id the A ids that it is linked with most often, ties included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, stripe in enumerate(batch.column(0).to_pylist()):
                cells, n = np.frombuffer(batch.column(1)[i].as_buffer(), "<u4").astype(np.int64), np.frombuffer(batch.column(2)[i].as_buffer(), "<i8")
                row = cells // columns
                most = np.zeros(int(row.max()) + 1, np.int64)
                np.maximum.at(most, row, n)
                best = np.flatnonzero(n == most[row])
                yield pa.RecordBatch.from_arrays([pa.array(row[best] * STRIPES + stripe), pa.array(cells[best] % columns), pa.array(n[best])], names=["b_id", "a_id", "n"])

    return counts.mapInArrow(run, "b_id long, a_id long, n long")


def visited(encoded: DataFrame, counts: DataFrame, columns: int, height: int) -> DataFrame:
    """(chunk, first, n, best): each stretch of a chunk's list with the counts of its pairs, and whether they are their B id's highest."""
    copies = copies_for(encoded)
    salt = F.pmod("chunk", F.lit(copies)).cast("int")
    lists = encoded.filter("stripe IS NOT NULL").select("stripe", salt.alias("copy"), "chunk", "first", "cells", F.lit(None).cast("binary").alias("n"))
    blocks = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("first"), "cells", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, used, most = np.zeros(columns * height, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            chunks, firsts, out = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
            for i, chunk in enumerate(chunks):
                cells = np.frombuffer(batch.column(4)[i].as_buffer(), "<u4")
                if chunk < 0:  # a stripe's block comes before the lists that visit it
                    block[used] = 0
                    used = cells
                    block[used] = np.frombuffer(batch.column(5)[i].as_buffer(), "<i8")
                    most = block.reshape(height, columns).max(axis=1)
                    continue
                n = block[cells]
                out.append((chunk, firsts[i], n.astype("<i8").tobytes(), (n == most[cells // columns]).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "first", "n", "best"])

    return together(blocks.union(lists), "stripe", "copy", then=("chunk",)).mapInArrow(run, "chunk long, first int, n binary, best binary")


def summed(encoded: DataFrame, lists: DataFrame) -> DataFrame:
    """Each document's row with n_best and count_sum: its links look up their places in their chunk's list."""
    none = lambda kind: F.lit(None).cast(kind)
    docs = encoded.filter("stripe IS NULL").select("chunk", none("int").alias("first"), none("binary").alias("n"), none("binary").alias("best"), "links", *[c.split(" ")[0] for c in DOCUMENT.split(", ")])
    lists = lists.select("chunk", "first", "n", "best", none("binary").alias("links"), *[none(kind).alias(c) for c, kind in (x.split(" ") for x in DOCUMENT.split(", "))])
    names = [*docs.columns[5:], "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, bests, n, best = None, [], [], np.empty(0, np.int64), np.empty(0, bool)
        for batch in batches:
            rows, n_best, count_sum = [], [], []
            for i, (chunk, first) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if chunk != now:
                    now, counts, bests, n, best = chunk, [], [], np.empty(0, np.int64), np.empty(0, bool)
                if first is not None:  # stretches come in order, before the documents
                    counts.append(np.frombuffer(batch.column(2)[i].as_buffer(), "<i8"))
                    bests.append(np.frombuffer(batch.column(3)[i].as_buffer(), bool))
                    continue
                if counts:
                    n, best, counts, bests = np.concatenate(counts), np.concatenate(bests), [], []
                links = np.frombuffer(batch.column(4)[i].as_buffer(), "<u4")
                rows.append(i)
                n_best.append(int(best[links].sum()))
                count_sum.append(int(n[links].sum()))
            if rows:
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(5, batch.num_columns)], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=names)

    return together(docs.unionByName(lists), "chunk", then=(F.col("first").asc_nulls_last(),)).mapInArrow(run, f"{DOCUMENT}, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """A row per document (DOCUMENT, n_best, count_sum), and the best pairs (b_id, a_id, n) of the corpus."""
    a_path, b_path = a_path or public_tokenizers.path(A_VOCABULARY), b_path or public_tokenizers.path(B_VOCABULARY)
    scratch, (columns, height) = Scratch(docs.sparkSession, "alignment"), sizes(a_path, b_path)
    encoded = scratch.write(encode(without_clashes(docs, id_col, text_col).toDF("doc_id", "text"), a_path, b_path), "encoded")
    counts = scratch.write(pair_counts(encoded, columns, height), "counts")
    lists = scratch.write(visited(encoded, counts, columns, height), "lists")
    return summed(encoded, lists), best_pairs(counts, columns)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))[0].select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
