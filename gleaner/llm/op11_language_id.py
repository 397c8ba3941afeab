"""Language identification by words, with spans of mixed-language texts.

A text is cut into words: runs of letters of one script (longer runs every WORD letters). The script, told by ranges of code points, narrows the languages
that a word may be of to those that write at least SHARE of their letters in it. Each remaining language scores a word by the smoothed
log-probabilities of its character pieces (one to ORDERS letters, with word ends) and of the word as a whole, hashed into BUCKETS for each kind. A Viterbi pass over the
words of a text, with a penalty for each switch, then labels spans. The prediction is the language with most letters, and its score their share.

Learning counts pieces over all labelled texts: a task sends the buckets of the languages that it met, and they are added up in a tree of two levels. The
model is one row of buckets for each language (about 0.7 MB) and passes through the driver; nothing in it grows with the number of texts.

The Viterbi pass runs over many texts at once. Texts are cut into blocks of BLOCK words; all blocks run side by side, first from each possible language
before them, which gives a table a block and so the languages between blocks, then once more from the language that was found. A text of a million words therefore costs no long chain of steps.

Nulls and odd input: null texts and texts without a letter are ``und`` with score 0, as all are where nothing could be learned; rows without a language are not learned from; null and
repeated doc_ids pass through (a null id is never held out); ties go to the smaller language value; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, pieces, text_bytes, without_clashes
from gleaner.llm.kernels import BASE, MIX_1, mix, quick_hash, quick_sums

WORD, ORDERS, BUCKETS, SMOOTHING = 24, 4, 1 << 15, 0.1
#: Words are looked at by groups of these lengths.
LENGTHS = (0, 3, 5, 8, 12, WORD)
#: Share of a language's letters that makes a script one of its own.
SHARE = 0.01
#: Cost of a switch between languages, in units of log-probability, and the cost of a word in a language that doesn't use its script.
SWITCH, FOREIGN = 8.0, 1000.0
BLOCK, STATES = 64, 1 << 22
#: Bytes of text looked at together.
PIECE = 1 << 20
UNKNOWN = "und"
#: Where scripts begin; each range ends where the next begins. 0 is anything else.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"),
    (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "cherokee"), (0x1400, "syllabics"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"),
    (0x2E00, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "yi"), (0xA4D0, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})
KINDS = ORDERS + 1
WIDTH = KINDS * BUCKETS + len(NAMES)
#: Buckets of a slice of a language's row on its way to the driver.
SLICE = 1 << 13

_tables: dict[str, np.ndarray] = {}


def tables() -> dict[str, np.ndarray]:
    """By code point: 1 for letters and 2 for marks that stand on them, the lower-case code point, the script's number."""
    if not _tables:
        kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            category = unicodedata.category(chr(c))[0]
            if category in "LM":
                kind[c] = 1 if category == "L" else 2
                small = chr(c).lower()
                if len(small) == 1:
                    lower[c] = ord(small)
        starts = np.array([at for at, _ in SCRIPTS])
        script = np.array([NAMES.index(name) for _, name in SCRIPTS], np.uint8)[np.searchsorted(starts, np.arange(0x110000), side="right") - 1]
        _tables.update(kind=kind, lower=lower, script=script)
    return _tables


class Words:
    """The words of a batch of texts: where they begin and end (characters of all texts end to end), each one's script and row, and its distinct forms."""

    def __init__(self, batch: pa.RecordBatch, column: int):
        data, offsets = text_bytes(batch.column(column))
        try:
            text = data.tobytes().decode()
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        except UnicodeDecodeError:
            texts = [data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(offsets, offsets[1:])]
            text, chars = "".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        known = tables()
        kind, script = known["kind"][code], known["script"][code]
        # A mark belongs to what it stands on, within its text.
        at, edges = np.arange(len(code)), chars[:-1][np.diff(chars) > 0]
        floating = kind == 2
        floating[edges] = False
        base = np.maximum.accumulate(np.where(floating, 0, at))
        script, inside = script[base], kind[base] == 1
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (script[1:] != script[:-1])
        begins[edges] = inside[edges]
        nth = at - np.maximum.accumulate(np.where(begins, at, 0))
        self.start = np.flatnonzero(inside & (begins | (nth % WORD == 0)))
        ends = np.ones(len(code) + 1, bool)
        ends[:-1] = ~inside
        ends[self.start] = True
        ends[edges] = True
        stops = np.flatnonzero(ends)
        self.end = stops[np.searchsorted(stops, self.start, side="right")] if len(self.start) else self.start
        self.script = script[self.start]
        self.first = np.searchsorted(self.start, chars)
        self.row = np.repeat(np.arange(batch.num_rows), np.diff(self.first))
        self.chars = chars
        self.code = known["lower"][code]
        # No word is long enough for structured strings to collide.
        hashes = quick_hash(quick_sums(mix(self.code.astype(np.uint64) + np.uint64(1))), self.start, self.end)
        self.forms, self.at, self.form = np.unique(hashes, return_index=True, return_inverse=True)

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Buckets of the pieces of distinct words, KINDS * BUCKETS where a word has fewer: some of the words, and a row of buckets for each. Words of like length come together."""
        sizes, whole = (self.end - self.start)[self.at], (self.forms >> np.uint64(49)).astype(np.int32) + ORDERS * BUCKETS
        for low, high in zip(LENGTHS, LENGTHS[1:]):
            mine = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(mine):
                continue
            size, width = sizes[mine], high + 2
            grid = np.zeros((len(mine), width), np.uint64)
            spot = np.arange(high)
            spelled = self.code[np.minimum(self.start[self.at[mine]][:, None] + spot, len(self.code) - 1)].astype(np.uint64) + np.uint64(2)
            grid[:, 1:-1] = np.where(spot < size[:, None], spelled, np.uint64(0))
            grid[:, 0] = 1
            grid[np.arange(len(mine)), size + 1] = 1
            out, rolled = [whole[mine][:, None]], np.zeros_like(grid)
            for n in range(ORDERS):
                # Pieces of n + 1 places that begin at each place; a word's ends are no piece by themselves.
                rolled = rolled[:, : width - n] * np.uint64(BASE) + grid[:, n:]
                at = np.arange(width - n)
                there = at + n < (size + 2)[:, None] if n else (at >= 1) & (at <= size[:, None])
                out.append(np.where(there, ((rolled * np.uint64(MIX_1)) >> np.uint64(49)).astype(np.int32) + n * BUCKETS, KINDS * BUCKETS))
            yield mine, np.concatenate(out, axis=1)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Counts of WIDTH buckets for each language of (text, lang): pieces by kind, then letters by script."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch, 0, PIECE):
                words, langs = Words(piece, 0), piece.column(1).to_pylist()
                names = sorted(set(langs))
                numbers = {x: k for k, x in enumerate(names)}
                lang = np.array([numbers[x] for x in langs], np.int64)[words.row]
                times = np.bincount(words.form * len(names) + lang, minlength=len(words.forms) * len(names)).reshape(-1, len(names))
                features = list(words.features())
                for k, name in enumerate(names):
                    mine = lang == k
                    total = totals.setdefault(name, np.zeros(WIDTH))
                    total[KINDS * BUCKETS :] += np.bincount(words.script[mine], weights=(words.end - words.start)[mine], minlength=len(NAMES))
                    for forms, own in features:
                        used = np.flatnonzero(times[forms, k])
                        own = own[used]
                        total[: KINDS * BUCKETS] += np.bincount(own.ravel(), weights=np.repeat(times[forms[used], k], own.shape[1]), minlength=KINDS * BUCKETS + 1)[:-1]
        for name, total in totals.items():
            for at in range(0, WIDTH, SLICE):
                if total[at : at + SLICE].any():
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name]), "at": pa.array([at], pa.int32()), "counts": pa.array([total[at : at + SLICE].astype("<f8").tobytes()], pa.binary())})

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "at": [key[1]], "counts": [sum(np.frombuffer(x, "<f8") for x in rows["counts"]).tobytes()]})

    own = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    schema = "lang string, at int, counts binary"
    partial = own.mapInArrow(count, schema).withColumn("part", F.spark_partition_id())
    branches = max(1, int(np.ceil(np.sqrt(own.rdd.getNumPartitions()))))
    partial = partial.withColumn("branch", F.col("part") % branches).groupBy("lang", "at", "branch").applyInPandas(merge, schema)
    model: dict[str, np.ndarray] = {}
    for x in partial.groupBy("lang", "at").applyInPandas(merge, schema).collect():  # WIDTH / SLICE rows a language
        model.setdefault(x["lang"], np.zeros(WIDTH))[x["at"] : x["at"] + SLICE] = np.frombuffer(x["counts"], "<f8")
    return {k: v for k, v in model.items() if v[KINDS * BUCKETS :].any()}


class Model:
    """Log-probabilities of pieces, and which languages a script leaves."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        table = np.array([counts[x] for x in self.langs]).reshape(len(self.langs), WIDTH)
        kinds = table[:, : KINDS * BUCKETS].reshape(len(self.langs), KINDS, BUCKETS)
        logs = np.log(kinds + SMOOTHING) - np.log(kinds.sum(axis=2, keepdims=True) + SMOOTHING * BUCKETS)
        # A row for each bucket, and one of zeros for no piece.
        self.logs = np.zeros((KINDS * BUCKETS + 1, len(self.langs)), np.float32)
        self.logs[:-1] = logs.reshape(len(self.langs), KINDS * BUCKETS).T / KINDS
        letters = table[:, KINDS * BUCKETS :]
        writes = letters >= SHARE * letters.sum(axis=1, keepdims=True)
        self.foreign = np.where(writes | ~writes.any(axis=0), 0, FOREIGN).T.astype(np.float32)

    def scores(self, words: Words) -> np.ndarray:
        """A row for each word, a column for each language."""
        own = np.zeros((len(words.forms), len(self.langs)), np.float32)
        for forms, buckets in words.features():
            for column in buckets.T:
                own[forms] += self.logs[column]
        return own[words.form] - self.foreign[words.script]


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word: ``first[i]`` is text i's first word (one entry more than texts)."""
    n, states = scores.shape
    if not n or states == 1:
        return np.zeros(n, np.int64)
    count = np.diff(first)
    blocks = -(-count // BLOCK)
    owner, start = np.repeat(np.arange(len(count)), blocks), np.cumsum(blocks) - blocks
    nth = np.arange(len(owner)) - start[owner]
    begin = first[owner] + nth * BLOCK
    size = np.minimum(first[owner + 1] - begin, BLOCK)

    def forward(which: np.ndarray, entry: np.ndarray, back: np.ndarray | None) -> np.ndarray:
        """Best sums at the ends of blocks, from entry sums; ``back`` takes the language before each word."""
        value = entry
        for t in range(BLOCK):
            live = size[which] > t
            best = value.max(axis=-1, keepdims=True)
            moved = best - switch
            stays = value >= moved
            if back is not None:
                back[t, which] = np.where(stays[:, 0], np.arange(states), value[:, 0].argmax(axis=-1)[:, None])
            here = np.where(stays, value, moved) + scores[np.minimum(begin[which] + t, n - 1)][:, None, :]
            value = np.where(live[:, None, None], here, value)
        return value

    # Tables of blocks: from each language before to each at the end. Starting sums keep all but one language out.
    table = np.empty((len(owner), states, states), np.float32)
    out = np.where(np.eye(states, dtype=bool), 0, -1e30).astype(np.float32)
    step = max(1, STATES // (states * states))
    inner = np.flatnonzero(nth + 1 < blocks[owner])  # nothing follows a text's last block
    for at in range(0, len(inner), step):
        which = inner[at : at + step]
        table[which] = forward(which, np.broadcast_to(out, (len(which), states, states)), None)
    # Block by block through each text, all texts side by side; a text may begin in any language.
    enter = np.zeros((len(owner), states), np.float32)
    deep, by_length = int(blocks.max()), np.argsort(-blocks, kind="stable")
    longer = len(blocks) - np.searchsorted(np.sort(blocks), np.arange(deep + 1), side="right")
    for k in range(deep - 1):
        here = start[by_length[: longer[k + 1]]] + k
        sums = (enter[here][:, :, None] + table[here]).max(axis=1)
        enter[here + 1] = sums - sums.max(axis=1, keepdims=True)
    # Once more from what enters each block, keeping the language before each word; then, for each language at a block's end, the one before the block.
    back = np.zeros((BLOCK, len(owner), states), np.uint8 if states < 256 else np.int32)
    ended = forward(np.arange(len(owner)), enter[:, None, :], back)[:, 0]
    lead = np.broadcast_to(np.arange(states), ended.shape)
    for t in range(BLOCK - 1, -1, -1):
        lead = np.where((size > t)[:, None], np.take_along_axis(back[t], lead, axis=1), lead)
    final = np.zeros(len(owner), np.int64)
    ends = start[blocks > 0] + blocks[blocks > 0] - 1
    final[ends] = ended[ends].argmax(axis=1)
    for k in range(deep - 1, 0, -1):
        here = start[by_length[: longer[k]]] + k
        final[here - 1] = lead[here, final[here]]
    path, now = np.zeros(n, np.int64), final
    for t in range(BLOCK - 1, -1, -1):
        live = np.flatnonzero(size > t)
        path[begin[live] + t] = now[live]
        now[live] = back[t, live, now[live]]
    return path


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans (array of start, end, lang; ends in characters, the end excluded) of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs, names = len(model.langs), pa.array(model.langs, pa.string())
        for batch in batches:
            for piece in pieces(batch, 1, PIECE):
                rows = piece.num_rows
                words = Words(piece, 1) if langs else None
                n = len(words.start) if langs else 0
                if not n:
                    empty = pa.ListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int32)), pa.array([], schema.field("spans").type.value_type))
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([UNKNOWN] * rows, pa.string()), pa.array(np.zeros(rows)), empty], schema=schema)
                    continue
                path = viterbi(model.scores(words), words.first, switch)
                letters = np.bincount(words.row * langs + path, weights=words.end - words.start, minlength=rows * langs).reshape(rows, langs)
                total, best = letters.sum(axis=1), letters.argmax(axis=1)
                score = letters[np.arange(rows), best] / np.maximum(total, 1)
                pred = pa.compute.if_else(pa.array(total > 0), names.take(pa.array(best)), UNKNOWN)
                first = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (words.row[1:] != words.row[:-1])])
                last = np.r_[first[1:], n] - 1
                origin = words.chars[words.row[first]]
                spans = pa.StructArray.from_arrays([pa.array((words.start[first] - origin).astype(np.int32)), pa.array((words.end[last] - origin).astype(np.int32)), names.take(pa.array(path[first]))], fields=list(schema.field("spans").type.value_type))
                starts = np.searchsorted(words.row[first], np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column(0), pred, pa.array(score), pa.ListArray.from_arrays(pa.array(starts), spans)], schema=schema)

    return without_clashes(docs, id_col, text_col).toDF("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def held_out() -> F.Column:
    """Rows of the held-out fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = Model(learn(docs.filter(~held_out())))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
