"""Kernels and per-task helpers without Spark."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import kernels, tokens
from gleaner.llm import op02_packing as packing
from gleaner.llm import op03_suffix_dedup as suffix
from gleaner.llm import op04_substring_dedup as substring
from gleaner.llm import op08_token_output as output
from gleaner.llm.common import text_bytes
from gleaner.llm.op10_exact_dedup import QuotientFilter


def test_words_are_ascii_white_space_words():
    rows = ["a b\tc", "", None, "  é x　y ", "a"]
    data, offsets = text_bytes(pa.array(rows))
    hashes, start, end, first = kernels.words(data, offsets)
    got = [[data[start[w] : end[w]].tobytes().decode() for w in range(first[i], first[i + 1])] for i in range(len(rows))]
    assert got == [["a", "b", "c"], [], [], ["é", "x　y"], ["a"]]
    assert hashes[0] == hashes[-1] and len(set(hashes.tolist())) == 5


def thue_morse(n, flip=0):
    return [(bin(i).count("1") + flip) % 2 for i in range(n)]


def test_structured_strings_get_hashes_of_their_own():
    for n in (1024, 2048, 4096):
        texts = ["".join("ab"[x] for x in thue_morse(n, flip)) for flip in (0, 1)]
        data, offsets = text_bytes(pa.array(texts))
        hashes = kernels.words(data, offsets)[0]
        assert len(hashes) == 2 and hashes[0] != hashes[1]
        # The same over words instead of letters.
        values = np.array([3 << 40, 5 << 50], np.uint64)[thue_morse(n) + thue_morse(n, 1)]
        a, b = kernels.window_hash(kernels.prefix_sums(values), np.array([0, n]), np.array([n, 2 * n]))
        assert a != b


def test_window_hashes_are_polynomials_modulo_a_prime():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2)
    start = rng.integers(0, 1900, 200)
    end = start + rng.integers(1, 100, 200)
    got, p = kernels.window_hash(kernels.prefix_sums(values), start, end), int(kernels.PRIME)
    for i in range(200):
        window = [int(x) for x in values[start[i] : end[i]]]
        low = sum((x & p) * pow(kernels.PRIME_BASES[0], j, p) for j, x in enumerate(window)) % p
        high = sum((x >> 33) * pow(kernels.PRIME_BASES[1], j, p) for j, x in enumerate(window)) % p
        assert got[i] == kernels.mix(np.array([low << 32 | high], np.uint64))[0]


def test_slices_of_batches_keep_their_texts():
    array = pa.array(["one", "two", None, "three"]).slice(1, 3)
    data, offsets = text_bytes(array)
    assert [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(3)] == [b"two", b"", b"three"]


def test_encoder_gives_the_ids_of_the_library():
    e = tokens.Encoder(tokens.default_path())
    texts = ["The cat, sat. ÇA va l'été d'Ünder «où» İstanbul ẞtraße don't x..,. áb é. naïve, œuf. ŒUF 12,5. 3.5 <|endoftext|> ..., 世界。hello ﬁ ½ \x1c a\x1cb", "", " \n", "a" * 3000, "Straße. STRASSE, été.. ÉTÉ,. x,"]
    for t in texts:
        assert np.frombuffer(e.encode(t.encode()), e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 3)
    e = tokens.Encoder(tokens.default_path())
    for t in ("one two three four", "five one six", "two two seven"):
        assert np.frombuffer(e.encode(t.encode()), e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 50, 200).astype(np.uint64) * np.uint64(0x0123456789ABCDEF) for _ in range(4)]
    whole = QuotientFilter.merge([QuotientFilter.build(p, 12) for p in parts])
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (whole.fingerprints() == values).all() and (whole.counts == counts).all()
    back = [QuotientFilter.from_bytes(12, *b.to_bytes()) for _, b in whole.blocks(4)]
    assert (QuotientFilter.merge(back).counts == counts).all()
    assert list(QuotientFilter.build(np.empty(0, np.uint64), 12).blocks(4)) == []


def test_perfect_hash_is_minimal_and_rejects_others():
    rng = np.random.default_rng(1)
    keys = rng.permutation(100_000)[:5000].astype(np.int64)
    h = output.key_hash(keys, np.zeros(len(keys), np.int64))
    slots = output.PerfectHash.build(h).slots(h)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    lengths = rng.integers(1, 9, len(keys))
    index = output.Index(output.pack_index(h, np.cumsum(lengths) - lengths, lengths, 2))
    there, offset, length = index.find(h)
    assert there.all() and (length == lengths).all() and (offset == np.cumsum(lengths) - lengths).all()
    others = output.key_hash(np.arange(200_000, 300_000), np.zeros(100_000, np.int64))
    assert index.find(others)[0].sum() <= 3
    assert not output.Index(output.pack_index(h[:0], lengths[:0], lengths[:0], 2)).find(h)[0].any()


def test_cover_meets_every_pair_of_offsets():
    cover = set(substring.COVER)
    for i in range(substring.PERIOD):
        for j in range(substring.PERIOD):
            assert any((i + d) % substring.PERIOD in cover and (j + d) % substring.PERIOD in cover for d in range(substring.PERIOD))


def test_patterns_use_up_the_histogram():
    rng = np.random.default_rng(2)
    for n in (1, 7, 3000):
        sizes, counts = np.unique(rng.integers(1, 65, n), return_counts=True)
        histogram = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
        used, bins = dict.fromkeys(histogram, 0), 0
        for times, items in packing.solve(histogram, 64):
            assert sum(s * k for s, k in items.items()) <= 64
            bins += times
            for s, k in items.items():
                used[s] += times * k
        assert used == histogram and bins >= sum(s * k for s, k in histogram.items()) / 64
        if n == 3000:
            assert bins <= 1.02 * sum(s * k for s, k in histogram.items()) / 64 + 2
    assert packing.solve({}, 64) == []


def test_rounds_find_what_neighbours_share(monkeypatch):
    monkeypatch.setattr(suffix, "WINDOW", 6)
    rng = random.Random(5)
    for _ in range(30):
        made = []
        for g in range(3):
            base = "".join(rng.choice("ab") for _ in range(14))
            for _ in range(rng.randint(1, 5)):
                s = list(base)
                for _ in range(rng.randint(0, 2)):
                    s[rng.randrange(len(s))] = rng.choice("abc")
                cut = rng.randint(0, 4)
                made.append((g, "".join(s)[cut : len(s) - rng.randint(0, 3)], 7 - cut, rng.choice([1, 1, 1, 2])))
        data = np.frombuffer("".join(s for _, s, _, _ in made).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(s) for _, s, _, _ in made])])
        got = set()
        for i, a, b in zip(*suffix.rounds(data, offsets, np.array([m[2] for m in made]), np.array([m[0] for m in made]), np.array([m[3] for m in made])), strict=True):
            got |= {(int(i), w) for w in range(a, b + 1)}
        want = set()
        for i, (g, s, lead, weight) in enumerate(made):
            for w in range(len(s) - 5):
                at = w - lead
                twin = any(j != i and h == g and 0 <= at + l <= len(t) - 6 and t[at + l : at + l + 6] == s[w : w + 6] for j, (h, t, l, _) in enumerate(made))
                if twin or weight > 1:
                    want.add((i, w))
        assert got == want


@pytest.mark.parametrize("ids", [[], [1], list(range(70_000))])
def test_crc_is_of_unsigned_32_bit_ids(ids):
    assert zlib.crc32(np.array(ids, "<u4").tobytes()) == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
