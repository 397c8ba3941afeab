"""Token ids of whole texts, word by word, with the tokenizers library.

The vocabulary drops white space and never joins across it, so the ids of a text are the ids of its words end to end.
A worker therefore asks the library only for words it hasn't met lately. Words of plain Latin letters need none of the
library's normalising and splitting, so its BPE model is asked for them directly; all other words take the whole way.
"""

from __future__ import annotations

import os
import re

import public_tokenizers
from tokenizers import Tokenizer

from gleaner.llm.common import worker_cache

VOCABULARY = "word_bpe_49k.json"
#: Words of a generation that a worker remembers. When it is full, the one before is forgotten; words met again move to the new one.
MEMO_WORDS = 400_000
#: Lower-case letters that are one code point in NFC whatever stands beside them.
LETTERS = re.compile("[a-zß-öø-ÿœ]+")

_encoders: dict[str, Encoder] = worker_cache()


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> dict[str, str]:
    """How byte-level vocabularies spell the letters above: printable bytes as themselves, the others from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    spelled = [chr(b) if b in printable else chr(next(others)) for b in range(256)]
    return {c: "".join(spelled[b] for b in c.encode()) for c in map(chr, range(97, 340)) if LETTERS.fullmatch(c)}


class Encoder:
    """Gives ids as bytes: little-endian unsigned 16-bit where the vocabulary allows it, else 32-bit."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65_536 else "<u4"
        self.width = int(self.dtype[2])
        self.memo: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.spelling = str.maketrans(byte_letters())
        self.packed = [i.to_bytes(self.width, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

    def learn(self, words: set[bytes]) -> None:
        """Puts words into the memo. Points and commas that end a word of letters are a token group of their own, and case is dropped."""
        memo, packed, model, spelling, rest = self.memo, self.packed, self.tokenizer.model, self.spelling, []
        for word in words:
            core = word.rstrip(b".,")
            low = core.decode().lower()
            if not LETTERS.fullmatch(low):
                rest.append(word)
                continue
            key = low.encode()
            ids = memo.get(key) or self.before.get(key)
            if ids is None:
                ids = memo[key] = b"".join([packed[x.id] for x in model.tokenize(low.translate(spelling))])
            if len(core) < len(word):
                tail = word[len(core) :]
                if tail not in memo:
                    memo[tail] = self.library([tail])[0]
                ids += memo[tail]
            memo[word] = ids
        memo.update(zip(rest, self.library(rest), strict=True))

    def library(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [b"".join([self.packed[i] for i in x.ids]) for x in found]

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole text. bytes.split() cuts at ASCII white space only, all of which the vocabulary drops."""
        words = text.split()
        try:
            return b"".join(map(self.memo.__getitem__, words))
        except KeyError:
            if len(self.memo) > MEMO_WORDS:
                self.memo, self.before = {}, self.memo
            new = {w for w in words if w not in self.memo}
            known = new & self.before.keys()
            self.memo.update((w, self.before[w]) for w in known)
            self.learn(new - known)
            return b"".join(map(self.memo.__getitem__, words))


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
