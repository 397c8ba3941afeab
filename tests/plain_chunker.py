"""The chunker as plain loops over one text: what the column expressions of ``gleaner.operators.chunking`` must give."""

import re
from itertools import groupby

from gleaner.operators.chunking import BOXES, CODE_RUN, CODE_STARTS, CODE_WORDS, SHORT_LINE
from gleaner.params import Params

TABLE = re.compile(r"\|.+\||\|[\s\-:]+\|")
MARKED = re.compile(r"^(?=(?:\d+[.、．)]|[-•·]|[（(]\d+[)）]|第[一二三四五六七八九十\d]+[章节条款]|#+\s))", re.M)
BLANK_LINE = re.compile(r"\n\s*\n")
SENTENCE = re.compile(r"(?<=[。！？.!?\n])\s*")


def is_code(line: str) -> bool:
    s = line.strip()
    if not s:
        return False
    return not set(BOXES).isdisjoint(s) or (len(s) < SHORT_LINE and (s.startswith(CODE_STARTS) or any(w in s for w in CODE_WORDS)))


def is_table(line: str) -> bool:
    return TABLE.fullmatch(line.strip()) is not None


def blocks(lines: list[str], test, least: int) -> list[list[str]]:
    """Lines cut so that each run of at least ``least`` lines that pass ``test`` stands alone."""
    out: list[list[str]] = [[]]
    for passed, run in groupby(lines, test):
        run = list(run)
        if passed and len(run) >= least:
            out += [run, []]
        else:
            out[-1] += run
    return [b for b in out if b]


def structure(document: str) -> list[str]:
    """Paragraphs, cut at code, tables, line-initial marks and blank lines."""
    parts = [table for code in blocks(document.split("\n"), is_code, CODE_RUN) for table in blocks(code, is_table, 1)]
    marked = [m for part in parts for m in MARKED.split("\n".join(part))]
    return [p.strip() for m in marked for p in BLANK_LINE.split(m.strip()) if p.strip()]


def packed(paragraph: str, most: int) -> list[str]:
    """Sentences of a long paragraph, as many together as fit; a longer sentence stays whole."""
    out, size = [[]], 0
    for s in filter(None, map(str.strip, SENTENCE.split(paragraph))):
        if size + len(s) > most and out[-1]:
            out.append([])
            size = 0
        out[-1].append(s)
        size += len(s)
    return ["".join(x) for x in out if x]


def merged(chunks: list[str], least: int, most: int) -> list[str]:
    """Short chunks take the next one in, or as much of it as they lack."""
    queue, out = list(reversed(chunks)), []
    while queue:
        now = queue.pop()
        while queue and len(now) < least:
            following = queue.pop()
            if len(now) + len(following) <= most:
                now = f"{now}\n{following}"
            else:
                lack = least - len(now)
                now = f"{now}\n{following[:lack]}"
                queue.append(following[lack:])
                break
        out.append(now.strip())
    return out


def chunk_text(document: str | None, params: Params = Params()) -> list[str]:
    """Chunks without overlap."""
    long_ = lambda p: packed(p, params.chunk_chars) if len(p) > params.chunk_chars else [p]
    pieces = [c for p in structure(document or "") for c in long_(p) if c.strip()]
    return merged(pieces, params.chunk_least, params.chunk_chars)


def lines_of(document: str, chunks: list[str]) -> list[int]:
    """The line at which each chunk begins in the raw text, read on from the end of the one before; -1 where it isn't found as it is."""
    out, at, line, counted = [], 0, 0, 0
    for c in chunks:
        found = document.find(c, at)
        if found >= 0:
            line, counted = line + document.count("\n", counted, found), found
            at = found + max(len(c), 1)
        out.append(line if found >= 0 else -1)
    return out
