"""Text expressions: cleaning, garbage, headings. The parts of a text are in ``operators/chunking.py``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is cut from ends: what the engines call white space, no-break and ideographic space.
SPACE = r"[\s\x{00A0}\x{3000}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)), F.lit(0)) == 0


def garbage_ratio(text: Column) -> Column:
    """Share of replacement and control characters; 1 for empty text."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]", "")
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, F.lit(1.0)).otherwise((n - F.length(clean)) / n)


def clean_text(text: Column) -> Column:
    """Without page numbers, scraps of up to two digits and marks, and blank lines. Kept lines stay as they are."""
    def stays(line: Column) -> Column:
        s = strip(line)
        return (s != "") & ~F.rlike(s, F.lit(r"^[0-9]{1,3}$")) & ~F.rlike(s, F.lit(r"^[0-9.,;:\-—\s]{1,2}$"))

    return strip(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))


def join_paragraphs(paragraphs: Column) -> Column:
    return F.array_join(F.filter(paragraphs, lambda p: ~is_blank(p)), "\n")


def parsed(text_a: Column, text_b: Column, text_c: Column, least: int = 50, garbage: float = 0.30) -> Column:
    """The first of two extractions that is long enough; the third where that is garbage or neither is. Cleaned."""
    long_enough = lambda t: F.coalesce(F.length(strip(t)), F.lit(0)) >= least
    chosen = F.when(long_enough(text_a), text_a).when(long_enough(text_b), text_b).otherwise(F.lit(""))
    poor = (chosen == "") | (garbage_ratio(chosen) > garbage)
    return clean_text(F.when(poor & ~is_blank(text_c), text_c).otherwise(chosen))


def headings(text: Column) -> Column:
    """array<struct<line, text>>: marked, bracketed and numbered headings with the number of their line."""
    def heading(line: Column, number: Column) -> Column:
        s = strip(line)
        marked = F.regexp_extract(s, r"^#{1,4}\s+(.+)$", 1)
        bracketed = F.regexp_extract(s, r"^[【「](.+?)[】」]$", 1)
        numbered = F.regexp_extract(s, r"^(?:[一二三四五六七八九十]+[、．.]|[0-9]+[.、．]|[0-9]+\.[0-9]+)\s*(.+)$", 1)
        found = F.when(marked != "", marked).when(bracketed != "", bracketed).when((numbered != "") & (F.length(s) > 5), numbered)
        return F.struct(number.alias("line"), strip(found).alias("text"))

    return F.filter(F.transform(F.split(text, "\n"), heading), lambda h: h["text"].isNotNull())
