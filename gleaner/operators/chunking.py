"""Structure-aware chunks of documents, as column expressions.

A text stays one row from end to end: lines, runs of lines and pieces are arrays, and what depends on what came before is a fold (``aggregate``) whose state carries the
piece being filled. Nothing is shuffled and no Python worker starts. Runs are found by where they begin, so their cost is linear in the text; folds append a chunk at a time.

Blank and null texts give no rows. Line ends are ``\\n`` alone; white space is what Unicode calls so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import rules, text
from gleaner.params import Params

#: Characters of directory trees, and how short lines of code begin or what they hold.
BOXES = "│├└┌┐┘┤┬┴┼▸▼▶"
CODE_STARTS = ("# ", "//", "/*", "* ", "> ", "{", "}", "(", ")", "[", "]", "<", ">")
CODE_WORDS = ("def ", "class ", "import ", "from ", "return ")
CODE_RUN, SHORT_LINE = 5, 50
#: White space, as a class of characters.
WHITE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WHITE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: A table's line; a mark with which a line begins a section; blank lines; the end of a sentence.
TABLE = rf"(?d)^(?:\|.+\||\|(?:{WHITE}|[-:])+\|)\z"
MARK = rf"(?:\p{{Nd}}+[.、．)]|[-•·]|[（(]\p{{Nd}}+[)）]|第[一二三四五六七八九十\p{{Nd}}]+[章节条款]|#+{WHITE})"
BEFORE_MARK = rf"(?md)^(?={MARK})"
BLANK_LINE = rf"\n{WHITE}*\n"
SENTENCE = rf"(?<=[。！？.!?\n]){WHITE}*"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, wherever and however often it stands: the optimizer may copy a column into a lambda that runs for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(x: Column) -> Column:
    """Without white space at both ends. Only the ends are looked at."""
    return F.btrim(x, F.lit(WHITE_CHARS))


def filled(parts: Column) -> Column:
    """Parts without white space at their ends, blank ones left out."""
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def is_code(line: Column) -> Column:
    def found(s: Column) -> Column:
        marked = F.lit(False)
        for start in CODE_STARTS:
            marked = marked | s.startswith(start)
        for word in CODE_WORDS:
            marked = marked | s.contains(word)
        return (s != "") & (((F.length(s) < SHORT_LINE) & marked) | F.rlike(s, F.lit(f"[{BOXES}]")))

    return let(trimmed(line), found)


def is_table(line: Column) -> Column:
    return F.rlike(trimmed(line), F.lit(TABLE))


def changes(n: Column, differs) -> Column:
    """The places from 0 to n - 1 at which something begins: the first, and those for which ``differs`` holds."""
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | differs(i))


def runs(starts: Column, n: Column, make) -> Column:
    """``make(start, length)`` of each run that begins at ``starts``."""
    return F.transform(starts, lambda s, k: make(s, F.coalesce(F.get(starts, k + 1), n) - s))


def protected(lines: Column) -> Column:
    """Lines as parts: each long enough run of code and each run of a table stands alone, what lies between stays together."""
    def alone(v: Column) -> Column:
        starts = changes(v["n"], lambda i: F.get(v["code"], i) != F.get(v["code"], i - 1))
        return let(starts, lambda at: F.flatten(runs(at, v["n"], lambda s, m: F.array_repeat(F.get(v["code"], s) & (m >= CODE_RUN), m))))

    def parts(v: Column, own: Column) -> Column:
        starts = changes(v["n"], lambda i: (F.get(own, i) != F.get(own, i - 1)) | (F.get(v["table"], i) != F.get(v["table"], i - 1)))
        return let(starts, lambda at: runs(at, v["n"], lambda s, m: F.array_join(F.slice(v["lines"], s + 1, m), "\n")))

    known = let(lines, lambda x: F.struct(x.alias("lines"), F.transform(x, is_code).alias("code"), F.transform(x, is_table).alias("table"), F.size(x).alias("n")))
    return let(known, lambda v: let(alone(v), lambda own: parts(v, own)))


def sections(part: Column) -> Column:
    """Pieces that begin at the start or at a line-initial mark."""
    return F.split(part, BEFORE_MARK, -1)


def paragraphs(part: Column) -> Column:
    return filled(F.split(part, BLANK_LINE, -1))


def sentences(paragraph: Column) -> Column:
    """Sentences with their closing mark."""
    return filled(F.split(paragraph, SENTENCE, -1))


def structure(document: Column) -> Column:
    """A text's paragraphs: cut at runs of code and of tables, at line-initial marks and at blank lines."""
    marked = F.flatten(F.transform(protected(F.split(document, "\n", -1)), sections))
    return F.flatten(F.transform(marked, lambda m: paragraphs(trimmed(m))))


def packed(paragraph: Column, most: int) -> Column:
    """Sentences of a long paragraph, as many together as fit; a longer sentence stays whole."""
    none = F.array().cast("array<string>")
    state = lambda out, now: F.struct(out.alias("out"), now.alias("now"))
    add = lambda s, x: F.when((F.length(s["now"]) + F.length(x) > most) & (s["now"] != ""), state(F.array_append(s["out"], s["now"]), x)).otherwise(state(s["out"], F.concat(s["now"], x)))
    return F.aggregate(sentences(paragraph), state(none, F.lit("")), add, lambda s: F.filter(F.array_append(s["out"], s["now"]), lambda x: x != ""))


def pieces(paragraphs: Column, most: int) -> Column:
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > most, packed(p, most)).otherwise(F.array(p))))


def merged(chunks: Column, least: int, most: int) -> Column:
    """Short chunks take the next one in, or as much of it as they lack; the rest of it goes on."""
    none = F.array().cast("array<string>")
    state = lambda out, now: F.struct(out.alias("out"), now.alias("now"))

    def add(s: Column, x: Column) -> Column:
        now, lack = s["now"], least - F.length(s["now"])
        both = F.concat(now, F.lit("\n"), x)
        taken = F.concat(now, F.lit("\n"), F.substring(x, F.lit(1), lack))
        return (
            F.when(now.isNull(), state(s["out"], x)).when(F.length(now) >= least, state(F.array_append(s["out"], trimmed(now)), x))
            .when(F.length(now) + F.length(x) <= most, state(s["out"], both)).otherwise(state(F.array_append(s["out"], trimmed(taken)), F.substring(x, lack + 1, F.length(x))))
        )

    return F.aggregate(chunks, state(none, F.lit(None).cast("string")), add, lambda s: F.when(s["now"].isNull(), s["out"]).otherwise(F.array_append(s["out"], trimmed(s["now"]))))


def lines_of(document: Column, chunks: Column) -> Column:
    """The line at which each chunk begins in the raw text, read on from the end of the one before; -1 where it isn't found as it is."""
    count = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    state = lambda out, rest, line: F.struct(out.alias("out"), rest.alias("rest"), line.cast("int").alias("line"))

    def add(s: Column, c: Column) -> Column:
        # The cursor: what is left of the text, and the line on which it begins.
        def moved(at: Column) -> Column:
            line = s["line"] + count(F.substring(s["rest"], F.lit(1), at - 1))
            found = let(line, lambda n: state(F.array_append(s["out"], n.cast("int")), F.substring(s["rest"], at + F.length(c), F.length(s["rest"])), n + count(c)))
            return F.when(at > 0, found).otherwise(state(F.array_append(s["out"], F.lit(-1)), s["rest"], s["line"]))

        return let(F.call_function("locate", c, s["rest"]), moved)

    return F.aggregate(chunks, state(F.array().cast("array<int>"), document, F.lit(0)), add, lambda s: s["out"])


def split(document: Column, params: Params = Params()) -> Column:
    """array<struct<content, line>> of a text that isn't null, without overlap."""
    chunks = merged(pieces(structure(document), params.chunk_chars), params.chunk_least, params.chunk_chars)
    return let(chunks, lambda made: F.zip_with(made, lines_of(document, made), lambda c, n: F.struct(c.alias("content"), n.alias("line"))))


def overlapped(chunks: Column, overlap: int) -> Column:
    """Each chunk with the end of the one before it, if that is longer than the overlap."""
    def with_tail(c: Column, i: Column) -> Column:
        before = F.get(chunks, i - 1)["content"]
        return F.struct(F.when((i > 0) & (F.length(before) > overlap), text.strip(F.concat(F.right(before, F.lit(overlap)), F.lit("\n"), c["content"]))).otherwise(c["content"]).alias("content"), c["content"].alias("own"), c["line"].alias("line"))

    return F.transform(chunks, with_tail) if overlap > 0 else F.transform(chunks, lambda c: F.struct(c["content"].alias("content"), c["content"].alias("own"), c["line"].alias("line")))


def build(documents: DataFrame, params: Params = Params(), source: str = "source", text_col: str = "text", section_rules=rules.SECTIONS) -> DataFrame:
    """(source, chunk_index, total_chunks, content, file_type, project, section_type). Blank texts give no rows."""
    own = documents.select(F.col(source).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = own.select("source", text.headings(F.col("text")).alias("headings"), let(split(F.col("text"), params), lambda c: overlapped(c, params.chunk_overlap)).alias("chunks"))
    # The plain posexplode would be given a filter of its own, which makes all chunks twice more to see whether there are any.
    each = cut.select("source", "headings", F.size("chunks").alias("total_chunks"), F.posexplode_outer("chunks").alias("chunk_index", "c")).filter("c IS NOT NULL")
    above = F.transform(F.filter("headings", lambda h: h["line"] <= F.col("c.line")), lambda h: h["text"])
    return each.select(
        "source", "chunk_index", "total_chunks", "c.content", rules.file_type(F.col("source")).alias("file_type"), rules.project(F.col("source")).alias("project"),
        rules.section_type(F.col("c.own"), above, section_rules).alias("section_type"),
    )
