"""Line deduplication within one edit, by a deletion-neighbourhood join. DataFrame functions only.

A text is cut at line feeds. Lines are compared trimmed and in lower case; those under ``near_chars`` characters (MIN_CHARS; 1: no floor) are never
removed, or with ``short_repeats`` (as in the query and the pipeline) only if an equal line stands earlier; blank ones always stay. A line goes if an equal line, or one within one inserted, deleted or replaced character, stands anywhere earlier: in a smaller
doc_id, or higher up in the same text. This is judged on the input, so what a removed line resembles goes too.

Neighbourhood. A line emits, as hashed keys, itself without its i-th character, with i, and itself whole with each place at which a
character could be put in; of these only the open block (below) is hashed anew, with a hash of the rest. Two lines within one edit share such a key, and lines that share one are all within one edit of each
other, so a key needs only its earliest line: no group is ever turned into pairs. The distance to that earliest line is verified.

Two lossless filters come before, since a key for each character of a corpus would be too much: with a line cut into m
blocks, one edit touches one block, so near lines agree on all the others. Only lines that share such a remainder (first m = 2, then m = 16)
with a different line emit their neighbourhood, and only for characters of the block that was left out.

Nulls and odd input: a null text counts as one empty line; rows equal in doc_id and text count as one document and share its fate; rows with one
doc_id and different texts are ordered by a hash of the text; a null doc_id comes first; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, documents, without_clashes

MIN_CHARS = 12
BLANKS = " \t\r\f\v"
NEXT_BLOCKS = 16
PLACE = ["doc", "version", "line_no"]


def normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(BLANKS)))


def halves(line: Column) -> list[Column]:
    """The line's hash without its first or second half, as cut for its own length and for one less."""
    out = []
    for length in (F.length(line), F.length(line) - 1):
        half = F.floor(length / 2).cast("int")
        out += [F.xxhash64(F.lit(1), F.right(line, length - half)), F.xxhash64(F.lit(2), F.substring(line, F.lit(1), half))]
    return out


def cuts(line: Column, blocks: int) -> Column:
    """Array of struct<key, begin, tail>, one for each block, as cut for the line's own length and for one less: a hash of the line without the
    block, and the characters before and after it. Each block is hashed once with its number, and a key combines the hashes of the others, so a long line is not read again for each of its blocks."""

    def of(length: Column) -> Column:
        edge = lambda i: F.floor(length * i / blocks).cast("int")
        numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
        # Blocks before the open one are counted from the start, those behind it from the end.
        heads = F.transform(numbers, lambda i: F.xxhash64(i, F.substring(line, edge(i) + 1, edge(i + 1) - edge(i))))
        tails = F.transform(numbers, lambda i: F.xxhash64(i, F.substring(line, F.length(line) - length + edge(i) + 1, edge(i + 1) - edge(i))))
        fold = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
        key = lambda x, i: F.xxhash64(F.lit(blocks), i, fold(F.slice(x["heads"], F.lit(1), i)), fold(F.slice(x["tails"], i + 2, F.lit(blocks))))
        made = lambda x: F.transform(numbers, lambda i: F.struct(key(x, i).alias("key"), edge(i).alias("begin"), (length - edge(i + 1)).cast("int").alias("tail")))
        # One struct in an array, so that blocks are hashed once and not once for each key.
        return F.transform(F.array(F.struct(heads.alias("heads"), tails.alias("tails"))), made)[0]

    return F.concat(of(F.length(line)), of(F.length(line) - 1))


def shared_cuts(keyed: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows (id_1, key and more) whose key a different line has too."""
    shared = keyed.groupBy("key").agg(F.min("id_1").alias("low"), F.max("id_1").alias("high")).filter("low <> high").select("key")
    return keyed.join(scratch.write(shared, f"{name}-shared"), "key", "left_semi")


def neighbourhood(key: Column, block: Column) -> Column:
    """Hashed with the key of the rest of the line: every variant of the open block with a character left out, and the block with each gap."""
    length = F.length(block)
    without = lambda i, rest: F.xxhash64(key, F.substring(block, F.lit(1), i - 1), F.lit("|"), F.right(block, rest))
    taken = F.when(length > 0, F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), lambda i: without(i, length - i))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(taken, F.transform(F.sequence(F.lit(1), length + 1), lambda i: without(i, length - i + 1)))


def within_one(a: Column, b: Column, begin: Column, tail: Column) -> Column:
    """Whether lines agree on the first ``begin`` and the last ``tail`` characters and differ by one edit at most between them. The edit distance takes time
    with the square of what it compares, so it sees the open blocks only."""
    head, end = (lambda x: F.substring(x, F.lit(1), begin)), (lambda x: F.right(x, tail))
    open_ = lambda x: F.substring(x, begin + 1, F.length(x) - begin - tail)
    return (head(a) == head(b)) & (end(a) == end(b)) & (F.levenshtein(open_(a), open_(b), 1) >= 0)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_repeats: bool = False, near_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with all its columns, text_col without the lines that go, and n_lines and n_removed beside them."""
    floor = 1 if short_repeats else near_chars
    scratch = Scratch(docs.sparkSession, "lines")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    doc, version = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))), F.xxhash64(text)
    lines = docs.select(doc.alias("doc"), version.alias("version"), F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", normal(F.col("line"))).filter(F.length("line") >= floor)
    # A line goes by two hashes of its whole text. All keys of the first filter follow from the text, so they are grouped with it and no text is moved.
    # Shorter lines have no keys: they meet equal ones only.
    cut_keys = F.when(F.length("line") >= near_chars, F.array_distinct(F.array(*halves(F.col("line"))))).otherwise(F.array().cast("array<bigint>"))
    named = lines.select(*PLACE, F.xxhash64("line").alias("id_1"), F.xxhash64(F.lit("second"), "line").alias("id_2"), cut_keys.alias("keys"))
    keys = [f"key_{i}" for i in range(4)]
    first = named.select(*PLACE, "id_1", "id_2", *[F.get("keys", F.lit(i)).alias(k) for i, k in enumerate(keys)]).groupBy("id_1", "id_2", *keys).agg(F.min(F.struct(*PLACE)).alias("at"))
    first = scratch.write(first.select("id_1", "id_2", F.array_compact(F.array(*keys)).alias("keys"), "at.*"), "first")
    some = shared_cuts(first.select("id_1", "id_2", F.explode("keys").alias("key")), scratch, "some").select("id_1", "id_2").distinct()
    some = scratch.write(first.drop("keys").join(some, ["id_1", "id_2"], "left_semi"), "some")
    # Lines meet their places by a shuffle at every size; all of them are read, and few go on.
    spelled = scratch.write(lines.join(some.hint("merge"), PLACE).select(*PLACE, "id_1", "id_2", "line"), "spelled")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = spelled.repartition(parts, "id_1").select("id_1", "id_2", F.explode(cuts(F.col("line"), NEXT_BLOCKS)).alias("c")).select("id_1", "id_2", "c.*")
    # The edit lies in the block that is left out, so only its characters are varied.
    blocks = scratch.write(shared_cuts(keyed, scratch, "blocks").distinct(), "blocks")
    few = scratch.write(spelled.join(blocks.select("id_1", "id_2").distinct(), ["id_1", "id_2"], "left_semi"), "few")
    # Variants carry the line's place only; texts come back for the pairs to verify, at most one for each line and key.
    block = F.substring("line", F.col("begin") + 1, F.length("line") - F.col("begin") - F.col("tail"))
    spread = few.join(blocks, ["id_1", "id_2"]).select(*PLACE, "key", "begin", "tail", block.alias("block")).repartition(parts, "key", *PLACE)
    variants = spread.select(F.struct(*PLACE).alias("own"), "begin", "tail", F.explode(neighbourhood(F.col("key"), F.col("block"))).alias("key"))
    variants = scratch.write(variants, "variants")
    earliest = variants.groupBy("key").agg(F.min("own").alias("earliest"), F.max("own").alias("latest")).filter("earliest <> latest").drop("latest")
    met = variants.join(earliest, "key").filter("earliest < own").select("own", "earliest", "begin", "tail").distinct()
    spelled_as = lambda x, y: few.select(F.struct(*PLACE).alias(x), F.col("line").alias(y))
    near = (
        met.join(few.select(F.struct(*PLACE).alias("own"), "id_1", "id_2", F.col("line").alias("own_line")), "own").join(spelled_as("earliest", "earliest_line"), "earliest")
        .filter(within_one(F.col("own_line"), F.col("earliest_line"), F.col("begin"), F.col("tail")))
        .select("id_1", "id_2").distinct()
    )
    near = scratch.write(near, "near")
    stay = first.join(near, ["id_1", "id_2"], "left_anti").groupBy("doc", "version").agg(F.collect_list("line_no").alias("stay"))
    stay = scratch.write(stay, "stay")
    scratch.keep("stay")
    beside = docs.select(doc.alias("__doc"), version.alias("__version"), F.struct("*").alias("__row"))
    joined = beside.join(stay.toDF("__doc", "__version", "__stay"), ["__doc", "__version"], "left")
    joined = joined.withColumn("__lines", F.split(F.coalesce(F.col(f"__row.`{text_col}`"), F.lit("")), "\n"))
    tested = F.filter(F.transform("__lines", lambda x, i: F.when(F.length(F.btrim(x, F.lit(BLANKS))) >= floor, i)), lambda i: i.isNotNull())
    joined = joined.withColumn("__gone", F.array_except(tested, F.coalesce("__stay", F.array().cast("array<int>"))))
    left = F.when(F.size("__gone") == 0, F.col(f"__row.`{text_col}`")).otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone"), lambda i: F.get("__lines", i)), "\n"))
    extra = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *[left.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in extra],
        F.size("__lines").cast("long").alias("n_lines"), F.size("__gone").cast("long").alias("n_removed"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(without_clashes(documents(spark, sf_dir), "doc_id", "text"), short_repeats=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS n, unnest(str_split(coalesce(text, ''), chr(10))) AS x
  FROM documents
), e AS (SELECT doc_id, n, lower(trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11))) AS s FROM l),
t AS (SELECT * FROM e WHERE length(s) >= 1),
f AS (SELECT s, doc_id, n, row_number() OVER (ORDER BY doc_id, n) AS place FROM t QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, n) = 1),
v AS (
  SELECT s, place, hash(substr(s, 1, i - 1) || chr(1) || substr(s, i + 1)) AS k FROM (SELECT s, place, unnest(range(1, length(s) + 1)) AS i FROM f WHERE length(s) >= 12)
  UNION ALL
  SELECT s, place, hash(substr(s, 1, i - 1) || chr(1) || substr(s, i)) FROM (SELECT s, place, unnest(range(1, length(s) + 2)) AS i FROM f WHERE length(s) >= 12)
), b AS (SELECT k, min(place) AS p FROM v GROUP BY k HAVING count(*) > 1),
near AS (SELECT DISTINCT v.s FROM v JOIN b USING (k) WHERE b.p < v.place),
kept AS (
  SELECT l.doc_id, l.n, l.x, length(e.s) < 1 OR (f.s IS NOT NULL AND near.s IS NULL) AS stays
  FROM l JOIN e ON l.doc_id = e.doc_id AND l.n = e.n
  LEFT JOIN f ON f.doc_id = l.doc_id AND f.n = l.n
  LEFT JOIN near ON near.s = e.s
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY n) FILTER (stays), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""
