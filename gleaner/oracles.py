"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

import re

from gleaner import queries as q
from gleaner.functions import rules
from gleaner.operators import chunking, context, judge, lexical
from gleaner.params import PRESETS

RULE = "\n\n---\n"
SPACE = r"[\s\x{00A0}\x{3000}]"


def lit(x: str) -> str:
    parts = ["'" + p.replace("'", "''") + "'" for p in re.split(r"[\n\x01\x07]", x)]
    marks = re.findall(r"[\n\x01\x07]", x)
    out = parts[0]
    for m, p in zip(marks, parts[1:], strict=True):
        out += f" || chr({ord(m)}) || {p}"
    return f"({out})" if marks else out


def cases(conditions: list[tuple[str, str]], default: str | None) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {lit(v)}" for c, v in conditions) + f" ELSE {'NULL' if default is None else lit(default)} END"


def words(column: str, keywords: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(k)})" for k in keywords) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


TERMS = "|".join(re.escape(t).replace("\\ ", " ") for t in sorted(lexical.PROTECTED, key=lambda t: (-len(t), t)))
PATTERN = lit(TERMS + r"|\p{Han}|[\p{L}\p{N}]+")
STOP = "[" + ", ".join(lit(w) for w in lexical.STOPWORDS) + "]"
NAME = "lpad((doc_id % 9)::VARCHAR, 2, '0') || CASE WHEN doc_id % 2 = 0 THEN '_' ELSE '-' END || CASE lang " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in reversed(q.NAMES)) + " ELSE 'notes' END || '_' || source || '.md'"


def toks(column: str) -> str:
    return f"list_filter(regexp_extract_all(coalesce({column}, ''), {PATTERN}), lambda t: NOT list_contains({STOP}, lower(t)))"


ASKED = f"""qs AS (SELECT item_id AS query_id, text, {toks('text')} AS w FROM benchmark),
kw AS (SELECT query_id, (list_filter(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: length(x) >= 8))[1:3] AS keywords FROM qs),
tags AS (SELECT item_id AS query_id, list_filter([{', '.join(f"CASE WHEN {words('text', k)} THEN {lit(s)} END" for s, k in q.INTENTS)}], lambda x: x IS NOT NULL) AS intents,
  {cases([(words('text', k), p) for p, k in q.TARGETS], None)} AS target FROM benchmark)"""
INDEX = f"""ch AS (SELECT doc_id AS key, coalesce(text, '') AS content, source, lang, {toks('text')} AS w FROM documents),
posts AS MATERIALIZED (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(w) AS term FROM ch) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM ch),
rw AS MATERIALIZED (SELECT term, df, ln((SELECT n FROM st) - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM posts GROUP BY term)),
ts AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rw) ELSE raw END AS idf FROM rw)"""


def chunked(most: int = 500, least: int = 200) -> str:
    """Common table expressions up to ``cut`` (source, own, line, chunk_index, total_chunks): lines as islands, pieces in order, and folds over each document's pieces."""
    w = chunking.WHITE
    ws = lambda x: rf"regexp_replace({x}, '\A{w}+|{w}+\z', '', 'g')"
    code = f"s <> '' AND (regexp_matches(s, '[{chunking.BOXES}]') OR (length(s) < 50 AND ({' OR '.join([f'starts_with(s, {lit(x)})' for x in chunking.CODE_STARTS] + [f'contains(s, {lit(x)})' for x in chunking.CODE_WORDS])})))"
    newlines = lambda x: f"(length({x}) - length(replace({x}, chr(10), '')))"
    found = "strpos(a.rest, x)"
    return rf"""d AS (SELECT doc_id || '.md' AS source, coalesce(text, '') AS t FROM documents),
l AS (SELECT source, i, x, {code} AS code, regexp_matches(s, '^(?:\|.+\||\|(?:{w}|[-:])+\|)$') AS tab FROM (SELECT source, i, x, {ws('x')} AS s FROM (SELECT source, unnest(str_split(t, chr(10))) AS x, generate_subscripts(str_split(t, chr(10)), 1) AS i FROM d))),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY source, code ORDER BY i) AS run FROM l),
islands AS (SELECT *, code AND count(*) OVER (PARTITION BY source, code, run) >= 5 AS alone FROM runs),
marks AS (SELECT *, CASE WHEN i = 1 OR alone <> lag(alone) OVER o OR tab <> lag(tab) OVER o THEN 1 ELSE 0 END AS begins FROM islands WINDOW o AS (PARTITION BY source ORDER BY i)),
parts AS (SELECT source, part, string_agg(x, chr(10) ORDER BY i) AS t FROM (SELECT *, sum(begins) OVER (PARTITION BY source ORDER BY i) AS part FROM marks) GROUP BY ALL),
marked AS (SELECT source, part, generate_subscripts(z, 1) AS j, unnest(z) AS t FROM (SELECT source, part, str_split(regexp_replace(t, '(?m)^({chunking.MARK})', chr(1) || '\1', 'g'), chr(1)) AS z FROM parts)),
paras AS (SELECT source, part, j, k, {ws('t')} AS t FROM (SELECT source, part, j, generate_subscripts(z, 1) AS k, unnest(z) AS t FROM (SELECT source, part, j, regexp_split_to_array({ws('t')}, '\n{w}*\n') AS z FROM marked))),
sents AS (SELECT source, part, j, k, t, list_filter(list_transform(str_split(regexp_replace(t, '([。！？.!?\n]){w}*', '\1' || chr(1), 'g'), chr(1)), lambda x: {ws('x')}), lambda x: x <> '') AS z FROM paras WHERE t <> ''),
fits AS (SELECT source, part, j, k, t, list_reduce(z, lambda a, x: CASE WHEN length(a.now) + length(x) > {most} AND a.now <> '' THEN {{'out': list_append(a.out, a.now), 'now': x}} ELSE {{'out': a.out, 'now': a.now || x}} END, {{'out': []::VARCHAR[], 'now': ''}}) AS f FROM sents),
whole AS (SELECT source, flatten(list(CASE WHEN length(t) > {most} THEN list_filter(list_append(f.out, f.now), lambda x: x <> '') ELSE [t] END ORDER BY part, j, k)) AS z FROM fits GROUP BY source),
fill AS (SELECT source, list_reduce(z, lambda a, x: CASE WHEN a.now IS NULL THEN {{'out': a.out, 'now': x}} WHEN length(a.now) >= {least} THEN {{'out': list_append(a.out, {ws('a.now')}), 'now': x}} WHEN length(a.now) + length(x) <= {most} THEN {{'out': a.out, 'now': a.now || chr(10) || x}}
  ELSE {{'out': list_append(a.out, {ws(f"a.now || chr(10) || substr(x, 1, {least} - length(a.now))")}), 'now': substr(x, {least} - length(a.now) + 1)}} END, {{'out': []::VARCHAR[], 'now': NULL::VARCHAR}}) AS f FROM whole),
owns AS (SELECT source, t, list_append(f.out, {ws('f.now')}) AS z FROM fill JOIN d USING (source)),
places AS (SELECT source, z, list_reduce(z, lambda a, x: CASE WHEN {found} > 0 THEN {{'out': list_append(a.out, (a.line + {newlines(f"substr(a.rest, 1, {found} - 1)")})::INT), 'rest': substr(a.rest, {found} + length(x)), 'line': (a.line + {newlines(f"substr(a.rest, 1, {found} - 1 + length(x))")})::INT}}
  ELSE {{'out': list_append(a.out, -1), 'rest': a.rest, 'line': a.line}} END, {{'out': []::INT[], 'rest': t, 'line': 0}}).out AS ls FROM owns),
cut AS (SELECT source, unnest(z) AS own, unnest(ls) AS line, (generate_subscripts(z, 1) - 1)::INT AS chunk_index, len(z)::INT AS total_chunks FROM places)"""


def headings_of(rows: str, key: str) -> str:
    """(key, line, heading) of the lines of ``rows`` (key, ls)."""
    return rf"""SELECT {key}, line, {strip("CASE WHEN marked <> '' THEN marked WHEN bracketed <> '' THEN bracketed WHEN numbered <> '' AND length(s) > 5 THEN numbered END")} AS heading FROM (
  SELECT {key}, line, s, regexp_extract(s, '^#{{1,4}}\s+(.+)$', 1) AS marked, regexp_extract(s, '^[【「](.+?)[】」]$', 1) AS bracketed,
    regexp_extract(s, '^(?:[一二三四五六七八九十]+[、．.]|[0-9]+[.、．]|[0-9]+\.[0-9]+)\s*(.+)$', 1) AS numbered
  FROM (SELECT {key}, line, {strip('x')} AS s FROM (SELECT {key}, (generate_subscripts(ls, 1) - 1)::INT AS line, unnest(ls) AS x FROM ({rows})))) WHERE marked <> '' OR bracketed <> '' OR (numbered <> '' AND length(s) > 5)"""


def tags(name: str) -> tuple[str, str]:
    """File type and project of a file's name."""
    types = [(f"starts_with({name}, {lit(p)})", v) for p, v in rules.PREFIX_TYPES] + [(f"contains(lower({name}), {lit(k.lower())})", v) for k, v in rules.KEYWORD_TYPES]
    return cases(types, rules.OTHER_TYPE), cases([(f"contains({name}, {lit(k)})", v) for k, v in rules.NAME_PROJECTS], rules.OTHER_PROJECT)


def sparse(n: int = 10, name: str = "sparse") -> str:
    return f"""{name} AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, key)::INT AS rank FROM (
  SELECT query_id, posts.key, sum(qf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ch.w) / avgdl)))) AS score
  FROM (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(w) AS term FROM qs) GROUP BY ALL) a JOIN ts USING (term) JOIN posts USING (term) JOIN ch USING (key), st
  GROUP BY ALL) WHERE round(score, 6) > 0.05 QUALIFY rank <= {n})"""


BUCKETS = """bucket AS MATERIALIZED (SELECT k, q, b, count(*)::DOUBLE AS c FROM (
    SELECT key AS k, false AS q, ('0x' || substr(md5(unnest(w)), 1, 4))::INT % 64 AS b FROM ch UNION ALL SELECT query_id, true, ('0x' || substr(md5(unnest(w)), 1, 4))::INT % 64 FROM qs) GROUP BY ALL),
lens AS (SELECT k, q, sqrt(sum(c * c)) AS l FROM bucket GROUP BY ALL),
dots AS MATERIALIZED (SELECT a.k AS query_id, d.k AS key, sum(a.c * d.c) AS dot FROM bucket a JOIN bucket d ON a.b = d.b AND a.q AND NOT d.q GROUP BY ALL)"""


def dense(n: int = 10, name: str = "dense") -> str:
    return f"""{name} AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, key)::INT AS rank FROM (
  SELECT query_id, key, dot / ((a.l + 1e-8) * (d.l + 1e-8)) AS score FROM dots JOIN lens a ON a.k = query_id AND a.q JOIN lens d ON d.k = key AND NOT d.q) WHERE round(score, 6) > 0 QUALIFY rank <= {n})"""


def rrf(name: str = "fused", d: str = "dense", s: str = "sparse") -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_raw DESC, dense_rank NULLS LAST, sparse_rank, key)::INT AS rank FROM (
  SELECT query_id, key, round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 6) AS rrf_raw, CASE WHEN d.rank IS NULL THEN 'sparse' WHEN s.rank IS NULL THEN 'dense' ELSE 'both' END AS score_type,
    d.rank AS dense_rank, s.rank AS sparse_rank, coalesce(d.score, 0) AS dense_score, coalesce(s.score, 0) AS sparse_score FROM {d} d FULL JOIN {s} s USING (query_id, key)))"""


def minmax(x: str, by: str = "query_id") -> str:
    return f"CASE WHEN max({x}) OVER (PARTITION BY {by}) = min({x}) OVER (PARTITION BY {by}) THEN 1.0::DOUBLE ELSE ({x} - min({x}) OVER (PARTITION BY {by})) / (max({x}) OVER (PARTITION BY {by}) - min({x}) OVER (PARTITION BY {by})) END"


def diverse(candidates: str, near: str, threshold: float, top: int = 8) -> str:
    """``picked`` (query_id, position, key, stage) from ``candidates`` (query_id, key, rank, rrf_raw, source) and ``near`` (query_id, a, b, s, other): greedy choice and demotion, all queries stepped at once."""
    worth = "0.7::DOUBLE * rrf_raw - (1 - 0.7::DOUBLE) * near - 100 * CASE WHEN len(list_filter(srcs, lambda x: x = source)) >= 2 THEN 1 ELSE 0 END"
    return f"""cand AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY query_id) AS many, row_number() OVER (PARTITION BY query_id ORDER BY rank, key) AS place FROM {candidates}),
picks AS (SELECT query_id, 1 AS position, key, [key] AS sel, [source] AS srcs FROM cand WHERE place = 1
  UNION ALL SELECT query_id, position, key, sel, srcs FROM (SELECT query_id, position + 1 AS position, key, list_append(sel, key) AS sel, list_append(srcs, source) AS srcs,
    row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN many <= {top} THEN 0 ELSE round({worth}, 9) END DESC, place) AS nth
    FROM (SELECT p.query_id, p.position, p.sel, p.srcs, c.key, c.source, c.place, c.many, c.rrf_raw, greatest(0, max(n.s)) AS near FROM picks p JOIN cand c ON c.query_id = p.query_id AND NOT list_contains(p.sel, c.key)
      LEFT JOIN {near} n ON n.query_id = p.query_id AND n.a = c.key AND list_contains(p.sel, n.b) WHERE p.position < {top} GROUP BY ALL)) WHERE nth = 1),
picked AS (SELECT query_id, 1 AS position, key, 0 AS stage, [key] AS kept FROM picks WHERE position = 1
  UNION ALL SELECT query_id, position, key, CASE WHEN bad THEN 1 ELSE 0 END, CASE WHEN bad THEN kept ELSE list_append(kept, key) END
  FROM (SELECT p.query_id, p.position, p.key, d.kept, coalesce(bool_or(n.other AND n.s > {threshold}), false) AS bad FROM picked d JOIN picks p ON p.query_id = d.query_id AND p.position = d.position + 1
    LEFT JOIN {near} n ON n.query_id = p.query_id AND n.a = p.key AND list_contains(d.kept, n.b) GROUP BY ALL))"""


VECTOR_HITS = """v AS (SELECT vec_id, label::VARCHAR AS source, embedding::DOUBLE[] AS e FROM embeddings),
vs AS (SELECT a.vec_id AS query_id, b.vec_id AS key, b.source, b.e, list_dot_product(a.e, b.e) / ((sqrt(list_dot_product(a.e, a.e)) + 1e-8) * (sqrt(list_dot_product(b.e, b.e)) + 1e-8)) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, key)::INT AS rank FROM vs QUALIFY rank <= 32),
vh AS MATERIALIZED (SELECT *, round(1.0::DOUBLE / (60 + rank), 6) AS rrf_raw FROM vr),
vn AS MATERIALIZED (SELECT a.query_id, a.key AS a, b.key AS b, a.source <> b.source AS other, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) + 1e-8) AS s FROM vh a JOIN vh b ON a.query_id = b.query_id AND a.key <> b.key)"""


DISPLAY = f"round_even(0.5::DOUBLE * {minmax('dense_score')} + 0.5::DOUBLE * {minmax('sparse_score')}, 4)"
FUSED = f"{ASKED}, {INDEX}, {sparse()}, {BUCKETS}, {dense()}, {rrf()}"
SHOWN = f"""{FUSED}, shown AS (SELECT f.query_id, f.key, f.rank AS position, score_type, {DISPLAY} AS score, content, ch.source, ch.lang FROM (SELECT * FROM fused WHERE rank <= 8) f JOIN ch USING (key))"""
LABELS = "CASE lang " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in rules.SECTION_LABELS.items()) + f" ELSE {lit(context.OTHER_LABEL)} END"
CONTEXT = f"""{SHOWN}, ctx AS (SELECT query_id, string_agg('[项目: ' || source || ' | 来源: ' || source || ' | 章节: ' || {LABELS} || ']' || chr(10) || content, {lit(context.SEPARATOR)} ORDER BY position) AS context,
  list(struct_pack(position := position, source := source, file_type := lang, content := content, score := score) ORDER BY position) AS hits FROM shown GROUP BY query_id)"""
STATS = f"""{SHOWN}, stats AS (SELECT qs.query_id, coalesce(f.total_results, 0) AS total_results, coalesce(d.n, 0) AS dense_hits, coalesce(s.n, 0) AS sparse_hits, coalesce(f.both_hits, 0) AS both_hits, f.top_score, f.mean_score
  FROM qs LEFT JOIN (SELECT query_id, count(*) AS total_results, count(*) FILTER (score_type = 'both') AS both_hits, arg_min(score, position) AS top_score, ((200 * sum(round(score * 10000)::BIGINT) + count(*)) // (2 * count(*)))::BIGINT / 1000000.0::DOUBLE AS mean_score FROM shown GROUP BY 1) f USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) AS n FROM dense GROUP BY 1) d USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM sparse GROUP BY 1) s USING (query_id))"""
SNAPSHOTS = """now AS (SELECT 'doc-' || doc_id AS name, md5(text) AS m FROM documents),
was AS (SELECT 'doc-' || doc_id AS name, md5(CASE WHEN quality = 1 THEN text ELSE text || ' ' END) AS m FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'page-' || page_id, md5(html) FROM pages),
changes AS (SELECT name, CASE WHEN was.m IS NULL THEN 'added' WHEN now.m IS NULL THEN 'deleted' WHEN now.m <> was.m THEN 'modified' ELSE 'unchanged' END AS status FROM now FULL JOIN was USING (name))"""
ARTEFACTS = "art AS (SELECT doc_id AS key, 'chunks' AS t FROM documents UNION ALL SELECT doc_id, 'labels' FROM labels UNION ALL SELECT vec_id, 'vectors' FROM embeddings)"
BODY = "'{\"accuracy\": ' || (doc_id % 7 % 5 + 1) || ', \"relevance\": ' || (doc_id % 11 % 5 + 1) || ', \"completeness\": ' || (doc_id % 13 % 5 + 1) || ', \"comment\": \"c' || doc_id || '\"}'"
JUDGED = f"""rep AS (SELECT doc_id AS id, CASE WHEN quality = 1 AND toxic = 0 THEN '```json' || chr(10) || {BODY} || chr(10) || '```' WHEN toxic = 1 THEN 'Scores:' || chr(10) || '```' || chr(10) || {BODY} || chr(10) || '```' || chr(10) || 'Done.' ELSE 'broken ' || {BODY} END AS reply FROM labels),
body AS (SELECT id, trim(CASE WHEN contains(reply, '```json') THEN regexp_extract(reply, '(?s)```json(.*?)(```|$)', 1) WHEN contains(reply, '```') THEN regexp_extract(reply, '(?s)```(.*?)(```|$)', 1) ELSE reply END, ' ' || chr(10)) AS b FROM rep),
judged AS (SELECT id, CASE WHEN json_valid(b) THEN (b::JSON ->> 'accuracy')::INT ELSE 0 END AS accuracy, CASE WHEN json_valid(b) THEN (b::JSON ->> 'relevance')::INT ELSE 0 END AS relevance,
  CASE WHEN json_valid(b) THEN (b::JSON ->> 'completeness')::INT ELSE 0 END AS completeness, CASE WHEN json_valid(b) THEN b::JSON ->> 'comment' ELSE {lit(judge.FAILED)} END AS comment FROM body)"""
TAGLESS = "regexp_replace({0}, '<[^>]*>', chr(10), 'g')"


def parts(table: str, key: str, array: str) -> str:
    """Stripped, not blank parts of an array with their places from 0."""
    kept = f"list_filter(list_transform({array}, lambda x: {strip('x')}), lambda x: x <> '')"
    return f"SELECT {key}, (unnest(range(1, len(p) + 1)) - 1)::INT AS pos, unnest(p) AS piece FROM (SELECT {key}, {kept} AS p FROM {table})"


MARK = r"(?:[0-9]+[.、．)]|[-•·]|[（(][0-9]+[)）]|第[一二三四五六七八九十0-9]+[章节条款]|#+\s)"


def clean(x: str) -> str:
    s = strip("x")
    return strip(f"array_to_string(list_filter(str_split({x}, chr(10)), lambda x: {s} <> '' AND NOT regexp_matches({s}, '^[0-9]{{1,3}}$') AND NOT regexp_matches({s}, '^[0-9.,;:—\\s-]{{1,2}}$')), chr(10))")


def oracle_sql() -> dict[str, str]:
    known = f"{FUSED}, known AS (SELECT fused.*, ch.source, ch.lang, tags.intents, tags.target FROM fused JOIN ch USING (key) JOIN tags USING (query_id))"
    spoilt = "CASE WHEN lang = 'en' THEN translate(text, 'aei', '�' || chr(7) || chr(1)) ELSE text END"
    garbage = r"CASE WHEN length({0}) = 0 THEN 1.0::DOUBLE ELSE (length({0}) - length(regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{{FFFD}}]', '', 'g')))::DOUBLE / length({0}) END"
    a, b = "CASE WHEN lang = 'de' THEN ' ' ELSE text END", "CASE WHEN source = 'src3' THEN translate(text, 'enrai', '�����') ELSE text END"
    long_ = lambda x: f"length({strip(x)}) >= 50"
    per_k = lambda k: f"(SELECT {k} AS k, count(*) AS questions, coalesce(sum((first <= {k})::INT), 0)::BIGINT AS hits, round_even(coalesce(sum((first <= {k})::INT), 0)::DOUBLE / greatest(count(*), 1), 4) AS rate FROM rel{k})"
    searches = lambda ks: ", ".join(
        f"{sparse(max(10, 4 * k), f's{k}')}, {dense(max(10, 4 * k), f'd{k}')}, {rrf(f'f{k}', f'd{k}', f's{k}')}, rel{k} AS (SELECT kw.query_id, min(f.rank) AS first FROM kw LEFT JOIN (SELECT f{k}.query_id, f{k}.rank FROM f{k} JOIN ch USING (key) JOIN kw USING (query_id) "
        f"WHERE rank <= {k} AND len(list_filter(keywords, lambda x: contains(lower(content), lower(x)))) > 0) f USING (query_id) WHERE len(keywords) > 0 GROUP BY 1)" for k in ks
    )
    lengths = "length(coalesce(text, ''))"
    out = {
        "file_type": f"SELECT doc_id, {NAME} AS name, {cases([(f'starts_with({NAME}, {lit(p)})', v) for p, v in rules.PREFIX_TYPES] + [(f'contains(lower({NAME}), {lit(k.lower())})', v) for k, v in rules.KEYWORD_TYPES], rules.OTHER_TYPE)} AS file_type FROM documents",
        "project": f"SELECT doc_id, {NAME} AS name, {cases([(f'contains({NAME}, {lit(k)})', v) for k, v in rules.NAME_PROJECTS], rules.OTHER_PROJECT)} AS project FROM documents",
        "garbage_ratio": f"SELECT doc_id, round({garbage.format('t')}, 6) AS ratio, {garbage.format('t')} > 0.30 AS is_garbage FROM (SELECT doc_id, {spoilt} AS t FROM documents)",
        "parse_cascade": f"WITH c AS (SELECT doc_id, CASE WHEN {long_('a')} THEN a WHEN {long_('b')} THEN b ELSE '' END AS t, c FROM (SELECT doc_id, {a} AS a, {b} AS b, 'c:' || text AS c FROM documents)) "
        f"SELECT doc_id, md5({clean('t')}) AS parsed_md5 FROM (SELECT doc_id, CASE WHEN (t = '' OR {garbage.format('t')} > 0.30) AND {strip('c')} <> '' THEN c ELSE t END AS t FROM c)",
        "rulebook": f"WITH {ASKED}, rb AS (SELECT keyword, row_number() OVER (ORDER BY keyword)::INT AS rule FROM (SELECT DISTINCT keyword FROM (SELECT unnest(w) AS keyword FROM qs) WHERE length(keyword) >= 10)), "
        "m AS (SELECT doc_id, count(*)::INT AS matched, min(rule) AS first_rule FROM documents JOIN rb ON contains(text, keyword) GROUP BY doc_id) SELECT doc_id, coalesce(matched, 0)::INT AS matched, first_rule FROM documents LEFT JOIN m USING (doc_id)",
        "clean_text": f"SELECT page_id, {clean(TAGLESS.format('html'))} AS text FROM pages",
        "paragraph_join": f"SELECT page_id, array_to_string(list_filter(str_split({TAGLESS.format('html')}, chr(10)), lambda x: {strip('x')} <> ''), chr(10)) AS text FROM pages",
        "quarantine": f"SELECT doc_id, CASE WHEN toxic = 1 THEN 'refused' WHEN {strip('text')} = '' THEN 'blank' ELSE 'ok' END AS outcome FROM documents LEFT JOIN labels USING (doc_id)",
        "sentence_split": parts("documents", "doc_id", r"str_split(regexp_replace(text, '([。！？.!?\n])\s*', '\1' || chr(1), 'g'), chr(1))"),
        "structure_split": parts("pages", "page_id", f"str_split(regexp_replace(regexp_replace(html, '<li>|<h[1-6]>', chr(10) || '- ', 'g'), '(^|\\n)({MARK})', '\\1' || chr(1) || '\\2', 'g'), chr(1))"),
        "paragraph_split": parts("pages", "page_id", r"regexp_split_to_array(regexp_replace(html, '</p>|</div>', chr(10) || ' ' || chr(10), 'g'), '\n\s*\n')"),
        "section_type": "SELECT doc_id, " + cases([(f"regexp_matches(lower(' ' || substr(text, 1, 200)), {lit(p)})", s) for p, s in q.SECTIONS], rules.OTHER_SECTION) + " AS section_type FROM documents",
        "overlap": f"SELECT conv_id, chunk_index, CASE WHEN length(prev) > 100 THEN {strip('right(prev, 100) || chr(10) || t')} ELSE t END AS content FROM (SELECT conv_id, (row_number() OVER w - 1)::INT AS chunk_index, coalesce(text, '') AS t, lag(coalesce(text, '')) OVER w AS prev FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text))",
        "chunk_build": f"WITH {chunked()}, heads AS ({headings_of('SELECT source, str_split(t, chr(10)) AS ls FROM d', 'source')}), above AS (SELECT source, chunk_index, string_agg(heading, ' ' ORDER BY h.line) AS head FROM cut JOIN heads h USING (source) WHERE h.line <= cut.line GROUP BY ALL) "
        f"SELECT source, chunk_index, total_chunks, CASE WHEN length(prev) > 100 THEN {strip('right(prev, 100) || chr(10) || own')} ELSE own END AS content, {tags('source')[0]} AS file_type, {tags('source')[1]} AS project, "
        + cases([(f"regexp_matches(lower(coalesce(head, '') || ' ' || substr(own, 1, 200)), {lit(p)})", s) for p, s in q.SECTIONS], rules.OTHER_SECTION)
        + " AS section_type FROM (SELECT *, lag(own) OVER (PARTITION BY source ORDER BY chunk_index) AS prev FROM cut) LEFT JOIN above USING (source, chunk_index)",
        "tokenize": f"SELECT doc_id, (unnest(range(1, len(w) + 1)) - 1)::INT AS pos, unnest(w) AS term FROM (SELECT doc_id, {toks('text')} AS w FROM documents)",
        "postings": f"WITH {INDEX} SELECT * FROM posts",
        "bm25_stats": f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM ts",
        "corpus_stats": f"WITH {INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM st",
        "bm25_topn": f"WITH {ASKED}, {INDEX}, {sparse()} SELECT query_id, rank, key, round(score, 6) AS score FROM sparse",
        "bm25_bounded": f"WITH {ASKED}, {INDEX}, {sparse()} SELECT query_id, rank, key, round(score, 6) AS score FROM sparse",
        "bm25_effort": f"WITH {ASKED}, {INDEX} SELECT query_id, sum(df)::BIGINT AS postings, true AS within_bounds FROM (SELECT DISTINCT query_id, unnest(w) AS term FROM qs) a JOIN ts USING (term) GROUP BY query_id",
        "dense_topn": f"WITH {ASKED}, {INDEX}, {BUCKETS}, {dense()} SELECT query_id, rank, key, round(score, 6) AS score FROM dense",
        "vector_topn": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) / ((sqrt(list_dot_product(a.e, a.e)) + 1e-8) * (sqrt(list_dot_product(b.e, b.e)) + 1e-8)) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) "
        "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, vec_id)::INT AS rank, vec_id, round(s, 5) AS score FROM s QUALIFY rank <= 32",
        "dense_bounded": f"WITH {ASKED}, {INDEX}, {BUCKETS}, {dense()} SELECT query_id, rank, key, round(score, 6) AS score FROM dense",
        "vector_bounded": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) / ((sqrt(list_dot_product(a.e, a.e)) + 1e-8) * (sqrt(list_dot_product(b.e, b.e)) + 1e-8)) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) "
        "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, vec_id)::INT AS rank, vec_id, round(s, 5) AS score FROM s QUALIFY rank <= 32",
        "vector_lookup": "SELECT doc_id AS key, embedding IS NOT NULL AS found, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS length FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
        "pair_cosine": "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-8), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "rrf_fuse": f"WITH {FUSED} SELECT query_id, rank, key, rrf_raw, score_type FROM fused",
        "minmax_fuse": f"WITH {FUSED}, n AS (SELECT query_id, key, sum(p) AS p FROM (SELECT query_id, key, 0.5::DOUBLE * {minmax('score')} AS p FROM dense UNION ALL SELECT query_id, key, 0.5::DOUBLE * {minmax('score')} FROM sparse) GROUP BY ALL) "
        "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round_even(p, 4) DESC, key)::INT AS rank, key, round_even(p, 4) AS score FROM n QUALIFY rank <= 8",
        "display_score": f"WITH {FUSED} SELECT query_id, key, {DISPLAY} AS score FROM fused",
        "minmax_by_type": f"SELECT event_id, event_type, round({minmax('value', 'event_type')}, 6) AS norm FROM events",
        "query_intent": f"WITH {ASKED} SELECT query_id, array_to_string(intents, ',') AS intents, target FROM tags",
        "section_boost": f"WITH {known} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(r, 9) DESC, rank)::INT AS rank, key, round(r, 9) AS rrf_raw FROM (SELECT *, CASE WHEN list_contains(intents, lang) THEN rrf_raw * 1.2::DOUBLE ELSE rrf_raw END AS r FROM known)",
        "project_filter": f"WITH {known} SELECT query_id, rank, key, coalesce(source <> target, false) AS is_backup FROM known",
        "presets": f"WITH {SHOWN} SELECT query_id, key, preset, w_dense::DOUBLE AS w_dense, w_sparse::DOUBLE AS w_sparse FROM shown, (VALUES {', '.join(f'({lit(k)}, {a}, {b})' for k, (a, b) in PRESETS.items())}) p(preset, w_dense, w_sparse)",
        "mmr": f"WITH RECURSIVE {VECTOR_HITS}, {diverse('vh', 'vn', 2.0)} SELECT query_id, position::INT AS position, key AS vec_id FROM picked",
        "cross_source_dedup": f"WITH RECURSIVE {VECTOR_HITS}, {diverse('vh', 'vn', 0.35)} SELECT query_id, position::INT AS position, key AS vec_id, stage::INT AS stage FROM picked",
        "hybrid_search": f"WITH RECURSIVE {ASKED}, {INDEX}, {sparse(32)}, {BUCKETS}, {dense(32)}, {rrf()}, known AS (SELECT fused.*, ch.source, ch.lang, tags.intents, tags.target FROM fused JOIN ch USING (key) JOIN tags USING (query_id)), "
        "raised AS (SELECT query_id, key, source, score_type, dense_score, sparse_score, coalesce(source <> target, false) AS is_backup, CASE WHEN list_contains(intents, lang) THEN rrf_raw * 1.2::DOUBLE ELSE rrf_raw END AS rrf_raw, rank AS before FROM known), "
        "boosted AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_raw, 9) DESC, before)::INT AS rank FROM raised), main AS (SELECT * FROM boosted WHERE NOT is_backup), "
        "own AS (SELECT DISTINCT key FROM main), twin AS (SELECT a.k AS a, b.k AS b, sum(a.c * b.c) AS dot FROM bucket a JOIN bucket b ON a.b = b.b AND a.k <> b.k AND NOT a.q AND NOT b.q JOIN own x ON x.key = a.k JOIN own y ON y.key = b.k GROUP BY ALL), "
        "near AS MATERIALIZED (SELECT m.query_id, m.key AS a, o.key AS b, m.source <> o.source AS other, coalesce(dot, 0) / (la.l * lb.l + 1e-8) AS s FROM main m JOIN main o ON m.query_id = o.query_id AND m.key <> o.key LEFT JOIN twin ON a = m.key AND b = o.key JOIN lens la ON la.k = m.key AND NOT la.q JOIN lens lb ON lb.k = o.key AND NOT lb.q), "
        f"{diverse('main', 'near', 0.85)}, every AS (SELECT query_id, key, stage, position FROM picked UNION ALL SELECT query_id, key, 2, rank FROM boosted WHERE is_backup), "
        "final AS (SELECT query_id, key, stage, row_number() OVER (PARTITION BY query_id ORDER BY stage, place, key)::INT AS position FROM (SELECT query_id, key, min(stage) AS stage, arg_min(position, stage) AS place FROM every GROUP BY ALL) QUALIFY position <= 8), "
        f"out AS (SELECT final.*, score_type, rrf_raw, dense_score, sparse_score FROM final JOIN boosted USING (query_id, key)) SELECT query_id, position, key, stage::INT AS stage, score_type, round(rrf_raw, 6) AS rrf_raw, {DISPLAY} AS score FROM out",
        "file_hashes": f"WITH {SNAPSHOTS} SELECT name, m AS md5 FROM now",
        "detect_changes": f"WITH {SNAPSHOTS} SELECT * FROM changes",
        "detect_changes_by_digest": f"WITH {SNAPSHOTS} SELECT * FROM changes",
        "file_round_trip": "SELECT '页 ' || page_id || '%20 a' || CASE page_id % 3 WHEN 0 THEN '.txt' ELSE '.md' END AS name, md5(html) AS md5, length(html)::INT AS chars FROM pages WHERE page_id % 3 < 2 AND length(html) > 0",
        "headings": rf"""SELECT page_id, line, {strip("CASE WHEN marked <> '' THEN marked WHEN bracketed <> '' THEN bracketed WHEN numbered <> '' AND length(s) > 5 THEN numbered END")} AS heading FROM (
  SELECT page_id, line, s, regexp_extract(s, '^#{{1,4}}\s+(.+)$', 1) AS marked, regexp_extract(s, '^[【「](.+?)[】」]$', 1) AS bracketed,
    regexp_extract(s, '^(?:[一二三四五六七八九十]+[、．.]|[0-9]+[.、．]|[0-9]+\.[0-9]+)\s*(.+)$', 1) AS numbered
  FROM (SELECT page_id, line, {strip('x')} AS s FROM (SELECT page_id, (generate_subscripts(ls, 1) - 1)::INT AS line, unnest(ls) AS x FROM (
    SELECT page_id, str_split({TAGLESS.format("regexp_replace(html, '<h[1-6]>', chr(10) || '# ', 'g')")}, chr(10)) AS ls FROM pages)))) WHERE marked <> '' OR bracketed <> '' OR (numbered <> '' AND length(s) > 5)""",
        "changed_names": f"WITH {SNAPSHOTS} SELECT status, name FROM changes WHERE status <> 'unchanged'",
        "change_report": f"WITH {SNAPSHOTS} SELECT status, count(*) AS files, min(name) AS first_name, max(name) AS last_name, status <> 'unchanged' AS changed FROM changes GROUP BY status",
        "incremental_append": "SELECT doc_id AS key, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
        "upsert": f"WITH {SNAPSHOTS} SELECT name AS source, m AS md5 FROM was WHERE name NOT IN (SELECT name FROM changes WHERE status IN ('deleted', 'modified')) UNION ALL SELECT name, m FROM now WHERE name IN (SELECT name FROM changes WHERE status IN ('added', 'modified'))",
        "index_audit": f"WITH {ARTEFACTS} SELECT key, array_to_string(list_filter(['chunks', 'labels', 'vectors'], lambda x: NOT list_contains(h, x)), ',') AS missing FROM (SELECT key, list(DISTINCT t) AS h FROM art GROUP BY key) WHERE len(h) < 3",
        "index_counts": f"WITH {ARTEFACTS}, c AS (SELECT t AS artefact, count(*) AS n FROM art GROUP BY t) SELECT artefact, n, n = (SELECT n FROM c GROUP BY n ORDER BY count(*) DESC, min(artefact) LIMIT 1) AS agrees FROM c",
        "index_repair": "SELECT doc_id AS key FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT vec_id FROM embeddings)",
        "validate_question": f"SELECT conv_id, turn, CASE WHEN length(coalesce(text, '')) = 0 THEN 'empty' WHEN length(text) > 2000 THEN 'too long' WHEN {strip('text')} = '' THEN 'blank' ELSE 'ok' END AS outcome FROM conversations WHERE role = 'user'",
        "context": f"WITH {CONTEXT} SELECT query_id, context FROM ctx",
        "prompt": f"WITH {CONTEXT} SELECT query_id, md5('role' || {lit(chr(10) * 2)} || 'rules {{context}}' || {lit(RULE)} || context || {lit(RULE)} || text) AS prompt_md5 FROM ctx JOIN qs USING (query_id)",
        "sources": f"WITH {CONTEXT} SELECT query_id, (pos - 1)::INT AS pos, h.source, h.file_type, md5(h.content) AS content_md5, h.score FROM (SELECT query_id, unnest(range(1, len(hits) + 1)) AS pos, unnest(hits) AS h FROM ctx)",
        "used_files": f"WITH {CONTEXT}, l AS (SELECT query_id, list_transform(hits, lambda h: h.source) AS s FROM ctx) SELECT query_id, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ',') AS used_files FROM l",
        "no_hit_fallback": f"WITH qs AS (SELECT conv_id || '-' || turn AS query_id, {toks('text')} AS w FROM conversations WHERE role = 'user'), {INDEX}, {sparse(2)}, h AS (SELECT query_id, list(source ORDER BY rank) AS s FROM sparse JOIN ch USING (key) GROUP BY 1) "
        f"SELECT query_id, CASE WHEN s IS NULL THEN {lit(context.NO_HITS)} END AS answer, coalesce(len(s), 0)::INT AS n_sources, coalesce(array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ','), '') AS used_files FROM qs LEFT JOIN h USING (query_id)",
        "retrieval_stats": f"WITH {STATS} SELECT * FROM stats",
        "benchmark_summary": f"WITH {STATS} SELECT count(*) AS questions, round(avg(total_results), 6) AS mean_results, round(avg(mean_score), 6) AS mean_score, round(avg(both_hits::DOUBLE / greatest(total_results, 1)), 6) AS both_share FROM stats",
        "latency": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, round(quantile_cont(value::DOUBLE, 0.99), 6) AS p99_ms FROM events GROUP BY 1",
        "api_summary": f"WITH {STATS} SELECT count(*) AS total, round(coalesce(sum(total_results), 0)::DOUBLE / greatest(count(*), 1), 6) AS mean_results, round(coalesce(sum(mean_score * 100), 0)::DOUBLE / greatest(count(*), 1), 6) AS mean_latency FROM stats",
        "hit_rate": f"WITH {ASKED}, {INDEX}, {BUCKETS}, {searches((1, 3, 5))} SELECT * FROM {per_k(1)} UNION ALL SELECT * FROM {per_k(3)} UNION ALL SELECT * FROM {per_k(5)}",
        "mrr": f"WITH {ASKED}, {INDEX}, {BUCKETS}, {searches((10,))} SELECT count(*) AS questions, round_even(coalesce(sum(coalesce(1.0::DOUBLE / first, 0)), 0) / greatest(count(*), 1), 4) AS mrr FROM rel10",
        "category_stats": f"WITH {STATS} SELECT coalesce(intents[1], 'other') AS category, count(*) AS questions, round_even(avg(coalesce(top_score, 0)), 4) AS mean_top, round_even(avg(total_results), 1) AS mean_results, round_even(avg(both_hits), 1) AS mean_both, round_even(avg(sparse_hits), 1) AS mean_sparse FROM stats JOIN tags USING (query_id) GROUP BY 1",
        "categories_and_overall": f"WITH {STATS}, told AS (SELECT stats.*, coalesce(intents[1], 'other') AS category FROM stats JOIN tags USING (query_id)) SELECT category, grouping(category) = 1 AS is_total, count(*) AS questions, round_even(CASE WHEN grouping(category) = 1 THEN avg(top_score) ELSE avg(coalesce(top_score, 0)) END, 4) AS mean_top, "
        "round_even(avg(total_results), 1) AS mean_results, round_even(avg(both_hits), 1) AS mean_both, round_even(avg(sparse_hits), 1) AS mean_sparse FROM told GROUP BY GROUPING SETS ((category), ())",
        "overall_stats": f"WITH {STATS} SELECT count(*) AS questions, round_even(avg(top_score), 4) AS mean_top, round_even(avg(total_results), 1) AS mean_results, round_even(avg(both_hits), 1) AS mean_both FROM stats",
        "report_record": f"WITH {STATS}, lists AS (SELECT query_id, list(score ORDER BY position) AS scores FROM shown GROUP BY query_id) SELECT query_id, to_json(struct_pack(question := text, category := coalesce(intents[1], 'other'), scores := coalesce(scores, []), "
        "total := total_results, \"both\" := both_hits, top := round_even(top_score, 4), mean := round_even(mean_score, 4)))::VARCHAR AS record FROM stats JOIN qs USING (query_id) JOIN tags USING (query_id) LEFT JOIN lists USING (query_id)",
        "preset_compare": f"WITH {STATS}, {searches((1, 3, 5, 10))}, n AS (SELECT query_id, rank, {minmax('dense_score')} AS nd, {minmax('sparse_score')} AS ns FROM fused WHERE rank <= 8), s AS (SELECT preset, query_id, rank, round_even(wd::DOUBLE * nd + ws::DOUBLE * ns, 4) AS score FROM n, (VALUES {', '.join(f'({lit(k)}, {a}, {b})' for k, (a, b) in PRESETS.items())}) p(preset, wd, ws)), "
        "g AS (SELECT preset, query_id, max(score) FILTER (rank = 1) AS top, avg(score) AS mean FROM s GROUP BY ALL) SELECT preset, count(*) AS questions, round_even(avg(top), 4) AS mean_top, round_even(avg(mean), 4) AS mean_score, "
        f"any_value(h1.rate) AS hit_rate_1, any_value(h3.rate) AS hit_rate_3, any_value(h5.rate) AS hit_rate_5, any_value(m.mrr) AS mrr, any_value(c.b) AS mean_both, any_value(c.s) AS mean_sparse FROM g, {per_k(1)} h1, {per_k(3)} h3, {per_k(5)} h5, "
        "(SELECT round_even(coalesce(sum(coalesce(1.0::DOUBLE / first, 0)), 0) / greatest(count(*), 1), 4) AS mrr FROM rel10) m, (SELECT round_even(avg(both_hits), 1) AS b, round_even(avg(sparse_hits), 1) AS s FROM stats) c GROUP BY 1",
        "index_quality": f"SELECT count(*) AS chunks, count(DISTINCT source) AS files, floor(avg({lengths}))::BIGINT AS mean_chars, max({lengths}) AS most_chars, min({lengths}) AS least_chars, count(*) FILTER ({lengths} < 200) AS under_200, count(*) FILTER ({lengths} >= 200 AND {lengths} < 350) AS from_200, count(*) FILTER ({lengths} >= 350 AND {lengths} < 500) AS from_350, count(*) FILTER ({lengths} >= 500) AS from_500, (SELECT max(len(embedding)) FROM embeddings)::INT AS dimension FROM documents",
        "per_file": f"SELECT source, count(*) AS chunks, sum({lengths})::BIGINT AS chars FROM documents GROUP BY source",
        "document_list": "SELECT source, count(*) AS chunks, arg_min(lang, doc_id) AS file_type FROM documents GROUP BY source",
        "chunk_count": "SELECT count(*) AS chunks FROM documents",
        "judge_parse": f"WITH {JUDGED} SELECT * FROM judged",
        "judge_retry": f"WITH {JUDGED} SELECT id FROM judged WHERE accuracy < 3 OR relevance < 4",
        "judge_summary": f"WITH {JUDGED}, again AS (SELECT id, 4 AS a, id % 5 + 1 AS r, 3 AS c FROM judged WHERE accuracy < 3 OR relevance < 4) SELECT count(*) AS n, round_even(avg(accuracy), 2) AS accuracy, round_even(avg(relevance), 2) AS relevance, round_even(avg(completeness), 2) AS completeness, round_even((avg(accuracy) + avg(relevance) + avg(completeness)) / 3, 2) AS overall, "
        "count(a) AS retried, round_even(avg(a), 2) AS retry_accuracy, round_even(avg(r), 2) AS retry_relevance, round_even(avg(c), 2) AS retry_completeness FROM judged LEFT JOIN again USING (id)",
        "judge_prompt": f"WITH {CONTEXT} SELECT query_id, coalesce(array_to_string(list_transform(hits[1:3], lambda h: '[来源: ' || h.source || ']' || chr(10) || substr(h.content, 1, 300)), {lit(judge.SEPARATOR)}), {lit(judge.NO_SOURCES)}) AS context, substr(text, 1, 1200) AS answer FROM qs LEFT JOIN ctx USING (query_id)",
        "question_sample": "SELECT item_id AS id FROM benchmark ORDER BY md5(item_id || '#42'), item_id LIMIT 5",
    }
    return out
