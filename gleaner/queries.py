"""Every registered query over the given tables. Documents stand in for chunks, benchmark passages and conversations for questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import rules, text, vectors
from gleaner.operators import chunking, context, dense, diversity, evaluation, fusion, impact, judge, lexical, nearest, rulebook, search, sparse, sync
from gleaner.params import PRESETS, Params
from gleaner.sources import files
from gleaner.sources.tables import LARGE_ROWS, Workspace, spread

P = Params()
#: The most results that a registered query asks a search for.
MOST = 10
#: Rules for the given tables: lang stands for the section type, source for the project.
INTENTS = [("en", ["the ", "and "]), ("fr", ["ment ", "eau "]), ("de", ["der ", "und "]), ("es", ["ción", "que "])]
TARGETS = [("src1", ["ingst", "thth"]), ("src2", ["ndre", "eren"]), ("src3", ["onea"])]
SECTIONS = [("ción|ñ", "es"), ("ß|ü|keit", "de"), ("eaux|ç|è", "fr"), ("the .*and|tion", "en")]
NAMES = [("en", "My_Resume"), ("de", "cv"), ("fr", "RAG系统项目")]


class Tables:
    """The given tables by name, and what one query makes of them: each such table is made once, written, and read by all that need it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.work = spark, folder, None

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def once(self, name: str, make: Callable[[], DataFrame], **options) -> DataFrame:
        self.work = self.work or Workspace(self.spark, "query")
        return self.work.once(name, make, **options)


def name_of(docs: DataFrame) -> DataFrame:
    """Documents with a file name made of their columns."""
    word = F.lit("notes")
    for lang, stem in NAMES:
        word = F.when(F.col("lang") == lang, stem).otherwise(word)
    return docs.withColumn("name", F.concat(F.lpad((F.col("doc_id") % 9).cast("string"), 2, "0"), F.when(F.col("doc_id") % 2 == 0, "_").otherwise("-"), word, F.lit("_"), F.col("source"), F.lit(".md")))


def chunks(t: Tables) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("content"), "source", F.col("source").alias("project"), F.col("lang").alias("section_type"))


def questions(t: Tables) -> DataFrame:
    long_words = F.filter(F.array_distinct(lexical.tokens(F.col("text"))), lambda w: F.length(w) >= 8)
    return t("benchmark").select(
        F.col("item_id").alias("query_id"), "text", rules.intents(F.col("text"), INTENTS).alias("intents"), rules.target_project(F.col("text"), TARGETS).alias("target"), F.slice(long_words, 1, 3).alias("keywords"),
    )


def token_lists(t: Tables) -> DataFrame:
    """(key, tokens) of all documents."""
    return spread(chunks(t).select("key", "content")).select("key", lexical.tokens(F.col("content")).alias("tokens"))


def tokenised(t: Tables) -> DataFrame:
    return t.once("tokens", lambda: token_lists(t))


def postings(t: Tables) -> DataFrame:
    """(key, term, tf, dl) of all documents. A task counts the terms of its documents before they are shuffled."""
    counted = tokenised(t).select("key", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    return t.once("postings", lambda: counted.groupBy("key", "term", "dl").agg(F.count("*").alias("tf")).select("key", "term", "tf", "dl"))


def index(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(term statistics, corpus statistics). A document's terms are made distinct in its row, so no posting is shuffled."""
    stats = t.once("corpus", lambda: tokenised(t).agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl")))
    df = tokenised(t).select(F.explode_outer(F.array_distinct("tokens")).alias("term")).filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    return t.once("terms", lambda: lexical.idf(t.once("df", lambda: df), stats)), stats


def inverted(t: Tables) -> DataFrame:
    """Blocks of documents, with all that both channels and the statistics read, from one pass over the texts. Their tokens are never written."""
    return t.once("inverted", lambda: sparse.blocks(token_lists(t), "key", P.dims), **LARGE_ROWS)


def block_stats(t: Tables) -> tuple[DataFrame, DataFrame]:
    """``index`` from blocks."""
    stats = t.once("corpus", lambda: sparse.corpus_stats(inverted(t)))
    return t.once("terms", lambda: lexical.idf(t.once("df", lambda: sparse.document_counts(inverted(t))), stats)), stats


def sparse_hits(t: Tables, n: int = P.candidates) -> DataFrame:
    """What a channel gives for n candidates are the first of what it gives for more, so each channel is searched once."""
    return t.once("sparse", lambda: sparse.search_blocks(questions(t), inverted(t), *block_stats(t), "key", P, P.per_channel(MOST))).filter(F.col("rank") <= n)


def embedded(df: DataFrame, column: str) -> DataFrame:
    return vectors.with_hashed(df, lexical.tokens(F.col(column)), P.dims)


def document_vectors(t: Tables) -> DataFrame:
    return t.once("vectors", lambda: dense.unpacked(inverted(t), "key"))


def dense_hits(t: Tables, n: int = P.candidates) -> DataFrame:
    asked = embedded(questions(t), "text")
    search_all = lambda: dense.search_blocks(asked, inverted(t), t("documents").count(), "query_id", "key", params=P, n=P.per_channel(MOST))
    return t.once("dense", search_all).filter(F.col("rank") <= n)


def fused(t: Tables, n: int = P.candidates) -> DataFrame:
    return t.once(f"fused-{n}", lambda: fusion.reciprocal_rank(dense_hits(t, n), sparse_hits(t, n)))


def shown(t: Tables) -> DataFrame:
    """Fused hits as final ones: the first top_k with content and display score."""
    top = fused(t).filter(F.col("rank") <= P.top_k)
    return t.once("shown", lambda: fusion.display_score(top).withColumnRenamed("rank", "position").join(chunks(t).withColumn("file_type", F.col("section_type")), "key"))


def vector_hits(t: Tables, n: int = 4 * P.top_k) -> DataFrame:
    """Vectors ask for their neighbours; every vector is a candidate of every query whose id is divisible by 50."""
    v = t("embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").cast("string").alias("source"))
    asked = v.filter("vec_id % 50 = 0").withColumnsRenamed({"vec_id": "query_id"})
    hits = dense.search(asked, v, "query_id", "vec_id", params=P, n=n, above=None, not_itself=True)
    return hits.withColumn("rrf_raw", F.round(1.0 / (P.rrf_k + F.col("rank")), 6)).join(v, "vec_id")


# --- text and tags


def q_file_type(t: Tables) -> DataFrame:
    return name_of(t("documents")).select("doc_id", "name", rules.file_type(F.col("name")).alias("file_type"))


def q_project(t: Tables) -> DataFrame:
    return name_of(t("documents")).select("doc_id", "name", rules.project(F.col("name")).alias("project"))


def q_garbage_ratio(t: Tables) -> DataFrame:
    spoilt = F.when(F.col("lang") == "en", F.translate("text", "aei", "�\u0007\u0001")).otherwise(F.col("text"))
    return t("documents").select("doc_id", F.round(text.garbage_ratio(spoilt), 6).alias("ratio"), (text.garbage_ratio(spoilt) > 0.30).alias("is_garbage"))


def q_parse_cascade(t: Tables) -> DataFrame:
    d = t("documents")
    a = F.when(F.col("lang") == "de", F.lit(" ")).otherwise(F.col("text"))
    b = F.when(F.col("source") == "src3", F.translate("text", "enrai", "�����")).otherwise(F.col("text"))
    return d.select("doc_id", F.md5(text.parsed(a, b, F.concat(F.lit("c:"), "text")).cast("binary")).alias("parsed_md5"))


def words_as_rules(t: Tables) -> DataFrame:
    """(rule, keyword): every word of ten letters or more of the passages, numbered in order."""
    words = t("benchmark").select(F.explode(lexical.tokens(F.col("text"))).alias("keyword")).filter("length(keyword) >= 10").distinct()
    return words.select(F.row_number().over(Window.orderBy("keyword")).alias("rule"), "keyword")  # one list, as small as the rulebook


def q_rulebook(t: Tables) -> DataFrame:
    met = spread(t("documents").select("doc_id", "text")).select("doc_id", rulebook.match(F.col("text"), words_as_rules(t)).alias("rules"))
    return met.select("doc_id", F.size("rules").alias("matched"), F.get("rules", F.lit(0)).alias("first_rule"))


def q_clean_text(t: Tables) -> DataFrame:
    return t("pages").select("page_id", text.clean_text(F.regexp_replace("html", "<[^>]*>", "\n")).alias("text"))


def q_paragraph_join(t: Tables) -> DataFrame:
    return t("pages").select("page_id", text.join_paragraphs(F.split(F.regexp_replace("html", "<[^>]*>", "\n"), "\n")).alias("text"))


def q_quarantine(t: Tables) -> DataFrame:
    rows = t("documents").join(t("labels").select("doc_id", "toxic"), "doc_id", "left").select("doc_id", "text", F.when(F.col("toxic") == 1, "refused").alias("error"))
    good, bad = files.quarantine(rows)
    return good.select("doc_id", F.lit("ok").alias("outcome")).union(bad.select("doc_id", "reason"))


def q_sentence_split(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("pos", "piece"))


def q_structure_split(t: Tables) -> DataFrame:
    return t("pages").select("page_id", F.posexplode(chunking.filled(chunking.sections(F.regexp_replace("html", "<li>|<h[1-6]>", "\n- ")))).alias("pos", "piece"))


def q_paragraph_split(t: Tables) -> DataFrame:
    return t("pages").select("page_id", F.posexplode(chunking.paragraphs(F.regexp_replace("html", "</p>|</div>", "\n \n"))).alias("pos", "piece"))


def q_headings(t: Tables) -> DataFrame:
    marked = F.regexp_replace("html", "<h[1-6]>", "\n# ")
    return t("pages").select("page_id", F.explode(text.headings(F.regexp_replace(marked, "<[^>]*>", "\n"))).alias("h")).select("page_id", "h.line", F.col("h.text").alias("heading"))


def q_section_type(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", rules.section_type(F.col("text"), rules=SECTIONS).alias("section_type"))


def q_overlap(t: Tables) -> DataFrame:
    turns = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("content"), F.lit(0).alias("line")))).alias("c"))
    return turns.select("conv_id", F.posexplode(chunking.overlapped(F.col("c"), P.chunk_overlap)).alias("chunk_index", "x")).select("conv_id", "chunk_index", "x.content")


def q_chunk_build(t: Tables) -> DataFrame:
    named = spread(t("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), "text"))
    return chunking.build(named, P, section_rules=SECTIONS)


# --- lexical and dense search


def q_tokenize(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.posexplode(lexical.tokens(F.col("text"))).alias("pos", "term"))


def q_postings(t: Tables) -> DataFrame:
    return postings(t).drop("dl")


def q_bm25_stats(t: Tables) -> DataFrame:
    return index(t)[0].select("term", "df", F.round("idf", 6).alias("idf"))


def q_corpus_stats(t: Tables) -> DataFrame:
    return index(t)[1].select("n", F.round("avgdl", 6).alias("avgdl"))


def q_bm25_topn(t: Tables) -> DataFrame:
    return sparse_hits(t).select("query_id", "rank", "key", F.round("score", 6).alias("score"))


def bounded(t: Tables) -> tuple[DataFrame, DataFrame]:
    terms, stats = index(t)
    rows = t.once("blocks", lambda: impact.blocks_of_tokens(tokenised(t), ["key"], stats.first()["n"]))
    return impact.search(questions(t), rows, terms, stats, ["key"], t.work.under("bounded"), P)


def q_bm25_bounded(t: Tables) -> DataFrame:
    return bounded(t)[0].select("query_id", "rank", "key", F.round("score", 6).alias("score"))


def q_bm25_effort(t: Tables) -> DataFrame:
    """What the bounded search needed not read."""
    return bounded(t)[1].select("query_id", "postings", (F.col("read") <= 2 * F.col("postings")).alias("within_bounds"))


def q_dense_topn(t: Tables) -> DataFrame:
    return dense_hits(t).select("query_id", "rank", "key", F.round("score", 6).alias("score"))


def q_vector_topn(t: Tables) -> DataFrame:
    return vector_hits(t).select("query_id", "rank", "vec_id", F.round("score", 5).alias("score"))


def q_dense_bounded(t: Tables) -> DataFrame:
    docs = document_vectors(t)
    hits, _ = nearest.search(embedded(questions(t), "text"), docs, "query_id", "key", t.work.under("near"), params=P)
    return hits.select("query_id", "rank", "key", F.round("score", 6).alias("score"))


def q_vector_bounded(t: Tables) -> DataFrame:
    v = t("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = v.filter("vec_id % 50 = 0").withColumnsRenamed({"vec_id": "query_id"})
    work = Workspace(t.spark, "near")
    hits, _ = nearest.search(asked, v, "query_id", "vec_id", work.write, params=P, n=4 * P.top_k, above=None, not_itself=True)
    return hits.select("query_id", "rank", "vec_id", F.round("score", 5).alias("score"))


def q_vector_lookup(t: Tables) -> DataFrame:
    v = t("embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return dense.lookup(t("documents").select(F.col("doc_id").alias("key")), v, ["key"]).select("key", F.col("vector").isNotNull().alias("found"), F.round(vectors.norm(F.col("vector")), 4).alias("length"))


def q_pair_cosine(t: Tables) -> DataFrame:
    v = t("embeddings")
    pairs = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"), (F.col("vec_id") + 1).alias("b")).join(v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb")), "b")
    return dense.pair_similarity(pairs, "va", "vb").select("a", "b", F.round("similarity", 5).alias("similarity"))


# --- fusion


def q_rrf_fuse(t: Tables) -> DataFrame:
    return fused(t).select("query_id", "rank", "key", "rrf_raw", "score_type")


def q_minmax_fuse(t: Tables) -> DataFrame:
    return fusion.weighted(dense_hits(t), sparse_hits(t), top=P.top_k).select("query_id", "rank", "key", "score")


def q_display_score(t: Tables) -> DataFrame:
    return fusion.display_score(fused(t)).select("query_id", "key", "score")


def q_minmax_by_type(t: Tables) -> DataFrame:
    rows = fusion.minmax_of_groups(t("events").select("event_id", "event_type", "value"), "value", ["event_type"])
    return rows.select("event_id", "event_type", F.round("norm", 6).alias("norm"))


def q_query_intent(t: Tables) -> DataFrame:
    return questions(t).select("query_id", F.array_join("intents", ",").alias("intents"), "target")


def known(t: Tables) -> DataFrame:
    return fused(t).join(chunks(t).drop("content"), "key").join(questions(t).select("query_id", "intents", "target"), "query_id")


def q_section_boost(t: Tables) -> DataFrame:
    return fusion.boost(known(t)).select("query_id", "rank", "key", F.round("rrf_raw", 9).alias("rrf_raw"))


def q_project_filter(t: Tables) -> DataFrame:
    return fusion.project_filter(known(t)).select("query_id", "rank", "key", "is_backup")


def q_presets(t: Tables) -> DataFrame:
    table = t("benchmark").sparkSession.createDataFrame([(k, *v) for k, v in PRESETS.items()], "preset string, w_dense double, w_sparse double")
    return shown(t).select("query_id", "key").crossJoin(F.broadcast(table))


def q_mmr(t: Tables) -> DataFrame:
    return diversity.diversify(vector_hits(t), "query_id", "vec_id", Params(dedup_similarity=2.0)).select("query_id", "position", "vec_id")


def q_cross_source_dedup(t: Tables) -> DataFrame:
    return diversity.diversify(vector_hits(t), "query_id", "vec_id", Params(dedup_similarity=0.35)).select("query_id", "position", "vec_id", "stage")


def q_hybrid_search(t: Tables) -> DataFrame:
    n = P.per_channel()
    return search.finish(dense_hits(t, n), sparse_hits(t, n), chunks(t).drop("content").join(document_vectors(t), "key"), questions(t), params=P)


# --- synchronisation


def snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Now: all documents. Before: the labelled ones, of which those of low quality were other texts, and all pages."""
    d = t("documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), "text")
    old = d.join(t("labels"), "doc_id").select("name", F.md5(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit(" "))).cast("binary")).alias("md5"))
    pages = t("pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), F.md5(F.col("html").cast("binary")).alias("md5"))
    return files.file_hashes(d, content="text"), old.union(pages)


def q_file_hashes(t: Tables) -> DataFrame:
    return snapshots(t)[0]


def q_detect_changes(t: Tables) -> DataFrame:
    return sync.detect_changes(*snapshots(t))


def q_detect_changes_by_digest(t: Tables) -> DataFrame:
    now, before = snapshots(t)
    return sync.detect_changes_by_digest(now, before, buckets=512)


def q_file_round_trip(t: Tables) -> DataFrame:
    """Pages as files in the shared folder, under names with spaces, signs and Chinese letters; listed, hashed and read again as whole texts."""
    name = F.concat(F.lit("页 "), F.col("page_id").cast("string"), F.lit("%20 a"), F.when(F.col("page_id") % 3 == 0, ".txt").when(F.col("page_id") % 3 == 1, ".md").otherwise(".png"))
    folder = f"{Workspace(t.spark, 'files').root}/pages"
    files.write_files(t("pages").select(name.alias("name"), F.col("html").alias("text")).filter("length(text) > 0"), folder)
    listed = files.file_hashes(files.list_files(t.spark, folder))
    return listed.join(files.read_texts(t.spark, folder).withColumnRenamed("source", "name"), "name").select("name", "md5", F.length("text").alias("chars"))


def q_change_report(t: Tables) -> DataFrame:
    return sync.change_report(q_detect_changes(t))


def q_changed_names(t: Tables) -> DataFrame:
    return sync.changed_names(q_detect_changes(t))


def q_incremental_append(t: Tables) -> DataFrame:
    return sync.incremental(t("embeddings").select(F.col("vec_id").alias("key")), chunks(t).select("key", "source"), ["key"])


def q_upsert(t: Tables) -> DataFrame:
    now, before = snapshots(t)
    out = sync.upsert(before.withColumnRenamed("name", "source"), now.withColumnRenamed("name", "source"), sync.detect_changes(now, before))
    return out.select("source", "md5")


def artefacts(t: Tables) -> dict[str, DataFrame]:
    return {"chunks": chunks(t).select("key"), "labels": t("labels").select(F.col("doc_id").alias("key")), "vectors": t("embeddings").select(F.col("vec_id").alias("key"))}


def q_index_audit(t: Tables) -> DataFrame:
    return sync.audit(artefacts(t), ["key"])


def q_index_counts(t: Tables) -> DataFrame:
    return sync.counts(artefacts(t))


def q_index_repair(t: Tables) -> DataFrame:
    return sync.repair(artefacts(t), ["key"])["chunks"]


# --- context


def q_validate_question(t: Tables) -> DataFrame:
    good, bad = context.validate(t("conversations").filter("role = 'user'").select("conv_id", "turn", "text"))
    return good.select("conv_id", "turn", F.lit("ok").alias("outcome")).union(bad.select("conv_id", "turn", "reason"))


def q_context(t: Tables) -> DataFrame:
    return context.assemble(shown(t)).select("query_id", "context")


def q_prompt(t: Tables) -> DataFrame:
    made = context.assemble(shown(t)).join(questions(t).select("query_id", "text"), "query_id")
    return made.select("query_id", F.md5(context.prompt(F.col("context"), F.col("text"), "role", "rules {context}").cast("binary")).alias("prompt_md5"))


def q_sources(t: Tables) -> DataFrame:
    return context.assemble(shown(t)).select("query_id", F.posexplode("sources").alias("pos", "s")).select("query_id", "pos", "s.source", "s.file_type", F.md5(F.col("s.content").cast("binary")).alias("content_md5"), "s.score")


def q_used_files(t: Tables) -> DataFrame:
    return context.assemble(shown(t)).select("query_id", F.array_join("used_files", ",").alias("used_files"))


def q_no_hit_fallback(t: Tables) -> DataFrame:
    asked = t("conversations").filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")
    found = t.once("found", lambda: sparse.search_blocks(asked, inverted(t), *block_stats(t), "key", P, 2))
    hits = found.withColumnRenamed("rank", "position").join(chunks(t).withColumn("file_type", F.col("section_type")), "key")
    return context.with_fallback(asked, context.assemble(hits)).select("query_id", F.col("answer").alias("answer"), F.size("sources").alias("n_sources"), F.array_join("used_files", ",").alias("used_files"))


# --- evaluation


def stats(t: Tables) -> DataFrame:
    return t.once("stats", lambda: evaluation.retrieval_stats(questions(t), shown(t), dense_hits(t), sparse_hits(t)))


def q_retrieval_stats(t: Tables) -> DataFrame:
    return stats(t).select("query_id", "total_results", "dense_hits", "sparse_hits", "both_hits", "top_score", "mean_score")


def q_benchmark_summary(t: Tables) -> DataFrame:
    return evaluation.summary(stats(t))


def q_latency(t: Tables) -> DataFrame:
    return evaluation.latency(t("events"), ["event_type"], "value")


def q_api_summary(t: Tables) -> DataFrame:
    return evaluation.api_summary(stats(t).withColumn("latency_ms", F.col("mean_score") * 100))


def searched(t: Tables, k: int) -> DataFrame:
    """A search of its own for k results: fusion depends on how many candidates each channel gives."""
    top = fused(t, P.per_channel(k)).filter(F.col("rank") <= k).select("query_id", "key", F.col("rank").alias("position"))
    return top.join(chunks(t).select("key", "content"), "key")


def relevant_at(t: Tables, ks: tuple[int, ...]) -> DataFrame:
    """(first, query_id, k) of a search of its own at each k."""
    limits = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(P.per_channel(k)).alias("n")) for k in ks])
    most = max(P.per_channel(k) for k in ks)

    def for_each(df: DataFrame) -> DataFrame:
        return df.withColumn("of", F.explode(limits)).withColumn("query_id", F.struct("query_id", "of.k"))

    cut = lambda hits: for_each(hits).filter(F.col("rank") <= F.col("of.n")).drop("of")
    top = fusion.reciprocal_rank(cut(dense_hits(t, most)), cut(sparse_hits(t, most))).filter(F.col("rank") <= F.col("query_id.k"))
    found = top.select("query_id", "key", F.col("rank").alias("position")).join(chunks(t).select("key", "content"), "key")
    return evaluation.relevance(found, for_each(questions(t)).drop("of")).select("first", "query_id.query_id", "query_id.k")


def q_hit_rate(t: Tables) -> DataFrame:
    return evaluation.hit_rate(relevant_at(t, (1, 3, 5)))


def q_mrr(t: Tables) -> DataFrame:
    return evaluation.mean_reciprocal_rank(evaluation.relevance(searched(t, 10), questions(t)))


def q_category_stats(t: Tables) -> DataFrame:
    category = F.coalesce(F.get(F.col("intents"), F.lit(0)), F.lit("other"))
    return evaluation.by_category(stats(t).join(questions(t).select("query_id", category.alias("category")), "query_id"))


def q_overall_stats(t: Tables) -> DataFrame:
    return evaluation.overall(stats(t))


def q_categories_and_overall(t: Tables) -> DataFrame:
    category = F.coalesce(F.get(F.col("intents"), F.lit(0)), F.lit("other"))
    return evaluation.categories_and_overall(stats(t).join(questions(t).select("query_id", category.alias("category")), "query_id"))


def q_preset_compare(t: Tables) -> DataFrame:
    return evaluation.compare_presets(fused(t).filter(F.col("rank") <= P.top_k), relevant_at(t, (1, 3, 5, 10)), stats(t))


def q_index_quality(t: Tables) -> DataFrame:
    return evaluation.index_quality(chunks(t), t("embeddings"), vector="embedding")


def q_per_file(t: Tables) -> DataFrame:
    return evaluation.per_file(chunks(t))


def q_document_list(t: Tables) -> DataFrame:
    return evaluation.document_list(chunks(t).select("source", F.col("section_type").alias("file_type"), F.col("key").alias("chunk_index")))


def q_chunk_count(t: Tables) -> DataFrame:
    return chunks(t).agg(F.count("*").alias("chunks"))


def q_report_record(t: Tables) -> DataFrame:
    return evaluation.report(stats(t).join(questions(t).select("query_id", F.col("text").alias("question"), F.coalesce(F.get("intents", F.lit(0)), F.lit("other")).alias("category")), "query_id"))


# --- judge


def replies(t: Tables) -> DataFrame:
    score = lambda by: (F.col("doc_id") % by % 5 + 1).cast("string")
    body = F.concat(F.lit('{"accuracy": '), score(7), F.lit(', "relevance": '), score(11), F.lit(', "completeness": '), score(13), F.lit(', "comment": "c'), F.col("doc_id").cast("string"), F.lit('"}'))
    reply = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("toxic") == 1, F.concat(F.lit("Scores:\n```\n"), body, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("broken "), body))
    return t("labels").select(F.col("doc_id").alias("id"), reply.alias("reply"))


def q_judge_parse(t: Tables) -> DataFrame:
    return judge.parse(replies(t)).select("id", "judged.*")


def q_judge_retry(t: Tables) -> DataFrame:
    return judge.parse(replies(t)).filter(judge.asks_again(F.col("judged"))).select("id")


def q_judge_summary(t: Tables) -> DataFrame:
    first = judge.parse(replies(t))
    again = first.filter(judge.asks_again(F.col("judged"))).select("id", F.struct(F.lit(4).alias("accuracy"), (F.col("id") % 5 + 1).cast("int").alias("relevance"), F.lit(3).alias("completeness")).alias("judged"))
    return judge.summary(first, again)


def q_judge_prompt(t: Tables) -> DataFrame:
    made = context.assemble(shown(t)).join(questions(t).select("query_id", "text"), "query_id", "right")
    return made.select("query_id", judge.judge_context(F.col("sources")).alias("context"), judge.short_answer(F.col("text")).alias("answer"))


def q_question_sample(t: Tables) -> DataFrame:
    return judge.sample(t("benchmark").select(F.col("item_id").alias("id")), 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(Tables(spark, sf_dir))

    return {name[2:]: bound(f) for name, f in globals().items() if name.startswith("q_")}
