"""Registered queries of the core: name -> (session, table folder) -> DataFrame, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import html, http, text, urls, vectors
from quillspark.operators import crawl as crawling
from quillspark.operators import semantic, stats
from quillspark.operators.audit import length_audit, posting_profile
from quillspark.operators.index import SearchIndex, append_documents, build_index, dense_ids, duplicate_ids, merge_indexes
from quillspark.operators.keyed import key_profile
from quillspark.operators.match import boolean_search, match_relational
from quillspark.operators.rank import batch_search, bm25, get_scorer, ranked_search, score, tfidf, top, with_documents
from quillspark.plans.query import parse
from quillspark.session import spread, table
from quillspark.sources.corpus import document_text, id_from_json, systematic_sample, text_from_json

Query = Callable[[SparkSession, str], DataFrame]

#: Folder names of the sample sources and their display titles, for book_names.
BOOKS = {"novel_scans": "Novels", "letters_archive": "Letters", "chapter_dump": "Chapters"}
#: Relevance for precision_at_k: documents of this source.
RELEVANT_SOURCE = "novel_scans"
BATCH = {1: "silence garden", 2: "silence OR garden OR winter", 3: "the NOT garden", 4: "harken (window OR voice)", 5: "borrowed", 6: '"the garden grew"', 7: "winter winter voice"}
ENTRY_QUERY = "the of"

_INDEXES: dict[tuple[str, str], SearchIndex] = {}


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "path", "text")


def index_of(spark: SparkSession, d: str) -> SearchIndex:
    """The index of a folder's documents, kept for the session so that search queries do not tokenize again."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = build_index(documents(spark, d)).cached()
    return _INDEXES[key]


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").filter("vec_id = 0").first().embedding]


def _owned(spark: SparkSession, d: str, owner: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.expr(owner).alias("doc_id"), "embedding")


def tokenize_docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(documents(spark, d)).select("doc_id", F.posexplode(text.tokens(F.col("text"))).alias("pos", "term"))


def token_lengths(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", text.n_tokens(F.col("text")).cast("int").alias("dl"))


def titles(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).docs.select("doc_id", "title")


def postings_tf(spark: SparkSession, d: str) -> DataFrame:
    return build_index(documents(spark, d), positions=False).postings.select("term", "doc_id", "tf")


def postings_positions(spark: SparkSession, d: str) -> DataFrame:
    return build_index(documents(spark, d)).postings.select("term", "doc_id", "tf", F.array_join("positions", ",").alias("positions"))


def term_df(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).terms


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).stats.withColumn("avgdl", F.round("avgdl", 6))


def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    return stats.corpus_stats(documents(spark, d))


def top_terms(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_terms(documents(spark, d), 50)


def term_df_ranking(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).terms.orderBy(F.desc("df"), "term").select("term", "df").limit(100)


def _matching(query: str) -> Query:
    return lambda spark, d: boolean_search(index_of(spark, d), query)


def _relational(query: str, hint: str) -> Query:
    return lambda spark, d: match_relational(index_of(spark, d), query, hint)


def _ranking(query: str, scorer: object = "bm25", k: int = 10, page: int = 1) -> Query:
    return lambda spark, d: ranked_search(index_of(spark, d), query, scorer, k, page)


def rank_all(spark: SparkSession, d: str) -> DataFrame:
    return score(index_of(spark, d), "silence OR garden OR winter OR the")


def rank_custom_scorer(spark: SparkSession, d: str) -> DataFrame:
    return ranked_search(index_of(spark, d), "silence OR voice", lambda tf, df, dl, n, avgdl: tf / F.sqrt(dl) * F.log1p(n / df))


def batch_ranking(spark: SparkSession, d: str) -> DataFrame:
    return batch_search(index_of(spark, d), BATCH)


def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    return ranked_search(index_of(spark, d), "silence garden", snippets=True)


def highlight_passages(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).filter("text is not null").select("doc_id", text.highlight_text(F.col("text"), "silence AND garden OR winter").alias("html"))


def highlight_hits(spark: SparkSession, d: str) -> DataFrame:
    starred = F.regexp_replace("text", r"\b(the|and)\b", "**$1**")
    return documents(spark, d).filter("text is not null").select("doc_id", text.highlight_snippet(starred).alias("html"))


def display_titles(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).docs.select("doc_id", text.display_title(F.col("title")).alias("shown"))


def book_names(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", text.book_slug(F.col("path")).alias("slug"), text.book_name(F.col("path"), BOOKS).alias("book"))


def headings(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).filter(F.trim("text") != "").select("doc_id", text.heading(F.lit("Shelf"), F.col("text")).alias("heading"))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("no", "paragraph"))


def byte_sizes(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).filter("text is not null").select("doc_id", text.format_bytes(F.octet_length("text").cast("bigint") * 100).alias("size"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return semantic.chunk_documents(documents(spark, d))


def chunk_encoding(spark: SparkSession, d: str) -> DataFrame:
    embedded = semantic.embed_chunks(semantic.chunk_documents(documents(spark, d), 128, 16), semantic.hash_encoder())
    return embedded.select("doc_id", "chunk_no", F.round(vectors.norm(F.col("embedding")), 4).alias("length"))


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    unit = vectors.l2_normalize(F.transform("embedding", lambda x: x * 3))
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(unit), 4).alias("length"), F.round(F.get(unit, F.lit(0)).cast("double"), 5).alias("first"))


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return top(semantic.semantic_scores(_owned(spark, d, "vec_id"), _query_vector(spark, d)), 10)


def semantic_titles(spark: SparkSession, d: str) -> DataFrame:
    """A page of hits with titles, most of them of documents that the index does not hold."""
    return with_documents(index_of(spark, d), top(semantic.semantic_scores(_owned(spark, d, "vec_id * 3"), _query_vector(spark, d)), 20))


def best_chunk_by_owner(spark: SparkSession, d: str) -> DataFrame:
    return semantic.semantic_scores(_owned(spark, d, "vec_id % 100"), _query_vector(spark, d))


def embedded_owners(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("embedding is not null").agg(F.count_distinct("doc_id").alias("n"))


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "search_hits").filter("score is not null and not isnan(score)")
    best = hits.groupBy("query_id", F.lower("mode").alias("mode"), "doc_id").agg(F.max("score").alias("score"))
    return semantic.fuse_lists(best, ["query_id"], "mode")


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    index = index_of(spark, d)
    keyword = top(score(index, parse("silence OR garden")), 200)
    near = top(semantic.semantic_scores(_owned(spark, d, "vec_id"), _query_vector(spark, d)), 200)
    return top(semantic.reciprocal_rank_fusion(keyword, near), 10)


def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    hits = batch_search(index_of(spark, d), BATCH).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return stats.precision_at_k(hits, F.col("source") == RELEVANT_SOURCE, 10)


def median_times(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("run"), "value")
    base = rows.agg(F.min("run").alias("r")).first().r
    return stats.medians(rows, "run", "value", base).select("run", F.round("median", 6).alias("median"), F.round("speedup", 6).alias("speedup"))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, d)
    return docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")


def merge_partials(spark: SparkSession, d: str) -> DataFrame:
    """Two partial indexes of all documents, merged."""
    return merge_indexes(*map(build_index, _halves(spark, d))).postings.select("term", "doc_id", "tf", F.array_join("positions", ",").alias("positions"))


def append_index(spark: SparkSession, d: str) -> DataFrame:
    """One half indexed, then all documents appended: those already held are left alone."""
    first, _ = _halves(spark, d)
    return append_documents(build_index(first), documents(spark, d)).terms


def duplicate_check(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return duplicate_ids(docs.unionByName(docs.filter("path like '%.jsonl'")))


def dense_numbering(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ext"), "path")
    return dense_ids(rows, "path", "ext").select("ext", "doc_id")


def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    return document_text(index_of(spark, d).docs, 7)


def documents_per_file(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def first_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).orderBy("doc_id").limit(25).select("doc_id", "path")


def jsonl_ingest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("line", F.to_json(F.struct(F.col("ext_id").alias("id"), F.col("text").alias("body"))))
    fallback = F.concat_ws(":", "path", F.col("doc_id").cast("string"))
    parsed = rows.select("doc_id", id_from_json(F.col("line"), fallback).alias("ext_id"), text_from_json(F.col("line")).alias("text"))
    return parsed.filter(F.length("text") > 0)


def demo_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("length(text) >= 80 and source is not null")
    return systematic_sample(rows.select("source", "doc_id"), "source", "doc_id")


def _markup(pages: DataFrame) -> DataFrame:
    """Pages as HTML: the title, a script to skip, every line a paragraph, and links to the two pages below it in a binary tree."""
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), text.escape_html(x), F.lit("</p>"))), "")
    link = lambda k: F.concat(F.lit("<a href='/p/"), (F.col("page_no") * 2 + k).cast("string"), F.lit("#top'>next</a>"))
    head = F.concat(F.lit("<title>"), text.escape_html(F.coalesce("title", F.lit(""))), F.lit("</title><script>skipped()</script>"))
    url = F.concat(F.lit("https://Site.Example:443/p/"), F.col("page_no").cast("string"), F.lit("/"))
    return pages.select("page_no", url.alias("url"), F.concat(F.lit("<html>"), head, body, link(1), link(2), F.lit("</html>")).alias("body"))


def html_parse(spark: SparkSession, d: str) -> DataFrame:
    pages = _markup(table(spark, d, "pages")).withColumn("p", html.parse_html(F.col("url"), F.col("body")))
    return pages.select("page_no", F.col("p.title").alias("title"), F.col("p.text").alias("text"))


def link_extract(spark: SparkSession, d: str) -> DataFrame:
    pages = _markup(table(spark, d, "pages")).withColumn("p", html.parse_html(F.col("url"), F.col("body")))
    return pages.select("page_no", F.posexplode("p.links").alias("no", "link"))


def html_detection(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("text/html; charset=utf-8", "text/plain", "application/pdf", "")]), (F.col("page_no") % 4 + 1).cast("int"))
    return _markup(table(spark, d, "pages")).select("page_no", html.is_html(kinds, F.col("body")).alias("page"))


def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.concat(F.lit(" HTTPS://User@"), F.regexp_replace("url", "^https?://", ""), F.when(F.col("url").contains("?"), F.lit("&a=1#frag")).otherwise(F.lit("?b=2&a=1#frag")))
    return table(spark, d, "pages").select("page_no", urls.canonical_url(dirty).alias("canonical"), urls.url_host(F.col("url")).alias("host"), urls.url_origin(F.col("url")).alias("origin"))


def _site_robots(spark: SparkSession, origins: DataFrame) -> DataFrame:
    """Robots answers by the last digit of the origin's text length: rules, missing, failing."""
    kind = F.length("origin") % 3
    return origins.select("origin", F.when(kind == 0, 200).when(kind == 1, 404).otherwise(500).alias("status"), F.lit("User-agent: *\nDisallow: /read\n").alias("body"))


def robots_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_no", "url")
    origins = pages.select(urls.url_origin(F.col("url")).alias("origin")).distinct()
    return crawling.robots_allowed(pages, _site_robots(spark, origins)).select("page_no", "verdict")


def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    """A closed site made of all pages, linked as a binary tree, crawled with a budget of 200 from its root."""
    site = _markup(table(spark, d, "pages")).withColumn("key", F.concat(F.lit("https://site.example/p/"), F.col("page_no").cast("string")))

    def fetch(frontier: DataFrame) -> DataFrame:
        body = site.select(F.col("key").alias("url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("final_url"), "body")
        return body.join(frontier, "url", "left_semi")

    robots = spark.createDataFrame([("https://site.example", 404, None)], "origin string, status int, body string")
    return crawling.crawl(spark, ["https://Site.example/p/0/#x"], fetch, robots, max_pages=200).select("url")


def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    """Attempts made of events: a Retry-After in seconds or as a date, or none, and the delay that follows."""
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 8).cast("int").alias("attempt"))
    dated = F.lit("Wed, 21 Oct 2015 07:28:30 GMT")
    header = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 20).cast("string")).when(F.col("event_id") % 3 == 1, dated)
    wait = http.retry_after(header, F.to_timestamp(F.lit("2015-10-21 07:28:00")))
    return rows.select("event_id", wait.alias("wait"), http.backoff_seconds(F.col("attempt"), wait).alias("delay"))


def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Three tries per URL made of events: which were made, and how each URL ended."""
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 404, 500, 429)]), (F.col("event_id") * 7 % 4 + 1).cast("int"))
    rows = table(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("url"), (F.col("event_id") % 3 + 1).cast("int").alias("attempt"), status.alias("status"), F.lit(None).cast("string").alias("error"))
    return crawling.settle_attempts(rows)


def crawl_log_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    status = F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("int")).otherwise(F.lit(200))
    wait = F.when(F.col("event_id") % 2 == 0, F.lit(1.5))
    line = http.log_line(F.lit("t"), F.concat(F.lit("u"), F.col("event_id").cast("string")), status, F.col("event_id"), F.lit(0.25), F.lit(1), F.lit(None).cast("string"), wait)
    return e.select("event_id", line.alias("line"))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    return posting_profile(table(spark, d, "postings"), (0.5, 0.9, 0.99))


def p5_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of text lengths per source, of which a handful hold all rows; lengths far exceed what has a bucket of its own."""
    rows = table(spark, d, "documents").select("source", F.length("text").alias("chars"))
    return key_profile(rows, "source", "chars", (0.1, 0.5, 0.9, 0.999))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    audit = length_audit(table(spark, d, "postings"), table(spark, d, "doc_lengths"), table(spark, d, "docs_meta"), ())
    return audit.filter("surplus <> 0").select("doc_id")


QUERIES: dict[str, Query] = {
    "tokenize_docs": tokenize_docs,
    "token_lengths": token_lengths,
    "titles": titles,
    "postings_tf": postings_tf,
    "postings_positions": postings_positions,
    "term_df": term_df,
    "corpus_stats": corpus_stats,
    "corpus_report": corpus_report,
    "top_terms": top_terms,
    "term_df_ranking": term_df_ranking,
    "bool_term": _matching("silence"),
    "bool_and": _matching("silence garden"),
    "bool_or": _matching("silence OR garden"),
    "bool_not": _matching("NOT the"),
    "bool_nested": _matching("(silence OR garden) AND the NOT (winter OR NOT of)"),
    "bool_and_merge": _relational("silence the of", "merge"),
    "bool_and_hash": _relational("silence the of", "shuffle_hash"),
    "phrase_two": _matching('"the garden"'),
    "phrase_three": _matching('"the garden grew" OR "of it in"'),
    "phrase_relational": _relational('"the garden" NOT "garden grew"', "merge"),
    "bm25_term": _ranking("silence"),
    "bm25_and": _ranking(ENTRY_QUERY),
    "bm25_or": _ranking("silence OR garden OR winter"),
    "bm25_dup_terms": _ranking("silence silence garden"),
    "bm25_custom": _ranking("silence OR garden", bm25(1.2, 0.5)),
    "bm25_phrase": _ranking('"the garden" silence'),
    "tfidf_or": _ranking("silence OR garden OR the", tfidf),
    "rank_pure_not": _ranking("NOT the"),
    "rank_partial_not": _ranking("garden OR NOT the", get_scorer("BM25")),
    "page_two": _ranking("silence OR garden", k=10, page=2),
    "rank_all": rank_all,
    "rank_custom_scorer": rank_custom_scorer,
    "batch_ranking": batch_ranking,
    "search_snippets": search_snippets,
    "highlight_passages": highlight_passages,
    "highlight_hits": highlight_hits,
    "display_titles": display_titles,
    "book_names": book_names,
    "headings": headings,
    "paragraphs": paragraphs,
    "byte_sizes": byte_sizes,
    "chunk_windows": chunk_windows,
    "chunk_encoding": chunk_encoding,
    "l2_normalize": l2_normalize,
    "semantic_topk": semantic_topk,
    "semantic_titles": semantic_titles,
    "best_chunk_by_owner": best_chunk_by_owner,
    "embedded_owners": embedded_owners,
    "rrf_fuse": rrf_fuse,
    "hybrid_topk": hybrid_topk,
    "precision_at_k": precision_at_k,
    "median_times": median_times,
    "merge_partials": merge_partials,
    "append_index": append_index,
    "duplicate_check": duplicate_check,
    "dense_numbering": dense_numbering,
    "document_lookup": document_lookup,
    "documents_per_file": documents_per_file,
    "first_documents": first_documents,
    "jsonl_ingest": jsonl_ingest,
    "demo_sample": demo_sample,
    "html_parse": html_parse,
    "link_extract": link_extract,
    "html_detection": html_detection,
    "url_canonical": url_canonical,
    "robots_filter": robots_filter,
    "crawl_bfs": crawl_bfs,
    "retry_delays": retry_delays,
    "fetch_outcomes": fetch_outcomes,
    "crawl_log_lines": crawl_log_lines,
    "p5_found": p5_found,
    "p5_profile": p5_profile,
    "p5_lengths": p5_lengths,
}
