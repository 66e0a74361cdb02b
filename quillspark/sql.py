"""The same results as plain SQL for an independent engine, over whole tables."""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]+(?:[''’-][\p{L}\p{N}_]+)*"
FOLDED = "replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss')"
TOKENS = f"regexp_extract_all({FOLDED}, '{WORD}')"
#: First non-blank line, trimmed, 80 characters; the file's stem without one.
TITLE = r"""CASE WHEN regexp_extract(text, '(\S[^\n\r]*)', 1) <> '' THEN substring(regexp_replace(regexp_extract(text, '(\S[^\n\r]*)', 1), '\s+$', ''), 1, 80)
  ELSE regexp_extract(coalesce(path, ''), '([^/]*?)(?:\.[^./]*)?$', 1) END"""

INDEX = f"""t AS (SELECT doc_id, {TOKENS} AS tk, {TITLE} AS title FROM documents),
x AS (SELECT doc_id, unnest(range(len(tk)))::INTEGER AS pos, unnest(tk) AS term FROM t),
p AS (SELECT term, doc_id, count(*)::INTEGER AS tf FROM x GROUP BY ALL),
dl AS (SELECT doc_id, len(tk) AS dl FROM t),
f AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term),
s AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl)"""

_POSTINGS = f"""WITH {INDEX} SELECT term, doc_id, count(*)::INTEGER AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM x GROUP BY term, doc_id"""


def has(word: str) -> str:
    return f"bool_or(term = '{word}')"


def _phrase(*words: str) -> str:
    """Documents that hold the words in a row."""
    joins = "".join(f" JOIN x x{i} ON x{i}.doc_id = x0.doc_id AND x{i}.pos = x0.pos + {i} AND x{i}.term = '{w}'" for i, w in enumerate(words) if i)
    return f"SELECT DISTINCT x0.doc_id FROM x x0{joins} WHERE x0.term = '{words[0]}'"


def _bm25(k1: float = 1.5, b: float = 0.75) -> str:
    return f"ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))"


def _scores(times: dict[str, int], having: str, weight: str | None = None, extra: tuple[str, ...] = ()) -> str:
    case = " ".join(f"WHEN '{w}' THEN {n}" for w, n in times.items())
    words = ", ".join(f"'{w}'" for w in (*times, *extra))
    return f"""SELECT doc_id, round(sum(CASE term {case} END * {weight or _bm25()}), 6) AS score
FROM p JOIN f USING (term) JOIN dl USING (doc_id) CROSS JOIN s WHERE term IN ({words}) GROUP BY doc_id
HAVING ({having}) AND bool_or(term IN ({", ".join(f"'{w}'" for w in times)}))"""


def _top(scores: str, k: int = 10, page: int = 1, title: bool = True) -> str:
    return f"""WITH {INDEX}, sc AS ({scores}),
r AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM sc)
SELECT rank, doc_id, score{", title" if title else ""} FROM r {"JOIN t USING (doc_id)" if title else ""} WHERE rank > {(page - 1) * k} AND rank <= {page * k}"""


def _match(having: str) -> str:
    """Over all documents, those without any word included."""
    return f"WITH {INDEX} SELECT doc_id FROM t LEFT JOIN p USING (doc_id) GROUP BY doc_id HAVING coalesce({having}, false)"


def _absent(word: str) -> str:
    return f"NOT coalesce({has(word)}, false)"


_SILENCE_GARDEN_WINTER = {"silence": 1, "garden": 1, "winter": 1}
_ANY = "true"

_BATCH = [
    (1, {"silence": 1, "garden": 1}, f"{has('silence')} AND {has('garden')}", ()),
    (2, _SILENCE_GARDEN_WINTER, _ANY, ()),
    (3, {"the": 1}, f"{has('the')} AND NOT {has('garden')}", ("garden",)),
    (4, {"harken": 1, "window": 1, "voice": 1}, f"{has('harken')} AND ({has('window')} OR {has('voice')})", ()),
    (5, {"borrowed": 1}, _ANY, ()),
    (6, {"the": 1, "garden": 1, "grew": 1}, f"doc_id IN ({_phrase('the', 'garden', 'grew')})", ()),
    (7, {"winter": 2, "voice": 1}, f"{has('winter')} AND {has('voice')}", ()),
]
_BATCH_RANKED = ", ".join(f"b{q} AS ({_scores(times, having, None, extra)})" for q, times, having, extra in _BATCH)
_BATCH_SQL = f"""WITH {INDEX}, {_BATCH_RANKED},
u AS ({" UNION ALL ".join(f"SELECT {q}::BIGINT AS query_id, * FROM b{q}" for q, *_ in _BATCH)}),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM u)"""

_ESCAPED = """replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;')"""
_QUERY_VECTOR = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0)"
_NEAR = f"{_QUERY_VECTOR}, near AS (SELECT vec_id AS doc_id, round(list_dot_product(embedding::DOUBLE[], qv), 6) AS score FROM embeddings, q)"

_LATEST = """latest AS (
  SELECT partial_no, term, doc_id, any_value(coalesce(tf, len(positions))) AS tf
  FROM (SELECT *, max(built_at) OVER (PARTITION BY partial_no, term, doc_id) AS newest FROM postings)
  WHERE built_at = newest GROUP BY partial_no, term, doc_id)"""

_LENGTHS = """lens AS (
  SELECT doc_id, coalesce(sum(dl), 0) AS dl FROM (SELECT DISTINCT partial_no, doc_id, dl FROM doc_lengths) GROUP BY doc_id)"""

ORACLES: dict[str, str] = {
    "tokenize_docs": f"WITH {INDEX} SELECT doc_id, pos, term FROM x",
    "token_lengths": f"WITH {INDEX} SELECT doc_id, dl::INTEGER AS dl FROM dl",
    "titles": f"WITH {INDEX} SELECT doc_id, title FROM t",
    "postings_tf": f"WITH {INDEX} SELECT term, doc_id, tf FROM p",
    "postings_positions": _POSTINGS,
    "term_df": f"WITH {INDEX} SELECT term, df, cf FROM f",
    "corpus_stats": f"""WITH {INDEX} SELECT n AS n_docs, (SELECT sum(dl) FROM dl)::BIGINT AS n_tokens, (SELECT count(*) FROM f) AS vocabulary, round(avgdl, 6) AS avgdl FROM s""",
    "corpus_report": f"""WITH {INDEX} SELECT n AS n_docs, (SELECT sum(dl) FROM dl)::BIGINT AS n_tokens, (SELECT count(*) FROM f) AS vocabulary FROM s""",
    "top_terms": f"WITH {INDEX} SELECT term, cf AS n FROM f ORDER BY cf DESC, term LIMIT 50",
    "term_df_ranking": f"WITH {INDEX} SELECT term, df FROM f ORDER BY df DESC, term LIMIT 100",
    "bool_term": _match(has("silence")),
    "bool_and": _match(f"{has('silence')} AND {has('garden')}"),
    "bool_or": _match(f"{has('silence')} OR {has('garden')}"),
    "bool_not": _match(_absent("the")),
    "bool_nested": _match(f"({has('silence')} OR {has('garden')}) AND {has('the')} AND NOT ({has('winter')} OR NOT {has('of')})"),
    "bool_and_merge": _match(f"{has('silence')} AND {has('the')} AND {has('of')}"),
    "bool_and_hash": _match(f"{has('silence')} AND {has('the')} AND {has('of')}"),
    "phrase_two": f"WITH {INDEX} {_phrase('the', 'garden')}",
    "phrase_three": f"WITH {INDEX} {_phrase('the', 'garden', 'grew')} UNION {_phrase('of', 'it', 'in')}",
    "phrase_relational": f"WITH {INDEX} {_phrase('the', 'garden')} EXCEPT {_phrase('garden', 'grew')}",
    "bm25_term": _top(_scores({"silence": 1}, _ANY)),
    "bm25_and": _top(_scores({"the": 1, "of": 1}, f"{has('the')} AND {has('of')}")),
    "bm25_or": _top(_scores(_SILENCE_GARDEN_WINTER, _ANY)),
    "bm25_dup_terms": _top(_scores({"silence": 2, "garden": 1}, f"{has('silence')} AND {has('garden')}")),
    "bm25_custom": _top(_scores({"silence": 1, "garden": 1}, _ANY, _bm25(1.2, 0.5))),
    "bm25_phrase": _top(_scores({"the": 1, "garden": 1, "silence": 1}, f"{has('silence')} AND doc_id IN ({_phrase('the', 'garden')})")),
    "tfidf_or": _top(_scores({"silence": 1, "garden": 1, "the": 1}, _ANY, "tf * ln(n / df)")),
    "rank_pure_not": _top(f"SELECT doc_id, 0.0::DOUBLE AS score FROM t LEFT JOIN p USING (doc_id) GROUP BY doc_id HAVING {_absent('the')}"),
    "rank_partial_not": _top(_scores({"garden": 1}, _ANY)),
    "page_two": _top(_scores({"silence": 1, "garden": 1}, _ANY), 10, 2),
    "rank_all": f"WITH {INDEX} {_scores({'silence': 1, 'garden': 1, 'winter': 1, 'the': 1}, _ANY)}",
    "rank_custom_scorer": _top(_scores({"silence": 1, "voice": 1}, _ANY, "tf / sqrt(dl) * ln(1 + n / df)")),
    "batch_ranking": f"{_BATCH_SQL} SELECT * FROM r WHERE rank <= 10",
    "highlight_passages": f"""SELECT doc_id, regexp_replace({_ESCAPED}, '(?i)(^|[^\\pL\\pN_])(silence|garden|winter)\\b', '\\1<mark>\\2</mark>', 'g') AS html
FROM documents WHERE text IS NOT NULL""",
    "highlight_hits": f"""SELECT doc_id, regexp_replace(regexp_replace({_ESCAPED}, '\\b(the|and)\\b', '**\\1**', 'g'), '\\*\\*(.+?)\\*\\*', '<mark>\\1</mark>', 'g') AS html
FROM documents WHERE text IS NOT NULL""",
    "display_titles": rf"""WITH {INDEX} SELECT doc_id, CASE WHEN length(title) >= 80 AND contains(title, ' ')
  THEN rtrim(regexp_replace(title, ' [^ ]*$', ''), '.,;:') || '…' ELSE title END AS shown FROM t""",
    "book_names": """SELECT doc_id, regexp_extract(path, '([^/]+)/[^/]*$', 1) AS slug, CASE regexp_extract(path, '([^/]+)/[^/]*$', 1)
  WHEN 'novel_scans' THEN 'Novels' WHEN 'letters_archive' THEN 'Letters' WHEN 'chapter_dump' THEN 'Chapters' END AS book FROM documents""",
    "headings": """WITH h AS (SELECT doc_id, split_part(trim(text), '. ', 1) AS sentence FROM documents WHERE trim(text) <> '')
SELECT doc_id, substring('Shelf — ' || CASE WHEN length(sentence) <= 48 THEN sentence ELSE regexp_replace(substring(sentence, 1, 48), ' [^ ]*$', '') END, 1, 80) AS heading FROM h""",
    "paragraphs": r"""WITH b AS (SELECT doc_id, [x for x in [regexp_replace(regexp_replace(y, '[ \t\r\f\v]*\n[ \t\r\f\v]*', ' ', 'g'), '^\s+|\s+$', '', 'g')
  for y in regexp_split_to_array(replace(text, chr(13) || chr(10), chr(10)), '\n[ \t\r\f\v]*(?:\n[ \t\r\f\v]*)+')] if length(x) >= 280] AS ps FROM documents WHERE text IS NOT NULL)
SELECT doc_id, unnest(range(len(ps)))::INTEGER AS no, unnest(ps) AS paragraph FROM b""",
    "byte_sizes": """WITH b AS (SELECT doc_id, strlen(text) * 100 AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024) ELSE printf('%.1f MiB', n / 1048576) END AS size FROM b""",
    "chunk_windows": f"""WITH {INDEX}, w AS (SELECT doc_id, tk, unnest(range(CASE WHEN len(tk) = 0 THEN 0 WHEN len(tk) <= 256 THEN 1 ELSE 1 + ceil((len(tk) - 256) / 224)::BIGINT END)) AS i FROM t)
SELECT doc_id, i::INTEGER AS chunk_no, array_to_string(tk[i * 224 + 1 : i * 224 + 256], ' ') AS text FROM w""",
    "url_canonical": r"""WITH u AS (SELECT page_no, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS place,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, list_sort(list_concat(['a=1'], CASE WHEN url LIKE '%?%' THEN string_split(regexp_extract(url, '\?([^#]*)', 1), '&') ELSE ['b=2'] END)) AS query FROM pages)
SELECT page_no, 'https://' || lower(place) || coalesce(nullif(rtrim(path, '/'), ''), '/') || '?' || array_to_string(query, '&') AS canonical, lower(regexp_replace(place, ':\d+$', '')) AS host,
  scheme || '://' || place AS origin FROM u""",
    "chunk_encoding": f"""WITH {INDEX}, w AS (SELECT doc_id, unnest(range(CASE WHEN len(tk) = 0 THEN 0 WHEN len(tk) <= 128 THEN 1 ELSE 1 + ceil((len(tk) - 128) / 112)::BIGINT END)) AS i FROM t)
SELECT doc_id, i::INTEGER AS chunk_no, 1.0::DOUBLE AS length FROM w""",
    "l2_normalize": """SELECT vec_id, 1.0::DOUBLE AS length, round((embedding[1] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))::DOUBLE, 5) AS first FROM embeddings""",
    "semantic_topk": f"""WITH {_NEAR} SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM near QUALIFY rank <= 10""",
    "semantic_titles": f"""WITH {INDEX}, {_QUERY_VECTOR}, hit AS (SELECT vec_id * 3 AS doc_id, round(max(list_dot_product(embedding::DOUBLE[], qv)), 6) AS score FROM embeddings, q GROUP BY 1),
r AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM hit QUALIFY rank <= 20)
SELECT rank, doc_id, score, coalesce(title, '?') AS title FROM r LEFT JOIN t USING (doc_id)""",
    "best_chunk_by_owner": f"""WITH {_QUERY_VECTOR} SELECT vec_id % 100 AS doc_id, round(max(list_dot_product(embedding::DOUBLE[], qv)), 6) AS score FROM embeddings, q GROUP BY 1""",
    "embedded_owners": "SELECT count(DISTINCT doc_id) AS n FROM chunks WHERE embedding IS NOT NULL",
    "rrf_fuse": """WITH b AS (SELECT query_id, lower(mode) AS mode, doc_id, max(score) AS score FROM search_hits WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, mode ORDER BY score DESC, doc_id) AS r FROM b)
SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM r GROUP BY query_id, doc_id""",
    "hybrid_topk": f"""WITH {INDEX}, {_NEAR}, kw AS ({_scores({"silence": 1, "garden": 1}, _ANY)}),
a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM kw QUALIFY rank <= 200),
b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM near QUALIFY rank <= 200),
u AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id)
SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM u QUALIFY rank <= 10""",
    "precision_at_k": f"""{_BATCH_SQL} SELECT query_id, count(*) FILTER (WHERE source = 'novel_scans') / 10 AS precision
FROM r JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY query_id""",
    "median_times": """WITH m AS (SELECT event_type AS run, median(value) AS median FROM events GROUP BY 1)
SELECT run, round(median, 6) AS median, round((SELECT median FROM m ORDER BY run LIMIT 1) / median, 6) AS speedup FROM m""",
    "merge_partials": _POSTINGS,
    "append_index": f"WITH {INDEX} SELECT term, df, cf FROM f",
    "duplicate_check": "SELECT doc_id, 2::BIGINT AS n FROM documents WHERE path LIKE '%.jsonl'",
    "dense_numbering": "SELECT doc_id AS ext, row_number() OVER (ORDER BY path COLLATE C, doc_id) - 1 AS doc_id FROM documents",
    "document_lookup": f"WITH {INDEX} SELECT doc_id, coalesce(d.text, t.title) AS text FROM documents d JOIN t USING (doc_id) WHERE doc_id = 7",
    "documents_per_file": "SELECT path, count(*) AS n FROM documents GROUP BY path",
    "first_documents": "SELECT doc_id, path FROM documents ORDER BY doc_id LIMIT 25",
    "jsonl_ingest": "SELECT doc_id, coalesce(ext_id, path || ':' || doc_id) AS ext_id, text FROM documents WHERE text <> ''",
    "demo_sample": """WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, greatest(count(*) OVER (PARTITION BY source) // 100, 1) AS step
  FROM documents WHERE length(text) >= 80 AND source IS NOT NULL) SELECT source, doc_id FROM n WHERE i % step = 0 AND i / step < 100""",
    "html_parse": r"""WITH w AS (SELECT page_no, coalesce(title, '') AS title, array_to_string([x for x in regexp_split_to_array(text, '\n') if trim(x) <> ''], ' ') AS body FROM pages)
SELECT page_no, CASE WHEN trim(title) = '' THEN 'https://Site.Example:443/p/' || page_no || '/' ELSE trim(regexp_replace(title, '\s+', ' ', 'g')) END AS title,
  CASE WHEN trim(title) = '' THEN '' ELSE trim(regexp_replace(title, '\s+', ' ', 'g')) || chr(10) END ||
  trim(regexp_replace(title || ' ' || body || 'nextnext', '\s+', ' ', 'g')) AS text FROM w""",
    "link_extract": "SELECT page_no, k::INTEGER AS no, 'https://site.example/p/' || (page_no * 2 + k + 1) AS link FROM pages, range(2) r(k)",
    "html_detection": "SELECT page_no, page_no % 4 IN (0, 1, 3) AS page FROM pages",
    "robots_filter": """WITH o AS (SELECT page_no, regexp_extract(url, '^[^:]+://[^/]+') AS origin, regexp_replace(url, '^[^:]+://[^/]+', '') AS rest FROM pages)
SELECT page_no, CASE length(origin) % 3 WHEN 1 THEN 'allowed' WHEN 2 THEN 'unavailable' ELSE CASE WHEN rest LIKE '/read%' THEN 'disallowed' ELSE 'allowed' END END AS verdict FROM o""",
    "crawl_bfs": "SELECT 'https://site.example/p/' || page_no AS url FROM pages ORDER BY page_no LIMIT 200",
    "retry_delays": """WITH e AS (SELECT event_id, event_id % 8 AS attempt, CASE event_id % 3 WHEN 0 THEN (event_id % 20)::DOUBLE WHEN 1 THEN 30.0 END AS wait FROM events)
SELECT event_id, wait, greatest(least(8.0, 0.5 * pow(2, attempt)), coalesce(wait, 0.0))::DOUBLE AS delay FROM e""",
    "fetch_outcomes": """WITH a AS (SELECT event_id // 3 AS url, event_id % 3 + 1 AS attempt, [200, 404, 500, 429][event_id * 7 % 4 + 1] AS status FROM events),
m AS (SELECT *, coalesce(bool_and(status IN (500, 429)) OVER (PARTITION BY url ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS made FROM a)
SELECT url, max(attempt)::INTEGER AS tries, arg_max(status, attempt)::INTEGER AS status, arg_max(status, attempt) = 200 AS ok FROM m WHERE made GROUP BY url""",
    "crawl_log_lines": """SELECT event_id, 'ts=t url=u' || event_id || ' status=' || CASE WHEN event_id % 5 = 0 THEN '-' ELSE '200' END || ' bytes=' || event_id ||
  ' elapsed=0.250 attempt=1 error=-' || CASE WHEN event_id % 2 = 0 THEN ' retry_after=1.500' ELSE '' END AS line FROM events""",
    "p5_found": f"""WITH {_LATEST}, {_LENGTHS},
sums AS (SELECT doc_id, sum(tf) AS total FROM latest GROUP BY doc_id)
SELECT m.doc_id FROM (SELECT DISTINCT doc_id FROM docs_meta) m
LEFT JOIN sums s ON s.doc_id = m.doc_id LEFT JOIN lens l ON l.doc_id = m.doc_id
WHERE coalesce(s.total, 0) <> coalesce(l.dl, 0)""",
    "p5_lengths": """SELECT source, count(*) AS n_rows, count(text) AS n_values, coalesce(sum(length(text)), 0)::BIGINT AS total, min(length(text)) AS smallest, max(length(text)) AS largest,
  quantile_disc(length(text), 0.1) AS q10, quantile_disc(length(text), 0.5) AS q50, quantile_disc(length(text), 0.9) AS q90, quantile_disc(length(text), 0.999) AS q99_9
FROM documents GROUP BY source""",
    "p5_profile": f"""WITH {_LATEST}
SELECT doc_id, count(*) AS n_rows, count(tf) AS n_values, coalesce(sum(tf), 0)::BIGINT AS total,
  min(tf)::BIGINT AS smallest, max(tf)::BIGINT AS largest, quantile_disc(tf, 0.5)::BIGINT AS q50,
  quantile_disc(tf, 0.9)::BIGINT AS q90, quantile_disc(tf, 0.99)::BIGINT AS q99
FROM latest GROUP BY doc_id""",
}
