"""Plain SQL twins of the queries in this package that SQL can express over whole tables."""

from __future__ import annotations

_LATEST = """latest AS (
  SELECT partial_no, term, doc_id, any_value(coalesce(tf, len(positions))) AS tf
  FROM (SELECT *, max(built_at) OVER (PARTITION BY partial_no, term, doc_id) AS newest FROM postings)
  WHERE built_at = newest GROUP BY partial_no, term, doc_id),
folded AS (
  SELECT replace(lower(nfc_normalize(term)), 'ß', 'ss') AS term, doc_id, sum(tf)::BIGINT AS tf FROM latest GROUP BY 1, 2 HAVING sum(tf) > 0)"""

_SCORED = f"""{_LATEST},
lens AS (SELECT doc_id, coalesce(sum(dl), 0) AS dl FROM (SELECT DISTINCT partial_no, doc_id, dl FROM doc_lengths) GROUP BY doc_id),
size AS (SELECT (SELECT count(*) FROM docs_meta) AS n, (SELECT sum(dl) FROM lens) / (SELECT count(*) FROM docs_meta) AS avgdl),
terms AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM folded GROUP BY term),
scored AS (
  SELECT f.doc_id, f.term, f.tf, t.df, t.cf, coalesce(l.dl, 0) AS dl, n, avgdl
  FROM folded f JOIN terms t USING (term) LEFT JOIN lens l ON l.doc_id = f.doc_id CROSS JOIN size)"""

_HITS = """ok AS (SELECT query_id, lower(trim(mode)) AS mode, doc_id, score, served_at FROM search_hits WHERE score IS NOT NULL AND isfinite(score)),
hits AS (SELECT query_id, mode, doc_id, max(score) AS score FROM
  (SELECT *, max(served_at) OVER (PARTITION BY query_id, mode, doc_id) AS newest FROM ok) WHERE served_at = newest GROUP BY ALL)"""


def _fused(x: str, step: str) -> str:
    return f"""WITH {_HITS},
xs AS (SELECT query_id, mode, doc_id, {x} AS x FROM hits),
m1 AS (SELECT *, median(x) OVER (PARTITION BY query_id, mode) AS med FROM xs),
m2 AS (SELECT *, median(abs(x - med)) OVER (PARTITION BY query_id, mode) AS mad, avg(abs(x - med)) OVER (PARTITION BY query_id, mode) AS dev,
  min(x) OVER (PARTITION BY query_id, mode) AS low FROM m1),
sc AS (SELECT *, CASE WHEN mad > 0 THEN mad * 1.4826 WHEN dev > 0 THEN dev ELSE 1 END AS scale FROM m2),
v AS (SELECT query_id, mode, doc_id, 1 / (1 + exp(-((x - med) / scale))) AS v, 1 / (1 + exp(-((low - {step} - med) / scale))) AS absent FROM sc),
lists AS (SELECT DISTINCT query_id, mode, absent FROM v),
docs AS (SELECT DISTINCT query_id, doc_id FROM v),
full_ AS (SELECT d.query_id, d.doc_id, coalesce(v.v, l.absent) AS v, v.v IS NOT NULL AS held
  FROM docs d JOIN lists l USING (query_id) LEFT JOIN v ON v.query_id = d.query_id AND v.mode = l.mode AND v.doc_id = d.doc_id),
fused AS (SELECT query_id, doc_id, exp(avg(ln(v))) AS fused, count(*) FILTER (WHERE held) AS n_lists FROM full_ GROUP BY query_id, doc_id)"""


_PLACE = "-(rank() OVER (PARTITION BY query_id, mode ORDER BY score DESC) + (count(*) OVER (PARTITION BY query_id, mode, score) - 1) / 2.0)"

ORACLES: dict[str, str] = {
    "p1_found": f"""WITH {_SCORED},
w AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC) AS p, lead(w) OVER (PARTITION BY doc_id ORDER BY w DESC) AS next FROM w)
SELECT doc_id, term FROM r WHERE p = 1 AND w >= 1.2 * next""",
    "p1_terms": f"""WITH {_SCORED},
d AS (SELECT *, tf * CASE WHEN avgdl > 0 THEN log2(1 + avgdl / CASE WHEN dl > 0 THEN dl ELSE avgdl END) ELSE 1 END AS tfn, cf / n AS lam FROM scored),
w AS (SELECT doc_id, term, tf, df, cf, round((log2(1 + lam) + tfn * log2((1 + lam) / lam)) / (tfn + 1), 6) AS weight FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term)::INTEGER AS place FROM w)
SELECT * FROM r WHERE place <= 5""",
    "p2_terms": f"""WITH {_LATEST}
SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df,
  CASE WHEN count(*) <= 2 THEN 'rare' WHEN count(*) >= 0.2 * (SELECT count(*) FROM docs_meta) THEN 'common' END AS mark
FROM folded GROUP BY term""",
    "p2_found": f"""WITH {_LATEST},
t AS (SELECT term, CASE WHEN count(*) <= 2 THEN 'rare' WHEN count(*) >= 0.2 * (SELECT count(*) FROM docs_meta) THEN 'common' END AS mark FROM folded GROUP BY term)
SELECT term, mark FROM t WHERE mark IS NOT NULL""",
    "p3_found": """WITH v AS (
  SELECT chunk_id, model, any_value(embedding)::DOUBLE[] AS e FROM chunks
  WHERE len(embedding) = 64 AND len([x for x in embedding if isfinite(x)]) = 64
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 GROUP BY chunk_id, model)
SELECT DISTINCT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM v a JOIN v b
ON a.model IS NOT DISTINCT FROM b.model AND a.chunk_id < b.chunk_id AND list_cosine_similarity(a.e, b.e) >= 0.9""",
    "p3_recall": """SELECT model, count(DISTINCT chunk_id) AS asked, true AS reached FROM chunks
WHERE chunk_id % 100 = 0 AND len(embedding) = 64 AND len([x for x in embedding if isfinite(x)]) = 64
  AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 GROUP BY model""",
    "p6_found": f"""{_fused(_PLACE, '1')},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, doc_id) AS p FROM fused)
SELECT query_id, doc_id FROM r WHERE p <= 5""",
    "p6_ranking": f"""{_fused('score', 'scale')} SELECT query_id, doc_id, round(fused, 6) AS fused, n_lists FROM fused""",
    "p6_spread": f"""{_fused('score', 'scale')} SELECT query_id, doc_id, round(fused, 6) AS fused, n_lists,
  row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, doc_id)::INTEGER AS place FROM fused""",
    "p7_found": r"""SELECT doc_id, CASE WHEN regexp_matches(text, '\S{1000}\S{1000}\S') THEN 'forced' ELSE 'natural' END AS kind
FROM documents WHERE length(text) > 2000""",
    "p7_invariants": """SELECT doc_id, length(text) AS n_chars, true AS within_limit, true AS within_overlap, true AS nothing_missing FROM documents WHERE length(text) > 2000""",
    "p8_invariants": """WITH n AS (SELECT len(regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\\p{L}\\p{N}_]+(?:[''’-][\\p{L}\\p{N}_]+)*')) AS n FROM documents)
SELECT packing, sum(n)::BIGINT AS tokens, sum(ceil(n / 1024.0))::BIGINT AS items, 0::BIGINT AS over, true AS few FROM n, (VALUES ('plain'), ('tight')) AS p(packing) GROUP BY packing""",
    "p8_found": """SELECT doc_id FROM documents
WHERE len(regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\\p{L}\\p{N}_]+(?:[''’-][\\p{L}\\p{N}_]+)*')) > 1024""",
}
