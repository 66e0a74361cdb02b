"""A façade with the bounds and errors of a search service."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.index import SearchIndex
from quillspark.operators.match import boolean_search, match
from quillspark.operators.rank import Scorer, ranked_search
from quillspark.operators.semantic import EmbeddingsUnavailable, Encode, hybrid_search, semantic_search

MODES = ("keyword", "semantic", "hybrid")
#: Bounds of a request (fixed values).
MAX_QUERY, MAX_K, MAX_PAGE, POOL = 200, 100, 1000, 200


@dataclass(frozen=True)
class Response:
    """A page of hits and how many documents there are to page through."""

    hits: DataFrame
    total: int
    mode: str
    page: int
    k: int


@dataclass
class Engine:
    index: SearchIndex
    vectors: DataFrame | None = None
    encode: Encode | None = None

    def search(self, q: str, mode: str = "keyword", k: int = 10, page: int = 1, scorer: Scorer | str = "bm25", snippets: bool = True) -> Response:
        """One page of results. ValueError for parameters out of bounds or bad syntax (QuerySyntaxError), EmbeddingsUnavailable without vectors.

        total is the number of matches (keyword), of owners of vectors (semantic), or of fused hits within the pool (hybrid).
        """
        if not 1 <= len(q) <= MAX_QUERY or not 1 <= k <= MAX_K or not 1 <= page <= MAX_PAGE or mode not in MODES:
            raise ValueError("request out of bounds")
        if mode == "keyword":
            return Response(ranked_search(self.index, q, scorer, k, page, snippets), match(self.index, q).count(), mode, page, k)
        if self.vectors is None or self.encode is None:
            raise EmbeddingsUnavailable("no vectors or no encoder loaded")
        if mode == "semantic":
            total = self.vectors.filter("embedding is not null").agg(F.count_distinct("doc_id").alias("n")).first().n
            return Response(semantic_search(self.index, self.vectors, q, self.encode, k, page, snippets), total, mode, page, k)
        pool = hybrid_search(self.index, self.vectors, q, self.encode, max(k * page, POOL), scorer=scorer)
        hits = hybrid_search(self.index, self.vectors, q, self.encode, k, page, scorer, snippets=snippets)
        return Response(hits, pool.count(), mode, page, k)

    def ids(self, q: str, scorer: Scorer | str | None = None, k: int = 10) -> list[int]:
        """Ids only: all matches ascending without a scorer, the k best with one."""
        rows = boolean_search(self.index, q) if scorer is None else ranked_search(self.index, q, scorer, k).orderBy("rank")
        return [r.doc_id for r in rows.select("doc_id").collect()]

    def stats(self) -> dict[str, float]:
        r = self.index.stats.first()
        return {"documents": r.n_docs, "vocabulary": r.vocabulary, "average_length": round(r.avgdl, 2)}

    def document(self, doc_id: int) -> dict[str, object] | None:
        row = self.index.docs.filter(F.col("doc_id") == doc_id).first()
        return row.asDict() if row else None


def format_hit(score, doc_id, title, snippet=None):  # noqa: ANN001, ANN201
    """Columns of a hit as one line of a report, the snippet on a second one."""
    line = F.format_string("%8.4f  %d  %s", score, doc_id, title)
    return line if snippet is None else F.when(F.length(snippet) > 0, F.concat(line, F.lit("\n          "), snippet)).otherwise(line)
