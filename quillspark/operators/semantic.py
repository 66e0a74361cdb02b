"""Semantic search over chunk vectors, rank fusion and hybrid search. The text encoder is injected."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import chunk_texts, tokens
from quillspark.functions.vectors import dot_literal
from quillspark.operators.index import SearchIndex
from quillspark.operators.rank import PLACES, Scorer, score, top, with_documents
from quillspark.plans.query import parse
from quillspark.session import spread

#: A batch of texts to a float matrix, one row each.
Encode = Callable[[Sequence[str]], np.ndarray]


class EmbeddingsUnavailable(RuntimeError):
    """Semantic or hybrid search without vectors or encoder."""


def hash_encoder(dims: int = 64) -> Encode:
    """A deterministic stand-in for a model: counts of blank-separated words by the sum of their code points."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, text in enumerate(texts):
            for word in text.split():
                out[i, sum(map(ord, word)) % dims] += 1
        return out

    return encode


def chunk_documents(docs: DataFrame, size: int = 256, overlap: int = 32) -> DataFrame:
    """(doc_id, chunk_no, text): token windows of every document; documents without words have none."""
    # the words are a column of their own, or they would be found again for every window
    words = spread(docs.select("doc_id", "text")).select("doc_id", tokens(F.col("text")).alias("toks"))
    windows = words.select("doc_id", chunk_texts(F.col("toks"), size, overlap).alias("w"))
    return windows.select("doc_id", F.posexplode("w").alias("chunk_no", "text"))


def embed_chunks(chunks: DataFrame, encode: Encode) -> DataFrame:
    """Adds `embedding`, the unit-length vector of the text; the encoder sees Arrow batches and must return a row per text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            matrix = np.asarray(encode(texts), np.float32)
            if matrix.shape[0] != len(texts):
                raise ValueError(f"encoder returned {matrix.shape[0]} rows for {len(texts)} texts")
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            yield frame.assign(embedding=list(matrix / np.maximum(norms, 1e-12)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(run, f"{fields}, embedding array<float>")


def encode_query(text: str, encode: Encode) -> list[float]:
    v = np.asarray(encode([text]), np.float32)[0].astype(float)
    return (v / max(float(np.linalg.norm(v)), 1e-12)).tolist()


def semantic_scores(vectors: DataFrame, query: Sequence[float], owner: str = "doc_id", column: str = "embedding") -> DataFrame:
    """(doc_id, score): the best dot product of each owner's vectors with the query; every vector is compared."""
    rows = vectors.filter(F.col(column).isNotNull()).select(F.col(owner).alias("doc_id"), dot_literal(F.col(column), query).alias("s"))
    return rows.groupBy("doc_id").agg(F.round(F.max("s"), PLACES).alias("score"))


def semantic_search(index: SearchIndex, vectors: DataFrame, text: str, encode: Encode, k: int = 10, page: int = 1, snippets: bool = False) -> DataFrame:
    from quillspark.functions.pytext import py_tokens

    hits = top(semantic_scores(vectors, encode_query(text, encode)), k, page)
    return with_documents(index, hits, py_tokens(text) if snippets else None)


def reciprocal_rank_fusion(*rankings: DataFrame, k: int = 60) -> DataFrame:
    """(doc_id, score): sum of 1 / (k + rank) over rankings(rank, doc_id); a union and one aggregation, no full joins."""
    rows = reduce(DataFrame.unionByName, [r.select("doc_id", "rank") for r in rankings])
    return rows.groupBy("doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), PLACES).alias("score"))


def fuse_lists(lists: DataFrame, by: Sequence[str], list_col: str, k: int = 60) -> DataFrame:
    """The same for many fusions at once: lists(by..., list, doc_id, score) -> (by..., doc_id, score)."""
    rank = F.row_number().over(W.partitionBy(*by, list_col).orderBy(F.desc("score"), "doc_id"))
    return lists.withColumn("r", rank).groupBy(*by, "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("r"))), PLACES).alias("score"))


def hybrid_search(
    index: SearchIndex, vectors: DataFrame, text: str, encode: Encode, k: int = 10, page: int = 1, scorer: Scorer | str = "bm25", depth: int = 200, rrf_k: int = 60, snippets: bool = False
) -> DataFrame:
    """Keyword and semantic lists of max(k*page, depth) hits fused by reciprocal rank; the query must parse."""
    tree = parse(text)
    pool = max(k * page, depth)
    keyword = top(score(index, tree, scorer), pool)
    semantic = top(semantic_scores(vectors, encode_query(text, encode)), pool)
    hits = top(reciprocal_rank_fusion(keyword, semantic, k=rrf_k), k, page)
    return with_documents(index, hits, tree.scored() if snippets else None)
