"""Corpus reports and search quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import tokens
from quillspark.session import spread


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): occurrences of every word."""
    return spread(docs.select("text")).select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens, vocabulary; one pass over the texts, documents without words counted."""
    counts = term_counts(docs).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.count(F.lit(1)).alias("vocabulary"))
    return docs.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(F.broadcast(counts))


def top_terms(docs: DataFrame, k: int = 50) -> DataFrame:
    """The k most frequent words, ties by word."""
    return term_counts(docs).orderBy(F.desc("n"), "term").limit(k)


def precision_at_k(hits: DataFrame, relevant: Column, k: int, by: str = "query_id") -> DataFrame:
    """(by, precision): relevant hits among the first k, over k even where fewer were found."""
    good = F.sum(F.when(relevant, 1).otherwise(0))
    return hits.filter(F.col("rank") <= k).groupBy(by).agg((good / F.lit(float(k))).alias("precision"))


def macro_precision(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.avg("precision").alias("precision"))


def medians(timings: DataFrame, by: str, value: str, base: str) -> DataFrame:
    """(by, median, speedup): exact medians per group, and the base group's median over each."""
    med = timings.groupBy(by).agg(F.median(value).alias("median"))
    ref = med.filter(F.col(by) == base).select(F.col("median").alias("ref"))
    return med.crossJoin(F.broadcast(ref)).select(by, "median", (F.col("ref") / F.col("median")).alias("speedup"))
