"""Ranked search: pluggable Column scorers, top-k, pages, and many queries in one job."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import snippet
from quillspark.operators.index import SearchIndex
from quillspark.operators.match import leaf_columns, lookup, match, postings_for, predicate
from quillspark.plans.query import Node, Phrase, Term, parse

#: (tf, df, dl, n_docs, avgdl) -> weight of one posting.
Scorer = Callable[[Column, Column, Column, Column, Column], Column]
#: Scores are compared after rounding to this many places; equal ones are ordered by doc_id.
PLACES = 6


def tfidf(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    """tf * ln(n / df); 0 for a word that every document holds."""
    return F.when((tf > 0) & (df > 0) & (n > 0), tf * F.log(n / df)).otherwise(F.lit(0.0))


def bm25(k1: float = 1.5, b: float = 0.75) -> Scorer:
    def weight(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
        rarity = F.log(1 + (n - df + 0.5) / (df + 0.5))
        return F.when(avgdl > 0, rarity * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))).otherwise(F.lit(0.0))

    return weight


def get_scorer(name: str) -> Scorer:
    """A scorer by name, whatever its case and surrounding blanks."""
    known = {"bm25": bm25(), "tfidf": tfidf, "tf-idf": tfidf, "tf_idf": tfidf}
    try:
        return known[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown scorer {name!r}") from None


def _weights(index: SearchIndex, rows: DataFrame, words: Iterable[str], scorer: Scorer) -> DataFrame:
    """Adds `weight` to postings; df comes from at most one row per query word, the statistics from one row."""
    df = index.terms.filter(F.col("term").isin(sorted(set(words)))).select("term", "df")
    rows = rows.join(F.broadcast(df), "term").crossJoin(F.broadcast(index.stats.select("n_docs", "avgdl")))
    c = F.col
    return rows.withColumn("weight", scorer(c("tf"), c("df"), c("dl"), c("n_docs"), c("avgdl")))


def score(index: SearchIndex, query: str | Node, scorer: Scorer | str = "bm25") -> DataFrame:
    """(doc_id, score) of every ranked document: matching and scoring are one aggregation over the postings of the query's words.

    A word's weight counts as often as the query repeats it. Documents that match through NOT alone are ranked only if the query has no
    positive word; then all score 0.
    """
    tree = parse(query) if isinstance(query, str) else query
    scorer = get_scorer(scorer) if isinstance(scorer, str) else scorer
    counts = Counter(tree.scored())
    if not counts:
        return match(index, tree).select("doc_id", F.lit(0.0).alias("score"))
    times = F.lit(0)
    for word, n in counts.items():
        times = F.when(F.col("term") == word, F.lit(n)).otherwise(times)
    rows = _weights(index, lookup(index, tree), tree.words(), scorer)
    total = F.sum(F.when(F.col("term").isin(sorted(counts)), F.col("weight") * times)).alias("total")
    held = rows.groupBy("doc_id").agg(total, *leaf_columns(tree))
    return held.filter(predicate(tree) & F.col("total").isNotNull()).select("doc_id", F.round("total", PLACES).alias("score"))


def top(scored: DataFrame, k: int, page: int = 1) -> DataFrame:
    """(rank, doc_id, score): page `page` of k rows, best first, ties by doc_id; ranks count from 1 over all pages."""
    if k < 1 or page < 1:
        raise ValueError("k and page count from 1")
    best = scored.orderBy(F.desc("score"), "doc_id").limit(page * k)  # per-task heaps, then one merge of page * k rows
    ranked = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")))
    return ranked.filter(F.col("rank") > (page - 1) * k).select("rank", "doc_id", "score")


def with_documents(index: SearchIndex, hits: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Titles (and snippets if terms are given) for the hits of one page, fetched after the cut; "?" for a document that the index does not hold.

    The page, a handful of rows that the caller has bounded, is worked out here, so that only those documents are asked for: stored
    documents are sorted by id, and the condition reaches the row groups of their files.
    """
    page = hits.collect()
    spark = index.docs.sparkSession
    wanted = index.docs.filter(F.col("doc_id").isin([r.doc_id for r in page])).select("doc_id", "title", *(["text"] if terms is not None else []))
    rows = spark.createDataFrame(page, hits.schema).join(F.broadcast(wanted), "doc_id", "left")
    out = [*hits.columns, F.coalesce("title", F.lit("?")).alias("title")]
    if terms is not None:
        out.append(snippet(F.coalesce("text", "title", F.lit("")), terms).alias("snippet"))
    return rows.select(*out)


def ranked_search(index: SearchIndex, query: str, scorer: Scorer | str = "bm25", k: int = 10, page: int = 1, snippets: bool = False) -> DataFrame:
    """(rank, doc_id, score, title[, snippet]); a blank query has no hits."""
    if not query.strip():
        empty = index.docs.limit(0).select(F.lit(0).alias("rank"), "doc_id", F.lit(0.0).alias("score"), "title")
        return empty.withColumn("snippet", F.lit("")) if snippets else empty
    tree = parse(query)
    return with_documents(index, top(score(index, tree, scorer), k, page), tree.scored() if snippets else None)


#: Queries of up to this many different words are answered together; the truth table of longer ones would grow too large.
MASK_WORDS = 10


def _truth(tree: Node, words: list[str]) -> list[int]:
    """Bit masks of held words under which the tree matches and some positive word is held."""
    def value(node: Node, held: set[str]) -> bool:
        if isinstance(node, Term):
            return node.text in held
        if isinstance(node, Phrase):
            return bool(node.terms) and node.terms[0] in held
        kind = type(node).__name__
        if kind == "Not":
            return not value(node.child, held)
        sides = (value(node.left, held), value(node.right, held))
        return all(sides) if kind == "And" else any(sides)

    positive = set(tree.scored())
    masks = []
    for bits in product((False, True), repeat=len(words)):
        held = {w for w, b in zip(words, bits, strict=True) if b}
        if held & positive and value(tree, held):
            masks.append(sum(1 << i for i, b in enumerate(bits) if b))
    return masks


def batch_search(index: SearchIndex, queries: dict[int, str], scorer: Scorer | str = "bm25", k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): many queries in one pass over the postings.

    Each query becomes its words with multiplicities and the truth table of its tree over them; a document's words make a bit mask
    that is looked up in the table. Queries with phrases of several words, without a positive word, or of more than MASK_WORDS words are answered
    one by one and united with the rest. Unparsable queries raise QuerySyntaxError.
    """
    spark = index.docs.sparkSession
    scorer = get_scorer(scorer) if isinstance(scorer, str) else scorer
    words_, truth_, single = [], [], []
    for qid, text in queries.items():
        tree = parse(text)
        words = sorted(tree.words())
        if tree.phrases() or not tree.scored() or len(words) > MASK_WORDS:
            single.append((qid, tree))
            continue
        counts = Counter(tree.scored())
        words_ += [(qid, w, counts[w], 1 << i) for i, w in enumerate(words)]
        truth_ += [(qid, m) for m in _truth(tree, words)]
    out = None
    if words_:
        asked = spark.createDataFrame(words_, "query_id bigint, term string, times int, bit bigint")
        truth = spark.createDataFrame(truth_, "query_id bigint, mask bigint")
        needed = {w for _, w, _, _ in words_}
        rows = postings_for(index, needed).drop("positions").join(F.broadcast(asked), "term")
        rows = _weights(index, rows, needed, scorer)
        held = rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("times")).alias("total"), F.bit_or("bit").alias("mask"))
        matched = held.join(F.broadcast(truth), ["query_id", "mask"], "left_semi")
        matched = matched.select("query_id", "doc_id", F.round("total", PLACES).alias("score"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        out = matched.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
    for qid, tree in single:
        one = top(score(index, tree, scorer), k).select(F.lit(qid).cast("bigint").alias("query_id"), "rank", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no queries")
    return out
