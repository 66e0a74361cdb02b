"""Boolean matching over the index: documents that satisfy a query tree."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.index import SearchIndex, bucket_of
from quillspark.plans.query import And, Node, Not, Or, Phrase, Term, parse


def _flag(word: str) -> str:
    return f"w_{word}"


def leaf_columns(tree: Node) -> list[Column]:
    """Aggregates over the postings of one document: which words it holds and, for phrases, where."""
    held = [F.max(F.col("term") == w).alias(_flag(w)) for w in sorted(tree.words())]
    placed = sorted({w for p in tree.phrases() for w in p})
    return held + [F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(f"p_{w}") for w in placed]


def predicate(tree: Node) -> Column:
    """The tree over those aggregates."""

    def word(w: str) -> Column:
        return F.coalesce(F.col(f"`{_flag(w)}`"), F.lit(False))

    def phrase(terms: tuple[str, ...]) -> Column:
        first, *rest = (F.col(f"`p_{w}`") for w in terms)

        def follows(p: Column) -> Column:
            return reduce(lambda a, b: a & b, [F.array_contains(r, p + i + 1) for i, r in enumerate(rest)])

        return F.coalesce(F.exists(first, follows), F.lit(False))

    return tree.holds(word, phrase)


def postings_for(index: SearchIndex, words: Iterable[str]) -> DataFrame:
    """The postings of some words; stored ones are pruned to the words' buckets before any file is opened."""
    wanted = sorted(set(words))
    return index.postings.filter(F.col("bucket").isin(sorted({bucket_of(w) for w in wanted})) & F.col("term").isin(wanted))


def lookup(index: SearchIndex, tree: Node) -> DataFrame:
    """The postings of the tree's words; positions are read only where a phrase needs them."""
    rows = postings_for(index, tree.words())
    if tree.phrases() and "positions" not in rows.columns:
        raise ValueError("phrases need an index with positions")
    return rows if tree.phrases() else rows.drop("positions")


def match(index: SearchIndex, query: str | Node) -> DataFrame:
    """(doc_id): matching documents, each once, by one aggregation over the postings of the query's words.

    Documents that hold none of the words are added from docs only if such a document can match. A blank query matches nothing.
    """
    if isinstance(query, str):
        if not query.strip():
            return index.docs.select("doc_id").limit(0)
        query = parse(query)
    held = lookup(index, query).groupBy("doc_id").agg(*leaf_columns(query)) if query.words() else index.docs.select("doc_id").limit(0)
    if query.of_nothing():
        held = index.docs.select("doc_id").join(held, "doc_id", "left")
    return held.filter(predicate(query)).select("doc_id")


def _starts(index: SearchIndex, word: str, offset: int) -> DataFrame:
    """(doc_id, start): where a phrase would begin whose word number `offset` is here."""
    return postings_for(index, [word]).select("doc_id", F.explode(F.transform("positions", lambda p: p - offset)).alias("start"))


def match_relational(index: SearchIndex, query: str | Node, hint: str | None = None) -> DataFrame:
    """The same by one relational operator per node: semi joins for AND, distinct union for OR, anti join for NOT, offset joins for phrases.

    `hint` is a join hint: "merge" for sort-merge joins, "shuffle_hash" or "broadcast" for hash joins.
    """
    tree = parse(query) if isinstance(query, str) else query

    def hinted(df: DataFrame) -> DataFrame:
        return df.hint(hint) if hint else df

    def of(node: Node) -> DataFrame:
        if isinstance(node, Phrase) and len(node.terms) == 1:
            node = Term(node.terms[0])
        if isinstance(node, Term):
            return postings_for(index, [node.text]).select("doc_id")
        if isinstance(node, And):
            return of(node.left).join(hinted(of(node.right)), "doc_id", "left_semi")
        if isinstance(node, Or):
            return of(node.left).unionByName(of(node.right)).distinct()
        if isinstance(node, Not):
            return index.docs.select("doc_id").join(hinted(of(node.child)), "doc_id", "left_anti")
        starts = [_starts(index, w, i) for i, w in enumerate(node.terms)]
        if not starts:
            return index.docs.select("doc_id").limit(0)
        return reduce(lambda a, b: a.join(hinted(b), ["doc_id", "start"], "left_semi"), starts).select("doc_id").distinct()

    return of(tree)


def boolean_search(index: SearchIndex, query: str) -> DataFrame:
    """Matching ids, ascending."""
    return match(index, query).orderBy("doc_id")
