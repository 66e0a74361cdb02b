from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillspark.engine import Engine
from quillspark.operators.index import append_documents, build_index, dense_ids, duplicate_ids, load_index, merge_indexes, save_index
from quillspark.operators.match import boolean_search, match, match_relational
from quillspark.operators.rank import batch_search, bm25, get_scorer, ranked_search, tfidf, with_documents
from quillspark.sources.store import load, save

TINY = ("red cat sat", "blue cat ran", "red dog sat")


def ids(df):
    return [r.doc_id for r in df.collect()]


def hits(df):
    return [(r.doc_id, r.score) for r in df.orderBy("rank").collect()]


def test_index_of_tiny(corpus):
    index = build_index(corpus(*TINY))
    stats = index.stats.first()
    assert (stats.n_docs, stats.n_tokens, stats.vocabulary, stats.avgdl) == (3, 9, 6, 3.0)
    assert index.df("cat") == 2 and "unicorn" not in index
    assert {r.doc_id: r.positions for r in index.postings.filter("term = 'sat'").collect()} == {0: [2], 2: [2]}


@pytest.mark.parametrize(
    ("query", "expected"),
    [("cat", [0, 1]), ("red cat", [0]), ("red OR blue", [0, 1, 2]), ("sat NOT dog", [0]), ("NOT cat", [2]), ("unicorn", []), ("", []), ('"cat sat"', [0]), ('""', []), ("NOT unicorn", [0, 1, 2])],
)
def test_boolean(corpus, query, expected):
    assert ids(boolean_search(build_index(corpus(*TINY)), query)) == expected


def test_empty_documents_count(corpus):
    index = build_index(corpus("a b", "", None, "c"))
    stats = index.stats.first()
    assert stats.n_docs == 4 and stats.avgdl == 0.75
    assert ids(boolean_search(index, "NOT a")) == [1, 2, 3]
    assert build_index(corpus("x").limit(0)).stats.first().avgdl == 0.0


WORDS = ["a", "b", "c", "d"]
QUERIES = st.recursive(
    st.sampled_from([*WORDS, '"a b"', '"b c a"', "zzz"]),
    lambda inner: st.tuples(st.sampled_from(["({0}) AND ({1})", "({0}) OR ({1})", "NOT ({0})"]), inner, inner).map(lambda t: t[0].format(t[1], t[2])),
    max_leaves=5,
)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=6).map(" ".join), min_size=1, max_size=8), QUERIES)
def test_one_pass_equals_relational(corpus, texts, query):
    index = build_index(corpus(*texts))
    assert sorted(ids(match(index, query))) == sorted(ids(match_relational(index, query)))


def test_scores(corpus):
    index = build_index(corpus(*TINY))
    assert hits(ranked_search(index, "cat")) == [(0, 0.470004), (1, 0.470004)]
    assert hits(ranked_search(index, "red cat")) == [(0, 0.940007)]
    assert hits(ranked_search(index, "cat cat"))[0] == (0, 0.940007)
    assert hits(ranked_search(index, "cat", "tfidf"))[0] == (0, round(math.log(1.5), 6))
    assert hits(ranked_search(index, "NOT cat")) == [(2, 0.0)]
    assert hits(ranked_search(index, "unicorn OR NOT cat")) == []
    assert hits(ranked_search(index, " ")) == []


def test_ranking_invariants(corpus):
    rare = build_index(corpus("xyzzy appears once here the", "the the the the the filler words about nothing"))
    assert [d for d, _ in hits(ranked_search(rare, "xyzzy OR the", tfidf))] == [0, 1]
    assert hits(ranked_search(rare, "xyzzy OR the", tfidf))[1][1] == 0.0
    lorem = " lorem" * 30
    sat = build_index(corpus("needle" + lorem, "needle " * 19 + lorem, "needle " * 20 + lorem))
    s = dict(hits(ranked_search(sat, "needle")))
    assert s[2] - s[1] < 0.15 * (s[1] - s[0])
    length = build_index(corpus("walrus", "walrus" + " padding" * 400))
    assert [d for d, _ in hits(ranked_search(length, "walrus"))] == [0, 1]
    t = hits(ranked_search(length, "walrus", "tf-idf"))
    assert t[0][1] == t[1][1]


def test_pages_and_ties(corpus):
    index = build_index(corpus(*["alpha beta"] * 12))
    pages = [[d for d, _ in hits(ranked_search(index, "alpha", k=5, page=p))] for p in (1, 2, 3)]
    assert pages == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11]]
    with pytest.raises(ValueError):
        ranked_search(index, "alpha", k=0)


def test_scorers(corpus):
    assert get_scorer(" BM25 ") and get_scorer("TF_IDF") is tfidf
    with pytest.raises(ValueError):
        get_scorer("nope")
    index = build_index(corpus(*TINY))
    assert hits(ranked_search(index, "cat", lambda tf, df, dl, n, avgdl: tf * 10.0))[0] == (0, 10.0)
    assert hits(ranked_search(index, "cat", bm25(1.2, 0.0)))[0][0] == 0


def test_batch_equals_single(corpus):
    index = build_index(corpus("a b c", "a a", "b c", "c a b", "d"))
    queries = {1: "a b", 2: "a OR d", 3: "c NOT a", 4: '"a b"', 5: "NOT a", 6: "a a b", 7: "zzz"}
    got = {}
    for r in batch_search(index, queries).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for q, text in queries.items():
        assert got.get(q, []) == hits(ranked_search(index, text))


def test_partitioning_does_not_matter(corpus, rows):
    docs = corpus(*TINY, *["cat dog " * 30] * 5)
    expected = rows(build_index(docs).postings.drop("bucket"))
    for n in (1, 17):
        assert rows(build_index(docs.repartition(n)).postings.drop("bucket")) == expected


def test_merge_append_duplicates(corpus, rows):
    docs = corpus(*TINY)
    whole = build_index(docs)
    parts = [build_index(docs.filter(f)) for f in ("doc_id = 1", "doc_id <> 1")]
    merged = merge_indexes(*parts)
    assert rows(merged.postings) == rows(whole.postings) and rows(merged.stats) == rows(whole.stats)
    with pytest.raises(ValueError):
        merge_indexes(whole, parts[0])
    assert rows(append_documents(parts[0], docs).terms) == rows(whole.terms)
    assert rows(duplicate_ids(docs.union(docs.limit(1)))) == [(0, 2)]


def test_save_and_load(spark, corpus, rows, tmp_path):
    index = build_index(corpus(*TINY))
    save_index(index, str(tmp_path / "p"))
    save(index, str(tmp_path / "j"), "json")
    for folder in ("p", "j"):
        back = load(spark, str(tmp_path / folder))
        assert hits(ranked_search(back, '"red cat" sat', snippets=True)) == hits(ranked_search(index, '"red cat" sat'))
        assert rows(back.stats) == rows(index.stats)
    plan = load_index(spark, str(tmp_path / "p"))
    text = match(plan, "cat")._jdf.queryExecution().toString()
    assert "bucket#" in text.split("PartitionFilters")[1][:200]  # other buckets are not opened
    with pytest.raises(ValueError):
        save(index, str(tmp_path / "x"), "nope")
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "missing"))


def test_dense_ids(spark, rows):
    data = spark.createDataFrame([(f"p{i % 7}", i) for i in range(100)], "p string, i int").repartition(5)
    got = sorted(dense_ids(data, "p", "i").collect(), key=lambda r: (r.p, r.i))
    assert [r.doc_id for r in got] == list(range(100))


def test_engine(spark, corpus):
    from quillspark.operators.semantic import EmbeddingsUnavailable, chunk_documents, embed_chunks, hash_encoder

    docs = corpus("alpha alpha beta", "beta gamma gamma", "")
    encode = hash_encoder(4)
    engine = Engine(build_index(docs), embed_chunks(chunk_documents(docs), encode), encode)
    r = engine.search("alpha", k=5)
    assert r.total == 1 and r.hits.first().snippet == "**alpha** **alpha** beta"
    assert [x.doc_id for x in engine.search("alpha", "semantic").hits.orderBy("rank").collect()][0] == 0
    assert engine.search("alpha OR gamma", "hybrid").total == 2
    assert engine.ids("beta") == [0, 1] and engine.ids("beta", "bm25", 1) == [0]
    assert engine.stats() == {"documents": 3, "vocabulary": 3, "average_length": 2.0}
    assert engine.document(1)["title"] == "beta gamma gamma" and engine.document(9) is None
    with pytest.raises(EmbeddingsUnavailable):
        Engine(engine.index).search("a", "semantic")
    for bad in ({"q": ""}, {"q": "a", "k": 101}, {"q": "a", "page": 0}, {"q": "a", "mode": "x"}, {"q": "a" * 201}):
        with pytest.raises(ValueError):
            engine.search(**bad)


def test_hits_without_a_document(spark, corpus):
    index = build_index(corpus("red heron", "blue heron"))
    hits = spark.createDataFrame([(1, 1, 0.5), (2, 77, 0.25)], "rank int, doc_id bigint, score double")
    got = {r.doc_id: (r.rank, r.title, r.snippet) for r in with_documents(index, hits, ["heron"]).collect()}
    assert got == {1: (1, "blue heron", "blue **heron**"), 77: (2, "?", "")}
    assert with_documents(index, hits.limit(0)).count() == 0
