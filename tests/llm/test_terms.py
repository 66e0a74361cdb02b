from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import terms
from quillspark.llm.terms import bm25_weight, distinctive_terms, leading_terms, term_frequencies

SCHEMA = "partial_no int, term string, doc_id bigint, tf int, positions array<int>, built_at bigint, weight int, slice int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA).withColumn("built_at", F.timestamp_micros("built_at"))


ROWS = [
    (0, "Straße", 1, 2, None, 1), (0, "strasse", 1, 1, None, 1), (0, "the", 1, 9, None, 1), (0, "the", 1, 4, None, 2), (0, "the", 1, 4, None, 2),
    (1, "the", 1, None, [3, 4], 1), (0, "the", 2, 5, None, 1), (0, "rare", 2, 3, None, 1), (0, "café", -70, 1, None, 1), (0, "Café", -70, 1, None, None),
    (0, None, 1, 7, None, 1), (0, "x", None, 7, None, 1), (0, "zero", 1, 0, None, 1), (0, "none", 1, None, None, 1), (0, "the", 3, 1, None, 1),
]
LENGTHS = [(0, 1, 6), (0, 1, 6), (1, 1, 2), (0, 2, 8), (0, 3, None)]


def reference():
    newest = {}
    for part, term, doc, tf, pos, at in ROWS:
        if term is None or doc is None:
            continue
        key, n = (part, term, doc), tf if tf is not None else len(pos) if pos is not None else None
        at = -1 if at is None else at
        if key not in newest or at >= newest[key][0]:
            newest[key] = (at, n)
    held = Counter()
    for (_, term, doc), (_, n) in newest.items():
        held[doc, unicodedata.normalize("NFC", term).casefold()] += n or 0
    return {k: n for k, n in held.items() if n}


def test_weights_against_plain_python(spark):
    held = reference()
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, -70, 9)], "doc_id bigint")
    lengths = spark.createDataFrame(LENGTHS, "partial_no int, doc_id bigint, dl int")
    df, cf, dl, n, avgdl = Counter(t for _, t in held), Counter(), {1: 8, 2: 8}, 5, 16 / 5
    for (_, t), tf in held.items():
        cf[t] += tf
    scored = distinctive_terms(frame(spark, ROWS), lengths, docs)
    got = {(r.doc_id, r.term): r for r in scored.collect()}
    assert set(got) == set(held)
    for (d, t), r in got.items():
        tfn = held[d, t] * math.log2(1 + avgdl / (dl.get(d) or avgdl))
        lam = cf[t] / n
        assert (r.tf, r.df, r.cf, r.dl, r.n) == (held[d, t], df[t], cf[t], dl.get(d, 0), n)
        assert r.weight == pytest.approx((math.log2(1 + lam) + tfn * math.log2((1 + lam) / lam)) / (tfn + 1)) and r.weight > 0
    c = F.col
    best = leading_terms(scored, bm25_weight(c("tf"), c("df"), c("dl"), c("n"), c("avgdl")))
    weights = defaultdict(list)
    for (d, t), tf in held.items():
        idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
        weights[d].append((idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl.get(d, 0) / avgdl)), t))
    want = {(d, max(w)[1]) for d, w in weights.items() if len(w) > 1 and sorted(w)[-1][0] >= 1.2 * sorted(w)[-2][0]}
    assert {tuple(r) for r in best.collect()} == want


def test_many_lengths_are_sent_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, -70, 9)], "doc_id bigint")
    lengths = spark.createDataFrame(LENGTHS, "partial_no int, doc_id bigint, dl int")
    c = F.col
    got, plans = [], []
    for small in (True, False):
        monkeypatch.setattr(terms, "small_enough", lambda *_, small=small: small)
        scored = distinctive_terms(frame(spark, ROWS), lengths, docs)
        best = leading_terms(scored, bm25_weight(c("tf"), c("df"), c("dl"), c("n"), c("avgdl")))
        got.append((sorted(map(tuple, scored.collect())), sorted(map(tuple, best.collect()))))
        plans.append(best._jdf.queryExecution().sparkPlan().toString())
    assert got[0] == got[1] and len(got[1][0]) == len(reference()) and got[1][1]
    # the one row generator left sends totals back to their slices; no copies of lengths, no second key to spread by
    assert "ShuffledHashJoin [doc_id" in plans[1] and [p.count("Generate explode") for p in plans] == [1, 1]


def test_frequencies(spark):
    held = reference()
    df, tf = Counter(t for _, t in held), Counter()
    for (_, t), n in held.items():
        tf[t] += n
    docs = spark.createDataFrame([(i,) for i in range(10)], "doc_id bigint")
    got = {r.term: (r.tf, r.df, r.mark) for r in term_frequencies(frame(spark, ROWS), docs).collect()}
    assert got == {t: (tf[t], df[t], "rare" if df[t] <= 2 else "common" if df[t] >= 2 else None) for t in df}


def test_empty(spark):
    empty = frame(spark, ROWS).limit(0)
    docs = spark.createDataFrame([], "doc_id bigint")
    lengths = spark.createDataFrame([], "partial_no int, doc_id bigint, dl int")
    assert term_frequencies(empty, docs).count() == 0
    assert distinctive_terms(empty, lengths, docs).count() == 0
    assert distinctive_terms(frame(spark, ROWS), lengths, docs).filter("weight > 0").count() == len(reference())
