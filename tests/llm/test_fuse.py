from __future__ import annotations

import math
from statistics import median

import pytest
from pyspark.sql import functions as F

from quillspark.llm.fuse import fuse_scores, latest_hits

SCHEMA = "query_id bigint, mode string, doc_id bigint, score double, served_at bigint, place int"


def hits(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).withColumn("served_at", F.timestamp_micros("served_at"))


def test_latest(spark, rows):
    data = [(1, "Kw", 1, 5.0, 1), (1, "kw ", 1, 3.0, 2), (1, "kw", 1, float("nan"), 3), (1, "kw", 2, None, 1), (1, "kw", 3, 1.0, None), (1, None, 4, 1.0, 1), (None, "kw", 4, 1.0, 1), (1, "kw", 1, 3.0, 2)]
    assert rows(latest_hits(hits(spark, data))) == [(1, "kw", 1, 3.0), (1, "kw", 3, 1.0)]


def test_scores_against_plain_python(spark):
    lists = {"a": {1: 100.0, 2: 50.0, 3: 10.0, 4: 9.0}, "b": {1: 0.1, 3: 0.9, 5: 0.5}}
    data = [(7, m, d, s, 1) for m, x in lists.items() for d, s in x.items()]
    for by, weights in (("score", {}), ("place", {}), ("score", {"b": 3.0, "a": 0.0})):
        total, want = sum(weights.get(m, 1.0) for m in lists), {}
        for d in {d for x in lists.values() for d in x}:
            logs = 0.0
            for m, x in lists.items():
                v = x if by == "score" else {k: -float(sorted(x.values(), reverse=True).index(s) + 1) for k, s in x.items()}
                med = median(v.values())
                scale = 1.4826 * median(abs(y - med) for y in v.values())
                z = (v[d] - med if d in v else min(v.values()) - (1.0 if by == "place" else scale) - med) / scale
                logs += weights.get(m, 1.0) * -math.log1p(math.exp(-z))
            want[d] = math.exp(logs / total)
        got = {r.doc_id: r for r in fuse_scores(hits(spark, data), weights, by).collect()}
        assert {d: r.fused for d, r in got.items()} == pytest.approx(want)
        assert [d for d, _ in sorted(got.items(), key=lambda x: x[1].place)] == sorted(want, key=lambda d: (-round(want[d], 12), d))


def test_no_scale_wins_ties_and_bad_parameters(spark):
    data = [(1, "big", d, 1e9 - d, 1) for d in range(5)] + [(1, "small", d, d * 1e-9, 1) for d in range(5)]
    got = {r.doc_id: r.fused for r in fuse_scores(hits(spark, data)).collect()}
    assert got[0] == pytest.approx(got[4]) and got[1] == pytest.approx(got[3])
    one = fuse_scores(hits(spark, [(1, "a", 1, 2.0, 1), (2, "a", 1, 2.0, 1), (2, "a", 2, 2.0, 1)]))
    assert {(r.query_id, r.doc_id, r.place) for r in one.collect()} == {(1, 1, 1), (2, 1, 1), (2, 2, 2)}
    assert fuse_scores(hits(spark, data).limit(0)).count() == 0
    with pytest.raises(ValueError):
        fuse_scores(hits(spark, data), by="x")
    with pytest.raises(ValueError):
        fuse_scores(hits(spark, data), {"a": -1.0})


def test_a_list_of_most_rows(spark, monkeypatch):
    """One list of nine tenths of all rows, with sides that may not be broadcast, against the same values by plain Python."""
    import random

    from quillspark import session

    rng = random.Random(0)
    scores = {d: rng.choice([rng.random(), 0.5, 100 * rng.random()]) for d in range(3000)}
    data = [(1, "a", d, s, 1) for d, s in scores.items()] + [(1, "b", d, rng.random(), 1) for d in range(200)] + [(2, "a", d, rng.random(), 1) for d in range(100)]
    monkeypatch.setattr(session, "small_enough", lambda *_: False)
    got, spread = ({(r.query_id, r.doc_id): r for r in fuse_scores(hits(spark, data), {"b": 0.0}, task_rows=n).collect()} for n in (200_000, 500))
    assert {k: (round(r.fused, 9), r.place) for k, r in got.items()} == {k: (round(r.fused, 9), r.place) for k, r in spread.items()}
    got = {d: r for (q, d), r in spread.items() if q == 1}
    order = sorted(scores.values(), reverse=True)
    place = {s: order.index(s) + (order.count(s) + 1) / 2 for s in set(order)}
    x = {d: -place[s] for d, s in scores.items()}
    med = median(x.values())
    mad = median(abs(v - med) for v in x.values())
    for d in rng.sample(range(3000), 200):
        assert got[d].fused == pytest.approx(1 / (1 + math.exp(-(x[d] - med) / (1.4826 * mad))))
    want = sorted(scores, key=lambda d: (-round(got[d].fused, 12), d))
    assert [d for d, _ in sorted(got.items(), key=lambda r: r[1].place)] == want
