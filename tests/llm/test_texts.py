"""Cutting, packing, truncation."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.pytext import py_tokens
from quillspark.llm.pack import pack_texts, plan_patterns
from quillspark.llm.pieces import cut_offsets, split_texts
from quillspark.llm.truncation import ENDINGS as KINDS
from quillspark.llm.truncation import ending, find_truncated, fit_censored, truncation_shares, weigh_endings


def test_cuts_hold_on_random_texts():
    random.seed(0)
    for _ in range(3000):
        text = "".join(random.choice("ab c.\n\n  d!") for _ in range(random.randint(0, 120)))
        if random.random() < 0.3:
            text = text[:20] + "x" * random.randint(0, 60) + text[20:]
        limit = random.choice([2, 3, 7, 10, 20, 31])
        overlap = random.randint(0, limit // 2)
        s, e, forced = cut_offsets(text, limit, overlap)
        assert s[0] == 0 and e[-1] == len(text) and (e - s <= limit).all()
        assert (s[1:] <= e[:-1]).all() and (e[:-1] - s[1:] <= overlap).all() and (np.diff(s) > 0).all() and (np.diff(e) > 0).all()
        if len(text) > limit:
            assert forced == (max(map(len, re.split(r"\s", text))) > limit)


def test_paragraphs_before_sentences_before_words():
    text = "word " * 30 + "End. " + "word " * 30 + "\n\n" + "word " * 100
    s, e, forced = cut_offsets(text, 320, 20)
    assert text[: e[0]].endswith("\n\n") and not forced
    s, e, _ = cut_offsets(text, 250, 20)
    assert text[: e[0]].endswith("End. ")
    s, e, _ = cut_offsets("y " * 500, 100, 0)
    assert set(np.diff(s).tolist()) == {100}


def test_split_rows(spark, rows):
    data = [(1, "short"), (None, "ab " * 1000), (2, None), (3, ""), (4, "z" * 5001), (4, "z" * 5001), (5, "\U0001f600 " * 1500)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumns({"kind": F.lit(1), "piece_no": F.lit(2)})
    got = split_texts(df).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        assert len(r.text) == r.end - r.start <= 2000
    assert set(by) == {None, 4, 5} and {r.kind for r in by[4]} == {"forced"} and {r.kind for r in by[5] + by[None]} == {"natural"}
    assert Counter(r.piece_no for r in by[4]) == Counter([0, 0, 1, 1, 2, 2])
    assert split_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, limit=100, overlap=51)


def test_plan_respects_every_capacity():
    counts = {100: 7, 300: 5, 512: 4, 1: 40, 1024: 2}
    plans = {}
    for rule in ("dot", "norm"):
        for docs, cost in ((256, 1024.0**2), (3, 1024.0**2), (256, 0.3 * 1024**2), (256, 90000.0)):
            used = Counter()
            plans[rule, docs, cost] = plan_patterns(counts, 1024, docs, cost, rule=rule)
            for times, take in plans[rule, docs, cost]:
                alone = sum(take.values()) == 1
                assert sum(s * n for s, n in take.items()) <= 1024 and sum(take.values()) <= docs and (alone or sum(s * s * n for s, n in take.items()) <= cost)
                for s, n in take.items():
                    used[s] += n * times
            assert used == counts
        n = {k: sum(times for times, _ in p) for k, p in plans.items() if k[0] == rule}
        plain = n.pop((rule, 256, 1024.0**2))
        assert all(more > plain for more in n.values())  # each of the other capacities decides somewhere


def test_packing(spark):
    random.seed(2)
    data = [(i, "w " * random.choice([0, 1, 5, 5, 5, 30, 90, 100, 101, 250])) for i in range(400)] + [(7, "w " * 5), (None, "w " * 3), (8, None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumns({"tokens": F.lit(1), "n": F.lit("x")})
    got = pack_texts(df, capacity=100).collect()
    sizes = sorted(len(py_tokens(t or "")) for _, t in data)
    fill, parts = Counter(), defaultdict(int)
    for r in got:
        parts[r.doc_id] += r.tokens
        if r.container is not None:
            fill[r.container] += r.tokens
        assert (r.container is None) == (r.tokens == 0) and r.n_parts == max(1, -(-(100 * (r.n_parts - 1) + r.tokens) // 100) if r.part_no == r.n_parts - 1 else r.n_parts)
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(sizes) and set(fill) == set(range(len(fill)))
    assert len(fill) <= -(-sum(sizes) // 100) * 1.05 + 1
    assert Counter(r.n_parts > 1 for r in got if r.part_no == 0)[True] == sum(s > 100 for s in sizes)
    assert pack_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack_texts(df, max_docs=0)


ENDINGS = {
    "He laughed.": "sentence", 'He said "no."': "sentence", "Really?»  \n": "sentence", "And then the sea": "line", "One.\nAnd then the long road to the\nsea and the": "open",
    "One.\n— Harken": "closing", "One.\n- a kettle": "closing", "One.\n(41)": "closing", "One.\nTHE END": "closing", "One.\n* * *": "closing", "One.\nhttps://a.example/x": "closing",
    "One.\nTags: a, b, c": "closing", "One.\nXIV\nFenyar & Selmel": "closing", "One.\nHe went…": "dots", "One.\nHe went...": "marked", "One.\rHe went [...]": "marked", "One.\nHe went ca<": "open", "One.\nHe went &am": "open", "One. He w�": "open",
    "One.\n\nB": "open", "": None, " \n": None, None: None, "One.\nTags: " + "a, " * 20000 + "b": "closing",
}


def test_endings(spark):
    for r in spark.createDataFrame([(t,) for t in ENDINGS], "t string").withColumn("e", ending(F.col("t"))).collect():
        assert r.e == ENDINGS[r.t], r.t[:60]


def test_censored_fit_recovers_parameters():
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(6.0, 0.7, 20000))
    cut = np.minimum(x, 500.0).round()
    length, n = np.unique(cut, return_counts=True)
    mu, sd = fit_censored(np.log(length), n.astype(float), length >= 500)
    assert abs(mu - 6.0) < 0.03 and abs(sd - 0.7) < 0.03


def test_truncation_by_limit_and_ending(spark):
    rng = random.Random(1)
    sentence = "The old clerk kept a blue kettle near the river and nobody asked. "
    data = []
    for i in range(1500):
        text = f"Note {i}\n" + "".join(rng.choice((sentence, "It rained. ", f"In {i} she left the harbour town. ")) for _ in range(rng.randint(2, 40))).strip()
        if len(text) > 800:
            data.append((i, "short", text[:797] + "...", True) if i % 2 else (i, "short", text[:800], None))
        elif i % 9 == 0:
            data.append((i, "short", text[:-1] + "...", False))  # deliberate dots
        else:
            data.append((i, "short", text, False))
    data += [(9000, None, "One. And then the", True), (9001, "short", None, False), (9002, "short", "", False)]
    df = spark.createDataFrame([(d, s, t.replace("\n", " ") + ("" if d != 9000 else " ") if t else t) for d, s, t, _ in data], "doc_id bigint, source string, text string")
    df = df.withColumn("limit", F.lit("clash"))
    got = {r.doc_id: r for r in find_truncated(df).collect()}
    wrong = 0
    for d, _, text, cut in data:
        if cut is None:
            cut = not re.search(r'[.!?]$', text.rstrip())
        if d < 9000:
            wrong += got[d].truncated != cut
    assert len(got) == len(data) and wrong <= 3
    assert not got[9001].truncated and got[9001].ending is None and not got[9002].truncated
    shares = {r.source: (r.documents, r.truncated) for r in truncation_shares(find_truncated(df)).collect()}
    assert shares["short"][0] == len(data) - 1 and set(shares) == {"short", None}
    assert find_truncated(df.limit(0)).count() == 0
    # the lengths decide: without them, texts cut to the limit with dots added cannot be told from deliberate dots
    blind = {r.doc_id for r in find_truncated(df, use_lengths=False).collect() if r.truncated}
    dotted = {d for d, _, text, cut in data if cut and text.endswith("...")}
    assert dotted and dotted <= {d for d, r in got.items() if r.truncated} and not dotted & blind


def test_weights_of_endings_are_estimated():
    rng = random.Random(4)
    whole, cut = {"sentence": 0.8, "closing": 0.15, "dots": 0.05}, {"dots": 0.2, "closing": 0.01, "open": 0.79}
    cells = Counter()
    for _ in range(40000):
        p = 0.95 if rng.random() < 0.1 else 0.0
        kinds = cut if rng.random() < 1 - (1 - p) * 0.98 else whole
        cells[p, rng.choices(list(kinds), kinds.values())[0]] += 1
    weights, share = weigh_endings([(p, e, n) for (p, e), n in cells.items()])
    assert set(weights) == set(KINDS) and abs(share - 0.02) < 0.004
    assert abs(weights["dots"] - np.log(0.2 / 0.05)) < 0.3 and weights["closing"] < -2 and weights["open"] > 6 and weights["sentence"] == -np.inf
