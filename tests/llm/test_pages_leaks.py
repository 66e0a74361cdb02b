from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import leaks
from quillspark.llm.leaks import _Words, find_leaks, holds, longest_run, may_hold, passage, plain_words
from quillspark.llm.mainbody import NEAR, NEXT, cut_lines, main_lines


def energy(costs, labels):
    own = sum(max(0, -c) if x else max(0, c) for c, x in zip(costs, labels, strict=True))
    near = sum(a != b for a, b in zip(labels, labels[1:], strict=False))
    far = sum(a != b for a, b in zip(labels, labels[2:], strict=False))
    return own + NEAR * near + NEXT * far


def test_cut_is_minimal():
    rng = random.Random(0)
    for n in range(1, 11):
        for _ in range(15):
            costs = [rng.choice([-3, -1, -0.5, 0, 0.4, 1.3, 2.5]) + rng.random() * 0.01 for _ in range(n)]
            best = min(energy(costs, [m >> i & 1 for i in range(n)]) for m in range(1 << n))
            assert energy(costs, cut_lines(costs)) == pytest.approx(best)
    assert cut_lines([]) == [] and cut_lines([0.0] * 3) == [0, 0, 0]  # ties go to boilerplate


def test_long_runs_are_cut_by_flow_too():
    rng = random.Random(1)
    long = [rng.choice([-0.5, 0.4, -1.9, 1.9]) for _ in range(20000)]
    labels = cut_lines(long)
    assert len(labels) == len(long)
    best = energy(long, labels)
    for i in rng.sample(range(len(long)), 300):  # no single line, nor a block of three, can be turned for less
        for j in (i + 1, i + 3):
            turned = [1 - x if i <= k < j else x for k, x in enumerate(labels)]
            lo, hi = max(0, i - 5), j + 5
            assert energy(long[lo:hi], turned[lo:hi]) >= energy(long[lo:hi], labels[lo:hi]) - 1e-6
    assert best < energy(long, [int(c > 0) for c in long])


def test_edges_decide_lines_that_stand_between_content():
    costs = [-9.0, 4.0, -0.6, 4.0, 5.0, -0.6, -4.0, -0.6, -9.0]
    assert cut_lines(costs) == [0, 1, 1, 1, 1, 0, 0, 0, 0]


def test_pages(spark):
    prose = ["The clerk of the old town kept a blue kettle near the river and nobody asked.", "She left in the rain, and the harbour was quiet for a week.", "Nothing of it was ever found."]
    data = []
    for i in range(12):
        body = [f"{prose[i % 3][:-1]} number {chr(97 + i)}.", f"- a copper kettle {chr(97 + i)}", f"The road {chr(97 + i)} was long."]
        lines = [f"Title {chr(65 + i)} · Part", "Home", "Shelves", "By Harken | 3.04.2020 | 5 min read", *body, "Related passages", f"Title {chr(65 + (i + 1) % 12)} · Part", "© 2020 Site. All rights reserved."]
        data.append((i, f"id{i}", "https://www.site.example/p", f"Title {chr(65 + i)} · Part | Site", "\n".join(lines)))
    data += [(50, None, None, None, None), (51, None, None, None, ""), (52, "x", "bad url", None, "One single sentence stands here alone.\n\n"), (0, *data[0][1:])]
    df = spark.createDataFrame(data, "page_no bigint, id string, url string, title string, text string").withColumns({"line_no": F.lit(9), "h": F.lit(1)})
    got = sorted((r.page_no, r.line_no) for r in main_lines(df).collect())
    assert got == sorted([(i, k) for i in range(12) for k in (4, 5, 6)] + [(0, k) for k in (4, 5, 6)] + [(52, 0)])
    assert main_lines(df.limit(0)).count() == 0


PASSAGE = "The ledger of Fesalo says that Ebkö paid 362 millstones to the lighthouse until 1746 when the tide took the northern wall and all of its twelve keepers went home"


def test_leaks(spark):
    words = PASSAGE.split()
    edited = [*words[:9], "CHANGED", *words[10:]]
    docs = [
        (1, "Before. " + PASSAGE.upper().replace(" ", "\n") + " After."), (2, "x " + " ".join(edited) + " y"), (3, "only " + " ".join(words[:12]) + " here"), (4, None), (5, ""),
        (6, "a b c " * 2000 + " ".join(words[2:26]).replace("ö", "ö").replace("of", "‘of’") + " d e" * 2000), (1, "again " + PASSAGE), (7, "Choose the best answer and read it twice before you go on to the next question please do"),
    ]
    items = [(10, "Choose the best answer and read it twice before you go on to the next question please do\n" + PASSAGE), (11, PASSAGE), (12, "too short"), (13, None), (14, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    e = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = sorted((r.doc_id, r.item_id) for r in find_leaks(d, e).collect())
    assert got == sorted((x, y) for x in (1, 1, 2, 6) for y in (10, 11))
    assert find_leaks(d.limit(0), e).count() == 0 and find_leaks(d, e.limit(0)).count() == 0
    with pytest.raises(ValueError):
        find_leaks(d, e, min_words=5)
    assert passage("one line") == "one line" and passage("a\nb\nc") == "b\nc" and plain_words("D’Été-co, ‘x’") == ["dete", "co", "x"]


def edited(rng, words, n):
    """n words in a row with as many edits as are allowed, the first and last word unchanged."""
    s = rng.randrange(0, len(words) - n + 1)
    copy = words[s : s + n]
    for _ in range(n // 10):
        at, kind = rng.randrange(1, len(copy) - 1), rng.random()
        if kind < 0.4:
            copy[at] = "changed"
        elif kind < 0.7:
            copy.insert(at, "added")
        else:
            del copy[at]
    return copy


def test_edited_copies_are_found(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([40, 60, 300])))) for i in range(30)]
    docs, want = [], set()
    for d in range(300):
        item, text = rng.choice(items)
        fill = ["f%d" % rng.randrange(1000) for _ in range(80)]
        docs.append((d, " ".join(fill[:40] + edited(rng, text.split(), rng.randint(18, 39)) + fill[40:])))
        want.add((d, item))
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert want <= got and len(got) < 1.1 * len(want)


def test_a_line_shared_by_many_items(spark, monkeypatch):
    """Copies are found though most of what they hold is common to all items, and the line alone is no copy of any; so too without broadcasts."""
    rng = random.Random(5)
    line = [f"line{i}" for i in range(12)]
    items = [(i, " ".join([f"i{i}x{k}" for k in range(20)] + line + [f"i{i}y{k}" for k in range(20)])) for i in range(200)]
    docs, want = [], set()
    for d in range(60):
        i = rng.randrange(200)
        words = items[i][1].split()
        copy = words[15:19] + ["other"] + words[20:33] if d % 2 else line  # 18 words of the item with one changed, most of them the line
        docs.append((d, " ".join(["a", "b", *copy, "c", "d"])))
        if d % 2:
            want.add((d, i))
    tables = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(*tables).collect()} == want
    monkeypatch.setattr(leaks, "small_enough", lambda *_: False)
    assert {(r.doc_id, r.item_id) for r in find_leaks(*tables).collect()} == want


def test_word_tests():
    a = np.arange(40)
    assert longest_run(a, np.concatenate((a[5:25], a[26:])), -5) == 20 and longest_run(a, a + 100, 0) == 0
    words = _Words([a, a + 30, (a + 100)[:25]])
    for place in (a, np.delete(a, [3, 12, 22, 33]), a + 35, np.zeros(0, np.int64)):
        known = words.known(np.arange(3), place)
        assert (known[:, :25] == np.isin(np.stack([a, a + 30, a + 100])[:, :25], place)).all() and not known[2, 25:].any()
    assert may_hold(words.known(np.arange(3), a), 18, 10).tolist() == [True, False, False]
    assert may_hold(words.known(np.arange(3), np.delete(a, [3, 12, 22, 33])), 18, 10).tolist() == [True, False, False]


def test_window_rule():
    one = np.ones(18, np.int32)
    edit = np.zeros(18, np.int32)
    assert holds(one, edit, 18, 10) and not holds(one[:17], edit[:17], 18, 10)
    edit[8] = 1
    assert holds(one, edit, 18, 10)
    edit[4] = 1
    assert not holds(one, edit, 18, 10)
