from __future__ import annotations

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.pytext import py_tokens, snippet

CASES = {
    "SEVEN Grey herons": ["seven", "grey", "herons"],
    "Ґанок; ліхтар!": ["ґанок", "ліхтар"],
    "пів'яра зв’язку": ["пів'яра", "зв’язку"],
    "żółw": ["żółw"],
    unicodedata.normalize("NFD", "żółw Über"): ["żółw", "über"],
    "[half-open] – gate…": ["half-open", "gate"],
    None: [],
    "\u2003\r\n": [],
    "o'clock, ne'er-do-well": ["o'clock", "ne'er-do-well"],
    "v2.0: 10,5 a4-sheet": ["v2", "0", "10", "5", "a4-sheet"],
    "GROẞ Maß": ["gross", "mass"],
    "tail' _id -q- m--n": ["tail", "_id", "q", "m", "n"],
    "ΛΟΓΟΣ": ["λογοσ"],
}


def evaluate(spark, values, *columns):
    return spark.createDataFrame([(v,) for v in values], "c string").select("c", *columns).collect()


def test_token_cases(spark):
    for r in evaluate(spark, CASES, T.tokens(F.col("c")).alias("t"), T.n_tokens(F.col("c")).alias("n")):
        assert r.t == CASES[r.c] == py_tokens(r.c or "")
        assert r.n == len(r.t)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x24F) | st.sampled_from("'’-_ ßẞЇїй"), max_size=40), min_size=20, max_size=60))
def test_tokens_agree_with_python(spark, texts):
    for r in evaluate(spark, texts, T.tokens(F.col("c")).alias("t")):
        assert r.t == py_tokens(r.c)


def test_null_and_very_long(spark):
    null, joined, run = evaluate(spark, [None, "a-" * 100_000, "x" * 1_000_000], T.tokens(F.col("c")).alias("t"), T.fold(F.col("c")).alias("f"))
    assert null.t == [] and null.f is None
    assert len(joined.t) == 1 and len(run.t[0]) == 1_000_000


def test_titles(spark):
    cases = {"\n  Head line  \nrest": "Head line", "x" * 100: "x" * 80, "": "stem", None: "stem", " \n ": "stem", "a\r\nb": "a"}
    for r in evaluate(spark, cases, T.title(F.col("c"), F.lit("stem")).alias("t")):
        assert r.t == cases[r.c]


def test_chunks(spark):
    words = F.split("c", " ")
    ten = " ".join(f"w{i}" for i in range(10))
    (r,) = evaluate(spark, [ten], T.chunk_texts(words, 4, 1).alias("t"))
    assert r.t == ["w0 w1 w2 w3", "w3 w4 w5 w6", "w6 w7 w8 w9"]
    (r,) = evaluate(spark, ["a b"], T.chunk_texts(words, 4, 1).alias("t"))
    assert r.t == ["a b"]
    with pytest.raises(ValueError):
        T.chunk_texts(words, 4, 4)
    with pytest.raises(ValueError):
        T.chunk_texts(words, 0, 0)


def test_display(spark):
    (r,) = evaluate(spark, ["a<b> & event loop's amp"], T.highlight_text(F.col("c"), "EVENT and loop").alias("t"), T.escape_html(F.col("c")).alias("e"))
    assert r.t == "a&lt;b&gt; &amp; <mark>event</mark> <mark>loop</mark>&#39;s amp"
    (r,) = evaluate(spark, ["**x** <y>"], T.highlight_snippet(F.col("c")).alias("t"))
    assert r.t == "<mark>x</mark> &lt;y&gt;"
    long = "word, " * 13 + "cutoff"
    (r,) = evaluate(spark, [long], T.display_title(F.col("c")).alias("t"))
    assert r.t == ("word, " * 13).rstrip(" ,") + "…"
    sizes = spark.createDataFrame([(512,), (2048,), (83200,), (3 << 30,)], "n bigint").select(T.format_bytes(F.col("n"))).collect()
    assert [x[0] for x in sizes] == ["512 B", "2.0 KiB", "81.2 KiB", "3.0 GiB"]


def test_paragraphs_and_headings(spark):
    text = "a b\n c \n\n" + "x" * 10 + "\r\n \r\nshort"
    (r,) = evaluate(spark, [text], T.paragraphs(F.col("c"), 5).alias("p"))
    assert r.p == ["a b c", "x" * 10, "short"]
    (r,) = evaluate(spark, ["First sentence. Second"], T.heading(F.lit("Book"), F.col("c")).alias("h"))
    assert r.h == "Book — First sentence"


def test_snippet():
    assert snippet("nothing here", ["zebra"]) == "nothing here"
    assert snippet("x" * 200, ["zebra"]) == "x" * 160 + "…"
    text = "Tide " + "a " * 200 + "Tide table of the TIDE" + " b" * 100
    got = snippet(text, ["tide", "table", ""])
    assert got.startswith("…") and got.endswith("…") and "**tide** **table** of the **tide**" in got
    assert snippet("tide-table and tide", ["tide", "tide-table"]) == "**tide-table** and **tide**"
