from __future__ import annotations

import pytest

from quillspark.plans.query import And, Not, Or, Phrase, QuerySyntaxError, Term, parse

a, b, c = Term("a"), Term("b"), Term("c")


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        ("b c OR NOT a b", Or(And(b, c), And(Not(a), b))),
        ('"b c" NOT (a OR NOT c) AND b', And(And(Phrase(("b", "c")), Not(Or(a, Not(c)))), b)),
        ("(a b) OR c OR b", Or(Or(And(a, b), c), b)),
        ("c NOT b", And(c, Not(b))),
        ("NOT (NOT a)", Not(Not(a))),
        ('"AND"', Phrase(("and",))),
        ('""', Phrase(())),
        ("A or B", Or(a, b)),
        ("GROẞ", Term("gross")),
    ],
)
def test_trees(query, tree):
    assert parse(query) == tree


@pytest.mark.parametrize("query", ["", "  ", "and", "a AND", "AND a", "NOT NOT a", '"open', "a )", "((c) b", "@@@", "a, b"])
def test_errors(query):
    with pytest.raises(QuerySyntaxError):
        parse(query)


def test_operators_and_scored_words():
    assert (a & ~b) | c == Or(And(a, Not(b)), c)
    assert parse('a a NOT b "c a"').scored() == ["a", "a", "c", "a"]
    assert parse("NOT a OR b").of_nothing() and not parse("a NOT b").of_nothing()
