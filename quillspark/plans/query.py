"""The boolean query language: syntax tree, parser, and translation of a tree into one Column predicate.

    expression = conjunction (OR conjunction)*
    conjunction = negation (AND? negation)*
    negation = NOT? operand
    operand = word | "phrase" | ( expression )

Queries are folded before they are read, so operators may be written in any case and a bare and/or/not is
always an operator. Parsing happens on the driver; nothing here touches data.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.pytext import PY_WORD, py_fold

_KEYWORDS = {"and", "or", "not"}


class QuerySyntaxError(ValueError):
    """The query does not follow the grammar; the message names the position where it is one character."""


class Node:
    """A query tree; `&`, `|` and `~` combine trees."""

    def __and__(self, other: Node) -> Node:
        return And(self, other)

    def __or__(self, other: Node) -> Node:
        return Or(self, other)

    def __invert__(self) -> Node:
        return Not(self)

    def scored(self) -> list[str]:
        """Words that count for ranking, in query order, repeats included; what stands under NOT does not."""
        return []

    def words(self) -> set[str]:
        """All words the tree needs to look up."""
        return set()

    def phrases(self) -> set[tuple[str, ...]]:
        return set()

    def holds(self, word: Callable[[str], Column], phrase: Callable[[tuple[str, ...]], Column]) -> Column:
        """The tree as a predicate over one document."""
        raise NotImplementedError

    def of_nothing(self) -> bool:
        """Whether a document with none of the words matches."""
        raise NotImplementedError


@dataclass(frozen=True)
class Term(Node):
    text: str

    def scored(self) -> list[str]:
        return [self.text]

    def words(self) -> set[str]:
        return {self.text}

    def holds(self, word, phrase) -> Column:  # noqa: ANN001
        return word(self.text)

    def of_nothing(self) -> bool:
        return False


@dataclass(frozen=True)
class Phrase(Node):
    terms: tuple[str, ...]

    def scored(self) -> list[str]:
        return list(self.terms)

    def words(self) -> set[str]:
        return set(self.terms)

    def phrases(self) -> set[tuple[str, ...]]:
        return {self.terms} if len(self.terms) > 1 else set()

    def holds(self, word, phrase) -> Column:  # noqa: ANN001
        if not self.terms:
            return F.lit(False)
        return word(self.terms[0]) if len(self.terms) == 1 else phrase(self.terms)

    def of_nothing(self) -> bool:
        return False


@dataclass(frozen=True)
class _Pair(Node):
    left: Node
    right: Node

    def scored(self) -> list[str]:
        return self.left.scored() + self.right.scored()

    def words(self) -> set[str]:
        return self.left.words() | self.right.words()

    def phrases(self) -> set[tuple[str, ...]]:
        return self.left.phrases() | self.right.phrases()


class And(_Pair):
    def holds(self, word, phrase) -> Column:  # noqa: ANN001
        return self.left.holds(word, phrase) & self.right.holds(word, phrase)

    def of_nothing(self) -> bool:
        return self.left.of_nothing() and self.right.of_nothing()


class Or(_Pair):
    def holds(self, word, phrase) -> Column:  # noqa: ANN001
        return self.left.holds(word, phrase) | self.right.holds(word, phrase)

    def of_nothing(self) -> bool:
        return self.left.of_nothing() or self.right.of_nothing()


@dataclass(frozen=True)
class Not(Node):
    child: Node

    def words(self) -> set[str]:
        return self.child.words()

    def phrases(self) -> set[tuple[str, ...]]:
        return self.child.phrases()

    def holds(self, word, phrase) -> Column:  # noqa: ANN001
        return ~self.child.holds(word, phrase)

    def of_nothing(self) -> bool:
        return not self.child.of_nothing()


_BLANK = re.compile(r"\s*")


def _lexemes(query: str) -> list[tuple[str, object]]:
    """(kind, value) of every lexeme: "(" ")" and or not word phrase, closed by end."""
    text, at, out = py_fold(query), 0, []
    while (at := _BLANK.match(text, at).end()) < len(text):
        char = text[at]
        if char in "()":
            out.append((char, char))
            at += 1
        elif char == '"':
            close = text.find('"', at + 1)
            if close < 0:
                raise QuerySyntaxError(f"phrase opened at {at} is never closed")
            out.append(("phrase", tuple(PY_WORD.findall(text[at + 1 : close]))))
            at = close + 1
        elif found := PY_WORD.match(text, at):
            word = found.group()
            out.append((word if word in _KEYWORDS else "word", word))
            at = found.end()
        else:
            raise QuerySyntaxError(f"unexpected {char!r} at {at}")
    return [*out, ("end", None)]


def parse(query: str) -> Node:
    """The tree of a query; QuerySyntaxError if it is empty or malformed."""
    lexemes = _lexemes(query)[::-1]  # the next one is last
    if lexemes[-1][0] == "end":
        raise QuerySyntaxError("empty query")

    def ahead(*kinds: str) -> bool:
        return lexemes[-1][0] in kinds

    def operand() -> Node:
        kind, value = lexemes.pop()
        if kind == "word":
            return Term(value)
        if kind == "phrase":
            return Phrase(value)
        if kind == "(":
            inner = expression()
            if lexemes.pop()[0] != ")":
                raise QuerySyntaxError("missing )")
            return inner
        raise QuerySyntaxError(f"expected a word, a phrase or ( but found {'the end' if kind == 'end' else kind}")

    def negation() -> Node:
        if ahead("not"):
            lexemes.pop()
            return Not(operand())
        return operand()

    def conjunction() -> Node:
        tree = negation()
        while ahead("and", "not", "word", "phrase", "("):
            if ahead("and"):
                lexemes.pop()
            tree = And(tree, negation())
        return tree

    def expression() -> Node:
        tree = conjunction()
        while ahead("or"):
            lexemes.pop()
            tree = Or(tree, conjunction())
        return tree

    tree = expression()
    if not ahead("end"):
        raise QuerySyntaxError(f"unexpected {lexemes[-1][0]} after the end of the query")
    return tree
