"""Text functions as Column expressions: folding, tokens, titles, chunk windows, display helpers.

Folding is NFC, then full Unicode case folding. Both run inside the JVM through the ICU library
that Spark ships, so no Python worker is started for them; ASCII strings take a cheaper branch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, numbers and "_", joined inside by an apostrophe or a hyphen. The possessive
#: quantifiers keep Java from recursing on texts with thousands of joined words.
WORD_RE = r"[\p{L}\p{N}_]++(?:['’\-][\p{L}\p{N}_]++)*+"

#: Characters at which Python's str.splitlines ends a line (fixed values).
LINE_ENDS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85  "


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def nfc(c: Column) -> Column:
    """NFC form; null stays null."""
    icu = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.isNotNull(), F.when(is_ascii(c), c).otherwise(icu))


def fold(c: Column) -> Column:
    """NFC and full case folding (ß becomes ss); null stays null."""
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    icu = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    return F.when(c.isNotNull(), F.when(is_ascii(c), F.lower(c)).otherwise(icu))


def tokens(c: Column) -> Column:
    """The folded words of a text in order; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(fold(c), F.lit(WORD_RE), F.lit(0)), F.array().cast("array<string>"))


def n_tokens(c: Column) -> Column:
    """size(tokens(c)) without building the array; null counts as 0."""
    return F.coalesce(F.regexp_count(fold(c), F.lit(WORD_RE)), F.lit(0))


def title(text: Column, stem: Column | None = None) -> Column:
    """First non-blank line, trimmed, first 80 characters; `stem` (or "") if the text has none."""
    line = F.regexp_extract(text, rf"(\S[^{LINE_ENDS}]*)", 1)
    head = F.substring(F.regexp_replace(line, r"\s+$", ""), 1, 80)
    return F.when(F.length(head) > 0, head).otherwise(F.coalesce(stem, F.lit("")) if stem is not None else F.lit(""))


def chunk_starts(n: Column, size: int, overlap: int) -> Column:
    """0-based starts of token windows: stride size - overlap, the last window ends at n; none for n = 0."""
    if size < 1:
        raise ValueError("size must be at least 1")
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie in [0, size)")
    step = size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(float(step))).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def chunk_texts(toks: Column, size: int = 256, overlap: int = 32) -> Column:
    """Windows of folded tokens, each joined by one space."""
    return F.transform(chunk_starts(F.size(toks), size, overlap), lambda s: F.array_join(F.slice(toks, s + 1, size), " "))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def highlight_snippet(c: Column) -> Column:
    """Escape, then **word** to <mark>word</mark>."""
    return F.regexp_replace(escape_html(c), r"\*\*(.+?)\*\*", "<mark>$1</mark>")


def highlight_text(c: Column, query: str) -> Column:
    """Escape, then mark whole-word, case-insensitive query words; operators and 1-character words are ignored."""
    import re

    from quillspark.functions.pytext import py_tokens

    words = {t for t in py_tokens(query) if len(t) > 1 and t not in ("and", "or", "not")}
    if not words:
        return escape_html(c)
    alt = "|".join(re.escape(t) for t in sorted(words, key=lambda t: (-len(t), t)))
    return F.regexp_replace(escape_html(c), rf"(?iU)\b(?:{alt})\b", "<mark>$0</mark>")


def display_title(c: Column) -> Column:
    """A title cut at 80 characters loses its last word and gets an ellipsis."""
    cut = F.concat(F.regexp_replace(F.regexp_replace(c, r" [^ ]*$", ""), r"[.,;:]+$", ""), F.lit("…"))
    return F.when((F.length(c) >= 80) & c.contains(" "), cut).otherwise(c)


def format_bytes(n: Column) -> Column:
    """Bytes with a binary unit: whole bytes, otherwise one decimal."""
    def of(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1024**power)), 1))

    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("bigint")))
        .when(n < 1024**2, of(1, "KiB"))
        .when(n < 1024**3, of(2, "MiB"))
        .otherwise(of(3, "GiB"))
    )


def format_ms(ms: Column) -> Column:
    """Milliseconds: one decimal below ten, whole above."""
    return F.when(ms < 10, F.format_string("%.1f ms", ms)).otherwise(F.format_string("%.0f ms", ms))


def book_slug(path: Column) -> Column:
    """Name of the folder that holds the file, "" without one."""
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)


def book_name(path: Column, names: dict[str, str]) -> Column:
    """Title of a book by its folder slug; null when unknown."""
    if not names:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), book_slug(path))


def heading(book: Column, paragraph: Column) -> Column:
    """`Book — first sentence`, the sentence cut at a word within 48 characters, 80 characters in all."""
    sentence = F.split_part(F.trim(paragraph), F.lit(". "), F.lit(1))
    head = F.substring(sentence, 1, 48)
    short = F.when(F.length(sentence) <= 48, sentence).otherwise(F.regexp_replace(head, r" [^ ]*$", ""))
    return F.substring(F.concat(book, F.lit(" — "), short), 1, 80)


def snippet(text: Column, terms: list[str], radius: int = 80) -> Column:
    """Snippets by an Arrow UDF, meant for the few rows left after a top-k."""
    from quillspark.functions.pytext import snippet as cut

    @F.pandas_udf("string")
    def snippets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cut(t, terms, radius))

    return snippets(text)


def paragraphs(text: Column, least: int = 280) -> Column:
    """Blank-line separated blocks, their lines trimmed and joined by a blank, from `least` characters on."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    blocks = F.split(unix, r"\n[^\S\n]*(?:\n[^\S\n]*)+")
    joined = F.transform(blocks, lambda b: F.regexp_replace(F.regexp_replace(b, r"[^\S\n]*\n[^\S\n]*", " "), r"^\s+|\s+$", ""))
    return F.filter(joined, lambda b: F.length(b) >= least)
