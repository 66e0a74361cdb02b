"""Cutting oversized texts at natural boundaries by pointer doubling.

Every place where a piece may start gets the start of its greedy successor: the piece runs to the best
boundary within the limit, and the next one starts back from there by up to the overlap. That table of
successors is then squared again and again; after log2(pieces) rounds every start reachable from the
beginning of the text is known, without walking from piece to piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that end a sentence, and those that may follow one before the blank (fixed values).
SENTENCE_ENDS = ".!?…。！？"
CLOSERS = "\"'”“’»)]*"

_SPACES = np.array([i for i in range(0x3001) if chr(i).isspace()], np.uint32)
_IS_SPACE = np.zeros(0x3001, bool)
_IS_SPACE[_SPACES] = True
_ENDS = np.array(sorted(map(ord, SENTENCE_ENDS)), np.uint32)
_CLOSE = np.array(sorted(map(ord, CLOSERS)), np.uint32)


def _boundaries(cp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places where a piece may start or end, their rank (2 paragraph, 1 sentence, 0 word or forced), and whether a word must be cut."""
    n = len(cp)
    space = _IS_SPACE[np.minimum(cp, 0x3000)] & (cp <= 0x3000)
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    word_ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1  # first blank after a word
    lead = int(space[0])  # a text that opens with blanks has a word start before any word end
    rank = np.zeros(len(starts), np.int8)
    if len(starts) > lead:
        ends = word_ends[: len(starts) - lead]
        last, before = cp[ends - 1], cp[np.maximum(ends - 2, 0)]
        closes = np.isin(last, _CLOSE)
        ended = np.isin(last, _ENDS) | closes & np.isin(before, _ENDS)
        lines = np.concatenate(([0], np.cumsum(cp == 10)))
        blank_line = lines[starts[lead:]] - lines[ends] > 1
        rank[lead:] = np.where(blank_line, 2, np.where(ended, 1, 0))
    places, ranks = np.concatenate(([0], starts, [n])), np.concatenate(([0], rank, [2])).astype(np.int8)
    # unbroken stretches beyond the limit get places of their own, evenly spaced from where they begin
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > limit)
    forced = False
    if len(wide):
        step = max(1, limit // 10)
        extra = np.concatenate([np.arange(places[i] + step, places[i + 1], step) for i in wide])
        order = np.argsort(np.concatenate((places, extra)), kind="stable")
        places = np.concatenate((places, extra))[order]
        ranks = np.concatenate((ranks, np.zeros(len(extra), np.int8)))[order]
        edge = np.concatenate(([0], np.flatnonzero(np.diff(space.astype(np.int8))) + 1, [n]))
        runs = np.diff(edge)
        forced = bool(np.any((runs > limit) & ~space[edge[:-1]]))
    return places, ranks, forced


def cut_offsets(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Starts and ends of the pieces (code points) and whether a word had to be cut."""
    n = len(text)
    if n <= limit:
        return np.array([0]), np.array([n]), False
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    places, ranks, forced = _boundaries(cp, limit)
    m = len(places)
    far = np.searchsorted(places, places + limit, "right") - 1  # the last place within reach
    end = far.copy()
    for level in (1, 2):  # a sentence end, or better a paragraph end, in the second half of the reach
        at = np.flatnonzero(ranks >= level)
        best = at[np.searchsorted(at, far, "right") - 1]
        end = np.where((best <= far) & (places[best] > places + limit // 2), best, end)
    end = np.where(places + limit >= n, m - 1, end)
    # back by the overlap, but so that the piece after still ends beyond this one
    onward = places[np.minimum(end + 1, m - 1)]
    floor = np.maximum(np.maximum(places[end] - overlap, np.where(end == far, onward - limit, 0)), places + 1)
    back = np.minimum(np.searchsorted(places, floor, "left"), end)
    whole = np.flatnonzero(ranks >= 1)
    sentence = whole[np.minimum(np.searchsorted(whole, back, "left"), len(whole) - 1)]
    succ = np.where((sentence >= back) & (sentence < end), sentence, back)
    succ = np.where(end == m - 1, m - 1, succ)
    succ[m - 1] = m - 1
    reached = np.zeros(m, bool)
    reached[0] = True
    jump, count = succ, 0
    while count != (count := int(reached.sum())):
        reached[jump[reached]] = True
        jump = jump[jump]
    reached[m - 1] = False
    return places[reached], places[end[reached]], forced


def split_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """(doc_id, piece_no, start, end, kind[, text]): the pieces of every text longer than `limit` characters.

    Characters are Unicode code points. A piece holds at most `limit` of them, consecutive pieces share up to
    `overlap`, and their union is the whole text. Cuts fall between paragraphs, else sentences, else words; only an
    unbroken word longer than the limit is cut inside (kind `forced`, else `natural`, the same for all
    pieces of a text). Null, empty and shorter texts give no row. Each row is cut by itself, so repeated rows and
    ids come out as often as they occur, null ids included. Needs 0 <= overlap <= limit/2. Other columns are ignored.
    """
    if limit < 2 or not 0 <= overlap <= limit // 2:
        raise ValueError("needs limit >= 2 and 0 <= overlap <= limit / 2")
    long = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") > limit)
    id_type = long.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {id_type}, piece_no int, start int, end int, kind string" + ", text string" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, nos, starts, ends, kinds, texts = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                s, e, forced = cut_offsets(text, limit, overlap)
                rows.append(np.full(len(s), i))
                nos.append(np.arange(len(s), dtype=np.int32))
                starts.append(s.astype(np.int32))
                ends.append(e.astype(np.int32))
                kinds.extend(["forced" if forced else "natural"] * len(s))
                if with_text:
                    texts.extend(text[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True))
            if not rows:
                continue
            columns = [batch.column(0).take(pa.array(np.concatenate(rows))), *(pa.array(np.concatenate(x)) for x in (nos, starts, ends)), pa.array(kinds, pa.string())]
            names = ["doc_id", "piece_no", "start", "end", "kind"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return long.mapInArrow(cut, fields)
