"""Evaluation passages inside training texts: rare word n-gram seeds, then Smith-Waterman alignment.

Passages are cut into overlapping stretches, and each stretch into seeds, hashes of consecutive words. The corpus is read
once: a bitmap of fixed size tells which of a text's n-grams may be seeds, and only the surroundings of such places
leave it. A join on the seeds pairs places with stretches. Pairs that share a rare seed are aligned word by
word; those that share only seeds common to many items must first hold enough words of the stretch. The alignment decides.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import SALTS, broadcast_if_small, small_enough, written

#: Accents, and apostrophes and quote marks that may stand inside a word.
_DROPPED = re.compile("[̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿︠-︯'’‘ʼ`´′­​]+")
_WORD = re.compile(r"[^\W_]+")
#: Passages are aligned in stretches of this many words; neighbours share OVERLAP words, more than the
#: 2*min_words that some qualifying window always fits into.
STRETCH, OVERLAP = 128, 48
#: Words per seed. A window of at least 18 words with one edit in ten at most has three such unchanged n-grams (20 words with
#: 2 edits leave 18 words in 3 runs; longer windows leave more), so places with fewer are never aligned.
SEED, MIN_SEEDS = 6, 3
#: Seeds in more items than this are common.
RARE = 20
#: Words kept on either side of a text's seeds: what an alignment of a stretch can reach.
REACH = STRETCH + STRETCH // 5 + 2
#: Bits of the seed bitmap, which is all that is broadcast for the scan (8 MB). More seeds than bits only make it let more places through.
BITS = 1 << 26
#: Words whose hashes a task remembers.
_REMEMBERED = 500_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def plain_words(text: str) -> list[str]:
    """Words regardless of case, accents, punctuation, quote marks and line breaks."""
    folded = text.casefold()
    if not folded.isascii():
        folded = unicodedata.normalize("NFD", folded)
    return _WORD.findall(_DROPPED.sub("", folded))


def passage(text: str) -> str:
    """The text without its instruction line, if it has more than one line."""
    head, cut, rest = text.partition("\n")
    return rest if cut and rest.strip() else text


class _Numbers(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = number = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return number

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), np.uint64, len(words))


def seeds_of(numbers: np.ndarray) -> np.ndarray:
    """Hashes of all n-grams; the place of each is its index."""
    m = max(0, len(numbers) - SEED + 1)
    h = np.zeros(m, np.uint64)
    for k in range(SEED):
        h = (h ^ numbers[k : k + m]) * _MULT
        h ^= h >> np.uint64(29)
    return h


def _longs(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _stretches(items: DataFrame) -> DataFrame:
    """(item_id, stretch, words, seeds) of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for batch in batches:
            ids, nos, words, seeds = [], [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                all_ = numbers.of(plain_words(passage(text)))
                for start in range(0, max(1, len(all_) - OVERLAP), STRETCH - OVERLAP):
                    part = all_[start : start + STRETCH]
                    ids.append(item)
                    nos.append(start)
                    words.append(part)
                    seeds.append(seeds_of(part))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), _longs(words), _longs(seeds)], ["item_id", "stretch", "words", "seeds"])

    held = items.select(F.col("item_id").cast("bigint"), "text").filter(F.col("item_id").isNotNull() & (F.length("text") > 0))
    return held.mapInArrow(cut, "item_id bigint, stretch int, words array<bigint>, seeds array<bigint>")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Which seeds there may be: bit (seed mod BITS) of BITS/64 words, merged by OR before anything leaves the tasks."""
    at = F.col("seed").bitwiseAND(BITS - 1)
    words = seeds.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(seed & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).view(np.uint64)
    return out


def _places(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(row, seg, doc_id, words, seeds, at): the surroundings of every run of possible seeds; row numbers the texts, seg the runs."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, numbers = shared.value, _Numbers()
        row = seg = TaskContext.get().partitionId() << 40
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                found: list[list] = [[], [], [], [], [], []]
                texts = [plain_words(t) for t in batch.column(1).to_pylist()]
                sizes = np.array([len(w) for w in texts])
                ids = numbers.of([w for words in texts for w in words])
                h = seeds_of(ids)
                hit = np.flatnonzero((bits[(h & np.uint64(BITS - 1)) >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1))
                end = np.cumsum(sizes)
                owner = np.searchsorted(end, hit, "right")
                inside = hit + SEED <= end[owner]  # no seed spans two texts
                hit, owner = hit[inside], owner[inside]
                cuts = np.flatnonzero((np.diff(owner) != 0) | (np.diff(hit) > STRETCH)) + 1
                for run, own in zip(np.split(hit, cuts), np.split(owner, cuts), strict=True):
                    if len(run) < MIN_SEEDS:
                        continue
                    t = int(own[0])
                    lo, hi = max(int(end[t] - sizes[t]), int(run[0]) - REACH), min(int(end[t]), int(run[-1]) + REACH)
                    for into, value in zip(found, (row + t, seg, t, ids[lo:hi], h[run], (run - lo).astype(np.uint64)), strict=True):
                        into.append(value)
                    seg += 1
                row += batch.num_rows
                if found[0]:
                    columns = [pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), batch.column(0).take(pa.array(found[2])), *map(_longs, found[3:])]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "seg", "doc_id", "words", "seeds", "at"])

    return docs.mapInArrow(scan, f"row bigint, seg bigint, doc_id {id_type}, words array<bigint>, seeds array<bigint>, at array<bigint>")


def align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Smith-Waterman over rows of word numbers (match 3, change, drop or addition -1), all pairs at once.

    A match outweighs two edits, so that edits near the ends of a copy stay on the path. a is (pairs, n) and b (pairs, m),
    padded with numbers that are no word's. Per pair: the unchanged words of the best path and, from its end, how
    many passage words and how many edits each step takes.
    """
    pairs, n = a.shape
    m = b.shape[1]
    h = np.zeros((pairs, n + 1, m + 1), np.int16)
    ramp = np.arange(m + 1, dtype=np.int16)
    for i in range(1, n + 1):
        step = np.where(a[:, i - 1, None] == b, 3, -1).astype(np.int16)
        row = np.zeros((pairs, m + 1), np.int16)
        row[:, 1:] = np.maximum(h[:, i - 1, :-1] + step, h[:, i - 1, 1:] - 1)
        np.maximum(row, 0, out=row)
        # additions run along the row: the best start minus the distance from it
        h[:, i] = np.maximum.accumulate(row + ramp, axis=1) - ramp
    flat = h.reshape(pairs, -1).argmax(axis=1)
    i, j = flat // (m + 1), flat % (m + 1)
    live = np.arange(pairs)
    trail_p, trail_t, trail_e = [], [], []
    while len(live := live[h[live, i[live], j[live]] > 0]):
        ii, jj = i[live], j[live]
        now, same = h[live, ii, jj], a[live, ii - 1] == b[live, jj - 1]
        diagonal = now == h[live, ii - 1, jj - 1] + np.where(same, 3, -1)
        up = ~diagonal & (now == h[live, ii - 1, jj] - 1)
        trail_p.append(live.copy())
        trail_t.append((diagonal | up).astype(np.int32))
        trail_e.append((~(diagonal & same)).astype(np.int32))
        i[live] -= (diagonal | up).astype(i.dtype)
        j[live] -= (~up).astype(j.dtype)
    if not trail_p:
        return [(0, np.zeros(0, np.int32), np.zeros(0, np.int32))] * pairs
    p, t, e = map(np.concatenate, (trail_p, trail_t, trail_e))
    order = np.argsort(p, kind="stable")
    cuts = np.searchsorted(p[order], np.arange(1, pairs))
    paths = zip(np.split(t[order], cuts), np.split(e[order], cuts), strict=True)
    return [(int(len(y) - y.sum()), x, y) for x, y in paths]


def holds(taken: np.ndarray, edits: np.ndarray, min_words: int, one_in: int) -> bool:
    """Whether some stretch of the path, from an unchanged word to an unchanged word, has at least min_words
    passage words and one edit in `one_in` at most."""
    if not len(taken):
        return False
    c = np.concatenate(([0], np.cumsum(taken)))
    p = c - one_in * np.concatenate(([0], np.cumsum(edits)))
    opens = np.where(edits == 0, p[:-1], np.iinfo(np.int32).max)
    start = np.searchsorted(c[:-1], c[1:] - min_words, "right") - 1
    ok = (start >= 0) & (edits == 0)
    return bool(np.any(p[1:][ok] >= np.minimum.accumulate(opens)[start[ok]]))


def may_hold(known: np.ndarray, min_words: int, one_in: int) -> np.ndarray:
    """Which rows have a window that a place could hold, by the words alone: known[i, j] says that the place has word j of stretch i somewhere."""
    p = np.concatenate((np.zeros((len(known), 1), np.int32), np.cumsum(np.where(known, np.int32(1), np.int32(1 - one_in)), axis=1, dtype=np.int32)), axis=1)
    if p.shape[1] <= min_words:
        return np.zeros(len(known), bool)
    return (p[:, min_words:] >= np.minimum.accumulate(p, axis=1)[:, :-min_words]).any(axis=1)


def longest_run(a: np.ndarray, b: np.ndarray, shift: int) -> int:
    """The most consecutive words that a has in common with b where a[i] stands against b[i + shift]."""
    lo, hi = max(0, -shift), min(len(a), len(b) - shift)
    differ = np.flatnonzero(a[lo:hi] != b[lo + shift : hi + shift])
    return int(np.diff(np.concatenate(([-1], differ, [hi - lo]))).max()) - 1 if hi > lo else 0


#: Padding of stretches and of places; as good as never the hash of a word, and never each other.
_PAD_A, _PAD_B = np.int64(-2), np.int64(-1)


class _Words:
    """The stretches of one bucket as rows of numbers of their distinct words."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        block = np.full((len(rows), max(map(len, rows))), _PAD_A)
        for k, row in enumerate(rows):
            block[k, : len(row)] = row
        self.words, inverse = np.unique(block, return_inverse=True)
        self.numbers = inverse.reshape(block.shape)

    def known(self, rows: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether `place` has each word of these stretches."""
        held = np.zeros(len(self.words), bool)
        at = np.searchsorted(self.words, place)
        at[at == len(self.words)] = 0
        held[at[self.words[at] == place]] = True
        return held[self.numbers[rows]]


def _decide(places: pa.Table, pairs: pa.Table, min_words: int, one_in: int) -> pa.Table:
    """(row, doc_id, item_id, score) of the pairs of one bucket that hold; rows of pairs without a seg bring the words of a stretch."""
    rows: list[tuple[int, int, int]] = []
    tasks = []
    brought = np.asarray(pairs.column("seg").is_null()) if pairs.num_rows else np.zeros(0, bool)
    if brought.any():
        texts = places.column("words").combine_chunks()
        number = {seg: i for i, seg in enumerate(places.column("seg").to_pylist())}
        given = pairs.filter(pa.array(brought))
        words = given.column("words").combine_chunks()
        stretches = [np.asarray(words[i].values) for i in range(given.num_rows)]
        of = {key: i for i, key in enumerate(zip(given.column("item_id").to_pylist(), given.column("stretch").to_pylist(), strict=True))}
        asked = pairs.filter(pa.array(~brought)).sort_by("seg")
        item = asked.column("item_id").to_pylist()
        which = np.fromiter((of[k] for k in zip(item, asked.column("stretch").to_pylist(), strict=True)), np.int64, asked.num_rows)
        seg, lo_, hi_, common = (np.asarray(asked.column(c)) for c in ("seg", "lo", "hi", "common"))
        every = _Words(stretches) if common.any() else None
        starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1]))) if len(seg) else np.zeros(0, np.int64)
        for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(seg)], strict=True):
            at = number[int(seg[start])]
            b = np.asarray(texts[at].values)
            mine = np.arange(start, stop)
            doubtful = mine[common[start:stop]]
            if len(doubtful):
                step = max(1, (1 << 22) // every.numbers.shape[1])
                ok = [may_hold(every.known(which[doubtful[k : k + step]], b), min_words, one_in) for k in range(0, len(doubtful), step)]
                mine = np.concatenate((mine[~common[start:stop]], doubtful[np.concatenate(ok)]))
            for i in mine.tolist():
                a, lo, hi = stretches[which[i]], int(lo_[i]), int(hi_[i])
                run = longest_run(a, b, lo) if lo == hi else 0
                if run >= min_words:  # an unbroken copy
                    rows.append((at, item[i], run))
                    continue
                margin = len(a) // 5 + 2
                lo, hi = max(lo - margin, 0), min(hi + len(a) + margin, len(b))
                # a long stretch of repeated seeds is aligned in overlapping parts of bounded length
                for part in range(lo, max(lo + 1, hi - 2 * STRETCH), 2 * STRETCH):
                    tasks.append((at, item[i], a, b[part : min(hi, part + 4 * STRETCH)]))
    tasks.sort(key=lambda t: (len(t[2]), len(t[3])))
    for k in range(0, len(tasks), 128):
        some = tasks[k : k + 128]
        a = np.full((len(some), max(len(t[2]) for t in some)), _PAD_A)
        b = np.full((len(some), max(len(t[3]) for t in some)), _PAD_B)
        for i, (_, _, x, y) in enumerate(some):
            a[i, : len(x)], b[i, : len(y)] = x, y
        for (at, own, *_), (score, taken, edits) in zip(some, align(a, b), strict=True):
            if score > 0 and holds(taken, edits, min_words, one_in):
                rows.append((at, own, score))
    at = pa.array([r[0] for r in rows], pa.int64())
    found = places.select(["row", "doc_id"]).take(at)
    return found.append_column("item_id", pa.array([r[1] for r in rows], pa.int64())).append_column("score", pa.array([r[2] for r in rows], pa.int32()))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 18, one_in: int = 10) -> DataFrame:
    """(doc_id, item_id, score): every training text that holds a passage of at least `min_words` consecutive words
    of an item, with at most one word in `one_in` changed, added or dropped; score is the number of unchanged words
    of the copy.

    Words are compared without case, accents, punctuation, quote marks and line breaks. The first of several lines of an item is an
    instruction and does not count. A window begins and ends with an unchanged word. Null and empty texts and items match nothing, nor do items shorter than min_words.
    Repeated items come out under each id, repeated documents once per row. Other columns are ignored. The seeds guarantee that nothing is missed for
    min_words >= 18 and one_in >= 10; other values are rejected. Words are compared by 64-bit hashes.
    """
    if min_words < 18 or one_in < 10 or 2 * min_words > OVERLAP:
        raise ValueError("seeds are complete for 18 <= min_words <= 24 and one_in >= 10")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    stretches = written(_stretches(items))
    placed = stretches.select("item_id", "stretch", F.posexplode("seeds").alias("place", "seed"))
    known = written(placed.groupBy("seed").agg(F.count_distinct("item_id").alias("items")))
    places = written(_places(texts, _bitmap(known)))
    # a seed that many texts and many items hold is spread over parts; what leaves a part is one row per place and stretch
    seeds = placed.join(broadcast_if_small(known, 32), "seed")
    hits = places.select("seg", F.explode(F.arrays_zip("seeds", "at")).alias("e")).select("seg", F.col("e.seeds").alias("seed"), "e.at")
    if small_enough(seeds, 48):
        hits = hits.join(F.broadcast(seeds), "seed")
    else:
        parts = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = hits.withColumn("salt", F.pmod(F.xxhash64("seg"), F.lit(SALTS)).cast("int")).join(parts, ["seed", "salt"])
    shift = F.col("at") - F.col("place")
    pairs = hits.groupBy("seg", "item_id", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(shift).alias("lo"), F.max(shift).alias("hi"), (F.min("items") > RARE).alias("common"))
    pairs = written(pairs.filter(F.col("n") >= MIN_SEEDS))
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("seg"), F.lit(buckets)).alias("bucket")
    # the words of a stretch go to a bucket once, however many places it is paired with there
    wanted = pairs.select(bucket, "item_id", "stretch").distinct().join(broadcast_if_small(stretches.select("item_id", "stretch", "words"), 1200), ["item_id", "stretch"])
    asked = pairs.select(bucket, "seg", "item_id", "stretch", "lo", "hi", "common")
    left = places.select(bucket, "row", "seg", "doc_id", "words").groupBy("bucket")
    right = asked.unionByName(wanted, allowMissingColumns=True).groupBy("bucket")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    found = left.cogroup(right).applyInArrow(lambda a, b: _decide(a, b, min_words, one_in), f"row bigint, doc_id {id_type}, item_id bigint, score int")
    return found.groupBy("row", "doc_id", "item_id").agg(F.max("score").alias("score")).drop("row")
