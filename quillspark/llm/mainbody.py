"""The passage of a crawled page without menus, notices, lists and footers: minimum-cut labelling of lines.

Every line gets a cost for either label from a small linear classifier over its shape and over how often the
line occurs on its site, in the whole crawl, or as a title of another page. Lines are joined to their
neighbours, and a little less to the next but one, by smoothness edges, since blocks of a page stand together. A
maximum flow from content to boilerplate finds the cheapest consistent labelling. All but the flow is Column work.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import broadcast_if_small, release, written

#: Shares of a site's pages, with the least number of pages, from which a line counts as part of the site (fixed values).
SITE_SHARES = ((0.1, 3), (0.3, 2))
#: Share of all pages from which a line counts as furniture of the web at large.
CRAWL_SHARE = 0.025
#: Share of all pages, with the least number of sites, from which the same sentence is not a page's own.
WIDE_SHARE, WIDE_SITES = 0.005, 3
#: Smoothness between neighbouring lines and between a line and the next but one.
NEAR, NEXT = 0.7, 0.4
#: Weights of the classifier; positive speaks for content (fixed values).
WEIGHTS = {
    "title_line": -9.0, "site": -9.0, "crawl": -9.0, "wide": -9.0, "title": -4.0, "like_title": -3.0, "date": -5.0,
    "separators": -5.0, "prose": 3.0, "prose_word": 0.1, "entry": 1.5, "lower": 1.5, "heading": 2.0,
}
#: Parts that the lines of one text are spread over while they are counted, so that a line of every page is not one task's.
SLICES = 64
_SITE, _CRAWL, _TITLE, _WIDE = 1, 2, 4, 8
_BLANKS = " \t\n\r\x0b\x0c\u00a0\u200b\ufeff"
_SENTENCE = r"[.!?…][\"”»“’')\]]*$"


def _shape(line: Column, no: Column, title: Column) -> list[Column]:
    """`base`, what the shape of a line speaks for content, and `soft`, `like` and `prose`, which say how recurrence and titles add to it."""
    w, s = WEIGHTS, F.btrim(line, F.lit(_BLANKS))
    words = F.when(s == "", 0).otherwise(F.size(F.split(s, r"\s+")))
    named = F.length(F.btrim(title, F.lit(_BLANKS))) > 0
    head = (no == 0) & F.when(named, s == F.btrim(title, F.lit(_BLANKS))).otherwise(~s.rlike(_SENTENCE))
    sentence, entry, lower = s.rlike(_SENTENCE), s.rlike(r"^(?:[•\-*–]|\d{1,3}[.)]) "), s.rlike(r"^\p{Ll}")
    dated = (words <= 12) & s.rlike(r"\b\d{1,2}[./]\d{1,2}[./]\d{4}\b|\b\d{4}-\d{2}-\d{2}\b")
    kind = F.when(sentence & (words >= 3), w["prose"] + w["prose_word"] * F.least(words, F.lit(40))).when(entry, w["entry"])
    kind = kind.when(lower, w["lower"]).when(words.between(1, 3), w["heading"]).otherwise(0.0)
    parts = [(head, w["title_line"]), (dated, w["date"]), (s.contains(" | ") | s.contains(" › "), w["separators"])]
    base = sum((F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0) for c, v in parts), kind)
    like = (words <= 8) & ~sentence & s.rlike(r" · | — |(?:^|: )[IVXLC]+\. ")
    return [base.alias("base"), (entry | lower).alias("soft"), like.alias("like"), (sentence & (words >= 3)).alias("prose"), (s == "").alias("blank")]


def _cost(bits: Column) -> Column:
    """`base` with what is known of a line beyond its page."""
    w = WEIGHTS
    cost = F.col("base") + F.when((bits.bitwiseAND(_SITE) > 0) & ~F.col("soft"), w["site"]).otherwise(0.0)  # entries of short lists recur by nature
    cost = cost + F.when(bits.bitwiseAND(_CRAWL) > 0, w["crawl"]).otherwise(0.0)
    cost = cost + F.when((bits.bitwiseAND(_WIDE) > 0) & F.col("prose"), w["wide"]).otherwise(0.0)
    return cost + F.when(bits.bitwiseAND(_TITLE) > 0, w["title"]).when(F.col("like"), w["like_title"]).otherwise(0.0)


def _edges(i: int, n: int) -> Iterator[tuple[int, float]]:
    for step, weight in ((-2, NEXT), (-1, NEAR), (1, NEAR), (2, NEXT)):
        if 0 <= i + step < n:
            yield i + step, weight


def _max_flow(excess: dict[int, float], links: dict[int, dict[int, float]]) -> set[int]:
    """Nodes on the content side of a minimum cut. excess is what a node takes from the source, or below 0, gives to the sink.

    Flow leaves one source node at a time by shortest paths, which stay near it. What lines can still reach once nothing
    more leaves is the content side.
    """
    left = dict(excess)
    cap = {u: dict(v) for u, v in links.items()}
    for start in sorted(u for u, e in excess.items() if e > 0):
        while left[start] > 1e-9:
            back, queue, end = {start: start}, deque([start]), None
            while queue and end is None:
                u = queue.popleft()
                for v, c in cap[u].items():
                    if c > 1e-9 and v not in back:
                        back[v] = u
                        queue.append(v)
                        if left[v] < -1e-9:
                            end = v
                            break
            if end is None:
                break
            path, v = [], end
            while v != start:
                path.append((back[v], v))
                v = back[v]
            flow = min(left[start], -left[end], *(cap[u][v] for u, v in path))
            for u, v in path:
                cap[u][v] -= flow
                cap[v][u] += flow
            left[start] -= flow
            left[end] += flow
    held = {u for u, e in left.items() if e > 1e-9}
    queue = deque(held)
    while queue:
        for v, c in cap[queue.popleft()].items():
            if c > 1e-9 and v not in held:
                held.add(v)
                queue.append(v)
    return held


def cut_lines(costs: list[float]) -> list[int]:
    """1 for content, 0 for boilerplate: the minimum cut; ties go to boilerplate.

    Lines whose own cost outweighs all their edges keep its sign in every minimum cut, so they are settled first. What
    stays open falls into runs without edges between them, each of which is sent through the flow by itself.
    """
    n = len(costs)
    label = [1 if c > 0 else 0 for c in costs]
    open_ = [i for i in range(n) if abs(costs[i]) <= sum(w for _, w in _edges(i, n))]
    run: list[int] = []
    for i, following in zip(open_, [*open_, n + 3][1:], strict=False):
        run.append(i)
        if following - i <= 2:
            continue
        free = set(run)
        excess, links = {}, {}
        for k in run:
            excess[k], links[k] = costs[k], {}
            for j, w in _edges(k, n):
                if j in free:
                    links[k][j] = w
                else:
                    excess[k] += w if label[j] else -w
        content = _max_flow(excess, links)
        for k in run:
            label[k] = int(k in content)
        run = []
    return label


def _site(url: Column) -> Column:
    """The last two labels of the host."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(F.trim(line), r"\d+", "0"))


def _lines(rows: DataFrame) -> DataFrame:
    """Every line of every page, without its text: what it looks like, what it is counted by, and where it stands."""
    nothing = F.xxhash64(F.lit(""))
    flat = rows.select("key", "site", "title", F.xxhash64("id").alias("pid"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # what a line announces after a colon may be the title of another page
    told = F.when(F.length("line") <= 120, F.regexp_extract("line", r"^[^:]{1,40}: (.+)$", 1))
    hashes = [_line_hash(F.col("line")).alias("h"), F.when(F.length("line") <= 120, _line_hash(F.col("line"))).alias("short"), F.when(F.length(told) > 0, _line_hash(told)).alias("told")]
    out = flat.select("key", "site", "pid", "line_no", *hashes, *_shape(F.col("line"), F.col("line_no"), F.col("title")))
    # a blank line joins with nothing, whatever other pages have in its place
    return out.withColumns({"h": F.when(F.col("h") != nothing, F.col("h")), "slice": F.pmod("pid", F.lit(SLICES)).cast("int")})


def _bits(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(site, h, slice, bits) of the lines that recur or are titles, for just the slices that hold them."""
    spread = lines.filter("h is not null").repartition("site", "h", "slice")
    per = spread.groupBy("site", "h", "slice", "pid").agg(F.first("short").alias("short"), F.first("told").alias("told"))
    per = per.groupBy("site", "h", "slice").agg(F.count(F.lit(1)).alias("n"), F.first("short").alias("short"), F.first("told").alias("told"))
    held = written(per.groupBy("site", "h").agg(F.sum("n").alias("n"), F.collect_list("slice").alias("slices"), F.first("short").alias("short"), F.first("told").alias("told")))
    size = written(rows.select("site", F.xxhash64("id").alias("pid")).distinct().groupBy("site").agg(F.count(F.lit(1)).alias("site_pages")))
    part = F.lit(False)
    for share, least in SITE_SHARES:
        part = part | ((F.col("n") >= least) & (F.col("n") >= share * F.col("site_pages")))
    on_site = held.filter(F.col("n") >= min(least for _, least in SITE_SHARES)).join(broadcast_if_small(size, 64), "site").filter(part)
    # at most (lines per page / WIDE_SHARE) lines can be that frequent, however many pages there are
    everywhere = held.groupBy("h").agg(F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("sites")).crossJoin(F.broadcast(size.agg(F.sum("site_pages").alias("all"))))
    often = lambda share: F.col("n_all") >= F.greatest(share * F.col("all"), F.lit(3))
    wide = F.when(often(WIDE_SHARE) & (F.col("sites") >= WIDE_SITES), _WIDE).otherwise(0)
    everywhere = everywhere.select("h", (F.when(often(CRAWL_SHARE), _CRAWL).otherwise(0) + wide).alias("bits")).filter("bits > 0")
    # a title with and without the site's name after its last separator
    bare = F.regexp_replace("title", r"\s+[|–—-]\s+[^|–—]*$", "")
    titles = rows.filter("title is not null").select(F.explode(F.array(F.col("title"), bare)).alias("t")).select(_line_hash(F.col("t")).alias("t"))
    titles = written(titles.filter(F.col("t") != F.xxhash64(F.lit(""))).distinct())
    kinds = [on_site.withColumn("bits", F.lit(_SITE)), held.join(broadcast_if_small(everywhere, 32), "h")]
    kinds += [held.join(titles, F.col(c) == F.col("t"), "left_semi").withColumn("bits", F.lit(_TITLE)) for c in ("short", "told")]
    found = reduce(DataFrame.unionByName, [some.select("site", "h", "slices", "bits") for some in kinds])
    found = found.groupBy("site", "h").agg(F.bit_or("bits").alias("bits"), F.first("slices").alias("slices"))
    return found.select("site", "h", F.explode("slices").alias("slice"), "bits")


def main_lines(pages: DataFrame, with_text: bool = True) -> DataFrame:
    """(page_no, line_no[, line]): the lines of `text` (split at newlines, from 0) that belong to the page's own passage.

    Reads page_no, id, url, title and text; other columns are ignored. Every row counts by itself, fetches of the same
    id count once in the frequencies. Null and empty texts give no row; a null or missing title, url or id is fine
    (such pages share one site). Blank lines never come out. Ties between the labels go to boilerplate.
    """
    rows = pages.select("page_no", F.coalesce("id", "url").alias("id"), "url", "title", "text").filter(F.length("text") > 0)
    rows = rows.withColumns({"site": F.xxhash64(_site(F.col("url"))), "key": F.xxhash64("page_no", "url", "title", "text")})
    lines = written(_lines(rows))
    marked = lines.join(_bits(lines, rows), ["site", "h", "slice"], "left")
    costs = marked.select("key", F.struct("line_no", _cost(F.coalesce("bits", F.lit(0))).cast("float").alias("cost"), "blank").alias("c"))
    # rows that agree in everything are one key; their lines are equal
    per_page = costs.groupBy("key").agg(F.array_sort(F.collect_set("c")).alias("c")).select("key", F.col("c.cost").alias("cost"), F.col("c.blank").alias("blank"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = []
            for costs_, blanks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept.append([k for k, (x, b) in enumerate(zip(cut_lines(costs_), blanks, strict=True)) if x and not b])
            ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.array(k, np.int32) for k in kept]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["key", "kept"])

    labels = written(per_page.mapInArrow(label, "key bigint, kept array<int>"))
    release(lines)
    out = rows.select("key", "page_no", *(["text"] if with_text else [])).join(labels, "key")
    if not with_text:
        return out.select("page_no", F.explode("kept").alias("line_no"))
    out = out.withColumn("all", F.split("text", "\n")).select("page_no", "all", F.explode("kept").alias("line_no"))
    return out.select("page_no", "line_no", F.get("all", F.col("line_no")).alias("line"))
