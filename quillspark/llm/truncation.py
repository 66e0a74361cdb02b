"""Texts cut off by field limits: censored length distributions per source, joined with how a text ends.

Per source, text lengths (in characters and in bytes, since fields are limited in either) are taken as
log-normal and right-censored: a text at a limit only says that it would have been at least that long. The
distribution is fitted by maximum likelihood. Lengths at which more texts stop than it explains are candidate
limits; a text that stops there has been censored with the probability that the length is a limit at all, times
the share of the texts there that the fitted tail beyond the limit accounts for. How much an ending speaks for a
cut is estimated from the texts themselves, given those probabilities; both are added as log odds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import durable

#: How a text can end. `sentence` is complete by definition, whatever its length; the weight of the others is estimated.
ENDINGS = ("sentence", "closing", "dots", "marked", "line", "open")
#: Share of complete texts whose end is not recognised as one and passes for open: what `ending` may miss (fixed value).
MISSED = 0.0005
#: How far below a limit texts stop that were cut back to a whole character (bytes) or a whole word (characters).
SLACK = {"chars": 20, "bytes": 3}
#: Steps of a log odd that probabilities are told apart by when endings are weighed, and the farthest step.
STEP, FAR = 4, 32

_QUOTES = "\"'”“’‘»«)\\]*_"
_BLANKS = " \t\n\r\x0b\x0c\u00a0\u200b\ufeff"


def ending(text: Column) -> Column:
    """How a text ends: sentence, closing (signature, list entry, heading, link, page number, tags, ornament), dots (one character),
    marked (dots typed one by one, maybe in brackets), line, open; null for blank texts.

    Only the last lines of a text are looked at.
    """
    body = F.rtrim(text, F.lit(_BLANKS))
    lines = F.regexp_replace(F.substring_index(body, "\n", -3), r"\r\n?", "\n")
    last = F.trim(F.regexp_replace(F.substring_index(lines, "\n", -1), "\u00a0", " "))
    parts = F.split(lines, "\n")
    before = F.trim(F.get(parts, F.size(parts) - 2))
    tail_word = F.substring_index(last, " ", -1)
    closing = (
        last.rlike(r"^[—–-] ?\p{Lu}[^\s]*( \p{Lu}\S*){0,3}$")
        | last.rlike(r"^[-•*·–—] ")
        | last.rlike(r"^\d{1,3}[.)] ")
        | last.rlike(r"^[(\[]?[-– ]*(?:[pPsSсСp]\.? ?)?\d+[-– ]*[)\]]?$")
        | last.rlike(r"^[*#=~_•·\-–—\s]+$")
        | (tail_word.rlike(r"^(?:https?://|www\.)\S+$"))
        | last.rlike(r"^\p{L}+: [^\s,]+(?: [^\s,]+)?(?:, [^\s,]+(?: [^\s,]+)?)++$")
        | last.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")
        | (F.coalesce(before.rlike(r"^(?:[IVXLC]+|\d+)\.?$"), F.lit(False)) & (F.length(last) <= 80))
    )
    single = (~lines.contains("\n")) & (F.length(last) <= 80)
    broken = last.rlike(r"(?:<[^>\s]{0,12}|&#?\w{0,8}|\x{FFFD})$")
    return (
        F.when(text.isNull() | (F.length(body) == 0), F.lit(None).cast("string"))
        .when(broken, "open")
        .when(last.rlike(rf"…[{_QUOTES}]*$"), "dots")
        .when(last.rlike(rf"\.\.\.[{_QUOTES}]*$"), "marked")
        .when(last.rlike(rf"[.!?。！？][{_QUOTES}]*$"), "sentence")
        .when(closing, "closing")
        .when(single, "line")
        .otherwise("open")
    )


def _cdf(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])


def fit_censored(x: np.ndarray, n: np.ndarray, censored: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Mean and deviation of log length by maximum likelihood (EM): n[i] texts at x[i], or at least x[i] where censored."""
    mu, sd = float(np.average(x, weights=n)), max(0.05, float(np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n))))
    total = n.sum()
    for _ in range(rounds):
        z = (x[censored] - mu) / sd
        tail = np.maximum(1 - _cdf(z), 1e-12)
        hazard = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        first, second = x.copy(), x**2
        first[censored] = mu + sd * hazard
        second[censored] = mu * mu + 2 * mu * sd * hazard + sd * sd * (1 + z * hazard)
        new_mu = float((n * first).sum() / total)
        new_sd = max(0.05, math.sqrt(max(0.0, float((n * second).sum() / total) - new_mu**2)))
        done = abs(new_mu - mu) + abs(new_sd - sd) < 1e-6
        mu, sd = new_mu, new_sd
        if done:
            break
    return mu, sd


def _explained(seen: np.ndarray, expected: np.ndarray, beyond: np.ndarray, tries: int) -> np.ndarray:
    """Probability that a length is a limit: the likelihood of what is seen if some share of the `beyond` texts that reach it stops there,
    any share being as likely, against the Poisson likelihood of the fitted rate. One length in `tries` is a limit beforehand."""
    rate = np.maximum(expected, 1e-9)
    chance = seen * np.log(rate) - rate - np.array([math.lgamma(k + 1) for k in seen])
    odds = np.where(seen > expected, -np.log(np.maximum(beyond, 1)) - chance, -np.inf) - math.log(max(1, tries))
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def _limits(unit: str, length: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int, float, float, float]]:
    """(limit, length, texts of that length, probability that they were censored there, mu, sd) of one source in one unit."""
    order = np.argsort(length)
    length, n = length[order].astype(float), n[order].astype(float)
    x, total = np.log(length), n.sum()
    censored = np.zeros(len(x), bool)
    below = np.concatenate(([0.0], np.cumsum(n)))
    best: dict[int, tuple[float, int]] = {}
    mu = sd = 0.0
    for _ in range(4):
        mu, sd = fit_censored(x, n, censored)
        edges = _cdf((np.log(np.concatenate((length - 0.5, length + 0.5))) - mu) / sd)
        own = total * np.maximum(edges[len(x) :] - edges[: len(x)], 0)
        beyond = total * (1 - edges[: len(x)])  # texts that the fit lets reach a length
        best = {}
        for width in (0, SLACK[unit]):  # exact pile-ups, and those cut back to a whole word or character
            lo = np.maximum(length - width, 1)
            start = np.searchsorted(length, lo, "left")
            seen = below[1:] - below[start]
            expected = total * np.maximum(edges[len(x) :] - _cdf((np.log(lo - 0.5) - mu) / sd), 0) if width else own
            limit = _explained(seen, expected, beyond[start], len(x))
            if width:  # a window must also be an edge, beyond which hardly anything follows
                after = np.searchsorted(length, length + 2 * width, "right")
                limit = np.where(below[after] - below[1:] < 0.1 * seen, limit, 0.0)
            for i in np.flatnonzero(limit > 0.5):
                some = slice(start[i], i + 1)
                surplus = min(max(0.0, seen[i] - expected[i]), beyond[start[i]])
                share = (n[some] + 1) / (n[some] + 1).sum()  # where in the window the surplus stops, from the texts there
                p = limit[i] * surplus * share / np.maximum(surplus * share + own[some], n[some])
                for at, value in zip(length[some].astype(int).tolist(), p.tolist(), strict=True):
                    if value > best.get(at, (0.0, 0))[0]:
                        best[at] = (value, int(length[i]))
        new = np.array([best.get(k, (0.0, 0))[0] > 0.5 for k in length.astype(int).tolist()])
        if (new == censored).all() or new.all():
            break
        censored = new
    count = dict(zip(length.astype(int).tolist(), n.astype(int).tolist(), strict=True))
    return [(limit, at, count[at], p, mu, sd) for at, (p, limit) in sorted(best.items())]


LIMITS_SCHEMA = "src string, unit string, limit bigint, length bigint, n bigint, posterior double, mu double, sd double"


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, ending, chars, bytes, h): all that is needed of a text, read once."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), ending(text).alias("ending"),
        F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("h"),
    )


def _histogram(measured: DataFrame) -> DataFrame:
    """(src, unit, length, n) of texts that are not blank; copies of a text count once, so that they do not look like a limit."""
    rows = measured.filter("ending is not null").select(F.col("source").alias("src"), "chars", "bytes", "h").distinct()
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("u")
    return rows.select("src", units).select("src", "u.unit", "u.length").groupBy("src", "unit", "length").agg(F.count(F.lit(1)).alias("n"))


def _fitted(hist: DataFrame) -> DataFrame:
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = pdf["unit"].iloc[0]
        got = _limits(unit, pdf["length"].to_numpy(), pdf["n"].to_numpy())
        out = pd.DataFrame(got, columns=["limit", "length", "n", "posterior", "mu", "sd"])
        out.insert(0, "unit", unit)
        out.insert(0, "src", pdf["src"].iloc[0])
        return out

    return hist.groupBy("src", "unit").applyInPandas(fit, LIMITS_SCHEMA)


def length_limits(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(src, unit, limit, length, n, posterior, mu, sd): lengths at which texts of a source were probably cut, and by which limit.

    A group of the fit holds one row per distinct length of a source, however many texts the source has.
    """
    return _fitted(_histogram(_measured(docs.select(F.lit(0).alias("_no"), text_col, source_col), "_no", text_col, source_col)))


def weigh_endings(cells: list[tuple[float, str, int]], rounds: int = 200) -> tuple[dict[str, float], float]:
    """(log odds of a cut by ending, share of texts cut at no limit) from (probability of censoring, ending, texts).

    Expectation maximisation over whether each text was cut: endings are drawn from one distribution if it was and from another if not,
    and a text at no limit is cut with one probability, so that a probability p of censoring becomes 1 - (1 - p)(1 - share). By
    definition a sentence end is never a cut, and complete texts end open only where `ending` fails (MISSED), which tells the two
    distributions apart. Half a text is added to every ending, so that no weight is infinite.
    """
    p = np.array([c[0] for c in cells])
    kind = np.array([ENDINGS.index(c[1]) for c in cells])
    n = np.array([c[2] for c in cells], float)
    may = np.array([e != "sentence" for e in ENDINGS])
    cut = np.where(may, [0, 0.1, 0.1, 0.1, 0.1, 0.6], 0.0)
    whole, share = np.array([(1 - MISSED) / (len(ENDINGS) - 1)] * (len(ENDINGS) - 1) + [MISSED]), 0.02
    for _ in range(rounds):
        prior = 1 - (1 - p) * (1 - share)
        weight = prior * cut[kind]
        r = weight / np.maximum(weight + (1 - prior) * whole[kind], 1e-300)
        new_cut = np.where(may, np.bincount(kind, n * r, len(ENDINGS)) + 0.5, 0.0)
        new_whole = np.bincount(kind, n * (1 - r), len(ENDINGS)) + 0.5
        new_whole[-1] = 0
        new_whole *= (1 - MISSED) / new_whole.sum()
        new_whole[-1] = MISSED
        free = 1 - p
        loose = free * share / np.maximum(prior, 1e-300)  # of the cut texts, those cut at no limit
        new_share = min(0.5, max(1e-6, float((n * r * loose).sum() / max((n * (1 - r * (1 - loose))).sum(), 1e-9))))
        moved = np.abs(new_cut / new_cut.sum() - cut).max() + abs(new_share - share)
        cut, whole, share = new_cut / new_cut.sum(), new_whole, new_share
        if moved < 1e-9:
            break
    return {e: float(np.log(cut[i] / whole[i])) if may[i] else -math.inf for i, e in enumerate(ENDINGS)}, share


def _settle(weights: dict[str, float]) -> Column:
    """Log odds to add at a limit: from the mean probability of censoring there, and how many of its texts end in each way, to the share
    of cut texts that both make likely. The lengths count as much as two texts."""
    ratio = np.exp(np.clip([weights[e] for e in ENDINGS], -700, 50))

    @F.pandas_udf("double")
    def shift(mean: pd.Series, counts: pd.DataFrame) -> pd.Series:
        m = np.clip(mean.to_numpy(float), 1e-9, 1 - 1e-9)
        n = counts[list(ENDINGS)].to_numpy(float)
        q = m.copy()
        for _ in range(100):
            odds = (q / (1 - q))[:, None] * ratio
            q = np.clip((2 * m + (n * odds / (1 + odds)).sum(axis=1)) / (2 + n.sum(axis=1)), 1e-9, 1 - 1e-9)
        return pd.Series(np.log(q / (1 - q)) - np.log(m / (1 - m)))

    return shift("mean", F.struct(*ENDINGS))


def find_truncated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", use_lengths: bool = True) -> DataFrame:
    """(doc_id, source, ending, limit, unit, posterior, log_odds, truncated): one row per input row. posterior is the probability that the text
    was censored at the limit, before its own ending is considered.

    Null and blank texts are not truncated (ending null), nor are texts that end their sentence. A text of unknown source (null) may have met
    any source's limit: its posterior is the share of censored texts among all of its length. Where several limits fit, the greatest posterior counts.
    Repeated rows come out as often as they occur; ties and extra columns do not matter; an empty table gives an empty
    result. Without `use_lengths` endings alone decide, for comparison.
    """
    measured = durable(_measured(docs, id_col, text_col, source_col))
    hist = durable(_histogram(measured))
    limits = durable(_fitted(hist))
    if not use_lengths:
        limits = limits.limit(0)
    known = limits.filter("src is not null").select("src", "unit", "length", "posterior", "limit")
    everyone = hist.groupBy("unit", "length").agg(F.sum("n").alias("all"))
    cut = limits.groupBy("unit", "length").agg(F.sum(F.col("posterior") * F.col("n")).alias("cut"), F.max_by("limit", "posterior").alias("limit"))
    anyone = cut.join(everyone, ["unit", "length"]).select(F.lit(None).cast("string").alias("src"), "unit", "length", (F.col("cut") / F.col("all")).alias("posterior"), "limit")
    at = known.unionByName(anyone)
    rows = measured
    for unit in ("chars", "bytes"):
        side = at.filter(F.col("unit") == unit).select(F.col("src").alias("s"), F.col("length").alias("l"), F.struct("posterior", F.lit(unit).alias("unit"), "limit").alias(f"at_{unit}"))
        rows = rows.join(side, F.col("source").eqNullSafe(F.col("s")) & (F.col(unit) == F.col("l")), "left").drop("s", "l")
    rows = rows.withColumn("at", F.greatest("at_chars", "at_bytes"))
    rows = durable(rows.select("doc_id", "source", "ending", "at.limit", "at.unit", "at.posterior"))
    p = F.least(F.greatest(F.coalesce("posterior", F.lit(0.0)), F.lit(1e-9)), F.lit(1 - 1e-9))
    step = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.round(F.log(p / (1 - p)) * STEP)))
    # at most (2 * FAR + 1) * len(ENDINGS) rows, whatever the corpus
    cells = rows.filter("ending is not null").groupBy(step.cast("int").alias("step"), "ending").agg(F.count(F.lit(1)).alias("n")).collect()
    found = [(1 / (1 + math.exp(-r.step / STEP)) if r.step > -FAR else 0.0, r.ending, r.n) for r in cells]
    weights, share = weigh_endings(found) if found else (dict.fromkeys(ENDINGS, 0.0), 0.02)
    # a pile-up of texts that end like complete ones is no limit: each limit is settled by the texts that stop at it
    stops = rows.filter("ending is not null and limit is not null").groupBy("source", "unit", "limit")
    stops = stops.agg(F.avg("posterior").alias("mean"), *[F.count_if(F.col("ending") == e).alias(e) for e in ENDINGS])
    stops = durable(stops.select(F.col("source").alias("s"), F.col("unit").alias("u"), F.col("limit").alias("l"), _settle(weights).alias("shift")))
    rows = rows.join(stops, F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") == F.col("u")) & (F.col("limit") == F.col("l")), "left")
    q = 1 / (1 + F.exp(-(F.log(p / (1 - p)) + F.coalesce("shift", F.lit(0.0)))))
    prior = 1 - (1 - q) * (1 - F.lit(share))
    evidence = F.element_at(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv]), F.col("ending"))
    rows = rows.withColumn("posterior", F.when(F.col("limit").isNotNull(), q)).withColumn("log_odds", F.log(prior / (1 - prior)) + evidence)
    return rows.select("doc_id", "source", "ending", "limit", "unit", "posterior", "log_odds", F.coalesce(F.col("log_odds") > 0, F.lit(False)).alias("truncated"))


def truncation_shares(found: DataFrame) -> DataFrame:
    """(source, documents, truncated, share): how often each source truncates, the unknown source included."""
    hit = F.sum(F.col("truncated").cast("bigint"))
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), hit.alias("truncated")).withColumn("share", F.col("truncated") / F.col("documents"))
