"""One ranking from lists whose scores live on different scales.

Robust standardisation: within each list, the distance from the median in units of the median absolute
deviation; a logistic curve then bounds the value in (0, 1), so no outlier dominates; the lists are
combined by a weighted geometric mean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.keyed import exact_medians, total_before
from quillspark.session import broadcast_if_small, durable, join_spread

#: Makes the median absolute deviation of a normal sample estimate its standard deviation (fixed value).
MAD_TO_SD = 1.4826
#: Rows that one task holds easily: lists and rankings of up to so many are worked out by windows, longer ones spread over tasks, to the same values.
TASK_ROWS = 200_000
KEYS = ["query_id", "mode"]


def latest_hits(hits: DataFrame) -> DataFrame:
    """(query_id, mode, doc_id, score): the newest logged score of each hit; mode trimmed to lower case.

    Null, NaN and infinite scores are ignored before the newest is taken. Rows with a null query_id, mode or doc_id
    are skipped. A null served_at is older than any other. Hits logged twice come out once; tied versions take the larger score.
    """
    ok = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    rows = hits.filter(ok & F.col("query_id").isNotNull() & F.col("mode").isNotNull() & F.col("doc_id").isNotNull())
    at = F.coalesce(F.unix_micros("served_at"), F.lit(-(2**62)))
    rows = rows.select("query_id", F.lower(F.trim("mode")).alias("mode"), "doc_id", F.col("score").cast("double").alias("score"), at.alias("at"))
    # one exchange serves both groupings, and numbers alone keep them in hash aggregates
    by_time = rows.repartition("query_id", "mode", "doc_id").groupBy("query_id", "mode", "doc_id", "at").agg(F.max("score").alias("score"))
    return by_time.groupBy("query_id", "mode", "doc_id").agg(F.max_by("score", "at").alias("score"))


def _apart(rows: DataFrame, keys: list[str], most: int, short: Callable[[DataFrame], DataFrame], long: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`short` over the groups of up to `most` rows, `long` over the others; both give the same values."""
    large = durable(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(*keys))
    if large.isEmpty():
        return short(rows)
    if most == 0:
        return long(rows)
    large = broadcast_if_small(large, 64)
    return short(rows.join(large, keys, "left_anti")).unionByName(long(rows.join(large, keys, "left_semi")))


def _by_window(lists: DataFrame, by: str) -> DataFrame:
    """Adds x, and the median, deviations and lowest x of its list, by windows over lists that a task holds."""
    one = W.partitionBy(*KEYS)
    if by == "place":
        ties = F.count(F.lit(1)).over(W.partitionBy(*KEYS, "score"))
        lists = lists.withColumn("x", -(2 * F.rank().over(one.orderBy(F.desc("score"))) + ties - 1).cast("bigint"))
    else:
        lists = lists.withColumn("x", F.col("score"))
    apart = F.abs(F.col("x") - F.col("med"))
    lists = lists.withColumn("med", F.median("x").over(one)).withColumn("mad", F.median(apart).over(one))
    return lists.withColumn("mean_dev", F.avg(apart).over(one)).withColumn("low", F.min("x").over(one))


def _by_selection(lists: DataFrame, by: str) -> DataFrame:
    """Adds x, and the median, deviations and lowest x of its list: range-partitioned sums for places, exact distributed selection for
    medians, so that a list is never brought into one task."""
    if by == "place":
        # places are found once per distinct score; doubled, they are whole numbers even where ties share a mean place
        scores = lists.groupBy(*KEYS, "score").agg(F.count(F.lit(1)).alias("c"))
        better = total_before(scores, KEYS, [F.desc("score")], F.col("c"))
        places = better.select(*KEYS, "score", (-(2 * F.col("before") + F.col("c") + 1)).alias("x"))
        lists = durable(join_spread(lists, places, [*KEYS, "score"], 96, "doc_id"))
    else:
        lists = lists.withColumn("x", F.col("score"))
    middle = durable(exact_medians(lists, KEYS, "x", "med"))
    away = join_spread(lists, middle, KEYS, 80, "doc_id").select(*KEYS, F.abs(F.col("x") - F.col("med")).alias("away"))
    spread = exact_medians(away, KEYS, "away", "mad").join(away.groupBy(*KEYS).agg(F.avg("away").alias("mean_dev")), KEYS)
    lowest = lists.groupBy(*KEYS).agg(F.min("x").alias("low"))
    return join_spread(lists, durable(middle.join(spread, KEYS).join(lowest, KEYS)), KEYS, 128, "doc_id")


def fuse_scores(hits: DataFrame, weights: dict[str, float] | None = None, by: str = "place", steepness: float = 1.0, task_rows: int = TASK_ROWS) -> DataFrame:
    """(query_id, doc_id, fused, n_lists, place): the combined ranking of each query.

    `by="score"` standardises the scores themselves, `by="place"` the places of a list (only the order
    counts, ties share their mean place). Values are (median - x) / (1.4826 * MAD) per list, squashed by
    a logistic curve. A document absent from a list gets the value one place below its last entry
    (by score: one deviation below the lowest); lists a query does not have say nothing. A list whose MAD is 0 (all
    tied, or a single hit) is scaled by its mean absolute deviation, or by 1 if that is 0 too. `weights` by mode, default 1
    each, must not be negative; lists and rankings of more than `task_rows` rows are never brought into one task: places come from
    range-partitioned sums, medians from exact distributed selection. The mean is weighted geometric: exp(sum w*ln v / sum w). Ties in `fused` are ordered by doc_id.
    """
    if by not in ("place", "score"):
        raise ValueError("by is 'place' or 'score'")
    if any(w < 0 for w in (weights or {}).values()):
        raise ValueError("weights must not be negative")
    lists = durable(latest_hits(hits))
    placed = _apart(lists, KEYS, task_rows, lambda rows: _by_window(rows, by), lambda rows: _by_selection(rows, by))
    step = 2.0 if by == "place" else None  # places are doubled
    scale = F.when(F.col("mad") > 0, F.col("mad") * MAD_TO_SD).when(F.col("mean_dev") > 0, F.col("mean_dev")).otherwise(F.lit(step or 1.0))
    below = (F.col("low") - (F.lit(step) if step else F.col("scale")) - F.col("med")) / F.col("scale")
    w: Column = F.lit(1.0)
    for mode, value in (weights or {}).items():
        w = F.when(F.col("mode") == mode, F.lit(float(value))).otherwise(w)
    lists = placed.withColumn("scale", scale).withColumn("below", below).withColumn("w", w).withColumn("z", (F.col("x") - F.col("med")) / F.col("scale"))
    lists = durable(lists.select(*KEYS, "doc_id", "z", "below", "w"))

    def log_value(z: Column) -> Column:
        return -F.log1p(F.exp(-steepness * z))

    # what a document would get from every list of its query by being absent; the lists it is in replace their share
    per_list = lists.groupBy(*KEYS).agg(F.first("below").alias("below"), F.first("w").alias("w"))
    floor = per_list.groupBy("query_id").agg(F.sum(F.col("w") * log_value(F.col("below"))).alias("none"), F.sum("w").alias("w_all"))
    gain = lists.groupBy("query_id", "doc_id").agg(
        F.sum(F.col("w") * (log_value(F.col("z")) - log_value(F.col("below")))).alias("gain"), F.count(F.lit(1)).alias("n_lists")
    )
    out = join_spread(gain, floor, ["query_id"], 64, "doc_id").withColumn("fused", F.when(F.col("w_all") > 0, F.exp((F.col("none") + F.col("gain")) / F.col("w_all"))).otherwise(F.lit(0.0)))
    out = out.select("query_id", "doc_id", "fused", "n_lists")
    order = [F.desc(F.round("fused", 12)), F.col("doc_id")]
    short = lambda rows: rows.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    long = lambda rows: total_before(rows, ["query_id"], order).withColumn("place", (F.col("before") + 1).cast("int")).drop("before")
    return _apart(out.select("query_id", "doc_id", "fused", "n_lists"), ["query_id"], task_rows, short, long).select("query_id", "doc_id", "fused", "n_lists", "place")
