"""Filling fixed-capacity containers: vector best-fit over residual tokens, documents and attention cost.

The packing is planned on how many items there are of each size, never on the items: at most `capacity`
sizes exist, whatever the corpus. A planned pattern (so many items of these sizes) is used for as many
containers as the counts allow. Items then find their container by their rank among items of their size,
which is numbered in slices so that a size shared by a third of all items does not meet in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import n_tokens
from quillspark.session import durable

#: Slices for numbering the items of one size.
SLICES = 256


def plan_patterns(counts: dict[int, int], capacity: int, max_docs: int, max_cost: float, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "dot") -> list[tuple[int, dict[int, int]]]:
    """(containers, {size: items in each}): greedy vector best-fit on size classes.

    A container opens with the largest size left. Then, among sizes that fit all three residual capacities
    (tokens, documents, sum of squared sizes), the one with the greatest weighted dot product of demand and residual
    (`dot`) or the smallest weighted norm of what would remain (`norm`) goes in, until none fits.
    """
    sizes = np.array(sorted(counts), np.int64)
    left = np.array([counts[int(s)] for s in sizes], np.int64)
    demand = np.stack([sizes / capacity, np.full(len(sizes), 1 / max_docs), sizes.astype(float) ** 2 / max_cost], axis=1)
    w = np.array(weights)
    plan: list[tuple[int, dict[int, int]]] = []
    top = len(sizes) - 1
    while top >= 0:
        if left[top] == 0:
            top -= 1
            continue
        residual, take = np.ones(3), np.zeros(len(sizes), np.int64)
        pick = top
        room = capacity
        while pick >= 0:
            take[pick] += 1
            residual = residual - demand[pick]
            room -= int(sizes[pick])
            hi = int(np.searchsorted(sizes, room, "right"))
            if hi == 0 or residual[1] < demand[0, 1] - 1e-12:
                break
            d = demand[:hi]
            fits = (left[:hi] > take[:hi]) & (d[:, 2] <= residual[2] + 1e-12)
            if not fits.any():
                break
            value = d @ (w * residual) if rule == "dot" else -(((residual - d) ** 2) @ w)
            pick = int(np.where(fits, value, -np.inf).argmax())
        used = np.flatnonzero(take)
        times = int((left[used] // take[used]).min())
        left[used] -= times * take[used]
        plan.append((times, {int(sizes[i]): int(take[i]) for i in used}))
    return plan


def pack_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    max_docs: int = 256,
    max_cost: float | None = None,
    rule: str = "dot",
) -> DataFrame:
    """(doc_id, part_no, n_parts, tokens, container): every text in containers of `capacity` tokens.

    Sizes are counted in the engine's own words. A text of more than `capacity` tokens, and no other, is divided: parts of
    `capacity` tokens fill containers alone, the rest is packed like any other item. A container holds at most
    `max_docs` items and, if given, `max_cost` of attention (sum of squared sizes; by default the square of
    the capacity, which nothing exceeds). An item that alone costs more than `max_cost` has a container to itself. Null and empty texts have 0 tokens and no container (null). Rows with
    equal or null ids are items of their own. Ties between equal sizes are settled by id hash. Other columns are ignored.
    """
    if capacity < 1 or max_docs < 1:
        raise ValueError("capacities must be positive")
    cost = float(capacity) ** 2 if max_cost is None else float(max_cost)
    if cost <= 0:
        raise ValueError("capacities must be positive")
    if rule not in ("dot", "norm"):
        raise ValueError("rule is 'dot' or 'norm'")
    sized = durable(docs.select(F.col(id_col).alias("doc_id"), n_tokens(F.col(text_col)).cast("int").alias("n")))
    parts = F.greatest(F.ceil(F.col("n") / F.lit(float(capacity))), F.lit(1)).cast("int")
    items = sized.withColumn("n_parts", parts).withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    tokens = F.least(F.col("n") - F.col("part_no") * capacity, F.lit(capacity))
    items = items.select("doc_id", "part_no", "n_parts", tokens.alias("tokens"), F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(SLICES)).cast("int").alias("slice"))
    by_slice = durable(items.filter("tokens > 0").groupBy("tokens", "slice").agg(F.count(F.lit(1)).alias("n")))
    # at most `capacity` rows, whatever the corpus
    counts = {r.tokens: r.n for r in by_slice.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}
    entries, bin_, used = [], 0, dict.fromkeys(counts, 0)
    for times, take in plan_patterns(counts, capacity, max_docs, cost, rule=rule):
        for size, each in take.items():
            entries.append((size, used[size], used[size] + each * times, each, bin_))
            used[size] += each * times
        bin_ += times
    spark = docs.sparkSession
    # each pattern uses up a size or halves its rest, so entries are bounded by the capacity and the items of a container
    plan = spark.createDataFrame(entries, "tokens int, lo bigint, hi bigint, each bigint, bin bigint")
    offset = F.sum("n").over(W.partitionBy("tokens").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    offsets = by_slice.select("tokens", "slice", F.coalesce(offset, F.lit(0)).alias("offset"))
    ranked = items.withColumn("rn", F.row_number().over(W.partitionBy("tokens", "slice").orderBy("doc_id", "part_no")))
    ranked = ranked.join(offsets, ["tokens", "slice"], "left").withColumn("i", F.col("offset") + F.col("rn") - 1)
    found = ranked.join(F.broadcast(plan.withColumnRenamed("tokens", "size")), (F.col("tokens") == F.col("size")) & (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi")), "left")
    container = F.col("bin") + F.floor((F.col("i") - F.col("lo")) / F.col("each"))
    return found.select("doc_id", "part_no", "n_parts", "tokens", container.cast("bigint").alias("container"))
