"""Per-key totals and exact quantiles when a few keys own most rows.

Distributed exact selection. Every key gets a histogram of its values: (key, bucket) -> rows, sum,
smallest, largest. Histograms are mergeable, so map tasks combine them before the exchange and a hot key
costs a few hundred rows there, however many it owns. Totals are read from the histograms directly.
For a quantile, the bucket that holds the wanted rank is found by cumulating counts; where that bucket
still spans several values, only its range is counted again with a finer histogram, until every rank
falls into a bucket of a single value. The values of a key are never gathered anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.session import broadcast_if_small, durable

#: Finer buckets per refinement; each round narrows a range at least this much unless values are crowded.
FINE = 256
#: Whole values below this have a bucket each from the start.
ALONE = 1024


def _coarse(v: Column) -> Column:
    """A monotone bucket number: whole values up to ALONE in buckets of their own, beyond that eight per doubling."""
    far = F.floor(F.log2(F.abs(v) / float(ALONE)) * 8).cast("int") + ALONE
    return F.when(F.abs(v) < ALONE, F.floor(v).cast("int")).when(v > 0, far).otherwise(-far - 1)


def _summed(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def key_histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, bucket, n, s, lo, hi) plus one row per key with bucket null for its rows without a value.

    NaN and infinite values count as missing. Whole-number columns keep exact 64-bit sums.
    """
    whole = df.schema[value].dataType.typeName() in ("byte", "short", "integer", "long")
    v = F.col(value).cast("bigint" if whole else "double")
    if not whole:
        v = F.when(F.abs(v) < float("inf"), v)
    # a fresh projection: extra columns of the input, clashing names included, end here
    rows = df.select(F.col(key).alias("k"), v.alias("v")).withColumn("b", _coarse(F.col("v")))
    return rows.groupBy("k", "b").agg(
        F.count(F.lit(1)).alias("rows"), F.count("v").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )


def _locate(hist: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bucket of each (key, q) whose cumulated count first reaches the rank; rank becomes the rank inside it."""
    cum = hist.withColumn("upto", F.sum("n").over(W.partitionBy("k", "q").orderBy("b").rowsBetween(W.unboundedPreceding, 0)))
    at = cum.join(wanted.select(F.col("k").alias("wk"), F.col("q").alias("wq"), "rank"), F.col("k").eqNullSafe(F.col("wk")) & (F.col("q") == F.col("wq")))
    at = at.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return at.select("k", "q", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "lo", "hi")


def _totals(hist: DataFrame) -> DataFrame:
    return hist.groupBy("k").agg(
        F.sum("rows").alias("n_rows"),
        F.sum("n").alias("n_values"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("total"),
        F.min("lo").alias("smallest"),
        F.max("hi").alias("largest"),
    )


def key_profile(df: DataFrame, key: str, value: str, quantiles: tuple[float, ...] = (0.5,), max_rounds: int = 64) -> DataFrame:
    """One row per key: n_rows, n_values, total, smallest, largest and q<percent> per quantile, all exact.

    The quantile q of n values is the smallest value with at least ceil(q*n) values at or below it
    (q = 0 gives the smallest). Null, NaN and infinite values count in n_rows only; a key without any value has total 0
    and null quantiles. Rows with a null key form one group under the null key. An empty table gives
    an empty result. Repeated rows count as often as they occur; ties share their value. The key column
    keeps its name and type; other columns of the input are ignored, whatever their names.
    """
    for q in quantiles:
        if not 0 <= q <= 1:
            raise ValueError("quantiles lie in [0, 1]")
    hist = key_histogram(df, key, value)
    if quantiles:
        hist = durable(hist)
    totals = _totals(hist)
    out = totals.withColumnRenamed("k", key)
    if not quantiles:
        return out

    name = {q: f"q{q * 100:.10g}".replace(".", "_") for q in quantiles}
    ranks = {name[q]: F.greatest(F.ceil(F.lit(float(q)) * F.col("n_values")), F.lit(1)) for q in quantiles}
    values = _select(df, key, value, hist, totals, ranks, max_rounds)
    joined = out.join(values, F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.select(*out.columns, *ranks)


def _select(df: DataFrame, key: str, value: str, hist: DataFrame, totals: DataFrame, ranks: dict[str, Column], max_rounds: int = 64) -> DataFrame:
    """(_k, one column per name): the value at each rank, counted from 1, of every key. Ranks are expressions of n_values."""
    qs = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), r.cast("bigint").alias("rank")) for q, r in ranks.items()])).alias("w")
    wanted = totals.filter("n_values > 0").select("k", qs).select("k", "w.q", "w.rank")
    qs = F.explode(F.array(*[F.lit(q) for q in ranks])).alias("q")
    state = durable(_locate(hist.filter("b is not null").select("*", qs), wanted))
    found = [state.filter("lo = hi")]
    open_ = state.filter("lo < hi")
    rounds = 0
    rows = df.select(F.col(key).alias("rk"), F.col(value).cast(totals.schema["smallest"].dataType).alias("v"))
    while not open_.isEmpty():
        if (rounds := rounds + 1) > max_rounds:
            raise RuntimeError("quantiles did not resolve; values crowd below the resolution of their type")
        spans = open_.select("k", "q", "lo", "hi")
        near = rows.join(broadcast_if_small(spans, 64), F.col("rk").eqNullSafe(F.col("k")) & F.col("v").between(F.col("lo"), F.col("hi")))
        # lo falls into bucket 0 and hi into the last one, so each round splits every open range
        part = (F.col("v").cast("double") - F.col("lo").cast("double")) / (F.col("hi").cast("double") - F.col("lo").cast("double"))
        b = F.when(F.col("v") == F.col("hi"), F.lit(FINE)).otherwise(F.least(F.floor(part * FINE), F.lit(FINE - 1))).cast("int")
        state = durable(_locate(_summed(near.withColumn("b", b), "k", "q", "b"), open_))
        found.append(state.filter("lo = hi"))
        open_ = state.filter("lo < hi")
    return reduce(DataFrame.unionByName, found).groupBy(F.col("k").alias("_k")).agg(*[F.max(F.when(F.col("q") == q, F.col("lo"))).alias(q) for q in ranks])


def total_before(rows: DataFrame, keys: list[str], order: list[Column], weight: Column | None = None, name: str = "before") -> DataFrame:
    """Adds `name`: the sum of `weight` (default 1, which makes it the place from 0) over the rows of the same keys that come earlier.

    Rows are range-partitioned by keys and order, so a key of many rows spreads over several tasks; each task sums its part of a
    key, and the parts before are added from a table of one row per key and task. Keys must not be null, and the order must be total within a key.
    """
    weight = F.lit(1) if weight is None else weight
    ranged = durable(rows.withColumn("_w", weight).repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id()))
    inside = F.coalesce(F.sum("_w").over(W.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = ranged.groupBy(*keys, "_pid").agg(F.sum("_w").alias("_s"))
    shift = F.coalesce(F.sum("_s").over(W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = sums.select(*keys, "_pid", shift.alias("_shift"))
    return ranged.withColumn("_in", inside).join(shifts, [*keys, "_pid"]).withColumn(name, F.col("_shift") + F.col("_in")).drop("_w", "_pid", "_in", "_shift")


def exact_medians(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys..., name): the median per key, the mean of the middle two for an even count, selected by rank."""
    packed = rows.select(F.struct(*keys).alias("_key"), value)
    hist = durable(key_histogram(packed, "_key", value))
    n = F.col("n_values")
    both = _select(packed, "_key", value, hist, _totals(hist), {"lower": F.floor((n + 1) / 2), "upper": F.floor(n / 2) + 1})
    return both.select("_k.*", ((F.col("lower") + F.col("upper")) / 2.0).alias(name))
