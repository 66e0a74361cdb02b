"""Reading raw posting rows as they were sent: resent rows, superseded versions, missing counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_postings(rows: DataFrame, *, cluster_by: list | None = None, extra: dict | None = None) -> DataFrame:
    """One row per (partial_no, term, doc_id): the tf of the latest built_at.

    tf is `tf`, or the number of positions where tf is null; null when both are missing. Rows with
    a null built_at lose to any dated row. Null key parts group with each other. Rows with equal times agree
    by contract; should they disagree, any one of them is taken. `extra` adds columns that follow from the
    key (a folded term, a salt); with `cluster_by`, names of such columns or of key columns, the rows
    are exchanged once on those, and later groupings on any superset of them need no further exchange.
    """
    extra = extra or {}
    keys = ["partial_no", "term", "doc_id"]
    out = rows.select(
        *keys,
        F.coalesce("tf", F.array_size("positions")).alias("tf"),
        F.coalesce(F.unix_micros("built_at"), F.lit(-(2**62))).alias("at"),
    )
    for name, col in extra.items():
        out = out.withColumn(name, col)
    if cluster_by:
        out = out.repartition(*cluster_by)
    # over two plain numbers max_by stays in a hash aggregate
    return out.groupBy(*keys, *extra).agg(F.max_by("tf", "at").alias("tf"))


def document_lengths(doc_lengths: DataFrame) -> DataFrame:
    """(doc_id, dl): the sum of dl over a document's distinct rows; null counts as 0."""
    return (
        doc_lengths.select("partial_no", "doc_id", "dl")
        .distinct()
        .groupBy("doc_id")
        .agg(F.coalesce(F.sum(F.col("dl").cast("bigint")), F.lit(0)).alias("dl"))
    )
