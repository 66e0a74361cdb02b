"""Term statistics over an index: how distinctive a term is per document, and how frequent each term is.

Both read posting rows once and exchange them once, on (folded term, slice of the documents): the slice
keeps a term that occurs everywhere from landing in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import fold
from quillspark.operators.postings import document_lengths, latest_postings
from quillspark.session import small_enough

#: Slices that the rows of one term are spread over.
SLICES = 64


def _folded_postings(postings: DataFrame) -> DataFrame:
    """(term, slice, doc_id, tf): tf summed per folded term and document, clustered by (term, slice)."""
    rows = postings.filter(F.col("term").isNotNull() & F.col("doc_id").isNotNull())
    # both keys are never null by construction, so the two uses of the exchange plan alike and Spark runs it once
    extra = {"folded": F.coalesce(fold(F.col("term")), F.lit("")), "slice": F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int"), F.lit(0))}
    latest = latest_postings(rows, cluster_by=["folded", "slice"], extra=extra)
    summed = latest.groupBy("folded", "slice", "doc_id").agg(F.coalesce(F.sum(F.col("tf").cast("bigint")), F.lit(0)).alias("tf"))
    return summed.filter("tf > 0").withColumnRenamed("folded", "term")


def dfr_weight(tf: Column, dl: Column, n: Column, cf: Column, avgdl: Column, c: float = 1.0) -> Column:
    """Divergence from randomness: geometric collection model, Laplace gain, normalised term frequency.

    tfn = tf * log2(1 + c*avgdl/dl); with mean lambda = cf/n occurrences per document, the information of
    tfn occurrences is -log2(1/(1+lambda)) - tfn*log2(lambda/(1+lambda)); Laplace's after-effect leaves
    1/(tfn+1) of it as gain. A document without a recorded length counts as one of average length.
    """
    length = F.when(dl > 0, dl.cast("double")).otherwise(avgdl)
    tfn = tf * F.when(avgdl > 0, F.log2(1 + c * avgdl / length)).otherwise(F.lit(1.0))
    lam = cf / n
    return (F.log2(1 + lam) + tfn * F.log2((1 + lam) / lam)) / (tfn + 1)


def bm25_weight(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return F.when(avgdl > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))).otherwise(F.lit(0.0))


def distinctive_terms(postings: DataFrame, doc_lengths: DataFrame, docs_meta: DataFrame, c: float = 1.0) -> DataFrame:
    """(doc_id, term, tf, df, cf, dl, n, avgdl, weight): every term of every document with its DFR weight.

    Rows with a null term or doc_id are skipped, counts of 0 hold no term, null or missing lengths count
    as 0 (see dfr_weight). Repeated and superseded rows are resolved first. Ties keep equal weights: all
    rows come out, ordering is the caller's. Empty postings give an empty result. Other columns of the inputs are ignored.
    """
    held = _folded_postings(postings)
    per_slice = held.groupBy("term", "slice").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    totals = per_slice.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.collect_list("slice").alias("slices"))
    # totals go back to just the slices that hold the term: the large side stays where the exchange put it
    back = totals.select("term", F.explode("slices").alias("slice"), "df", "cf").hint("shuffle_hash")
    lens = document_lengths(doc_lengths).filter("doc_id is not null")
    size = docs_meta.agg(F.count(F.lit(1)).alias("n")).crossJoin(lens.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")))
    scalars = size.select("n", F.when(F.col("n") > 0, F.col("tokens") / F.col("n")).otherwise(F.lit(0.0)).alias("avgdl"))
    # summed, a document has one row per term at most and is hot no more: lengths too many for a broadcast are sent once and meet
    # the rows in one exchange on doc_id, after which groupings per document need none
    lens = F.broadcast(lens) if small_enough(lens, 48) else lens.hint("shuffle_hash")
    rows = held.join(back, ["term", "slice"]).join(lens, "doc_id", "left").crossJoin(F.broadcast(scalars))
    rows = rows.withColumns({"dl": F.coalesce("dl", F.lit(0)), "n": F.greatest("n", F.lit(1))})
    col = F.col
    return rows.select("doc_id", "term", "tf", "df", "cf", "dl", "n", "avgdl", dfr_weight(col("tf"), col("dl"), col("n"), col("cf"), col("avgdl"), c).alias("weight"))


def leading_terms(scored: DataFrame, weight: Column, ratio: float = 1.2) -> DataFrame:
    """(doc_id, term): the term of the highest weight where it is at least `ratio` times the runner-up's.

    Documents with one term have no runner-up and do not come out. Each task keeps just two rows per document before
    the exchange, so a hot document costs the exchange a handful of rows.
    """
    rows = scored.select("doc_id", "term", weight.alias("w"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("w")))
    two = rows.withColumn("place", place).filter("place <= 2")
    best = two.groupBy("doc_id").agg(F.max_by("term", "w").alias("term"), F.max("w").alias("first"), F.min("w").alias("second"), F.count(F.lit(1)).alias("held"))
    return best.filter((F.col("held") > 1) & (F.col("first") >= ratio * F.col("second"))).select("doc_id", "term")


def term_frequencies(postings: DataFrame, docs_meta: DataFrame, rare: int = 2, common: float = 0.2) -> DataFrame:
    """(term, tf, df, mark): total tf and document frequency of every folded term.

    Vertical layout: the identifiers of a term's documents are kept as a sparse bitmap, one 64-bit word per
    64 neighbouring ids that hold the term, beside a counter of occurrences. Bitmaps merge by OR, counters by
    addition, both before the exchange; df is the number of set bits. mark is `rare` for df <= rare, `common` for
    df >= common * rows of docs_meta (rare wins if both), else null. Rows with a null term or doc_id are
    skipped; ids may be negative; counts of 0 hold no term; empty postings give an empty result.
    """
    rows = postings.filter(F.col("term").isNotNull() & F.col("doc_id").isNotNull())
    extra = {"folded": fold(F.col("term")), "word": F.shiftright("doc_id", 6)}
    latest = latest_postings(rows, cluster_by=["folded", "word"], extra=extra).filter("tf > 0")
    bit = F.expr("shiftleft(1L, cast(doc_id & 63 as int))")
    words = latest.groupBy("folded", "word").agg(F.bit_or(bit).alias("bits"), F.sum(F.col("tf").cast("bigint")).alias("tf"))
    terms = words.groupBy(F.col("folded").alias("term")).agg(F.sum("tf").alias("tf"), F.sum(F.bit_count("bits")).cast("bigint").alias("df"))
    n = docs_meta.agg(F.count(F.lit(1)).alias("n"))
    mark = F.when(F.col("df") <= rare, "rare").when(F.col("df") >= common * F.col("n"), "common")
    return terms.crossJoin(F.broadcast(n)).select("term", "tf", "df", mark.alias("mark"))
