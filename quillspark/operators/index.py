"""The inverted index as DataFrames: documents, postings, terms and one row of corpus statistics."""

from __future__ import annotations

import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import title, tokens
from quillspark.session import durable, spread

#: Term buckets, by which stored postings are partitioned.
BUCKETS = 64


def bucket_of(word: str) -> int:
    """The bucket of a word, computed on the driver as the bucket column is in Spark."""
    return zlib.crc32(word.encode()) % BUCKETS


@dataclass(frozen=True)
class SearchIndex:
    """docs(doc_id, path, title, dl, text), postings(bucket, term, doc_id, tf, dl, positions), terms(term, df, cf), stats(n_docs, n_tokens, vocabulary, avgdl).

    Postings carry the length of their document, so scoring needs no join with docs.
    """

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def df(self, term: str) -> int:
        row = self.terms.filter(F.col("term") == term).select("df").first()
        return row.df if row else 0

    def __contains__(self, term: str) -> bool:
        return self.df(term) > 0

    def cached(self) -> SearchIndex:
        """Keep the small parts and the postings at hand for many queries; release() undoes it."""
        for part in (self.docs, self.postings, self.terms, self.stats):
            part.persist()
        return self

    def release(self) -> None:
        for part in (self.docs, self.postings, self.terms, self.stats):
            part.unpersist()

    def __enter__(self) -> SearchIndex:
        return self.cached()

    def __exit__(self, *_: object) -> None:
        self.release()


def _terms_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("tf").cast("bigint")).alias("cf"))


def _stats_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """N counts documents without words too; avgdl is 0.0 for an empty corpus."""
    per_doc = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.col("dl").cast("bigint")), F.lit(0)).alias("n_tokens"))
    per_term = terms.agg(F.count(F.lit(1)).alias("vocabulary"))
    avgdl = F.when(F.col("n_docs") > 0, F.col("n_tokens") / F.col("n_docs")).otherwise(F.lit(0.0))
    return per_doc.crossJoin(F.broadcast(per_term)).withColumn("avgdl", avgdl)


def postings_of(docs: DataFrame, positions: bool = True) -> DataFrame:
    """(bucket, term, doc_id, tf, dl[, positions]) of documents with a `toks` column.

    Words cross the wire once, to their term bucket and a slice of the documents, so that neither a frequent word nor a
    long document makes a heavy task; counting there and storing by bucket need no further exchange.
    """
    words = docs.select("doc_id", F.size("toks").alias("dl"), F.posexplode("toks").alias("pos", "term"))
    # enough slices that a word of a third of all rows still gives no task more than a few times its share
    slices = max(1, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    bucket = (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int")
    words = words.withColumns({"bucket": bucket, "slice": F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int")})
    found = [F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl")]
    if positions:
        found.append(F.sort_array(F.collect_list("pos")).alias("positions"))
    return words.repartition("bucket", "slice").groupBy("bucket", "slice", "term", "doc_id").agg(*found).drop("slice")


def build_index(docs: DataFrame, positions: bool = True, keep_text: bool = True) -> SearchIndex:
    """Index documents(doc_id, text[, path]). Ids must be unique (see duplicate_ids); null texts index as empty ones."""
    path = F.col("path") if "path" in docs.columns else F.lit(None).cast("string")
    stem = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*?)(?:\.[^./]*)?(?:#\d+)?$", 1)
    full = spread(docs).select("doc_id", path.alias("path"), "text", tokens(F.col("text")).alias("toks"))
    kept = full.select("doc_id", "path", title(F.col("text"), stem).alias("title"), F.size("toks").alias("dl"), *(["text"] if keep_text else []))
    postings = postings_of(full, positions)
    terms = _terms_of(postings)
    return SearchIndex(kept, postings, terms, _stats_of(kept, terms))


def duplicate_ids(docs: DataFrame) -> DataFrame:
    """Ids that occur more than once; an index is built from none."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def merge_indexes(*parts: SearchIndex) -> SearchIndex:
    """One index of disjoint parts; ValueError if a doc_id is in two of them."""
    if not parts:
        raise ValueError("nothing to merge")
    docs, postings = parts[0].docs, parts[0].postings
    for part in parts[1:]:
        docs = docs.unionByName(part.docs, allowMissingColumns=True)
        postings = postings.unionByName(part.postings, allowMissingColumns=True)
    if len(parts) > 1 and not duplicate_ids(docs).isEmpty():
        raise ValueError("a document is in more than one part")
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("tf").cast("bigint")).alias("cf"))
    return SearchIndex(docs, postings, terms, _stats_of(docs, terms))


def append_documents(index: SearchIndex, docs: DataFrame) -> SearchIndex:
    """The index with those documents whose id it does not hold yet."""
    new = docs.join(index.docs.select("doc_id"), "doc_id", "left_anti")
    return merge_indexes(index, build_index(new, "positions" in index.postings.columns, "text" in index.docs.columns))


def save_index(index: SearchIndex, folder: str) -> None:
    """Parquet tables; postings are partitioned by term bucket and sorted by (term, doc_id), so that a lookup opens the files of its words' buckets
    and reads few row groups of them."""
    spark = index.docs.sparkSession
    with ThreadPoolExecutor(1) as pool:  # documents are written while the postings are counted
        docs = pool.submit(lambda: index.docs.sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{folder}/docs"))
        # df and cf come from the written postings, which costs a scan of two columns instead of tokenizing again
        index.postings.sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        docs.result()
    terms = _terms_of(spark.read.parquet(f"{folder}/postings"))
    terms.write.mode("overwrite").parquet(f"{folder}/terms")
    _stats_of(spark.read.parquet(f"{folder}/docs"), spark.read.parquet(f"{folder}/terms")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")


def load_index(spark: SparkSession, folder: str) -> SearchIndex:
    return SearchIndex(*(spark.read.parquet(f"{folder}/{part}") for part in ("docs", "postings", "terms", "stats")))


def dense_ids(rows: DataFrame, *order: str, name: str = "doc_id") -> DataFrame:
    """Number rows 0, 1, 2, ... in the given order without bringing them into one task.

    Rows are range-partitioned and sorted by the order, numbered inside their partition, and shifted by the sizes of the partitions before. Rows
    must be distinct in `order` for stable numbers.
    """
    ranged = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    inside = ranged.withColumn("_no", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_part", before.alias("_shift"))
    numbered = inside.join(F.broadcast(shifts), "_part").withColumn(name, (F.col("_shift") + F.col("_no") - 1).cast("bigint"))
    return numbered.drop("_part", "_no", "_shift")
