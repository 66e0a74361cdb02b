"""Incremental indexing of documents as they arrive, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillspark.functions.text import title, tokens
from quillspark.operators.index import SearchIndex, _stats_of, _terms_of, postings_of


def index_stream(docs: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append arriving documents(doc_id, text) to docs and postings tables under `folder`.

    A document whose id is stored already is skipped, so replayed or repeated input changes nothing; within a batch the
    first text by content order wins. Each batch writes a partition named by its number, overwritten if the batch is run again after a failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("doc_id").agg(F.min("text").alias("text"))
        stored = _read(spark, f"{folder}/docs")
        if stored is not None:
            new = new.join(stored.filter(F.col("batch") != number).select("doc_id"), "doc_id", "left_anti")
        full = new.withColumn("toks", tokens(F.col("text"))).persist()
        try:
            kept = full.select("doc_id", F.lit(None).cast("string").alias("path"), title(F.col("text")).alias("title"), F.size("toks").alias("dl"), "text")
            # postings first: a document counts as stored once its row in docs exists
            postings_of(full).sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/batch={number}")
            kept.write.mode("overwrite").parquet(f"{folder}/docs/batch={number}")
        finally:
            full.unpersist()

    stream = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()


def _read(spark: SparkSession, folder: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(folder) if fs.exists(path) else None


def streamed_index(spark: SparkSession, folder: str) -> SearchIndex:
    """The index over everything streamed so far; terms and statistics are aggregated on reading.

    Batches stay apart, each with its postings by bucket. save_index of this index compacts them: one table by bucket, with terms and statistics.
    """
    docs, postings = (spark.read.parquet(f"{folder}/{p}").drop("batch") for p in ("docs", "postings"))
    terms = _terms_of(postings)
    return SearchIndex(docs, postings, terms, _stats_of(docs, terms))
