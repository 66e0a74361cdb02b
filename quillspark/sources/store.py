"""Sinks and sources besides plain Parquet: JSON exports of an index, vectors with their model, crawl output and log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.http import log_line
from quillspark.operators.crawl import page_records
from quillspark.operators.index import SearchIndex, load_index, save_index

PARTS = ("docs", "postings", "terms", "stats")


def export_json(index: SearchIndex, folder: str) -> None:
    """The index as JSON lines, a folder per table."""
    for part in PARTS:
        getattr(index, part).write.mode("overwrite").json(f"{folder}/{part}")


def import_json(spark: SparkSession, folder: str) -> SearchIndex:
    kinds = (
        "doc_id bigint, path string, title string, dl int, text string",
        "bucket int, term string, doc_id bigint, tf int, dl int, positions array<int>",
        "term string, df bigint, cf bigint",
        "n_docs bigint, n_tokens bigint, vocabulary bigint, avgdl double",
    )
    return SearchIndex(*(spark.read.schema(k).json(f"{folder}/{p}") for p, k in zip(PARTS, kinds, strict=True)))


def save(index: SearchIndex, folder: str, fmt: str = "parquet") -> None:
    """By format name: parquet or json."""
    writers = {"parquet": save_index, "json": export_json}
    if fmt not in writers:
        raise ValueError(f"unknown index format {fmt!r}")
    writers[fmt](index, folder)


def load(spark: SparkSession, folder: str) -> SearchIndex:
    """Reads what save() wrote, whichever format it was."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/stats")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return import_json(spark, folder) if any(n.endswith(".json") for n in names) else load_index(spark, folder)


def save_vectors(vectors: DataFrame, folder: str, model: str, column: str = "embedding") -> None:
    """Vectors as Parquet with the model's name in the metadata of their column."""
    meta = vectors.withMetadata(column, {"model": model})
    meta.write.mode("overwrite").parquet(folder)


def load_vectors(spark: SparkSession, folder: str, column: str = "embedding", default_model: str = "unknown") -> tuple[DataFrame, str]:
    rows = spark.read.parquet(folder)
    return rows, rows.schema[column].metadata.get("model", default_model)


def write_pages(pages: DataFrame, folder: str) -> None:
    """Crawl output as JSON lines."""
    page_records(pages).write.mode("append").json(folder)


def write_crawl_log(attempts: DataFrame, folder: str) -> None:
    """attempts(ts, url, status, nbytes, elapsed, attempt, error, retry_after) as key=value lines."""
    c = F.col
    line = log_line(c("ts"), c("url"), c("status"), c("nbytes"), c("elapsed"), c("attempt"), c("error"), c("retry_after"))
    attempts.select(line.alias("value")).write.mode("append").text(folder)
