"""Corpus readers: folders of .txt, .md and .jsonl files as one documents table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.index import dense_ids

#: JSON keys that may hold the text and the id, first match wins (fixed values).
TEXT_KEYS = ("text", "body", "content")
ID_KEYS = ("id", "doc_id")


def text_from_json(line: Column) -> Column:
    """The text of a JSON line: a bare string, or the first key of text, body, content that holds a string; null otherwise.

    A number under such a key is not a text, and an empty string under an earlier key hides later keys.
    """
    v = F.try_parse_json(line)

    def string_at(path: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))

    bare = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.coalesce(bare, *(string_at(f"$.{k}") for k in TEXT_KEYS))


def id_from_json(line: Column, fallback: Column) -> Column:
    """The first non-empty id under id or doc_id; 0, "" and false count as none."""
    v = F.try_parse_json(line)
    found = [F.try_variant_get(v, f"$.{k}", "string") for k in ID_KEYS]
    return F.coalesce(*(F.when(~x.isin("", "0", "false", "0.0"), x) for x in found), fallback)


def numbered_lines(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, line_no, line) of line-oriented files, line_no from 1.

    Lines are counted per file block and shifted by the blocks before, so one huge file is not read by one task.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("o"), F.make_valid_utf8("value").alias("line"))
    inside = raw.withColumn("no", F.row_number().over(W.partitionBy("path", "block").orderBy("o")))
    sizes = raw.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("path", "block", before.alias("before"))
    return inside.join(shifts, ["path", "block"]).select("path", (F.col("no") + F.col("before")).cast("int").alias("line_no"), "line")


def list_files(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("*.txt", "*.md", "*.jsonl")) -> DataFrame:
    """(path, length) of the corpus files, without their contents."""
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", p).load(root).select("path", "length") for p in patterns]
    return reduce(DataFrame.unionByName, parts)


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, ext_id, path, source_line, text) of a file or folder, numbered densely by path and line.

    A .txt or .md file is one document, each non-blank line of a .jsonl file another; bad JSON and empty texts are skipped, the
    line number still counts them. Bytes that are not UTF-8 are replaced. A missing root raises FileNotFoundError.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(root)
    base = fs.makeQualified(path).toString()
    base = base if fs.getFileStatus(path).isDirectory() else base.rpartition("/")[0]

    def relative(p: Column) -> Column:
        plain = F.regexp_replace(F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), r"^file:/+", "/")
        return F.substring(plain, len(base.removeprefix("file:").rstrip("/")) + 2, 1 << 30)

    whole = []
    for pattern in ("*.txt", "*.md"):
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("wholetext", True).text(root)
        whole.append(files.select(relative(F.col("_metadata.file_path")).alias("path"), F.lit(None).cast("int").alias("source_line"), F.make_valid_utf8("value").alias("text")))
    texts = reduce(DataFrame.unionByName, whole).withColumn("ext_id", F.col("path"))
    lines = numbered_lines(spark, root, "*.jsonl").withColumn("path", relative(F.col("path")))
    fallback = F.concat_ws(":", "path", F.col("line_no").cast("string"))
    rows = lines.filter(F.trim("line") != "").select("path", F.col("line_no").alias("source_line"), text_from_json(F.col("line")).alias("text"), id_from_json(F.col("line"), fallback).alias("ext_id"))
    docs = texts.unionByName(rows.filter(F.length("text") > 0)).withColumn("_line", F.coalesce("source_line", F.lit(0)))
    return dense_ids(docs, "path", "_line").select("doc_id", "ext_id", "path", "source_line", "text")


def document_text(docs: DataFrame, doc_id: int) -> DataFrame:
    """The text of one document, its title if it has none."""
    fallback = F.col("title") if "title" in docs.columns else F.lit("")
    return docs.filter(F.col("doc_id") == doc_id).select("doc_id", F.coalesce("text", fallback).alias("text"))


def systematic_sample(rows: DataFrame, by: str, order: str, most: int = 100) -> DataFrame:
    """Every (n // most)-th row per group, at most `most`, in the given order."""
    w = W.partitionBy(by).orderBy(order)
    n = F.count(F.lit(1)).over(W.partitionBy(by))
    numbered = rows.withColumns({"_i": F.row_number().over(w) - 1, "_step": F.greatest(F.floor(n / F.lit(most)), F.lit(1))})
    kept = numbered.filter((F.col("_i") % F.col("_step") == 0) & (F.col("_i") / F.col("_step") < most))
    return kept.drop("_i", "_step")
