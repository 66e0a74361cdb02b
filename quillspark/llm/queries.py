"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.fuse import fuse_scores
from quillspark.llm.leaks import find_leaks
from quillspark.llm.mainbody import main_lines
from quillspark.llm.neighbours import nearest_by_graph, nearest_exact, similar_pairs
from quillspark.llm.pack import pack_texts
from quillspark.llm.pieces import split_texts
from quillspark.llm.terms import bm25_weight, distinctive_terms, leading_terms, term_frequencies
from quillspark.llm.truncation import find_truncated, truncation_shares
from quillspark.session import table


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return distinctive_terms(table(spark, d, "postings"), table(spark, d, "doc_lengths"), table(spark, d, "docs_meta"))


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return leading_terms(_scored(spark, d), bm25_weight(c("tf"), c("df"), c("dl"), c("n"), c("avgdl")))


def _p1_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).select("doc_id", "term", "tf", "df", "cf", F.round("weight", 6).alias("weight"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))
    return rows.withColumn("place", place).filter("place <= 5")


def _p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(table(spark, d, "postings"), table(spark, d, "docs_meta"))


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2_terms(spark, d).filter("mark is not null").select("term", "mark")


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar_pairs(table(spark, d, "chunks"))
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b")).distinct()


def _p3_search(spark: SparkSession, d: str) -> DataFrame:
    """Ten most alike for every chunk whose id is divisible by 100, against all chunks of its model, by greedy search on the neighbour graph."""
    hits = nearest_by_graph(table(spark, d, "chunks"), "id % 100 = 0", 10)
    return hits.select(F.col("id").alias("chunk_id"), "model", F.col("near").alias("near_id"), "place", F.round("sim", 6).alias("similarity"))


def recall_at(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(model, asked, recall) of (id, model, near, sim): the share of the true places that were reached; a tie with the last place counts."""
    keys = ["id", "model"]
    found, exact = (df.withColumn("model", F.struct("model")) for df in (found, exact))  # a null model is one too
    last = exact.groupBy(*keys).agg(F.min("sim").alias("last"), F.count(F.lit(1)).alias("of"))
    good = found.join(last, keys).groupBy(*keys).agg(F.count_if(F.col("sim") >= F.col("last") - 1e-6).alias("good"))
    per = last.join(good, keys, "left").withColumn("good", F.least(F.coalesce("good", F.lit(0)), "of"))
    return per.groupBy("model.model").agg(F.count(F.lit(1)).alias("asked"), (F.sum("good") / F.sum("of")).alias("recall"))


def _p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether p3_search reaches nine in ten of the true places, per model, by brute force over all chunks."""
    chunks = table(spark, d, "chunks")
    recall = recall_at(nearest_by_graph(chunks, "id % 100 = 0", 10), nearest_exact(chunks, "id % 100 = 0", 10))
    return recall.select("model", "asked", (F.col("recall") >= 0.9).alias("reached"))


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    return main_lines(table(spark, d, "pages"), with_text=False)


def _p4_bodies(spark: SparkSession, d: str) -> DataFrame:
    lines = main_lines(table(spark, d, "pages"))
    kept = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("page_no").agg(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("body"))


def _p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fuse_scores(table(spark, d, "search_hits"), by="score").select("query_id", "doc_id", F.round("fused", 6).alias("fused"), "n_lists")


def _p6_spread(spark: SparkSession, d: str) -> DataFrame:
    """p6_ranking with every list spread over tasks, as lists are that no task holds."""
    return fuse_scores(table(spark, d, "search_hits"), by="score", task_rows=0).select("query_id", "doc_id", F.round("fused", 6).alias("fused"), "n_lists", "place")


def _p6_found(spark: SparkSession, d: str) -> DataFrame:
    return fuse_scores(table(spark, d, "search_hits")).filter("place <= 5").select("query_id", "doc_id")


def _p7_found(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(table(spark, d, "documents"), with_text=False).filter("piece_no = 0").select("doc_id", "kind")


def _p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(table(spark, d, "documents"))


def _p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per text that was cut: whether every piece keeps the limit, consecutive ones share at most the overlap, and all of them are the text."""
    pieces = split_texts(table(spark, d, "documents"), with_text=False)
    before = F.lag("end").over(W.partitionBy("doc_id").orderBy("piece_no"))
    pieces = pieces.withColumn("shared", F.when(F.col("piece_no") > 0, before - F.col("start")))
    found = pieces.groupBy("doc_id").agg(
        F.max("end").cast("bigint").alias("n_chars"), (F.max(F.col("end") - F.col("start")) <= 2000).alias("within_limit"), (F.coalesce(F.max("shared"), F.lit(0)) <= 200).alias("within_overlap"),
        ((F.coalesce(F.min("shared"), F.lit(0)) >= 0) & (F.min("start") == 0)).alias("nothing_missing"),
    )
    return found


def _p8_found(spark: SparkSession, d: str) -> DataFrame:
    packed = pack_texts(table(spark, d, "documents"))
    return packed.filter("part_no = 0 and n_parts > 1 and container is not null").select("doc_id")


def _p8_containers(spark: SparkSession, d: str) -> DataFrame:
    packed = pack_texts(table(spark, d, "documents")).filter("container is not null")
    return packed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))


#: A packing under all three capacities: tokens, documents, and attention cost below that of one full container.
TIGHT = {"capacity": 1024, "max_docs": 8, "max_cost": 0.5 * 1024**2}


def _p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Of the plain packing and one under tight capacities: tokens and items in containers, containers over a capacity, whether few are wasted."""
    found = []
    for name, limits in (("plain", {}), ("tight", TIGHT)):
        items = pack_texts(table(spark, d, "documents"), **limits).filter("container is not null")
        cost = F.sum(F.col("tokens").cast("double") * F.col("tokens"))
        bins = items.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"), cost.alias("cost"))
        over = (F.col("tokens") > 1024) | (F.col("items") > limits.get("max_docs", 256)) | ((F.col("cost") > limits.get("max_cost", 1024.0**2)) & (F.col("items") > 1))
        few = F.count(F.lit(1)) <= 1.02 * F.greatest(F.sum("tokens") / 1024, F.sum("items") / limits.get("max_docs", 256)) + 1
        few = few if name == "plain" else F.lit(True)
        found.append(bins.agg(F.sum("tokens").alias("tokens"), F.sum("items").alias("items"), F.count_if(over).alias("over"), few.alias("few")).withColumn("packing", F.lit(name)))
    return found[0].unionByName(found[1])


def _p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def _p9_items(spark: SparkSession, d: str) -> DataFrame:
    found = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("score").alias("longest"))


def _p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_truncated(table(spark, d, "documents")).filter("truncated").select("doc_id")


def _p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation_shares(find_truncated(table(spark, d, "documents")))


QUERIES = {
    "p1_found": _p1_found,
    "p1_terms": _p1_terms,
    "p2_found": _p2_found,
    "p2_terms": _p2_terms,
    "p3_found": _p3_found,
    "p3_search": _p3_search,
    "p3_recall": _p3_recall,
    "p4_found": _p4_found,
    "p4_bodies": _p4_bodies,
    "p6_found": _p6_found,
    "p6_ranking": _p6_ranking,
    "p6_spread": _p6_spread,
    "p7_found": _p7_found,
    "p7_pieces": _p7_pieces,
    "p7_invariants": _p7_invariants,
    "p8_found": _p8_found,
    "p8_invariants": _p8_invariants,
    "p8_containers": _p8_containers,
    "p9_found": _p9_found,
    "p9_items": _p9_items,
    "p10_found": _p10_found,
    "p10_shares": _p10_shares,
}
