from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.__main__ import main
from quillspark.operators import semantic, stats
from quillspark.operators.match import boolean_search
from quillspark.operators.rank import top
from quillspark.sources.corpus import list_files, read_corpus, systematic_sample
from quillspark.sources.store import load_vectors, save_vectors, write_crawl_log
from quillspark.streaming.ingest import index_stream, streamed_index


def test_folder(spark, tmp_path):
    (tmp_path / "notes" / "old").mkdir(parents=True)
    (tmp_path / "harbour.txt").write_text("grey heron", encoding="utf-8")
    (tmp_path / "notes" / "old" / "low tide+1.md").write_bytes(b"th\xe9 blue boat")
    (tmp_path / "cover.png").write_text("no")
    lines = [{"text": "first"}, "[1, 2", {"id": "k7", "content": "second"}, {"doc_id": "k8", "text": "third"}, {"body": ""}, {"text": 5, "body": "fourth"}, {"id": 0, "content": "fifth"}]
    (tmp_path / "letters.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + '\n\n"plain"\n')
    got = [(r.doc_id, r.ext_id, r.path, r.source_line, r.text) for r in read_corpus(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [
        (0, "harbour.txt", "harbour.txt", None, "grey heron"),
        (1, "letters.jsonl:1", "letters.jsonl", 1, "first"),
        (2, "k7", "letters.jsonl", 3, "second"),
        (3, "k8", "letters.jsonl", 4, "third"),
        (4, "letters.jsonl:6", "letters.jsonl", 6, "fourth"),
        (5, "letters.jsonl:7", "letters.jsonl", 7, "fifth"),
        (6, "letters.jsonl:9", "letters.jsonl", 9, "plain"),
        (7, "notes/old/low tide+1.md", "notes/old/low tide+1.md", None, "th\ufffd blue boat"),
    ]
    assert list_files(spark, str(tmp_path)).count() == 3
    with pytest.raises(FileNotFoundError):
        read_corpus(spark, str(tmp_path / "missing"))


def test_systematic_sample(spark, rows):
    data = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    got = rows(systematic_sample(data, "g", "id", 100).filter("g = 0").select("id"))
    assert len(got) == 100 and {i for (i,) in got} == {10 * k for k in range(100)}


def test_statistics(spark, corpus, rows):
    docs = corpus("b a a", "", None, "c b")
    assert rows(stats.corpus_stats(docs)) == [(4, 5, 3)]
    assert [tuple(r) for r in stats.top_terms(docs, 2).collect()] == [("a", 2), ("b", 2)]
    hits = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, True)], "query_id int, rank int, good boolean")
    per_query = stats.precision_at_k(hits, F.col("good"), 5)
    assert rows(per_query) == [(1, 0.2), (2, 0.2)] and rows(stats.macro_precision(per_query)) == [(0.2,)]


def test_semantic(spark, corpus, tmp_path):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.2, 0.9]), (1, [0.0, 1.0]), (2, None)], "doc_id bigint, embedding array<float>")
    got = [(r.doc_id, r.score) for r in top(semantic.semantic_scores(vectors, [1.0, 0.0]), 5).orderBy("rank").collect()]
    assert got == [(0, 1.0), (1, 0.0)]
    a, b = (spark.createDataFrame([(d, i + 1) for i, d in enumerate(x)], "doc_id bigint, rank int") for x in ([0, 1, 2], [1, 2, 0]))
    fused = [(r.doc_id, r.score) for r in top(semantic.reciprocal_rank_fusion(a, b), 3).orderBy("rank").collect()]
    assert fused == [(1, 0.032522), (0, 0.032266), (2, 0.032002)]
    chunks = semantic.embed_chunks(semantic.chunk_documents(corpus("alpha beta", "", "gamma")), semantic.hash_encoder(4))
    assert {r.doc_id: round(float(np.linalg.norm(r.embedding)), 5) for r in chunks.collect()} == {0: 1.0, 2: 1.0}
    save_vectors(chunks, str(tmp_path / "v"), "hash-4")
    back, model = load_vectors(spark, str(tmp_path / "v"))
    assert model == "hash-4" and back.count() == 2


def test_stream(spark, tmp_path):
    schema = "doc_id bigint, text string"
    for i, rows_ in enumerate(([(1, "red cat"), (2, "blue")], [(2, "changed"), (3, "red dog")])):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        index_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert streamed_index(spark, str(tmp_path / "out")).stats.first().n_docs == 2 + i
    index = streamed_index(spark, str(tmp_path / "out"))
    assert [r.doc_id for r in boolean_search(index, "red").collect()] == [1, 3]
    assert boolean_search(index, "changed").count() == 0


def test_crawl_log(spark, tmp_path):
    attempts = spark.createDataFrame([("t", "u", None, 3, 0.25, 1, "timeout", 2.0)], "ts string, url string, status int, nbytes bigint, elapsed double, attempt int, error string, retry_after double")
    write_crawl_log(attempts, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).first().value == "ts=t url=u status=- bytes=3 elapsed=0.250 attempt=1 error=timeout retry_after=2.000"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("red cat sat")
    (tmp_path / "b.txt").write_text("blue cat")
    index = str(tmp_path / "index")
    assert main(["index", str(tmp_path), "--out", index]) == 0
    assert main(["search", index, "cat OR red", "--json"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[1])["doc_id"] == 0
    assert main(["search", index, "cat NOT red", "--mode", "boolean"]) == 0
    assert main(["stats", str(tmp_path / "a.txt")]) == 0
    assert main(["search", index, "a AND"]) == 1
