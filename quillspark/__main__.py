"""Command line: python -m quillspark index|search|stats|embed|crawl, by itself or through spark-submit."""

from __future__ import annotations

import argparse
import json
import sys
import time
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

from pyspark.sql import functions as F

from quillspark.engine import Engine
from quillspark.operators.crawl import AGENT, crawl, page_records, paced_fetch
from quillspark.operators.index import build_index
from quillspark.operators.semantic import chunk_documents, embed_chunks, hash_encoder
from quillspark.operators.stats import corpus_stats, top_terms
from quillspark.session import cluster_session
from quillspark.sources.corpus import read_corpus
from quillspark.sources.store import load, load_vectors, save, save_vectors


def http_get(url: str) -> dict:
    """One request, as paced_fetch wants it. A redirect is followed; an error status is an answer."""
    try:
        with urlopen(Request(url, headers={"User-Agent": AGENT}), timeout=10) as r:
            return {"status": r.status, "content_type": r.headers.get("Content-Type"), "final_url": r.url, "body": r.read()}
    except HTTPError as e:
        wait = e.headers.get("Retry-After", "")
        return {"status": e.code, "content_type": e.headers.get("Content-Type"), "final_url": e.url, "body": e.read(), "retry_after": float(wait) if wait.isdigit() else None}
    except URLError as e:
        if isinstance(e.reason, TimeoutError):
            raise e.reason from None
        raise


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="quillspark")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index", help="index a file or folder")
    p.add_argument("corpus")
    p.add_argument("--out", required=True)
    p.add_argument("--format", default="parquet", choices=("parquet", "json"))
    p.add_argument("--limit", type=int)
    p = sub.add_parser("search", help="search an index")
    p.add_argument("index")
    p.add_argument("query")
    p.add_argument("--mode", default="keyword", choices=("boolean", "keyword", "semantic", "hybrid"))
    p.add_argument("--scorer", default="bm25")
    p.add_argument("-k", "--limit", type=int, default=10)
    p.add_argument("--page", type=int, default=1)
    p.add_argument("--vectors")
    p.add_argument("--json", action="store_true")
    p = sub.add_parser("stats", help="words of a corpus")
    p.add_argument("corpus")
    p.add_argument("--top", type=int, default=50)
    p = sub.add_parser("embed", help="chunk an index and write vectors of the built-in hash encoder")
    p.add_argument("index")
    p.add_argument("--out", required=True)
    p = sub.add_parser("crawl", help="fetch pages from seeds and write them as JSON lines")
    p.add_argument("seeds", nargs="+")
    p.add_argument("--out", required=True)
    p.add_argument("--max-pages", type=int, default=500)
    p.add_argument("--min-delay", type=float, default=0.2)
    p.add_argument("--domain", action="append")
    a = top.parse_args(argv)
    spark = cluster_session()
    try:
        if a.command == "index":
            began = time.time()
            docs = read_corpus(spark, a.corpus)
            docs = docs.orderBy("doc_id").limit(a.limit) if a.limit is not None else docs
            save(build_index(docs), a.out, a.format)
            print(f"{load(spark, a.out).stats.first().asDict()} in {time.time() - began:.1f} s")
        elif a.command == "stats":
            docs = read_corpus(spark, a.corpus)
            print(corpus_stats(docs).first().asDict())
            for r in top_terms(docs, a.top).collect():
                print(f"{r.n:>10}  {r.term}")
        elif a.command == "crawl":
            pages = crawl(spark, a.seeds, paced_fetch(http_get, a.min_delay), max_pages=a.max_pages, domains=a.domain)
            page_records(pages).write.mode("overwrite").json(a.out)
            print(f"{spark.read.json(a.out).count() if pages.count() else 0} pages")
        elif a.command == "embed":
            chunks = chunk_documents(load(spark, a.index).docs)
            save_vectors(embed_chunks(chunks, hash_encoder()), a.out, "hash-64")
        else:
            vectors = load_vectors(spark, a.vectors)[0] if a.vectors else None
            engine = Engine(load(spark, a.index), vectors, hash_encoder() if a.vectors else None)
            if a.mode == "boolean":
                ids = engine.ids(a.query)[: a.limit]
                print(json.dumps(ids) if a.json else "\n".join(map(str, ids)))
            else:
                hits = engine.search(a.query, a.mode, a.limit, a.page, a.scorer).hits.orderBy(F.col("rank")).collect()
                for r in hits:
                    print(json.dumps(r.asDict(), ensure_ascii=False) if a.json else f"{r.score:8.4f}  {r.doc_id}  {r.title}\n          {r.snippet}")
    except (ValueError, RuntimeError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
