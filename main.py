"""Search indexed Word files for the sources of query documents.

    python main.py FOLDER QUERIES.parquet [--index STORE] [--threshold 100] [--max-candidates 5] [--fast] [--front-page-only]

QUERIES holds rows with query_id and the document columns of tracewell.schema
(tracewell.sources.files.page_documents makes them from parsed pages). The index
is kept in STORE (by default beside FOLDER) and opens only new and changed files.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewell.operators.store import keep_longest
from tracewell.plans import search as P
from tracewell.plans.indexing import refresh


def main() -> None:
    a = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("folder")
    a.add_argument("queries")
    a.add_argument("--index")
    a.add_argument("--threshold", type=float, default=100.0)
    a.add_argument("--max-candidates", type=int, default=5)
    a.add_argument("--fast", action="store_true")
    a.add_argument("--front-page-only", action="store_true")
    args = a.parse_args()
    spark = SparkSession.builder.appName("tracewell").getOrCreate()
    store = args.index or args.folder.rstrip("/") + ".index"
    documents = refresh(spark, args.folder, store, progress=lambda done, total, message: print(f"{message}: {done} of {total}"))
    corpus = keep_longest(documents).withColumn("doc_id", F.xxhash64("filepath"))
    found = P.search(spark.read.parquet(args.queries), corpus, compare_all=not args.fast, max_candidates=args.max_candidates).persist()
    hits = P.accepted(found, args.threshold, args.front_page_only)
    lines = P.report(hits).join(P.details(hits), ["query_id", "doc_id"]).join(hits.select("query_id", "doc_id", "overall_score"), ["query_id", "doc_id"])
    for r in lines.orderBy("query_id", F.desc("overall_score")).toLocalIterator():
        print(f"[{r['query_id']}] {r['line']}\n   " + r["details"].replace("\n", "\n   "))
    for r in P.rejections(found).orderBy("query_id", "line").toLocalIterator():
        print(f"[{r['query_id']}] rejected - {r['line']}")


if __name__ == "__main__":
    main()
