"""Console: python -m quillmesh extract FOLDER OUT [--only FORMAT] [--limit N] | build DOCUMENTS.parquet ROOT | search ROOT QUERIES.jsonl RESULTS | ask ROOT 'a question'"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from quillmesh.config import Settings
from quillmesh.operators import validation
from quillmesh.plans.search import Retriever, build
from quillmesh.sources import files, records, sinks


def main(args: list[str]) -> int:
    if len(args) < 3 or args[0] not in ("extract", "build", "search", "ask"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("quillmesh").getOrCreate()
    if args[0] == "extract":
        options = dict(zip(args[3::2], args[4::2], strict=True))
        if not options.keys() <= {"--only", "--limit"}:
            print(__doc__)
            return 2
        limit = options.get("--limit")
        sinks.write_table(files.extract(spark, args[1], only=options.get("--only"), limit=None if limit is None else int(limit)), args[2])
        return 0
    if args[0] == "build":
        build(spark.read.parquet(args[1]), Settings().at(args[2]))
        return 0
    retriever = Retriever(spark, Settings().at(args[1]), use_graph=False, check=True)
    if args[0] == "ask":
        docs, frags = retriever.search(spark.createDataFrame([("q001", args[2])], "qid string, text string"))
        docs.orderBy("rnk").show(truncate=False)
        frags.select("rnk", "chunk_id", "text").orderBy("rnk").show(truncate=120)
        return 0
    queries = records.read_queries(spark, args[2]).select("query_id", "text").withColumnRenamed("query_id", "qid")
    results = sinks.result_objects(*retriever.search(queries)).cache()
    sinks.write_jsonl(results.orderBy("query_id"), args[3], "overwrite")
    found = validation.result_violations(results, queries.count()).where("severity = 'error'")
    found.show(truncate=False)
    return int(not found.isEmpty())


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
