"""All queries of the library and the SQL that answers the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmesh.plans import check_queries, file_queries, graph_queries, record_queries, retrieval_queries, text_queries, vector_queries  # noqa: F401  they register themselves
from quillmesh.plans.registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_queries.retrieve_documents(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
