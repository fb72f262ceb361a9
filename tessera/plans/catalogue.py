"""All queries of the package, but those of the training-data operators, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import metric_queries, operator_queries, relational_queries, retrieval_queries

MODULES = (retrieval_queries, relational_queries, metric_queries, operator_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_queries.flagship(spark, sf_dir)
