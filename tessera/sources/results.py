"""Search results and metrics as tables: wide and long rankings, flattened metric payloads, manifests."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RANK = re.compile(r"rank_(\d+)_sample_id$")


def to_wide(hits: DataFrame, depth: int) -> DataFrame:
    """One row per query: query_sample_id, rank_1_sample_id, rank_1_score, ... up to depth."""
    wide = hits.groupBy(F.col("query_id").alias("query_sample_id")).pivot("rank", list(range(1, depth + 1))).agg(F.first("sample_id").alias("sample_id"), F.first("score").alias("score"))
    return wide.select("query_sample_id", *(F.col(f"{i}_{c}").alias(f"rank_{i}_{c}") for i in range(1, depth + 1) for c in ("sample_id", "score")))


def to_long(wide: DataFrame) -> DataFrame:
    """hits from a wide ranking: null and empty ids are no hits, a missing score is 0."""
    ranks = sorted(int(m[1]) for c in wide.columns if (m := _RANK.match(c)))
    if not ranks:
        raise ValueError("no rank_N_sample_id column")
    score = lambda i: F.coalesce(F.col(f"rank_{i}_score").cast("double"), F.lit(0.0)) if f"rank_{i}_score" in wide.columns else F.lit(0.0)
    each = F.array(*(F.struct(F.lit(i).alias("rank"), F.nullif(F.col(f"rank_{i}_sample_id").cast("string"), F.lit("")).alias("sample_id"), score(i).alias("score")) for i in ranks))
    return wide.select(F.col("query_sample_id").alias("query_id"), F.inline(each)).where("sample_id IS NOT NULL")


def read(spark: SparkSession, path: str) -> DataFrame:
    """hits from a CSV of wide results."""
    return to_long(spark.read.csv(path, header=True))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """metric, scope, label, value rows as one CSV table."""
    metrics.select("metric", "scope", "label", "value").write.csv(path, header=True)


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """One JSON row; nested values stay nested."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").write.text(path)
