"""The driver's tables as bag data: tiles, annotations, single-vector items, predictions, survival rows, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tiles in a slide, and in a row of its grid; the side of a tile in pixels.
PER_SLIDE, PER_ROW, SIDE = 8, 4, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    no, idx = F.expr(f"vec_id div {PER_SLIDE}"), F.expr(f"vec_id % {PER_SLIDE}")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("S"), no).alias("slide"), no.alias("slide_no"), idx.cast("int").alias("tile_idx"),
        (SIDE * (idx % PER_ROW)).cast("int").alias("x0"), F.expr(f"int({SIDE} * ((vec_id % {PER_SLIDE}) div {PER_ROW}))").alias("y0"),
        "vec_id", "label", F.col("embedding").alias("vec"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per slide; its category is the label of its first tile."""
    first = table(spark, sf_dir, "embeddings").groupBy(F.expr(f"vec_id div {PER_SLIDE}").alias("slide_no")).agg(F.min_by("label", "vec_id").alias("label"))
    return first.select(
        F.when(F.col("slide_no") % 4 != 0, "ref_ds").otherwise("query_ds").alias("dataset"), F.concat(F.lit("S"), "slide_no").alias("slide"),
        F.concat(F.lit("C"), "slide_no").alias("case"), F.concat(F.lit("P"), F.expr("slide_no div 2")).alias("patient"),
        F.concat(F.lit("L"), "label").alias("category"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One single-vector item per embedding; five items share a patient."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("I"), "vec_id").alias("sample_id"), F.concat(F.lit("P"), F.expr("vec_id div 5")).alias("patient"),
        F.concat(F.lit("L"), "label").alias("category"), (F.col("vec_id") % 10 == 0).alias("is_query"), F.array("embedding").alias("vecs"),
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary truth y and probability p."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.round(F.col("l_discount").cast("double") * 10, 6).alias("p"))


def regressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth y and prediction yhat."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("price"))
    rows = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_extendedprice").cast("double").alias("y"), (F.col("l_quantity").cast("double") * F.col("price")).alias("yhat"))


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subject per customer with orders: follow-up time in days, event, risk."""
    orders = table(spark, sf_dir, "orders")
    first = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min_by(F.struct("o_orderdate", "o_orderstatus", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return first.select(
        "id", F.datediff(F.col("o.o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double").alias("time"),
        (F.col("o.o_orderstatus") == "F").cast("int").alias("event"), F.col("o.o_totalprice").cast("double").alias("risk"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One benchmark run per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_index"), F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "click", "complete").otherwise("failed").alias("status"),
        F.col("value").cast("double").alias("objective_value"), F.col("event_type").alias("error"),
    )


#: The same views as DuckDB common table expressions.
SQL = {
    "tiles": f"tiles AS (SELECT 'S' || (vec_id // {PER_SLIDE}) AS slide, vec_id // {PER_SLIDE} AS slide_no, vec_id % {PER_SLIDE} AS tile_idx, {SIDE} * ((vec_id % {PER_SLIDE}) % {PER_ROW}) AS x0, {SIDE} * ((vec_id % {PER_SLIDE}) // {PER_ROW}) AS y0, vec_id, label, embedding AS vec FROM embeddings)",
    "annotations": f"annotations AS (SELECT CASE WHEN slide_no % 4 <> 0 THEN 'ref_ds' ELSE 'query_ds' END AS dataset, 'S' || slide_no AS slide, 'C' || slide_no AS \"case\", 'P' || (slide_no // 2) AS patient, 'L' || label AS category FROM (SELECT vec_id // {PER_SLIDE} AS slide_no, arg_min(label, vec_id) AS label FROM embeddings GROUP BY 1))",
    "items": "items AS (SELECT 'I' || vec_id AS sample_id, 'P' || (vec_id // 5) AS patient, 'L' || label AS category, vec_id % 10 = 0 AS is_query, embedding::DOUBLE[] AS vec FROM embeddings)",
    "classified": "classified AS (SELECT CAST(l_returnflag = 'R' AS INT) AS y, round(l_discount::DOUBLE * 10, 6) AS p FROM lineitem)",
    "regressed": "regressed AS (SELECT l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE * p_retailprice::DOUBLE AS yhat FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "survival": "survival AS (SELECT o_custkey AS id, datediff('day', DATE '1992-01-01', o.o_orderdate::DATE)::DOUBLE AS time, CAST(o.o_orderstatus = 'F' AS INT) AS event, o.o_totalprice::DOUBLE AS risk FROM (SELECT o_custkey, arg_min({'o_orderdate': o_orderdate, 'o_orderstatus': o_orderstatus, 'o_totalprice': o_totalprice}, (o_orderdate, o_orderkey)) AS o FROM orders GROUP BY o_custkey))",
    "runs": "runs AS (SELECT event_id AS run_index, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'click' THEN 'complete' ELSE 'failed' END AS status, value::DOUBLE AS objective_value, event_type AS error FROM events)",
}


def with_views(names: str, *more: str) -> str:
    """WITH clause of the named views and further expressions."""
    return "WITH " + ", ".join([*(SQL[n] for n in names.split()), *more]) + " "
