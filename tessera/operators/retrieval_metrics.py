"""Retrieval metrics over hits(query_id, rank, label, score) and queries(query_id, query_label).

hits hold the label of the item found. Hits on the query itself go first; then the first k count. A metric is given per
label, as macro (mean over labels) and micro (mean over queries), in rows (metric, scope, label, value, queries).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def labelled(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """hits with the label of each hit, and positions counted anew without self hits. labels: sample_id, category."""
    found = hits.where("query_id <> sample_id").join(labels.select("sample_id", F.col("category").alias("hit_label")), "sample_id")
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "sample_id"))
    return found.withColumn("position", position).select("query_id", "position", "sample_id", "hit_label", "score")


def _judged(queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """A row per query and hit in the first k, and one with nulls for a query without hits."""
    top = hits.where(F.col("position") <= k)
    return queries.select("query_id", "query_label").join(top, "query_id", "left").withColumn("relevant", F.coalesce((F.col("hit_label") == F.col("query_label")).cast("int"), F.lit(0)))


def hit_at_k(queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """1 for a query with a relevant hit among the first k."""
    return _judged(queries, hits, k).groupBy("query_id", "query_label").agg(F.max("relevant").cast("double").alias("value"))


def precision_at_k(queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Relevant hits among the first k, divided by k even where there are fewer."""
    return _judged(queries, hits, k).groupBy("query_id", "query_label").agg((F.sum("relevant") / F.lit(float(k))).alias("value"))


def map_at_k(queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Mean precision at the relevant positions; 0 with fewer than k hits or none relevant."""
    running = F.sum("relevant").over(Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    rows = _judged(queries, hits, k).withColumn("at", F.when(F.col("relevant") == 1, running / F.col("position")))
    return rows.groupBy("query_id", "query_label").agg(F.when(F.count("position") < k, 0.0).otherwise(F.coalesce(F.avg("at"), F.lit(0.0))).alias("value"))


def votes_at_k(queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(query_id, query_label, predicted): the label of a strict majority of the first k hits; null without one."""
    rows = _judged(queries, hits, k).where("position IS NOT NULL").groupBy("query_id", "hit_label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("query_id"))
    won = rows.withColumn("total", total).where("n >= total div 2 + 1").select("query_id", F.col("hit_label").alias("predicted"))
    return queries.select("query_id", "query_label").join(won, "query_id", "left")


def mmv_at_k(queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """1 where the majority vote is the query's label; no majority is wrong."""
    right = F.coalesce((F.col("predicted") == F.col("query_label")).cast("double"), F.lit(0.0))
    return votes_at_k(queries, hits, k).select("query_id", "query_label", right.alias("value"))


def ndcg_at_k(queries: DataFrame, hits: DataFrame, k: int, available: DataFrame) -> DataFrame:
    """Binary NDCG; the ideal has min(k, relevant reference items) hits. available: query_id, relevant."""
    gain = lambda at: F.lit(1.0) / F.log2(at + 1)
    dcg = _judged(queries, hits, k).groupBy("query_id", "query_label").agg(F.sum(F.when(F.col("relevant") == 1, gain(F.col("position"))).otherwise(0.0)).alias("dcg"))
    best = F.least(F.lit(k), F.coalesce("available", F.lit(0))).cast("int")
    ideal = F.when(best > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(best, F.lit(1))), F.lit(0.0), lambda s, i: s + gain(i))).otherwise(0.0)
    joined = dcg.join(available.select("query_id", F.col("relevant").alias("available")), "query_id", "left").withColumn("ideal", ideal)
    return joined.select("query_id", "query_label", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("value"))


def relevant_items(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, relevant): pool items of the query's label, but the query and its exclusion group.

    queries: query_id, query_label, exclusion_key; pool: sample_id, category, exclusion_key. Counted from totals by label,
    and by label and group, so that queries never meet all items of their label.
    """
    by_label = pool.groupBy(F.col("category").alias("query_label")).agg(F.count("*").alias("all"))
    by_group = pool.where("exclusion_key IS NOT NULL").groupBy(F.col("category").alias("query_label"), "exclusion_key").agg(F.count("*").alias("grouped"))
    own = pool.select(F.col("sample_id").alias("query_id"), F.col("category").alias("own_label"), F.col("exclusion_key").alias("own_key"))
    rows = queries.join(by_label, "query_label", "left").join(by_group, ["query_label", "exclusion_key"], "left").join(own, "query_id", "left")
    counted = F.coalesce((F.col("own_label") == F.col("query_label")) & ~(F.col("exclusion_key").isNotNull() & F.col("own_key").eqNullSafe(F.col("exclusion_key"))), F.lit(False))
    return rows.select("query_id", (F.coalesce("all", F.lit(0)) - F.coalesce("grouped", F.lit(0)) - counted.cast("int")).alias("relevant"))


def summary(values: DataFrame, metric: str) -> DataFrame:
    """(metric, scope, label, value, queries) of per-query values: per label, macro and micro."""
    by = values.groupBy("query_label").agg(F.avg("value").alias("value"), F.count("*").alias("queries"), F.sum("value").alias("sum"))
    rows = by.select(F.lit("label").alias("scope"), F.col("query_label").alias("label"), "value", "queries")
    macro = by.agg(F.avg("value").alias("value"), F.sum("queries").alias("queries")).select(F.lit("macro").alias("scope"), F.lit(None).cast("string").alias("label"), "value", "queries")
    micro = by.agg((F.sum("sum") / F.sum("queries")).alias("value"), F.sum("queries").alias("queries")).select(F.lit("micro").alias("scope"), F.lit(None).cast("string").alias("label"), "value", "queries")
    return rows.unionByName(macro).unionByName(micro).select(F.lit(metric).alias("metric"), "scope", "label", "value", "queries")


def macro_f1_at_k(queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """F1 of the majority vote per true label, macro over true labels, micro over all counts."""
    rows = votes_at_k(queries, hits, k)
    right = F.coalesce((F.col("predicted") == F.col("query_label")).cast("int"), F.lit(0))
    truth = rows.groupBy(F.col("query_label").alias("label")).agg(F.sum(right).alias("tp"), F.sum(1 - right).alias("fn"))
    wrong = rows.where("predicted IS NOT NULL AND predicted <> query_label").groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("fp"))
    both = truth.join(wrong, "label", "full").na.fill(0, ["fp"])
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1 = lambda tp, fp, fn: zero(2.0 * tp, 2 * tp + fp + fn)
    each = both.where("tp IS NOT NULL").select("label", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("value"), (F.col("tp") + F.col("fn")).alias("queries"))
    macro = each.agg(F.avg("value").alias("value"), F.sum("queries").alias("queries")).select(F.lit("macro").alias("scope"), F.lit(None).cast("string").alias("label"), "value", "queries")
    sums = both.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    micro = sums.select(F.lit("micro").alias("scope"), F.lit(None).cast("string").alias("label"), f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("value"), (F.col("tp") + F.col("fn")).alias("queries"))
    return each.select(F.lit("label").alias("scope"), "label", "value", "queries").unionByName(macro).unionByName(micro).select(F.lit("f1").alias("metric"), "scope", "label", "value", "queries")


def dcg(relevance: Column) -> Column:
    """Sum of (2^rel - 1) / log2(rank + 1) over an array in rank order."""
    terms = F.transform(relevance, lambda r, i: (F.pow(F.lit(2.0), r) - 1) / F.log2(i + 2))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def reference_pool(annotations: DataFrame, sample: str) -> DataFrame:
    """One row per sample id: its label and, where single, its other ids. Raises on a sample with several of any."""
    others = [c for c in ("slide", "case", "patient") if c in annotations.columns and c != sample]
    sets = [F.collect_set(c).alias(c) for c in ["category", *others, "dataset"]]
    grouped = annotations.groupBy(F.col(sample).alias("sample_id")).agg(*sets)
    one = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1)).when(F.size(c) > 1, F.raise_error(F.lit(f"a sample has several values of {c}")).cast("string"))
    return grouped.select("sample_id", *(one(c).alias(c) for c in ["category", *others]), F.when(F.size("dataset") == 1, F.element_at("dataset", 1)).alias("dataset"))
