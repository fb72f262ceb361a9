"""Bags: groups of tile rows by slide, case or patient; resizing, pooling, checks, adjacency of tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def single(column: str) -> Column:
    """The one non-null value of a group: null if there is none; several raise."""
    values = F.collect_set(column)
    return F.when(F.size(values) > 1, F.raise_error(F.lit(f"a group has several values of {column}"))).otherwise(F.get(values, 0))


def build(annotations: DataFrame, level: str) -> DataFrame:
    """(sample_id, slides, category, patient, cases): one row per slide, case or patient; slides in order."""
    rows = annotations.where(F.col(level).isNotNull())
    return rows.groupBy(F.col(level).alias("sample_id")).agg(F.array_sort(F.collect_set("slide")).alias("slides"), F.min("category").alias("category"), F.count_distinct("category").alias("categories"), single("patient").alias("patient"), F.array_sort(F.collect_set("case")).alias("cases"))


def load(bags: DataFrame, tiles: DataFrame) -> DataFrame:
    """(sample_id, position, slide, tile_idx, vec): the tiles of each bag's slides in the order of slides and tiles."""
    rows = bags.select("sample_id", F.posexplode("slides").alias("slide_no", "slide")).join(tiles.select("slide", "tile_idx", "vec"), "slide")
    position = F.row_number().over(Window.partitionBy("sample_id").orderBy("slide_no", "tile_idx")) - 1
    return rows.select("sample_id", position.alias("position"), "slide", "tile_idx", "vec")


def dataset(annotations: DataFrame, tiles: DataFrame, level: str, task: str, size: int | None = None) -> DataFrame:
    """Bag rows for a task: retrieval bags as they are, others at a fixed size where one is given."""
    rows = load(build(annotations, level), tiles)
    return rows if task == "slide_retrieval" or size is None else resized(rows, size).drop("position").withColumnRenamed("place", "position")


def resized(bag_rows: DataFrame, size: int) -> DataFrame:
    """Bags of exactly size rows: larger ones keep evenly spaced rows (half-even), smaller ones repeat in turn."""
    sizes = bag_rows.groupBy("sample_id").agg(F.count("*").alias("n"))
    i = F.col("place")
    even = F.lit(0.0) if size == 1 else i * (F.col("n") - 1) / F.lit(float(size - 1))
    source = F.when(F.col("n") >= size, F.rint(even)).otherwise(i % F.col("n")).cast("int")
    wanted = sizes.select("sample_id", "n", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("place")).select("sample_id", "place", source.alias("position"))
    return wanted.join(bag_rows, ["sample_id", "position"])


def pooled(bag_rows: DataFrame, how: str = "mean") -> DataFrame:
    """(sample_id, dim, value): mean, max, min or sum of each component over the rows of a bag."""
    agg = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[how]
    return bag_rows.select("sample_id", F.posexplode("vec").alias("dim", "x")).groupBy("sample_id", "dim").agg(agg(F.col("x").cast("double")).alias("value"))


def attention_pooled(bag_rows: DataFrame, attention: str) -> DataFrame:
    """(sample_id, dim, mean, var): attention-weighted mean and variance of each component; weights are a soft-max."""
    top = F.max(attention).over(Window.partitionBy("sample_id"))
    rows = bag_rows.withColumn("w", F.exp(F.col(attention) - top)).select("sample_id", "w", F.posexplode("vec").alias("dim", "x"))
    sums = rows.groupBy("sample_id", "dim").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("wxx"))
    mean = F.col("wx") / F.col("w")
    return sums.select("sample_id", "dim", mean.alias("mean"), (F.col("wxx") / F.col("w") - mean * mean).alias("var"))


def ensemble(logits: DataFrame) -> DataFrame:
    """(sample_id, class, logit): mean over members."""
    return logits.groupBy("sample_id", "class").agg(F.avg("logit").alias("logit"))


def output_dim(annotations: DataFrame, task: str) -> DataFrame:
    """Classes, discrete time bins (largest + 1), or 1."""
    value = {"classification": F.count_distinct("category"), "survival_discrete": F.max(F.col("time").cast("int")) + 1}.get(task, F.lit(1))
    return annotations.agg(value.cast("long").alias("output_dim"))


def schema_problems(bag_rows: DataFrame) -> DataFrame:
    """Bags whose vectors differ in length, or hold nulls or non-finite values."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = bag_rows.groupBy("sample_id").agg(F.count_distinct(F.size("vec")).alias("lengths"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"))
    return found.where("lengths <> 1 OR bad > 0")


def padded(bag_rows: DataFrame) -> DataFrame:
    """(sample_id, position, vec, mask): all bags at the size of the largest, padded with zero vectors."""
    sizes = bag_rows.agg(F.max("position").alias("last"), F.max(F.size("vec")).alias("d"))
    slots = bag_rows.select("sample_id").distinct().join(F.broadcast(sizes)).select("sample_id", "d", F.explode(F.sequence(F.lit(0), "last")).alias("position"))
    joined = slots.join(bag_rows, ["sample_id", "position"], "left")
    return joined.select("sample_id", "position", F.coalesce("vec", F.array_repeat(F.lit(0.0).cast("float"), F.col("d"))).alias("vec"), F.col("vec").isNotNull().alias("mask"))


def normalized_scores(tiles: DataFrame, score: str, mask: str) -> DataFrame:
    """Scores of masked tiles from 0 to 1 per slide; the others are 0. A constant slide has 0."""
    by = Window.partitionBy("slide")
    x = F.when(F.col(mask), F.col(score))
    scaled = (x - F.min(x).over(by)) / F.greatest(F.max(x).over(by) - F.min(x).over(by), F.lit(1e-12))
    return tiles.withColumn("scaled", F.coalesce(scaled, F.lit(0.0)))


def metadata(annotations: DataFrame, level: str, tracked: list[str]) -> DataFrame:
    """Per group the sorted distinct non-null values of each tracked column, as arrays."""
    return annotations.groupBy(F.col(level).alias("sample_id")).agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in tracked))
