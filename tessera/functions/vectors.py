"""Expressions over vectors, bits, times and coordinates; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / ((F.sqrt(dot(a, a)) + eps) * (F.sqrt(dot(b, b)) + eps))


def falls(vec: Column) -> Column:
    """Bit i: component i + 1 is below component i."""
    return F.transform(F.sequence(F.lit(0), F.size(vec) - 2), lambda i: F.get(vec, i + 1) - F.get(vec, i) < 0)


def rises(vec: Column) -> Column:
    """Bit 0 is false; bit i: component i is not below component i - 1."""
    return F.transform(vec, lambda x, i: F.when(i == 0, F.lit(False)).otherwise(x >= F.get(vec, i - 1)))


def signs(vec: Column) -> Column:
    return F.transform(vec, lambda x: x > 0)


def packed(bits: Column) -> Column:
    """Bits as an array of numbers of 32 bits, padded with zeros."""
    words = F.sequence(F.lit(0), F.floor((F.size(bits) - 1) / 32).cast("int"))
    return F.transform(words, lambda w: F.aggregate(F.slice(bits, w * 32 + 1, 32), F.lit(0).cast("long"), lambda s, b: s * 2 + b.cast("long")))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of booleans of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def hamming_packed(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def softmin(distances: Column, tau: float) -> Column:
    """-tau log(mean(exp(-(d - min) / tau))) + min; infinity for an empty array."""
    low = F.array_min(distances)
    total = F.aggregate(F.transform(distances, lambda d: F.exp(-(d - low) / tau)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(distances) > 0, -tau * F.log(total / F.size(distances)) + low).otherwise(float("inf"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda s, x: s + x))


def argmax(values: Column) -> Column:
    """Position of the first largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def joint_mask(a: Column, b: Column) -> Column:
    """Both masks true; null where one is null or nothing is left."""
    both = F.zip_with(a, b, lambda x, y: x & y)
    return F.when(F.exists(both, lambda x: x), both)


def hazards(logits: Column, widths: Column) -> Column:
    """-log(1 - p) / width per time bin, p a clipped sigmoid of the logit."""
    clipped = F.transform(logits, lambda x: F.least(F.greatest(sigmoid(x), F.lit(1e-7)), F.lit(1 - 1e-7)))
    return F.zip_with(clipped, widths, lambda p, w: -F.log1p(-p) / w)


def cumulative_hazard(hazard: Column, tau: Column) -> Column:
    """Sum up to the rounded bin of tau, within the bins there are."""
    last = F.greatest(F.lit(0), F.least(F.rint(tau).cast("int"), F.size(hazard) - 1))
    return F.aggregate(F.slice(hazard, F.lit(1), last + 1), F.lit(0.0), lambda s, x: s + x)


def discrete_survival(hazard: Column) -> Column:
    """Running product of 1 - hazard."""
    return F.transform(hazard, lambda _, i: F.aggregate(F.slice(hazard, F.lit(1), i + 1), F.lit(1.0), lambda s, h: s * (1 - h)))


def discrete_risk(hazard: Column) -> Column:
    """Risk of a discrete survival prediction: the sum of its hazards."""
    return F.aggregate(hazard, F.lit(0.0), lambda s, h: s + h)


def safe_mean(values: Column) -> Column:
    """Mean of an array, 0 of an empty one."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def masked_or_all(values: Column, mask: Column) -> Column:
    """The values whose mask is true; all of them if it leaves none or is null."""
    kept = F.filter(values, lambda _, i: F.coalesce(F.get(mask, i), F.lit(False)))
    return F.when(F.size(kept) > 0, kept).otherwise(values)


def latent_key(level1: Column, level2: Column, level3: Column) -> Column:
    return level1.cast("long") + level2.cast("long") * 10**6 + level3.cast("long") * 10**11


def remapped(codes: Column, table: dict[int, int]) -> Column:
    """Codes through a small map; codes that it lacks become null."""
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.transform(codes, lambda c: F.element_at(known, c))


def bin_times(rows: DataFrame, column: str, bins: int, method: str = "quantile") -> DataFrame:
    """rows with bin, from 1: one more than the cuts below the time. Cuts: sorted values at floor(q (n - 1)), or equal widths."""
    if method == "quantile":
        counts = rows.groupBy(F.col(column).alias("t")).agg(F.count("*").alias("n")).where("t IS NOT NULL")
        last = counts.withColumn("end", F.sum("n").over(Window.orderBy("t"))).withColumn("start", F.col("end") - F.col("n"))  # one row per distinct time
        total = counts.agg(F.sum("n").alias("total"))
        ranks = F.array(*(F.floor(F.lit(i / bins) * (F.col("total") - 1)) for i in range(1, bins)))
        cuts = last.join(F.broadcast(total)).select("t", F.filter(ranks, lambda r: (r >= F.col("start")) & (r < F.col("end"))).alias("hit"))
        cuts = cuts.where(F.size("hit") > 0).agg(F.flatten(F.collect_list(F.transform("hit", lambda _: F.col("t")))).alias("cuts"))
    else:
        ends = rows.agg(F.min(column).alias("low"), F.max(column).alias("high"))
        cuts = ends.select(F.array(*(F.col("low") + (F.col("high") - F.col("low")) * i / bins for i in range(1, bins))).alias("cuts"))
    joined = rows.join(F.broadcast(cuts))
    return joined.withColumn("bin", F.lit(1) + F.size(F.filter("cuts", lambda c: F.col(column) > c))).drop("cuts")


def bounds(tiles: DataFrame, x: str, y: str, side: int, scale: float, border: int) -> DataFrame:
    """Per slide the pixels of a thumbnail that hold its tiles, with a border."""
    if scale <= 0:
        raise ValueError("the scale must be positive")
    low: Callable = lambda c: F.greatest(F.floor(F.min(c) / scale) - border, F.lit(0)).cast("int")
    high: Callable = lambda c: (F.ceil((F.max(c) + side) / scale) + border).cast("int")
    return tiles.groupBy("slide").agg(low(x).alias("left"), low(y).alias("top"), high(x).alias("right"), high(y).alias("bottom"))


def rasterized(rectangles: DataFrame, width: int, height: int) -> DataFrame:
    """(px, py, score): mean score of the rectangles (x, y, w, h, score) over each pixel of a canvas."""
    cells = lambda at, size, end: F.sequence(F.greatest(F.lit(0), F.floor(at).cast("int")), F.least(F.lit(end - 1), F.ceil(at + size).cast("int") - 1))
    inside = rectangles.where((F.col("x") < width) & (F.col("y") < height) & (F.col("x") + F.col("w") > 0) & (F.col("y") + F.col("h") > 0))
    spread = inside.withColumn("px", F.explode(cells(F.col("x"), F.col("w"), width))).withColumn("py", F.explode(cells(F.col("y"), F.col("h"), height)))
    return spread.groupBy("px", "py").agg(F.avg("score").alias("score"))
