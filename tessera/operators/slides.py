"""Slide-level helpers: targets per task, resolutions, tile geometry, score maps, run and work rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from tessera.operators.relational import resolve


def with_target(annotations: DataFrame, task: str, label: str = "category") -> DataFrame:
    """annotations with target: a whole class number, a double, or a struct (time, event); a label that can't be cast raises."""
    if task == "classification":
        return annotations.withColumn("target", F.expr(f"cast(`{label}` as bigint)"))
    if task == "regression":
        return annotations.withColumn("target", F.expr(f"cast(`{label}` as double)"))
    kind = {"survival": "double", "survival_discrete": "int"}[task]
    time, event = resolve(annotations, "time"), resolve(annotations, "event")
    return annotations.withColumn("target", F.struct(F.expr(f"cast(`{time}` as {kind})").alias("time"), F.expr(f"cast(`{event}` as int)").alias("event")))


def base_mpp(slides: DataFrame, found: str = "slide_mpp", fallback: str = "fallback_mpp") -> DataFrame:
    """slides with mpp: the first positive one of the slide's own and the fallback."""
    positive = lambda c: F.when(F.expr(f"try_cast(`{c}` as double)") > 0, F.expr(f"try_cast(`{c}` as double)"))
    return slides.withColumn("mpp", F.coalesce(positive(found), positive(fallback)))


def resolution_allowed(requested: Column, own: Column) -> Column:
    """A finer resolution than the slide's counts only within 1e-3 and one per cent of it."""
    return (requested >= own) | ((own - requested <= 1e-3) & (own - requested <= own * 1e-2))


def tile_grid(slides: DataFrame, side: int) -> DataFrame:
    """(slide, tile_idx, x0, y0): the whole squares of a side in slides of width and height, by rows."""
    whole = slides.where((F.col("width") >= side) & (F.col("height") >= side))
    grid = whole.select("slide", "width", F.explode(F.sequence(F.lit(0), F.floor(F.col("height") / side).cast("int") - 1)).alias("row"))
    cols = F.floor(F.col("width") / side).cast("int")
    cells = grid.select("slide", "row", cols.alias("cols"), F.explode(F.sequence(F.lit(0), cols - 1)).alias("col"))
    return cells.select("slide", (F.col("row") * F.col("cols") + F.col("col")).alias("tile_idx"), (F.col("col") * side).alias("x0"), (F.col("row") * side).alias("y0"))


def to_pixels(tiles: DataFrame, scale_x: float, scale_y: float) -> DataFrame:
    """tiles(x0, y0, read_w, read_h) with px, py, pw, ph on a thumbnail that is scale times smaller; a pixel at least."""
    if scale_x <= 0 or scale_y <= 0:
        raise ValueError("scales must be positive")
    size = lambda c, s: F.greatest(F.rint(F.col(c) / s).cast("int"), F.lit(1))
    at = lambda c, s: F.rint(F.col(c) / s).cast("int")
    return tiles.withColumns({"px": at("x0", scale_x), "py": at("y0", scale_y), "pw": size("read_w", scale_x), "ph": size("read_h", scale_y)})


def merged_runs(tiles: DataFrame, group: str, side: int) -> DataFrame:
    """(slide, group, y0, x0, x1): squares of a group that touch in a row become one rectangle."""
    row = Window.partitionBy("slide", group, "y0").orderBy("x0")
    new = F.when(F.col("x0") - F.lag("x0").over(row) == side, 0).otherwise(1)
    runs = tiles.select("slide", group, "x0", "y0").distinct().withColumn("new", new).withColumn("run", F.sum("new").over(row))
    return runs.groupBy("slide", group, "y0", "run").agg(F.min("x0").alias("x0"), (F.max("x0") + side).alias("x1")).drop("run")


def blurred(pixels: DataFrame, sigma: float) -> DataFrame:
    """(slide, px, py, score): each slide's score map under a separable Gaussian, pixels that are absent count as 0.

    A map has the size of a thumbnail and is one task's work.
    """
    reach = max(1, int(3 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = rows.px.min() - reach, rows.py.min() - reach
        canvas = np.zeros((rows.py.max() - y0 + reach + 1, rows.px.max() - x0 + reach + 1))
        canvas[rows.py - y0, rows.px - x0] = rows.score
        for axis in (0, 1):
            canvas = np.apply_along_axis(np.convolve, axis, canvas, kernel, "same")
        y, x = np.nonzero(canvas > 0)
        return pd.DataFrame({"slide": rows.slide.iloc[0], "px": (x + x0).astype(np.int32), "py": (y + y0).astype(np.int32), "score": canvas[y, x]})

    return pixels.select("slide", "px", "py", "score").groupBy("slide").applyInPandas(run, "slide string, px int, py int, score double")


def top_tiles(tiles: DataFrame, score: str, k: int) -> DataFrame:
    """tiles with rank: the k tiles of each slide with the largest scores, ties by tile_idx; all of them if there are fewer."""
    rank = F.row_number().over(Window.partitionBy("slide").orderBy(F.desc_nulls_last(score), "tile_idx"))
    return tiles.withColumn("rank", rank).where(F.col("rank") <= max(1, k))


def squares(tiles: DataFrame, side: int) -> DataFrame:
    """tiles with tile_id as text and the closed ring of a square's corners, from its upper left."""
    corner = lambda dx, dy: F.array((F.col("x0") + dx * side).cast("double"), (F.col("y0") + dy * side).cast("double"))
    return tiles.withColumns({"tile_id": F.col("tile_idx").cast("string"), "polygon": F.array(*(corner(*c) for c in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))})


def survival_times(rows: DataFrame, exact: str, binned: str) -> DataFrame:
    """rows with time: the exact one where there is one, else the bin."""
    return rows.withColumn("time", F.coalesce(F.col(exact).cast("double"), F.col(binned).cast("double")))


def mean_rgb(pixels: DataFrame) -> DataFrame:
    """(slide, tile_idx, vec): mean of r, g, b in 0 to 1 of each tile."""
    return pixels.groupBy("slide", "tile_idx").agg(F.array(*(F.avg(c) / 255 for c in "rgb")).alias("vec"))


def prototype_labels(texts: DataFrame, count: int) -> DataFrame:
    """(proto, label) from JSON text(s): a list of labels, an object by number, or a list of {id, label}; a gap raises."""
    listed = F.from_json("value", "array<string>")
    objects = F.from_json("value", "array<struct<id: int, label: string>>")
    mapped = F.from_json("value", MapType(StringType(), StringType()))
    head = F.substring(F.regexp_replace("value", r"\s", ""), 1, 2)
    pairs = (
        F.when(head.startswith("{"), F.transform(F.map_entries(mapped), lambda e: F.struct(e["key"].cast("int").alias("proto"), e["value"].alias("label"))))
        .when(head == "[{", F.transform(objects, lambda o: F.struct(o["id"].alias("proto"), o["label"].alias("label"))))
        .otherwise(F.transform(listed, lambda x, i: F.struct(i.alias("proto"), x.alias("label"))))
    )
    known = texts.select(F.inline(pairs))
    wanted = texts.sparkSession.range(count).select(F.col("id").cast("int").alias("proto"))
    label = F.coalesce("label", F.raise_error(F.concat(F.lit("no label for prototype "), F.col("proto").cast("string"))).cast("string"))
    return wanted.join(known, "proto", "left").select("proto", label.alias("label"))


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """Struct fields as columns with dotted names; arrays and maps as JSON text."""

    def columns(schema: StructType, path: tuple[str, ...] = ()):
        for f in schema.fields:
            at = (*path, f.name)
            column = F.col(".".join(f"`{p}`" for p in at))
            if isinstance(f.dataType, StructType):
                yield from columns(f.dataType, at)
            else:
                yield (F.to_json(column) if isinstance(f.dataType, (ArrayType, MapType)) else column).alias(separator.join(at))

    return df.select(*columns(df.schema))


def summary_rows(runs: DataFrame, parameters: Sequence[str], **constants: str) -> DataFrame:
    """Run rows with the listed keys of their parameter map as columns, and constant fields."""
    return runs.select(*(c for c in runs.columns if c != "params"), *(F.col("params")[p].alias(p) for p in parameters), *(F.lit(v).alias(k) for k, v in constants.items()))


def trial_rows(trials: DataFrame, prefix: str = "params_") -> DataFrame:
    return trials.withColumnsRenamed({c: c[len(prefix) :] for c in trials.columns if c.startswith(prefix)})


def work_records(combos: DataFrame, features: DataFrame) -> DataFrame:
    """(work_id, stage, dependencies): benchmark jobs that each wait for all feature jobs."""
    waits = F.broadcast(features.agg(F.array_sort(F.collect_list("work_id")).alias("dependencies")))
    return combos.join(waits).select(F.format_string("benchmark-%05d", F.col("combo_index")).alias("work_id"), F.lit("benchmark").alias("stage"), "dependencies")


def subset(results: DataFrame, ids: DataFrame | None, column: str = "query_id") -> DataFrame:
    """Results of an optional set of ids."""
    return results if ids is None else results.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")
