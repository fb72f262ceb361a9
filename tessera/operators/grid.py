"""Parameter grids and their identifiers."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = {"slide": ("patch", "slide"), "patch": ("patch",)}


def product(spark: SparkSession, lists: Mapping[str, Sequence]) -> DataFrame:
    """All combinations, the last key fastest, with combo_index; an empty list raises, but for color_norm (null)."""
    size = 1
    values: dict[str, list] = {}
    for key, options in lists.items():
        values[key] = list(options) or ([None] if key == "color_norm" else [])
        if not values[key]:
            raise ValueError(f"no value for {key}")
        size *= len(values[key])
    out, every = spark.range(size).withColumnRenamed("id", "combo_index"), size
    for key, options in values.items():
        every //= len(options)
        array = F.array(*(F.lit(str(v) if v is not None else None).cast("string") for v in options))
        out = out.withColumn(key, F.element_at(array, ((F.col("combo_index") / every).cast("long") % len(options) + 1).cast("int")))
    return out


def product_of(frames: Sequence[DataFrame]) -> DataFrame:
    """All combinations of small frames of one column each, which are broadcast."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(F.broadcast(frame))
    return out


def search_space(lists: Mapping[str, Sequence], explicit: Mapping[str, dict] | None = None, seeds: Sequence[str] = ("seed", "random_state")) -> dict:
    """Explicit entries, and lists of several values as categorical ones; seeds stay out."""
    found = {k: {"type": "categorical", "choices": list(v)} for k, v in lists.items() if len(v) > 1 and k not in seeds}
    return found | dict(explicit or {})


def g(x: Column) -> Column:
    """A number as %g writes it, for magnitudes that need no exponent."""
    text = F.format_string("%.6f", x.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def tiling_id(px: Column, mpp: Column) -> Column:
    return F.concat(px.cast("int").cast("string"), F.lit("px_"), g(mpp), F.lit("mpp"))


def feature_name(extractor: Column, color_norm: Column) -> Column:
    return F.concat_ws("_", extractor, F.nullif(F.trim(color_norm), F.lit("")))


def bag_id(tiling: Column, feature: Column) -> Column:
    return F.concat_ws("__", tiling, feature)


def representation_id(feature: str, representation: str, params: Mapping) -> str:
    canonical = json.dumps(dict(params), sort_keys=True, separators=(",", ":"), default=str)
    return f"{feature.lower()}_{representation.lower()}_{hashlib.sha1(canonical.encode()).hexdigest()[:16]}"


def entry_id(slides: Column) -> Column:
    """Of a group of slides, whatever their order."""
    return F.concat(F.lit("members_"), F.sha1(F.concat_ws("||", F.array_sort(slides))))


def canonical_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def run_hash(text: Column, length: int = 8) -> Column:
    return F.substring(F.md5(text), 1, length)


def safe_name(text: Column) -> Column:
    """Letters, digits, dot, dash and underscore; every run of others becomes one dash; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")


def metric_request(name: str) -> tuple[str, dict]:
    """("hit_at_k", {"k": 5}) for "hit_at_5"; a name without a number has no parameters."""
    m = re.fullmatch(r"([a-z0-9_]+)_at_([0-9]+)", name.strip().lower())
    if m:
        if int(m[2]) < 1:
            raise ValueError(f"k must be positive: {name}")
        return f"{m[1]}_at_k", {"k": int(m[2])}
    return name.strip().lower(), {}


def hyperparameter(name: str, kind: type, default, params: Mapping, choices: Sequence | None = None, low=None, high=None):
    """A parameter's value: cast, checked against choices, and clamped into [low, high]."""
    value = params.get(name, default)
    value = kind(value) if value is not None else None
    if choices is not None and value not in choices:
        raise ValueError(f"{name}: {value!r} is none of {list(choices)}")
    if low is not None:
        value = max(low, value)
    return min(high, value) if high is not None else value


def suggestions(trials: DataFrame, name: str, spec: Mapping, seed: int = 0) -> DataFrame:
    """trials (trial) with a column drawn from spec by a hash: choices, or low and high with step or log."""
    unit = F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "trial"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    if "choices" in spec:
        options = F.array(*map(F.lit, spec["choices"]))
        return trials.withColumn(name, F.element_at(options, (F.floor(unit * len(spec["choices"])) + 1).cast("int")))
    low, high = float(spec["low"]), float(spec["high"])
    if spec.get("type") == "int":
        step = int(spec.get("step", 1))
        return trials.withColumn(name, (F.floor(unit * ((high - low) // step + 1)) * step + int(low)).cast("int"))
    if spec.get("log"):
        return trials.withColumn(name, F.exp(F.log(F.lit(low)) + unit * (F.log(F.lit(high)) - F.log(F.lit(low)))))
    value = F.lit(low) + unit * (high - low)
    return trials.withColumn(name, F.round((value - low) / spec["step"]) * spec["step"] + low if "step" in spec else value)


def by_bag(combos: DataFrame, bag: str = "bag_id") -> DataFrame:
    """(bag_id, combos): the combinations that read each bag, in order."""
    return combos.groupBy(bag).agg(F.array_sort(F.collect_list("combo_index")).alias("combos"))


def first_seen(combos: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column with the first combination that has each."""
    return combos.groupBy(column).agg(F.min("combo_index").alias("first"))


def one_bundle(bundles: DataFrame, **wanted) -> DataFrame:
    """The one prototype bundle that matches all wanted fields; none or several raise."""
    found = bundles
    for key, value in wanted.items():
        found = found.where(F.col(key).eqNullSafe(F.lit(value)))
    names = [r.name for r in found.select("name").distinct().orderBy("name").limit(2).collect()]
    if len(names) != 1:
        raise ValueError(f"{'several' if names else 'no'} bundles for {wanted}")
    return found.where(F.col("name") == names[0])


def compatible(grid: DataFrame, table: DataFrame) -> DataFrame:
    """grid with reason: why a combination can't run, else null. table: representation, feature_level, search, kind."""
    known = F.broadcast(table.select(F.col("representation").alias("_r"), F.col("search").alias("_s"), F.col("feature_level").alias("_l")).distinct())
    pairs = F.broadcast(table.select(F.col("representation").alias("_r2"), F.col("search").alias("_s2")).distinct())
    joined = grid.join(known, (F.col("representation") == F.col("_r")) & (F.col("search") == F.col("_s")) & (F.col("feature_level") == F.col("_l")), "left")
    joined = joined.join(pairs, (F.col("representation") == F.col("_r2")) & (F.col("search") == F.col("_s2")), "left")
    reason = F.when(F.col("_l").isNotNull(), F.lit(None).cast("string")).when(F.col("_r2").isNotNull(), "feature level").otherwise("representation and search")
    return joined.select(*grid.columns, reason.alias("reason"))
