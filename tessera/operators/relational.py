"""Filters, joins, set operations and rankings over annotation, file and run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Alternative names of a column, by preference.
ALIASES = {
    "slide": ("slide", "slide_id"),
    "time": ("time", "survival_time", "os_time"),
    "event": ("event", "status", "os_event"),
}
RENAMED = {"submitter_id": "patient", "cases.submitter_id": "patient", "cases.case_id": "case_id", "file_id": "file_uid", "label": "category"}
MINIMIZED = ("loss", "error", "mae", "mse", "rmse")
SUCCESS = ("success", "complete", "completed")


def running(rows: DataFrame, order: str, made: dict[str, tuple[Column, str]], descending: bool = False, then: Sequence[str] = ()) -> DataFrame:
    """rows with running totals along a column, each row's own included, by range partitions: no task sees all rows.

    made: name to (column, "sum" or "product"). The column is cut at its approximate quantiles, each range is totalled by
    itself, and the totals of the ranges before, one row for each partition at most, are added. Rows of equal order go in the
    order of then. Nulls in order come first, or last when descending.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)] or [F.lit(0.5)]), 1000)).first()[0] or []
    least = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    bucket = F.coalesce(F.size(F.filter(least, lambda c: c <= F.col(order))), F.lit(0)) if cuts else F.lit(0)
    fold = {"sum": F.sum, "product": F.product}
    way = (lambda c: F.desc_nulls_last(c)) if descending else (lambda c: F.asc_nulls_first(c))
    cut = rows.withColumn("_range", F.when(F.col(order).isNull(), -1).otherwise(bucket))
    ends = cut.groupBy("_range").agg(*(fold[how](c).alias(f"_{name}") for name, (c, how) in made.items()))
    before = Window.orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = ends.select("_range", *(fold[how](f"_{name}").over(before).alias(f"_{name}") for name, (_, how) in made.items()))
    inside = Window.partitionBy("_range").orderBy(way(order), *then).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({name: fold[how](c).over(inside) for name, (c, how) in made.items()}).join(F.broadcast(carried), "_range")
    whole = {n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) if how == "sum" else F.col(n) * F.coalesce(f"_{n}", F.lit(1.0)) for n, (_, how) in made.items()}
    return out.withColumns(whole).drop("_range", *(f"_{n}" for n in made))


def resolve(df: DataFrame, role: str) -> str:
    """The first alias of a role that is a column; a table has one, whatever its rows hold."""
    for name in ALIASES[role]:
        if name in df.columns:
            return name
    raise ValueError(f"no {role} column among {df.columns}")


def validated(annotations: DataFrame) -> DataFrame:
    """Requires slide and category; patient defaults to slide and dataset to "default" where the column is absent."""
    missing = {"slide", "category"} - set(annotations.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    out = annotations if "patient" in annotations.columns else annotations.withColumn("patient", F.col("slide"))
    return out if "dataset" in out.columns else out.withColumn("dataset", F.lit("default"))


def of_dataset(annotations: DataFrame, name: str, slides: Sequence[str] | None = None) -> DataFrame:
    """Rows of one dataset, and of some slides when given."""
    rows = annotations.where(F.col("dataset") == name)
    return rows if slides is None else rows.where(F.col("slide").cast("string").isin(list(map(str, slides))))


def missing_slides(annotations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted slides that have no annotation: a set difference."""
    return wanted.select(F.col("slide").cast("string").alias("slide")).distinct().join(annotations.select("slide"), "slide", "left_anti")


def configured(annotations: DataFrame, config: DataFrame) -> DataFrame:
    """Annotation rows with the role of their dataset; ignored and unknown datasets drop out. config: name, used_for."""
    roles = F.broadcast(config.where("used_for <> 'ignore'").select(F.col("name").alias("dataset"), "used_for"))
    return annotations.join(roles, "dataset")


def by_role(config: DataFrame) -> DataFrame:
    """(used_for, datasets) in the order of names."""
    return config.groupBy("used_for").agg(F.array_sort(F.collect_list("name")).alias("datasets"))


def split_roles(items: DataFrame, both_are_queries: bool = True) -> tuple[DataFrame, DataFrame]:
    """(queries, references) of items with used_for; query_reference is a reference, and a query where allowed."""
    queries = items.where(F.col("used_for").isin(["query", "query_reference"] if both_are_queries else ["query"]))
    return queries, items.where(F.col("used_for").isin("reference", "query_reference"))


def not_excluded(query_key: Column, key: Column) -> Column:
    """A null query key keeps all, a null reference key is kept."""
    return query_key.isNull() | ~key.eqNullSafe(query_key)


def wsi_samples(annotations: DataFrame, files: DataFrame, dataset: str) -> DataFrame:
    """Slides of a dataset with their file; those without one drop out. files: path, one row per file.

    A file belongs to the slide of its exact stem; a stem with two files has none. fallback_mpp counts if it is a
    positive number.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    single = files.groupBy(stem.alias("stem")).agg(F.count("*").alias("n"), F.min("path").alias("found")).where("n = 1").drop("n")
    rows = annotations.where(F.col("dataset") == dataset)
    for name in ("wsi_path", "fallback_mpp"):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast("string"))
    joined = rows.join(single, F.col("slide") == F.col("stem"), "left").withColumn("path", F.coalesce("wsi_path", "found"))
    mpp = F.expr("try_cast(fallback_mpp AS double)")
    return joined.where("path IS NOT NULL").select("slide", "patient", "category", "path", F.when(mpp > 0, mpp).alias("fallback_mpp"))


def standardized(files: DataFrame, source: str, data_dir: str) -> DataFrame:
    """Renamed columns, slide from the file name, patient from case_id where null, path from local_path or data_dir."""
    out = files.withColumnsRenamed({k: v for k, v in RENAMED.items() if k in files.columns and v not in files.columns})
    have = lambda c: F.col(c) if c in out.columns else F.lit(None).cast("string")
    return out.withColumns({
        "slide": F.coalesce(F.regexp_replace("file_name", r"\.[^.]*$", ""), have("series_uid")),
        "patient": F.coalesce(have("patient"), have("case_id")),
        "wsi_path": F.coalesce(have("local_path"), F.concat(F.lit(data_dir.rstrip("/") + "/"), F.col("file_name")), F.concat(have("series_uid"), F.lit(".zip"))),
        "source": F.lit(source),
    })


def with_metadata(files: DataFrame, metadata: DataFrame, keys: Sequence[str] = ("case_id", "patient"), required: Sequence[str] = ("slide", "patient", "category", "wsi_path")) -> DataFrame:
    """Left join on the first key both sides have, null equal to null; clashing names get _metadata; incomplete rows go."""
    key = next((k for k in keys if k in files.columns and k in metadata.columns), None)
    if key is None:
        raise ValueError("no common key")
    other = metadata.withColumnsRenamed({c: f"{c}_metadata" for c in metadata.columns if c != key and c in files.columns}).withColumnRenamed(key, "_key")
    joined = files.join(other, files[key].eqNullSafe(F.col("_key")), "left").drop("_key")
    return joined.dropna(subset=[c for c in required if c in joined.columns])


def existing(rows: DataFrame, keys: DataFrame, on: Sequence[str] = ("dataset", "slide")) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), list(on), "left_semi")


def absent(rows: DataFrame, keys: DataFrame, on: Sequence[str] = ("dataset", "slide")) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), list(on), "left_anti")


def inference_rows(wanted: DataFrame, annotations: DataFrame, level: str = "slide") -> DataFrame:
    """Annotations of the wanted (dataset, slide) pairs, and rows of defaults for pairs without one.

    category is "unknown" and patient and case are the slide, unless that is the aggregation level: it can't be guessed.
    """
    kept = existing(annotations, wanted)
    made = absent(wanted.select("dataset", "slide").distinct(), kept)
    for c in ("patient", "case"):
        value = F.raise_error(F.lit(f"no {c} for a slide without annotation")).cast("string") if c == level else F.col("slide")
        made = made.withColumn(c, value)
    return kept.unionByName(made.withColumn("category", F.lit("unknown")), allowMissingColumns=True)


def unknown_datasets(wanted: DataFrame, config: DataFrame) -> DataFrame:
    return wanted.select("dataset").distinct().join(config.select(F.col("name").alias("dataset")), "dataset", "left_anti")


def label_lookup(annotations: DataFrame, ids: DataFrame, column: str, label: str) -> DataFrame:
    """(sample_id, label, problem): the one trimmed label of each id, or what is wrong with it."""
    text = F.trim(F.col(label).cast("string"))
    found = annotations.groupBy(F.col(column).cast("string").alias("sample_id")).agg(
        F.count("*").alias("rows"), F.count_if(F.col(label).isNull()).alias("nulls"), F.array_sort(F.collect_set(F.nullif(text, F.lit("")))).alias("labels")
    )
    problem = (
        F.when(F.col("rows").isNull(), "no row").when(F.col("nulls") > 0, "null label").when(F.size("labels") == 0, "blank label").when(F.size("labels") > 1, "several labels")
    )
    joined = ids.select(F.col("sample_id").cast("string").alias("sample_id")).distinct().join(found, "sample_id", "left").withColumn("problem", problem)
    return joined.select("sample_id", F.when(F.col("problem").isNull(), F.element_at("labels", 1)).alias("label"), "problem")


def nth_match(left: DataFrame, right: DataFrame, keys: Sequence[str], order_left: str, order_right: str, values: Sequence[str]) -> DataFrame:
    """left with values of right: the n-th row of a key goes with its n-th row there; nulls where there is none."""
    number = lambda by: F.row_number().over(Window.partitionBy(*keys).orderBy(by))
    a, b = left.withColumn("_n", number(order_left)), right.withColumn("_n", number(order_right)).select(*keys, "_n", *values)
    return a.join(b, [*keys, "_n"], "left").drop("_n")


def median_size(sizes: DataFrame, column: str) -> DataFrame:
    """The median of the positive sizes, 1 at least."""
    return sizes.agg(F.greatest(F.coalesce(F.expr(f"percentile(CASE WHEN {column} > 0 THEN {column} END, 0.5)"), F.lit(1.0)), F.lit(1.0)).alias("size"))


def minimizes(metric: str) -> bool:
    """By part of the name; a brier_score is thus maximised."""
    return any(word in metric.lower() for word in MINIMIZED)


def leaderboard(runs: DataFrame, metric: str = "objective") -> DataFrame:
    """Successful rows with a number, ranked from 1 by value and run_index; the others have a null rank."""
    good = F.lower("status").isin(*SUCCESS) & F.col("objective_value").isNotNull() & ~F.isnan("objective_value")
    ranked = running(runs.where(good), "objective_value", {"rank": (F.lit(1), "sum")}, descending=not minimizes(metric), then=["run_index"])
    value_first = ranked.withColumn("rank", F.col("rank").cast("int"))
    return value_first.unionByName(runs.where(~F.coalesce(good, F.lit(False))).withColumn("rank", F.lit(None).cast("int")))


def best_runs(runs: DataFrame, k: int, metric: str = "objective") -> DataFrame:
    """The k best rows of the leaderboard; each task keeps k, without sorting all runs together."""
    good = F.lower("status").isin(*SUCCESS) & F.col("objective_value").isNotNull()
    return runs.where(good).orderBy(F.asc("objective_value") if minimizes(metric) else F.desc("objective_value"), "run_index").limit(k)


def work_status(status: DataFrame) -> DataFrame:
    return status.groupBy("state").agg(F.count("*").alias("jobs"))


def pending(work: DataFrame, status: DataFrame) -> DataFrame:
    """Work rows without a success."""
    return work.join(status.where("state = 'success'").select("work_id"), "work_id", "left_anti")


def split_by_patient(annotations: DataFrame, roles: Sequence[str], val_fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """annotations with dataset extended by a role that each patient keeps: dataset__role.

    Patients are ordered by a seeded MD5 and cut by the roles' ratios: the validation role gets val_fraction where there
    are several, the others share the rest; every role gets one patient as far as they last.
    """
    rest = [r for r in roles if r != "validation"]
    share = {r: 1 / len(roles) for r in roles} if "validation" not in roles or not rest else {r: val_fraction if r == "validation" else (1 - val_fraction) / len(rest) for r in roles}
    people = annotations.select("patient").distinct()
    n = people.count()
    sizes, left = [], n
    for i, role in enumerate(roles):
        after = len(roles) - i - 1
        size = left if not after else max(min(1, left), min(round(n * share[role]), left - after))
        sizes.append(size)
        left -= size
    role, end = F.lit(None).cast("string"), n
    for name, size in reversed(list(zip(roles, sizes, strict=True))):
        role = F.when(F.col("place") <= end, name).otherwise(role)
        end -= size
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), "patient"))
    # the first digits as a number cut the ranges, the whole text orders within them
    shuffled = people.withColumns({"draw": F.conv(F.substring(drawn, 1, 12), 16, 10).cast("long"), "drawn": drawn})
    placed = running(shuffled, "draw", {"place": (F.lit(1), "sum")}, then=["drawn", "patient"]).select("patient", role.alias("role"))
    return annotations.join(placed, "patient").withColumn("dataset", F.concat_ws("__", "dataset", "role"))


def normalized_roles(raw: str | Sequence[str], known: Sequence[str] = ("training", "validation", "testing")) -> list[str]:
    words = [raw] if isinstance(raw, str) else list(raw)
    return list(dict.fromkeys(x for w in words for x in (known if w.strip().lower() == "all" else [w.strip().lower()])))


def feature_level(features: DataFrame, tiles: DataFrame) -> DataFrame:
    """(slide, level): patch if there are as many feature rows as tiles and several, unknown for 1 and 1, slide for 1 and many."""
    f = features.groupBy("slide").agg(F.count("*").alias("f"))
    t = tiles.groupBy("slide").agg(F.count("*").alias("t"))
    level = F.when((F.col("f") == F.col("t")) & (F.col("f") > 1), "patch").when((F.col("f") == 1) & (F.col("t") == 1), "unknown").when((F.col("f") == 1) & (F.col("t") > 1), "slide").otherwise("invalid")
    return f.join(t, "slide", "full").na.fill(0, ["f", "t"]).select("slide", level.alias("level"))


def spec_matches(specs: DataFrame, expected: dict, tolerance: float = 1e-6) -> DataFrame:
    """specs with matches: each expected key equal, numbers with a fraction within the tolerance."""
    same = F.lit(True)
    for key, value in expected.items():
        one = F.abs(F.col(key) - F.lit(value)) <= tolerance if isinstance(value, float) else F.col(key) == F.lit(value)
        same = same & F.coalesce(one, F.lit(False))
    return specs.withColumn("matches", same)


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, n) of equal-width bins from the smallest to the largest value; the last bin is closed."""
    ends = values.agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"))
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / bins).otherwise(1.0)
    bin_ = F.least(F.floor((F.col(column) - F.col("low")) / F.col("width")).cast("int"), F.lit(bins - 1))
    rows = values.join(F.broadcast(ends.withColumn("width", width))).where(F.col(column).isNotNull()).withColumn("bin", bin_)
    return rows.groupBy("bin").agg(F.min(F.col("low") + F.col("bin") * F.col("width")).alias("low"), F.count("*").alias("n"))


def artifact_states(artifacts: DataFrame) -> DataFrame:
    """Counts by state, and the tiles of those included."""
    states = ("included", "missing", "corrupt", "unreadable")
    return artifacts.agg(*(F.count_if(F.col("state") == s).alias(s) for s in states), F.coalesce(F.sum(F.when(F.col("state") == "included", F.col("tiles"))), F.lit(0)).alias("tiles"))
