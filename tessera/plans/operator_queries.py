"""Queries of the file, store, slide, vector and identifier operators, with DuckDB SQL."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from tessera import scratch
from tessera.functions import registry, vectors
from tessera.operators import bags, grid, models, select, slides
from tessera.operators import relational as rel
from tessera.operators import task_metrics as tm
from tessera.plans import retrieval_queries
from tessera.plans.domain import SIDE, annotations, classified, survival, table, tiles, with_views
from tessera.sources import results, store, tables

K = 3  # prototypes of the mixture queries


def validated(spark, sf_dir):
    return rel.validated(annotations(spark, sf_dir).select("slide", "category"))


def annotations_csv(spark, sf_dir):
    """Written as CSV and read again."""
    path = scratch.folder(spark, "annotations")
    tables.write_annotations(annotations(spark, sf_dir).withColumn("time", F.length("slide") / 2), path)
    return tables.read_annotations(spark, path, None)


def _slide_notes(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    mpp = F.when(key % 7 == 0, "x").when(key % 5 == 0, "-1").when(key % 3 == 0, "0.5")
    return orders.select(
        F.concat(F.lit("d"), key % 2).alias("dataset"), F.concat(F.lit("W"), key).alias("slide"), F.concat(F.lit("P"), "o_custkey").alias("patient"), F.col("o_orderstatus").alias("category"),
        F.when(key % 11 == 0, F.concat(F.lit("/own/"), key)).alias("wsi_path"), mpp.alias("fallback_mpp"),
    )


def _slide_paths(spark, sf_dir):
    """A file for most slides, and a second one for some."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    first = orders.where("o_orderkey % 4 <> 0").select(F.concat(F.lit("/a/W"), key, F.lit(".svs")).alias("path"))
    return first.unionByName(orders.where("o_orderkey % 9 = 0").select(F.concat(F.lit("/b/W"), key, F.lit(".tif")).alias("path")))


def slide_samples(spark, sf_dir):
    return rel.wsi_samples(_slide_notes(spark, sf_dir), _slide_paths(spark, sf_dir), "d1")


def roi_files(spark, sf_dir):
    return tables.first_by_name(_slide_paths(spark, sf_dir), ["svs", "tif"])


def _stored(spark, sf_dir, where="true"):
    """A store that holds the tiles of some slides as features."""
    kept = store.Store(spark, scratch.folder(spark, "store"))
    rows = tiles(spark, sf_dir).where(where).select("slide", "tile_idx", F.concat(F.lit("t"), F.col("slide_no") % 2).alias("tiling_id"), F.lit("e").alias("extractor"), "vec")
    kept.write("features", rows)
    return kept


def store_features(spark, sf_dir):
    rows = _stored(spark, sf_dir).read("features", tiling_id="t1", extractor="e")
    return rows.select("slide", "tile_idx", F.posexplode("vec").alias("dim", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


def store_missing(spark, sf_dir):
    return _stored(spark, sf_dir, "slide_no % 3 <> 0").split("features", annotations(spark, sf_dir).select("slide"), ["slide"])[1]


def store_cached(spark, sf_dir):
    """A cache is filled with the rows that it lacks, and all are read."""
    kept, source = _stored(spark, sf_dir, "slide_no % 3 <> 0"), tiles(spark, sf_dir)

    def make(missing):
        rows = source.join(missing, "slide", "left_semi")
        return rows.select("slide", "tile_idx", F.lit("t9").alias("tiling_id"), F.lit("e").alias("extractor"), "vec")

    found = kept.get_or_create("features", annotations(spark, sf_dir).select("slide"), ["slide"], make, extractor="e")
    return found.groupBy("tiling_id").agg(F.count("*").alias("tiles"), F.count_distinct("slide").alias("slides"))


def store_replaced(spark, sf_dir):
    """Writing replaces the partitions that the rows touch and no others."""
    kept = _stored(spark, sf_dir)
    kept.write("features", tiles(spark, sf_dir).where("slide_no % 6 = 1").select("slide", "tile_idx", F.lit("t1").alias("tiling_id"), F.lit("e").alias("extractor"), "vec"))
    return kept.read("features").groupBy("tiling_id").agg(F.count("*").alias("tiles"))


def store_complete(spark, sf_dir):
    expected = annotations(spark, sf_dir).select("slide", F.lit(8).alias("rows"))
    return _stored(spark, sf_dir, "tile_idx > 0 OR slide_no % 2 = 0").complete("features", expected)


def store_specs(spark, sf_dir):
    """Tiling specifications, a row per slide, checked against an expected one."""
    kept = store.Store(spark, scratch.folder(spark, "specs"))
    notes = annotations(spark, sf_dir).withColumn("no", F.expr("int(substring(slide, 2))"))
    kept.write("tiling_specs", notes.select("slide", F.lit("t").alias("tiling_id"), (F.lit(256) + F.col("no") % 2).alias("tile_px"), (F.lit(0.5) + (F.col("no") % 3) * 1e-6).alias("mpp")))
    return rel.spec_matches(kept.read("tiling_specs"), {"tile_px": 256, "mpp": 0.5}, 1.5e-6).select("slide", "matches")


def heatmap_rows(spark, sf_dir):
    """A heatmap written under a name and read by it."""
    kept = store.Store(spark, scratch.folder(spark, "heatmaps"))
    rows = tiles(spark, sf_dir).select("slide", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("vec")[0].cast("double").alias("score"))
    kept.write("heatmaps", rows.withColumns({"bag_id": F.lit("b"), "name": F.lit("first")}))
    kept.write("heatmaps", rows.withColumns({"bag_id": F.lit("b"), "name": F.lit("second"), "score": -F.col("score")}))
    return kept.read("heatmaps", name="second").select("slide", "x", "y", F.round("score", 6).alias("score"))


def thumbnails(spark, sf_dir):
    """Encoded images as binary rows."""
    kept = store.Store(spark, scratch.folder(spark, "thumbnails"))
    kept.write("thumbnails", table(spark, sf_dir, "documents").select(F.concat(F.lit("D"), "doc_id").alias("slide"), F.encode("text", "UTF-8").alias("image")))
    return kept.read("thumbnails").select("slide", F.octet_length("image").cast("long").alias("bytes"), F.sha2("image", 256).alias("digest"))


def _rings(spark, sf_dir):
    square = slides.squares(tiles(spark, sf_dir), SIDE)
    return square.select("slide", F.array("polygon").alias("polygon"))


def _corners(polygons, by):
    ring = F.col("polygon")[0]
    return polygons.select(by, ring[0][0].alias("x0"), ring[0][1].alias("y0"), ring[2][0].alias("x1"), ring[2][1].alias("y1"))


def tissue_json(spark, sf_dir):
    return _corners(tables.polygons_from_json(tables.polygons_json(_rings(spark, sf_dir))), "slide")


def tissue_geojson(spark, sf_dir):
    """A feature collection in one file, polygons and multipolygons, read as polygons."""
    path = scratch.folder(spark, "geojson")
    rings = _rings(spark, sf_dir).withColumn("no", F.expr("int(substring(slide, 2))")).where("no < 20")
    single = F.to_json(F.struct(F.struct(F.lit("Polygon").alias("type"), F.col("polygon").alias("coordinates")).alias("geometry")))
    many = F.to_json(F.struct(F.struct(F.lit("MultiPolygon").alias("type"), F.array("polygon").alias("coordinates")).alias("geometry")))
    text = rings.agg(F.concat(F.lit('{"features": ['), F.array_join(F.collect_list(F.when(F.col("no") % 2 == 0, single).otherwise(many)), ","), F.lit("]}")).alias("value"))
    text.coalesce(1).write.text(path)
    found = _corners(tables.read_polygons(spark, path).withColumn("slide", F.lit("all")), "slide")
    return found.groupBy("x0", "y0", "x1", "y1").agg(F.count("*").alias("n"))


def results_csv(spark, sf_dir):
    path = scratch.folder(spark, "results")
    retrieval_queries.results_wide(spark, sf_dir).write.csv(path, header=True)
    return results.read(spark, path)


def metrics_csv(spark, sf_dir):
    path = scratch.folder(spark, "metrics")
    long = tm.long_form(tm.binary(classified(spark, sf_dir))).withColumns({"scope": F.lit("all"), "label": F.lit("-")})
    results.write_metrics(long, path)
    return spark.read.csv(path, header=True).select("metric", "scope", "label", F.round(F.col("value").cast("double"), 6).alias("value"))


def manifest(spark, sf_dir):
    path = scratch.folder(spark, "manifest")
    results.write_manifest(spark, path, {"task": "slide_retrieval", "depth": 10, "search": {"name": "yottixel", "exclusion": "patient"}})
    read = spark.read.schema("task string, depth int, search struct<name: string, exclusion: string>").json(path)
    return read.select("task", "depth", F.col("search.name").alias("search"), F.col("search.exclusion").alias("exclusion"))


def status_files(spark, sf_dir):
    """A status file for each job."""
    path = scratch.folder(spark, "status")
    n = F.col("n_nationkey")
    jobs = table(spark, sf_dir, "nation").select(F.format_string("job-%02d", n).alias("work_id"), F.lit("features").alias("stage"), F.when(n % 3 == 0, "success").otherwise("failed").alias("state"), F.when(n % 3 != 0, F.col("n_name")).alias("error"))
    jobs.write.option("maxRecordsPerFile", 1).json(path)
    return tables.read_status(spark, path).select("work_id", "stage", "state", "error")


def run_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_index"), F.create_map(F.lit("px"), F.lit("256"), F.lit("type"), "event_type").alias("params"))
    return slides.summary_rows(rows, ["type", "px", "mpp"], task="mil")


def trial_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), F.col("p_size").alias("params_size"), F.col("p_brand").alias("params_brand"))
    return slides.trial_rows(rows)


def targets(task):
    def run(spark, sf_dir):
        if task == "survival":
            rows = survival(spark, sf_dir).select("id", F.col("time").cast("string").alias("os_time"), F.col("event").cast("string").alias("os_event"))
            return slides.with_target(rows, "survival").select("id", "target.time", "target.event")
        rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("category"))
        return slides.with_target(rows, task).select("p_partkey", "target")

    return run


def role_split(spark, sf_dir):
    key = F.col("c_custkey")
    items = table(spark, sf_dir, "customer").select(F.concat(F.lit("I"), key).alias("sample_id"), F.when(key % 3 == 0, "query").when(key % 3 == 1, "reference").when(key % 2 == 0, "query_reference").otherwise("ignore").alias("used_for"))
    queries, refs = rel.split_roles(items)
    return queries.select("sample_id", F.lit("query").alias("role")).unionByName(refs.select("sample_id", F.lit("reference").alias("role")))


def _datasets(spark, sf_dir):
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.when(key % 3 == 0, "training").when(key % 3 == 1, "testing").otherwise("validation").alias("used_for"))


def datasets_by_role(spark, sf_dir):
    return rel.by_role(_datasets(spark, sf_dir)).select("used_for", F.array_join("datasets", ",").alias("datasets"))


def unknown_datasets(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("no "), "n_name")).otherwise(F.col("n_name")).alias("dataset"))
    return rel.unknown_datasets(wanted, _datasets(spark, sf_dir))


def catalogue(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.when(key % 5 != 0, F.concat(F.lit("f"), key, F.lit(".svs"))).alias("file_name"), F.concat(F.lit("u"), key).alias("series_uid"), F.when(key % 3 == 0, F.concat(F.lit("C"), "o_custkey")).alias("submitter_id"),
        F.concat(F.lit("K"), "o_custkey").alias("case_id"), F.col("o_orderstatus").alias("label"), F.when(key % 7 == 0, F.concat(F.lit("/l/"), key)).alias("local_path"),
    )
    return rel.standardized(rows, "remote", "/data").select("slide", "patient", "category", "wsi_path", "source")


def results_subset(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"))
    return slides.subset(rows, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey"))


def tile_grid(spark, sf_dir):
    width, height = (F.expr(f"int(o_orderkey % {m})") * 64 + 100 for m in (13, 9))
    return slides.tile_grid(table(spark, sf_dir, "orders").select(F.concat(F.lit("W"), "o_orderkey").alias("slide"), width.alias("width"), height.alias("height")), SIDE)


def slide_mpp(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.when(key % 2 == 0, "0").when(key % 3 == 0, "none").otherwise("0.25").alias("slide_mpp"), F.when(key % 5 == 0, "-1").when(key % 7 != 0, "0.5").alias("fallback_mpp"))
    return slides.base_mpp(rows).select("o_orderkey", "mpp", slides.resolution_allowed(F.lit(0.4995), F.col("mpp")).alias("allowed"))


def heatmap_runs(spark, sf_dir):
    rows = tiles(spark, sf_dir).withColumn("level", F.floor((F.col("vec")[0] + 1) * 2))
    return slides.merged_runs(rows, "level", SIDE)


def tile_pixels(spark, sf_dir):
    rows = tiles(spark, sf_dir).withColumns({"read_w": F.lit(SIDE) + F.col("tile_idx"), "read_h": F.col("tile_idx")})
    return slides.to_pixels(rows, 24.0, 40.0).select("slide", "tile_idx", "px", "py", "pw", "ph")


def tile_squares(spark, sf_dir):
    rows = slides.squares(tiles(spark, sf_dir), SIDE)
    return rows.select("slide", "tile_id", F.size("polygon").alias("points"), F.col("polygon")[2][0].alias("x1"), F.col("polygon")[2][1].alias("y1"))


def tile_shapes(spark, sf_dir):
    rows = tiles(spark, sf_dir).select("slide", F.col("tile_idx").cast("string").alias("tile_id"), "x0", "y0", F.lit(SIDE).alias("tile_px"), (F.lit(1.0) + F.col("tile_idx") / 8).alias("downsample"))
    return store.pad_shapes(rows).select("slide", "tile_no", "read_w", "read_h", F.col("polygon")[2][0].alias("x1"))


def default_tile_size(spark, sf_dir):
    return rel.median_size(table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("int") - 5).alias("w")), "w")


def top_tiles(spark, sf_dir):
    rows = tiles(spark, sf_dir).withColumn("score", F.col("vec")[1].cast("double"))
    return slides.top_tiles(rows, "score", 3).select("slide", "tile_idx", "rank")


def tiles_overview(spark, sf_dir):
    states = F.when(F.col("o_orderstatus") == "F", "included").when(F.col("o_orderstatus") == "O", "missing").when(F.col("o_orderkey") % 2 == 0, "corrupt").otherwise("unreadable")
    return rel.artifact_states(table(spark, sf_dir, "orders").select(states.alias("state"), (F.col("o_orderkey") % 50).alias("tiles")))


def bag_metadata(spark, sf_dir):
    found = bags.metadata(annotations(spark, sf_dir), "patient", ["slide", "category", "dataset"])
    return found.select("sample_id", *(F.array_join(c, ",").alias(c) for c in ("slide", "category", "dataset")))


def bag_dataset(spark, sf_dir):
    rows = bags.dataset(annotations(spark, sf_dir), tiles(spark, sf_dir), "patient", "classification", 6)
    return rows.select("sample_id", "position", "slide", "tile_idx")


def bag_problems(spark, sf_dir):
    rows = tiles(spark, sf_dir).select(F.col("slide").alias("sample_id"), F.when(F.expr("slide_no % 5 = 0 AND tile_idx = 3"), F.slice("vec", 1, 7)).when(F.expr("slide_no % 7 = 0 AND tile_idx = 2"), F.transform("vec", lambda x: F.lit(float("inf")).cast("float"))).otherwise(F.col("vec")).alias("vec"))
    return bags.schema_problems(rows).select("sample_id")


def ensemble(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_returnflag").alias("class"), F.col("l_discount").cast("double").alias("logit"))
    return bags.ensemble(rows).withColumn("logit", F.round("logit", 6))


def heatmap_scores(spark, sf_dir):
    rows = tiles(spark, sf_dir).select("slide", "tile_idx", F.col("vec")[0].cast("double").alias("score"), (F.col("tile_idx") % 3 != 0).alias("mask"))
    return bags.normalized_scores(rows, "score", "mask").select("slide", "tile_idx", F.round("scaled", 6).alias("scaled"))


def heatmap_raster(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40 - 3).alias("x"), (F.col("p_partkey") % 23).alias("y"), (F.col("p_size") % 5 + 1).alias("w"), (F.col("p_size") % 4 + 1).alias("h"), F.col("p_retailprice").cast("double").alias("score"))
    return vectors.rasterized(rows, 32, 16).withColumn("score", F.round("score", 4))


def heatmap_blurred(spark, sf_dir):
    rows = tiles(spark, sf_dir).select("slide", (F.col("x0") / SIDE).cast("int").alias("px"), (F.col("y0") / SIDE).cast("int").alias("py"), (F.col("vec")[0].cast("double") + 2).alias("score"))
    found = slides.blurred(rows, 1.0).withColumn("score", F.round("score", 5))
    return found.where("score > 0.001")


def mean_rgb(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_orderkey") % 50).alias("slide"), F.col("l_linenumber").alias("tile_idx"), (q * 5).alias("r"), (q * 3).alias("g"), (q + 7).alias("b"))
    return slides.mean_rgb(rows).select("slide", "tile_idx", *(F.round(F.col("vec")[i], 6).alias(c) for i, c in enumerate("rgb")))


def flattened(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.struct("n_nationkey", F.struct("n_name").alias("of")).alias("nation"), F.array("n_regionkey", "n_nationkey").alias("keys"))
    return slides.flattened(rows, "_")


def work_records(spark, sf_dir):
    features = table(spark, sf_dir, "region").select(F.concat(F.lit("features-"), "r_regionkey").alias("work_id"))
    found = slides.work_records(grid.product(spark, {"a": [1, 2, 3], "b": ["x", "y"]}), features)
    return found.select("work_id", "stage", F.array_join("dependencies", ",").alias("dependencies"))


def combos_by_bag(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("combo_index"), F.concat_ws("__", F.col("p_size").cast("string"), "p_brand").alias("bag_id"))
    return grid.by_bag(rows).select("bag_id", F.array_join("combos", ",").alias("combos"))


def first_tilings(spark, sf_dir):
    return grid.first_seen(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("combo_index"), F.col("p_size").cast("string").alias("tiling_id")), "tiling_id")


def bundle(spark, sf_dir):
    parts = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("tile_px"), F.col("n_regionkey").alias("extractor"))
    return grid.one_bundle(parts, tile_px=7)


def hashes(kind):
    make = {"canonical": grid.canonical_hash, "run": grid.run_hash, "safe": grid.safe_name}[kind]
    return lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey", make(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("!"))).alias("value"))


def representation_ids(spark, sf_dir):
    made = [(f"F{k}", grid.representation_id(f"F{k}", "Mosaic", {"percent": k, "clusters": 9})) for k in range(5)]
    return spark.createDataFrame(made, "feature string, representation_id string")


def metric_requests(spark, sf_dir):
    names = ["hit_at_5", "MAP_at_10", " precision_at_1 ", "auroc", "macro_f1_at_3"]
    made = [(n, *(lambda m, p: (m, p.get("k")))(*grid.metric_request(n))) for n in names]
    return spark.createDataFrame(made, "name string, metric string, k int")


def hyperparameters(spark, sf_dir):
    given = [{"k": "7"}, {}, {"k": 99}, {"k": -4}]
    parameter = registry.Parameter(int, 5, low=1, high=20)
    made = [(i, grid.hyperparameter("k", int, 5, g, low=1, high=20), parameter.resolve("k", g)) for i, g in enumerate(given)]
    return spark.createDataFrame(made, "case_no int, value int, declared int")


def search_spaces(spark, sf_dir):
    lists = {"lr": [0.1, 0.2], "seed": [1, 2], "px": [256], "norm": ["a", "b", "c"]}
    space = grid.search_space(lists, {"dropout": {"type": "float", "low": 0.0, "high": 0.5}})
    return spark.createDataFrame([(k, v["type"], json.dumps(v.get("choices"))) for k, v in space.items()], "name string, kind string, choices string")


def roles(spark, sf_dir):
    made = [(i, ",".join(rel.normalized_roles(raw))) for i, raw in enumerate(["All", ["Training", " testing"], "validation", ["all", "extra", "training"]])]
    return spark.createDataFrame(made, "case_no int, roles string")


def registry_entries(spark, sf_dir):
    found = [(r.kind, name) for r in (registry.representations, registry.searches) for name in r.names()]
    found += [("metric", registry.metrics.resolve("slide-retrieval", f"{m}_at_3")[0].__name__) for m in ("hit", "precision", "map", "mmv", "macro_f1")]
    return spark.createDataFrame(found, "kind string, name string")


def prototype_names(spark, sf_dir):
    parts = [slides.prototype_labels(spark.createDataFrame([(text,)], "value string"), 2).withColumn("form", F.lit(i)) for i, text in enumerate(('["a", "exclude"]', '{"0": "a", "1": "exclude"}', '[{"id": 1, "label": "exclude"}, {"id": 0, "label": "a"}]'))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _pairs(spark, sf_dir, make):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", make(F.col("embedding")).alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), make(F.col("embedding")).alias("b")), "vec_id")


def packed_hamming(spark, sf_dir):
    rows = _pairs(spark, sf_dir, lambda v: vectors.packed(vectors.signs(v)))
    return rows.select("vec_id", F.size("a").alias("words"), vectors.hamming_packed(F.col("a"), F.col("b")).alias("distance"))


def rising_bits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.size(F.filter(vectors.rises(F.col("embedding")), lambda b: b)).cast("long").alias("rises"))


def latent_keys(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    level = lambda i: F.floor((F.col("embedding")[i].cast("double") + 1) * 100)
    codes = F.transform(F.slice("embedding", 1, 6), lambda x: F.floor((x.cast("double") + 1) * 2).cast("int"))
    return e.select("vec_id", vectors.latent_key(level(0), level(1), level(2)).alias("key"), F.array_join(vectors.remapped(codes, {0: 5, 1: 6, 2: 9}), ",", "-").alias("codes"))


def joint_masks(spark, sf_dir):
    rows = _pairs(spark, sf_dir, lambda v: F.transform(F.slice(v, 1, 4), lambda x: x > 0.02))
    values = F.array(*(F.lit(float(x)) for x in (3, 1, 2, 5)))
    joint = vectors.joint_mask(F.col("a"), F.col("b"))
    kept = vectors.masked_or_all(values, joint)
    return rows.select("vec_id", F.array_join(F.transform(joint, lambda x: x.cast("int").cast("string")), "").alias("mask"), F.round(vectors.softmin(kept, 0.5), 6).alias("softmin"), F.round(vectors.safe_mean(kept), 6).alias("mean"))


def _hazard_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double") * 4).alias("logits"), F.array(*(F.lit(w) for w in (1.0, 2.0, 4.0, 1.0, 0.5, 3.0))).alias("widths"))


def hazards(spark, sf_dir):
    rows = _hazard_rows(spark, sf_dir).withColumn("h", vectors.hazards(F.col("logits"), F.col("widths")))
    tau = (F.col("vec_id") % 9 - 1) / 1.0
    return rows.select("vec_id", F.round(vectors.cumulative_hazard(F.col("h"), tau), 6).alias("cumulative"), F.round(vectors.discrete_risk(F.col("h")), 6).alias("risk"))


def discrete_survival(spark, sf_dir):
    rows = _hazard_rows(spark, sf_dir).withColumn("s", vectors.discrete_survival(F.transform("logits", vectors.sigmoid)))
    return rows.select("vec_id", F.posexplode("s").alias("bin", "survival")).withColumn("survival", F.round("survival", 6))


def survival_times(spark, sf_dir):
    rows = survival(spark, sf_dir).select("id", F.when(F.col("id") % 3 != 0, F.col("time")).alias("exact"), F.floor(F.col("time") / 400).alias("bin"))
    return slides.survival_times(rows, "exact", "bin").select("id", "time")


def class_probabilities(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda x: F.round(x.cast("double"), 4) * 5).alias("logits"))
    rows = rows.withColumn("p", vectors.softmax(F.col("logits")))
    return rows.select("vec_id", vectors.argmax(F.col("p")).alias("predicted"), F.round(F.array_max("p"), 6).alias("probability"))


def metrics_long(spark, sf_dir):
    return tm.long_form(tm.binary(classified(spark, sf_dir)), ["accuracy", "f1", "brier"]).withColumn("value", F.round("value", 6))


def linear_model(spark, sf_dir):
    """Least squares of price on size, by a fitted pipeline."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sample_id"), (F.col("p_retailprice").cast("double") / 1000).alias("label"), F.array(F.col("p_size").cast("double")).alias("v"))
    pooled = rows.select("sample_id", F.posexplode("v").alias("dim", "value"))
    train = models.slide_vectors(pooled).join(rows.select("sample_id", "label"), "sample_id")
    return models.evaluate(models.fit("linear_regression", train), train, "regression").select(*(F.round(c, 3).alias(c) for c in ("mae", "mse", "rmse", "r2")))


def _prototypes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < K).orderBy("vec_id").collect()  # K rows
    return np.array([r.embedding for r in rows], np.float64)


def mixture_groups(spark, sf_dir):
    found = select.mixtures(tiles(spark, sf_dir), _prototypes(spark, sf_dir))
    return found.select("slide", "tile_idx", "top", F.round("top_prob", 4).alias("top_prob"))


def mixture_embedding(spark, sf_dir):
    found = select.embeddings(tiles(spark, sf_dir), _prototypes(spark, sf_dir))
    each = found.select("slide", "proto", "prob", F.posexplode(F.arrays_zip("mean", "cov")).alias("dim", "x"))
    return each.select("slide", "proto", F.round("prob", 5).alias("prob"), "dim", F.round("x.mean", 4).alias("mean"), F.round("x.cov", 4).alias("cov"))


def splice_tiles(spark, sf_dir):
    found = select.per_bag(tiles(spark, sf_dir), select.splice)
    return found.select("slide", "tile_idx", "group", "selected")


QUERIES = {
    "annotations_validated": validated, "annotations_csv": annotations_csv, "slide_samples": slide_samples, "roi_files": roi_files, "store_features": store_features,
    "store_missing": store_missing, "store_cached": store_cached, "store_replaced": store_replaced, "store_complete": store_complete, "store_specs": store_specs,
    "heatmap_rows": heatmap_rows, "thumbnail_images": thumbnails, "tissue_json": tissue_json, "tissue_geojson": tissue_geojson, "results_csv": results_csv,
    "metrics_csv": metrics_csv, "results_manifest": manifest, "status_files": status_files, "run_summary": run_summary, "trial_rows": trial_rows,
    "target_survival": targets("survival"), "target_class": targets("classification"), "target_value": targets("regression"), "role_split": role_split,
    "datasets_by_role": datasets_by_role, "datasets_unknown": unknown_datasets, "catalogue_standardized": catalogue, "results_subset": results_subset,
    "tile_grid": tile_grid, "slide_mpp": slide_mpp, "heatmap_runs": heatmap_runs, "tile_pixels": tile_pixels, "tile_squares": tile_squares, "tile_shapes": tile_shapes,
    "tile_default_size": default_tile_size, "tile_top": top_tiles, "tiles_overview": tiles_overview, "bag_metadata": bag_metadata, "bag_dataset": bag_dataset,
    "bag_problems": bag_problems, "bag_ensemble": ensemble, "heatmap_scores": heatmap_scores, "heatmap_raster": heatmap_raster, "heatmap_blurred": heatmap_blurred,
    "tile_mean_rgb": mean_rgb, "flattened_rows": flattened, "work_records": work_records, "combos_by_bag": combos_by_bag, "tilings_first_seen": first_tilings,
    "prototype_bundle": bundle, "hash_canonical": hashes("canonical"), "hash_run": hashes("run"), "name_safe": hashes("safe"), "representation_ids": representation_ids,
    "metric_requests": metric_requests, "hyperparameters": hyperparameters, "search_spaces": search_spaces, "roles_normalized": roles, "registry_entries": registry_entries,
    "prototype_names": prototype_names, "vector_packed_hamming": packed_hamming, "vector_rises": rising_bits, "latent_keys": latent_keys, "joint_masks": joint_masks,
    "surv_hazards": hazards, "surv_discrete": discrete_survival, "surv_times": survival_times, "class_probabilities": class_probabilities, "metrics_long": metrics_long,
    "slide_model_linear": linear_model, "mixture_groups": mixture_groups, "mixture_embedding": mixture_embedding, "splice_tiles": splice_tiles,
}

_SQUARE = f"x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x0 + {SIDE})::DOUBLE AS x1, (y0 + {SIDE})::DOUBLE AS y1"
_STORED = "f AS (SELECT *, 't' || (slide_no % 2) AS tiling_id FROM tiles)"
_PATHS = "paths AS (SELECT 'W' || o_orderkey AS stem, '/a/W' || o_orderkey || '.svs' AS path FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT 'W' || o_orderkey, '/b/W' || o_orderkey || '.tif' FROM orders WHERE o_orderkey % 9 = 0)"
_HAZARD = "l AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: x::DOUBLE * 4) AS logits, [1.0, 2.0, 4.0, 1.0, 0.5, 3.0]::DOUBLE[] AS w FROM embeddings), h AS (SELECT vec_id, logits, list_transform(range(1, 7), lambda i: -ln(1 - least(greatest(1 / (1 + exp(-logits[i])), 1e-7), 1 - 1e-7)) / w[i]) AS h FROM l)"
_BINARY = "c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p >= 0.5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (p < 0.5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (p < 0.5 AND y = 0)::DOUBLE AS tn, avg((p - y) ** 2) AS b FROM classified), m AS (SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, 2 * tp / (2 * tp + fp + fn) AS f1, b AS brier FROM c)"


def _values(names: str, rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({names})"


def _mixture(steps: int = 10, tau: float = 10.0, eps: float = 0.1) -> str:
    """The mixture of each slide, step by step: p0, m0 are the start; r_i the shares under p_i, m_i."""
    parts = [
        "x AS (SELECT slide, tile_idx, i, vec[i]::DOUBLE AS x FROM tiles, (SELECT unnest(range(1, 65)) AS i))",
        f"proto AS (SELECT vec_id AS k, i, embedding[i]::DOUBLE AS c FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id < {K})",
        f"p0 AS (SELECT DISTINCT slide, k, 1.0::DOUBLE / {K} AS p FROM tiles, (SELECT DISTINCT k FROM proto))",
        f"m0 AS (SELECT slide, k, i, c AS m, {eps}::DOUBLE AS v FROM (SELECT DISTINCT slide FROM tiles), proto)",
    ]
    for n in range(steps + 1):
        parts.append(f"g{n} AS MATERIALIZED (SELECT slide, tile_idx, k, ln(greatest(any_value(p), 1e-12)) - 0.5 * sum(ln(2 * pi() * greatest(v, 1e-8)) + (x - m) ** 2 / greatest(v, 1e-8)) AS g FROM x JOIN m{n} USING (slide, i) JOIN p{n} USING (slide, k) GROUP BY ALL)")
        parts.append(f"r{n} AS MATERIALIZED (SELECT slide, tile_idx, k, exp(g - top) / sum(exp(g - top)) OVER (PARTITION BY slide, tile_idx) AS r FROM (SELECT *, max(g) OVER (PARTITION BY slide, tile_idx) AS top FROM g{n}))")
        if n < steps:
            parts.append(f"w{n} AS (SELECT slide, k, sum(r) + {tau} AS w FROM r{n} GROUP BY ALL)")
            parts.append(f"p{n + 1} AS MATERIALIZED (SELECT slide, k, w / sum(w) OVER (PARTITION BY slide) AS p FROM w{n})")
            parts.append(f"m{n + 1} AS MATERIALIZED (SELECT slide, k, i, m, greatest(s - m * m, 1e-8) AS v FROM (SELECT slide, k, i, (sum(r * x) + {tau} * any_value(c)) / any_value(w) AS m, (sum(r * x * x) + {tau} * (any_value(c) ** 2 + {eps})) / any_value(w) AS s FROM x JOIN r{n} USING (slide, tile_idx) JOIN proto USING (k, i) JOIN w{n} USING (slide, k) GROUP BY ALL))")
    return with_views("tiles", *parts)


_REPRESENTATIONS = "SELECT 'F' || k AS feature, 'f' || k || '_mosaic_' || substr(sha1('{\"clusters\":9,\"percent\":' || k || '}'), 1, 16) AS representation_id FROM range(5) r(k)"

ORACLES = {
    "results_csv": retrieval_queries.ORACLES["results_long"],
    "annotations_validated": with_views("annotations") + "SELECT slide, category, slide AS patient, 'default' AS dataset FROM annotations",
    "annotations_csv": with_views("annotations") + "SELECT *, length(slide) / 2.0::DOUBLE AS time FROM annotations",
    "slide_samples": f"""WITH {_PATHS}, one AS (SELECT stem, min(path) AS found FROM paths GROUP BY 1 HAVING count(*) = 1),
      n AS (SELECT 'W' || o_orderkey AS slide, 'P' || o_custkey AS patient, o_orderstatus AS category, CASE WHEN o_orderkey % 11 = 0 THEN '/own/' || o_orderkey END AS own,
        CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 THEN 0.5::DOUBLE END AS fallback_mpp FROM orders WHERE o_orderkey % 2 = 1)
      SELECT slide, patient, category, coalesce(own, found) AS path, fallback_mpp FROM n LEFT JOIN one ON stem = slide WHERE coalesce(own, found) IS NOT NULL""",
    "roi_files": f"WITH {_PATHS} SELECT stem AS slide, min(path) AS path FROM paths GROUP BY 1",
    "store_features": with_views("tiles") + "SELECT slide, tile_idx, i - 1 AS dim, round(vec[i]::DOUBLE, 6) AS value FROM tiles, (SELECT unnest(range(1, 65)) AS i) WHERE slide_no % 2 = 1",
    "store_missing": with_views("annotations") + "SELECT slide FROM annotations WHERE CAST(substr(slide, 2) AS INT) % 3 = 0",
    "store_cached": with_views("tiles") + "SELECT CASE WHEN slide_no % 3 <> 0 THEN 't' || (slide_no % 2) ELSE 't9' END AS tiling_id, count(*) AS tiles, count(DISTINCT slide) AS slides FROM tiles GROUP BY 1",
    "store_replaced": with_views("tiles", _STORED) + "SELECT tiling_id, count(*) AS tiles FROM f WHERE slide_no % 2 = 0 OR slide_no % 6 = 1 GROUP BY 1",
    "store_complete": with_views("tiles") + "SELECT slide, count(*) FILTER (tile_idx > 0 OR slide_no % 2 = 0) = 8 AS complete FROM tiles GROUP BY 1",
    "store_specs": with_views("annotations") + "SELECT slide, CAST(substr(slide, 2) AS INT) % 2 = 0 AND CAST(substr(slide, 2) AS INT) % 3 <> 2 AS matches FROM annotations",
    "heatmap_rows": with_views("tiles") + "SELECT slide, x0 AS x, y0 AS y, round(-(vec[1]::DOUBLE), 6) AS score FROM tiles",
    "thumbnail_images": "SELECT 'D' || doc_id AS slide, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS digest FROM documents",
    "tissue_json": with_views("tiles") + f"SELECT slide, {_SQUARE} FROM tiles",
    "tissue_geojson": with_views("tiles") + f"SELECT x0, y0, x1, y1, count(*) AS n FROM (SELECT {_SQUARE} FROM tiles WHERE slide_no < 20) GROUP BY ALL",
    "metrics_csv": with_views("classified", _BINARY) + "SELECT metric, 'all' AS scope, '-' AS label, round(value, 6) AS value FROM (UNPIVOT m ON accuracy, balanced_accuracy, f1, brier INTO NAME metric VALUE value)",
    "results_manifest": "SELECT 'slide_retrieval' AS task, 10 AS depth, 'yottixel' AS search, 'patient' AS exclusion",
    "status_files": "SELECT printf('job-%02d', n_nationkey) AS work_id, 'features' AS stage, CASE WHEN n_nationkey % 3 = 0 THEN 'success' ELSE 'failed' END AS state, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS error FROM nation",
    "run_summary": "SELECT event_id AS run_index, event_type AS type, '256' AS px, CAST(NULL AS VARCHAR) AS mpp, 'mil' AS task FROM events",
    "trial_rows": "SELECT p_partkey AS number, p_size AS size, p_brand AS brand FROM part",
    "target_survival": with_views("survival") + "SELECT id, time, event FROM survival",
    "target_class": "SELECT p_partkey, p_size::BIGINT AS target FROM part",
    "target_value": "SELECT p_partkey, p_size::DOUBLE AS target FROM part",
    "role_split": "WITH i AS (SELECT 'I' || c_custkey AS sample_id, CASE WHEN c_custkey % 3 = 0 THEN 'query' WHEN c_custkey % 3 = 1 THEN 'reference' WHEN c_custkey % 2 = 0 THEN 'both' END AS u FROM customer) SELECT sample_id, 'query' AS role FROM i WHERE u IN ('query', 'both') UNION ALL SELECT sample_id, 'reference' FROM i WHERE u IN ('reference', 'both')",
    "datasets_by_role": "SELECT CASE n_nationkey % 3 WHEN 0 THEN 'training' WHEN 1 THEN 'testing' ELSE 'validation' END AS used_for, string_agg(n_name, ',' ORDER BY n_name) AS datasets FROM nation GROUP BY 1",
    "datasets_unknown": "SELECT 'no ' || n_name AS dataset FROM nation WHERE n_nationkey % 4 = 0",
    "catalogue_standardized": """SELECT CASE WHEN o_orderkey % 5 <> 0 THEN 'f' || o_orderkey ELSE 'u' || o_orderkey END AS slide, CASE WHEN o_orderkey % 3 = 0 THEN 'C' || o_custkey ELSE 'K' || o_custkey END AS patient, o_orderstatus AS category,
      CASE WHEN o_orderkey % 7 = 0 THEN '/l/' || o_orderkey WHEN o_orderkey % 5 <> 0 THEN '/data/f' || o_orderkey || '.svs' ELSE 'u' || o_orderkey || '.zip' END AS wsi_path, 'remote' AS source FROM orders""",
    "results_subset": "SELECT l_orderkey AS query_id, l_linenumber AS rank FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "tile_grid": f"WITH s AS (SELECT 'W' || o_orderkey AS slide, ((o_orderkey % 13) * 64 + 100) // {SIDE} AS c, ((o_orderkey % 9) * 64 + 100) // {SIDE} AS r FROM orders), g AS (SELECT slide, c, r, unnest(range(c * r)) AS tile_idx FROM s WHERE c > 0 AND r > 0) SELECT slide, tile_idx, (tile_idx % c) * {SIDE} AS x0, (tile_idx // c) * {SIDE} AS y0 FROM g",
    "slide_mpp": "WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 THEN 0.25::DOUBLE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN 0.5::DOUBLE END AS mpp FROM orders) SELECT o_orderkey, mpp, 0.4995 >= mpp OR mpp = 0.5 AS allowed FROM m",
    "heatmap_runs": with_views("tiles") + f", l AS (SELECT slide, floor((vec[1] + 1) * 2)::BIGINT AS level, x0, y0 FROM tiles), r AS (SELECT *, x0 - {SIDE} * row_number() OVER (PARTITION BY slide, level, y0 ORDER BY x0) AS run FROM l) SELECT slide, level, y0, min(x0) AS x0, max(x0) + {SIDE} AS x1 FROM r GROUP BY slide, level, y0, run",
    "tile_pixels": with_views("tiles") + f"SELECT slide, tile_idx, round_even(x0 / 24.0, 0)::INT AS px, round_even(y0 / 40.0, 0)::INT AS py, greatest(round_even(({SIDE} + tile_idx) / 24.0, 0)::INT, 1) AS pw, greatest(round_even(tile_idx / 40.0, 0)::INT, 1) AS ph FROM tiles",
    "tile_squares": with_views("tiles") + f"SELECT slide, tile_idx::VARCHAR AS tile_id, 5 AS points, (x0 + {SIDE})::DOUBLE AS x1, (y0 + {SIDE})::DOUBLE AS y1 FROM tiles",
    "tile_shapes": with_views("tiles") + f"SELECT slide, tile_idx AS tile_no, {SIDE} + 32 * tile_idx AS read_w, {SIDE} + 32 * tile_idx AS read_h, (x0 + {SIDE} + 32 * tile_idx)::DOUBLE AS x1 FROM tiles",
    "tile_default_size": "SELECT greatest(coalesce(median(w) FILTER (w > 0), 1), 1)::DOUBLE AS size FROM (SELECT l_quantity::INT - 5 AS w FROM lineitem)",
    "tile_top": with_views("tiles") + "SELECT slide, tile_idx, rank FROM (SELECT slide, tile_idx, row_number() OVER (PARTITION BY slide ORDER BY vec[2] DESC, tile_idx) AS rank FROM tiles) WHERE rank <= 3",
    "tiles_overview": "SELECT count(*) FILTER (o_orderstatus = 'F') AS included, count(*) FILTER (o_orderstatus = 'O') AS missing, count(*) FILTER (o_orderstatus NOT IN ('F', 'O') AND o_orderkey % 2 = 0) AS corrupt, count(*) FILTER (o_orderstatus NOT IN ('F', 'O') AND o_orderkey % 2 <> 0) AS unreadable, coalesce(sum(o_orderkey % 50) FILTER (o_orderstatus = 'F'), 0)::BIGINT AS tiles FROM orders",
    "bag_metadata": with_views("annotations") + "SELECT patient AS sample_id, string_agg(DISTINCT slide, ',' ORDER BY slide) AS slide, string_agg(DISTINCT category, ',' ORDER BY category) AS category, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS dataset FROM annotations GROUP BY 1",
    "bag_dataset": with_views("annotations tiles") + ", bag AS (SELECT patient AS sample_id, row_number() OVER (PARTITION BY patient ORDER BY slide, tile_idx) - 1 AS place, slide, tile_idx, count(*) OVER (PARTITION BY patient) AS n FROM annotations JOIN tiles USING (slide)), w AS (SELECT DISTINCT sample_id, n, unnest(range(6)) AS position FROM bag) SELECT sample_id, position, slide, tile_idx FROM (SELECT sample_id, position, CASE WHEN n >= 6 THEN round_even(position * (n - 1) / 5.0, 0)::BIGINT ELSE position % n END AS place FROM w) JOIN bag USING (sample_id, place)",
    "bag_problems": with_views("tiles") + "SELECT slide AS sample_id FROM tiles GROUP BY slide HAVING bool_or(slide_no % 5 = 0 AND tile_idx = 3) AND count(*) > 1 OR bool_or(slide_no % 7 = 0 AND tile_idx = 2)",
    "bag_ensemble": "SELECT l_orderkey AS sample_id, l_returnflag AS class, round(avg(l_discount::DOUBLE), 6) AS logit FROM lineitem GROUP BY ALL",
    "heatmap_scores": with_views("tiles") + ", s AS (SELECT slide, tile_idx, CASE WHEN tile_idx % 3 <> 0 THEN vec[1]::DOUBLE END AS x FROM tiles) SELECT slide, tile_idx, round(coalesce((x - min(x) OVER (PARTITION BY slide)) / greatest(max(x) OVER (PARTITION BY slide) - min(x) OVER (PARTITION BY slide), 1e-12), 0), 6) AS scaled FROM s",
    "heatmap_raster": "WITH r AS (SELECT p_partkey % 40 - 3 AS x, p_partkey % 23 AS y, p_size % 5 + 1 AS w, p_size % 4 + 1 AS h, p_retailprice::DOUBLE AS s FROM part), px AS (SELECT px, py FROM range(32) a(px), range(16) b(py)) SELECT px, py, round(avg(s), 4) AS score FROM px JOIN r ON px >= x AND px < x + w AND py >= y AND py < y + h GROUP BY ALL",
    "heatmap_blurred": with_views("tiles") + f", k AS (SELECT d, exp(-0.5 * d * d) / sum(exp(-0.5 * d * d)) OVER () AS k FROM range(-3, 4) r(d)), s AS (SELECT slide, x0 // {SIDE} AS px, y0 // {SIDE} AS py, vec[1]::DOUBLE + 2 AS s FROM tiles) SELECT * FROM (SELECT slide, (px + a.d)::INT AS px, (py + b.d)::INT AS py, round(sum(s * a.k * b.k), 5) AS score FROM s, k a, k b GROUP BY ALL) WHERE score > 0.001",
    "tile_mean_rgb": "SELECT 'S' || (l_orderkey % 50) AS slide, l_linenumber AS tile_idx, round(avg(l_quantity::INT * 5 / 255.0::DOUBLE), 6) AS r, round(avg(l_quantity::INT * 3 / 255.0::DOUBLE), 6) AS g, round(avg((l_quantity::INT + 7) / 255.0::DOUBLE), 6) AS b FROM lineitem GROUP BY ALL",
    "flattened_rows": "SELECT n_nationkey AS nation_n_nationkey, n_name AS nation_of_n_name, '[' || n_regionkey || ',' || n_nationkey || ']' AS keys FROM nation",
    "work_records": "SELECT printf('benchmark-%05d', i) AS work_id, 'benchmark' AS stage, (SELECT string_agg('features-' || r_regionkey, ',' ORDER BY 'features-' || r_regionkey) FROM region) AS dependencies FROM range(6) r(i)",
    "combos_by_bag": "SELECT p_size || '__' || p_brand AS bag_id, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS combos FROM part GROUP BY 1",
    "tilings_first_seen": "SELECT p_size::VARCHAR AS tiling_id, min(p_partkey) AS first FROM part GROUP BY 1",
    "prototype_bundle": "SELECT n_name AS name, n_nationkey AS tile_px, n_regionkey AS extractor FROM nation WHERE n_nationkey = 7",
    "hash_canonical": "SELECT c_custkey, substr(sha256(c_name || ' / ' || c_mktsegment || '!'), 1, 16) AS value FROM customer",
    "hash_run": "SELECT c_custkey, substr(md5(c_name || ' / ' || c_mktsegment || '!'), 1, 8) AS value FROM customer",
    "name_safe": "SELECT c_custkey, regexp_replace(regexp_replace(c_name || ' / ' || c_mktsegment || '!', '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS value FROM customer",
    "representation_ids": _REPRESENTATIONS,
    "metric_requests": _values("name, metric, k", [("hit_at_5", "hit_at_k", 5), ("MAP_at_10", "map_at_k", 10), (" precision_at_1 ", "precision_at_k", 1), ("auroc", "auroc", None), ("macro_f1_at_3", "macro_f1_at_k", 3)]),
    "hyperparameters": _values("case_no, value, declared", [(0, 7, 7), (1, 5, 5), (2, 20, 20), (3, 1, 1)]),
    "search_spaces": _values("name, kind, choices", [("lr", "categorical", "[0.1, 0.2]"), ("norm", "categorical", '["a", "b", "c"]'), ("dropout", "float", "null")]),
    "roles_normalized": _values("case_no, roles", [(0, "training,validation,testing"), (1, "training,testing"), (2, "validation"), (3, "training,validation,testing,extra")]),
    "registry_entries": _values("kind, name", [("representation", "hshr-features"), ("representation", "splice-features"), ("representation", "yottixel-features"), ("search", "cosine"), ("search", "pbss"), ("search", "retccl"), ("search", "sish"), ("search", "yottixel"), *(("metric", f"{m}_at_k") for m in ("hit", "precision", "map", "mmv", "macro_f1"))]),
    "prototype_names": "SELECT proto::INT AS proto, CASE proto WHEN 0 THEN 'a' ELSE 'exclude' END AS label, form::INT AS form FROM range(2) p(proto), range(3) f(form)",
    "vector_packed_hamming": "SELECT x.vec_id, 2 AS words, list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: CAST((z[1] > 0) <> (z[2] > 0) AS INT)))::BIGINT AS distance FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1",
    "vector_rises": "SELECT vec_id, list_sum(list_transform(range(2, 65), lambda i: CAST(embedding[i] >= embedding[i - 1] AS INT)))::BIGINT AS rises FROM embeddings",
    "latent_keys": "SELECT vec_id, floor((embedding[1]::DOUBLE + 1) * 100)::BIGINT + floor((embedding[2]::DOUBLE + 1) * 100)::BIGINT * 1000000 + floor((embedding[3]::DOUBLE + 1) * 100)::BIGINT * 100000000000 AS key, array_to_string(list_transform(embedding[1:6], lambda x: CASE floor((x::DOUBLE + 1) * 2)::INT WHEN 0 THEN '5' WHEN 1 THEN '6' WHEN 2 THEN '9' ELSE '-' END), ',') AS codes FROM embeddings",
    "joint_masks": """WITH m AS (SELECT x.vec_id, list_transform(range(1, 5), lambda i: x.embedding[i] > 0.02 AND y.embedding[i] > 0.02) AS m FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1),
      k AS (SELECT vec_id, m, CASE WHEN list_contains(m, true) THEN list_filter(range(1, 5), lambda i: m[i]) ELSE range(1, 5) END AS i FROM m), v AS (SELECT vec_id, m, list_transform(i, lambda j: [3.0, 1.0, 2.0, 5.0][j]::DOUBLE) AS v FROM k)
      SELECT vec_id, CASE WHEN list_contains(m, true) THEN array_to_string(list_transform(m, lambda b: CAST(b AS INT)), '') END AS mask, round(-0.5 * ln(list_avg(list_transform(v, lambda x: exp(-(x - list_min(v)) / 0.5)))) + list_min(v), 6) AS softmin, round(list_avg(v), 6) AS mean FROM v""",
    "surv_hazards": f"WITH {_HAZARD} SELECT vec_id, round(list_sum(h[1:1 + greatest(0, least(vec_id % 9 - 1, 5))]), 6) AS cumulative, round(list_sum(h), 6) AS risk FROM h",
    "surv_discrete": f"WITH {_HAZARD} SELECT vec_id, b::INT AS bin, round(list_product(list_transform(logits[1:b + 1], lambda x: 1 - 1 / (1 + exp(-x)))), 6) AS survival FROM h, range(6) r(b)",
    "surv_times": with_views("survival") + "SELECT id, CASE WHEN id % 3 <> 0 THEN time ELSE floor(time / 400) END AS time FROM survival",
    "class_probabilities": "WITH l AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: round(x::DOUBLE, 4) * 5) AS l FROM embeddings) SELECT vec_id, list_position(l, list_max(l)) - 1 AS predicted, round(exp(list_max(l)) / list_sum(list_transform(l, lambda x: exp(x))), 6) AS probability FROM l",
    "metrics_long": with_views("classified", _BINARY) + "SELECT metric, round(value, 6) AS value FROM (UNPIVOT m ON accuracy, f1, brier INTO NAME metric VALUE value) WHERE metric <> 'balanced_accuracy'",
    "slide_model_linear": "WITH l AS (SELECT p_retailprice::DOUBLE / 1000 AS y, p_size::DOUBLE AS x FROM part), f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b, avg(y) AS m FROM l) SELECT round(avg(abs(y - a * x - b)), 3) AS mae, round(avg((y - a * x - b) ** 2), 3) AS mse, round(sqrt(avg((y - a * x - b) ** 2)), 3) AS rmse, round(1 - sum((y - a * x - b) ** 2) / sum((y - m) ** 2), 3) AS r2 FROM l, f",
    "mixture_groups": _mixture() + "SELECT slide, tile_idx, arg_max(k, r)::INT AS top, round(max(r), 4) AS top_prob FROM r10 GROUP BY ALL",
    "mixture_embedding": _mixture() + "SELECT slide, k::INT AS proto, round(p, 5) AS prob, (i - 1)::INT AS dim, round(m, 4) AS mean, round(v, 4) AS cov FROM m10 JOIN p10 USING (slide, k)",
    "splice_tiles": """WITH RECURSIVE tiles AS (SELECT 'S' || (vec_id // 8) AS slide, vec_id % 8 AS tile_idx, embedding AS vec FROM embeddings),
      pair AS (SELECT a.slide, a.tile_idx AS i, b.tile_idx AS j, sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS far FROM tiles a JOIN tiles b USING (slide)),
      far AS (SELECT slide, list(r ORDER BY i) AS far FROM (SELECT slide, i, list(far ORDER BY j) AS r FROM pair GROUP BY ALL) GROUP BY ALL),
      step AS (
        SELECT slide, far, -1 AS seed, -1 AS grp, CAST([] AS BIGINT[]) AS took, (SELECT list(t.tile_idx ORDER BY t.tile_idx) FROM tiles t WHERE t.slide = far.slide) AS left_ FROM far
        UNION ALL
        SELECT slide, far, s, grp + 1, list_filter(left_, lambda j: j = s OR far[s + 1][j + 1] < cut), list_filter(left_, lambda j: j = s OR NOT far[s + 1][j + 1] < cut)
        FROM (SELECT *, list_aggregate(list_transform(left_, lambda j: far[s + 1][j + 1]), 'quantile_cont', 0.25) AS cut FROM (SELECT *, list_min(list_filter(left_, lambda j: j > seed)) AS s FROM step) WHERE s IS NOT NULL)
      )
      SELECT slide, tile_idx, max(grp) AS "group", bool_or(tile_idx = seed) AS selected FROM (SELECT slide, grp, seed, unnest(took)::INT AS tile_idx FROM step WHERE seed >= 0) GROUP BY ALL""",
}
