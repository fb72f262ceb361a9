"""Queries of the relational, bag and grid operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import bags, grid, relational as rel
from tessera.plans.domain import SIDE, annotations, runs, table, tiles, with_views


def _wanted(spark, sf_dir):
    """(dataset, slide) pairs to infer on: every third slide, and as many that no annotation has."""
    notes = annotations(spark, sf_dir).where("int(substring(slide, 2)) % 3 = 0").select("dataset", "slide")
    return notes.unionByName(notes.select("dataset", F.concat(F.lit("X"), "slide").alias("slide")))


_WANTED = "wanted AS (SELECT dataset, slide FROM annotations WHERE CAST(substr(slide, 2) AS INT) % 3 = 0 UNION ALL SELECT dataset, 'X' || slide FROM annotations WHERE CAST(substr(slide, 2) AS INT) % 3 = 0)"


def _config(spark):
    return spark.createDataFrame([("ref_ds", "reference"), ("query_ds", "query"), ("old_ds", "ignore")], "name string, used_for string")


def _files(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.concat(F.lit("slide_"), "o_orderkey", F.lit(".svs")).alias("file_name"), F.when(F.col("o_orderkey") % 10 != 0, F.concat(F.lit("C"), "o_custkey")).alias("case_id"),
        F.col("o_orderstatus").alias("label"),
    )


def _clinical(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("case_id"), F.col("c_mktsegment").alias("label"))


def metadata_join(spark, sf_dir):
    joined = rel.with_metadata(rel.standardized(_files(spark, sf_dir), "remote", "/data/"), _clinical(spark, sf_dir), required=("slide", "patient", "category", "wsi_path"))
    return joined.select("slide", "patient", "category", "wsi_path", "source", "label")


def bag_rows(spark, sf_dir, level="case"):
    return bags.load(bags.build(annotations(spark, sf_dir), level), tiles(spark, sf_dir))


def bag_build(level):
    def run(spark, sf_dir):
        found = bags.build(annotations(spark, sf_dir).withColumn("patient", F.col("patient")), level)
        return found.select("sample_id", F.array_join("slides", ",").alias("slides"), "category", "categories", "patient", F.array_join("cases", ",").alias("cases"))

    return run


def bag_resize(size):
    def run(spark, sf_dir):
        return bags.resized(bag_rows(spark, sf_dir, "patient"), size).select("sample_id", "place", "position", "slide", "tile_idx")

    return run


def bag_pool(how):
    return lambda spark, sf_dir: bags.pooled(bag_rows(spark, sf_dir, "patient"), how).withColumn("value", F.round("value", 6))


def attention(spark, sf_dir):
    rows = bag_rows(spark, sf_dir, "patient").withColumn("a", F.col("vec")[0].cast("double"))
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x.cast("double")))
    return bags.attention_pooled(rows, "a").select("sample_id", "dim", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


def padded(spark, sf_dir):
    rows = bags.padded(bag_rows(spark, sf_dir, "patient"))
    return rows.select("sample_id", "position", "mask", F.posexplode("vec").alias("dim", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


def nth_match(spark, sf_dir):
    found = tiles(spark, sf_dir).select(F.col("x0").alias("x"), F.col("y0").alias("y"), "vec_id")
    sizes = found.where("vec_id % 3 <> 0").select("x", "y", "vec_id", (F.lit(SIDE) + F.col("vec_id") % 5).alias("size"))
    return rel.nth_match(found, sizes, ["x", "y"], "vec_id", "vec_id", ["size"])


def feature_level(spark, sf_dir):
    found = tiles(spark, sf_dir)
    return rel.feature_level(found.where("slide_no % 5 <> 0 OR tile_idx = 0"), found.where("slide_no % 7 <> 0"))


def param_grid(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    brands, sizes, types = (part.select(c).distinct() for c in ("p_brand", "p_size", "p_type"))
    return grid.product_of([brands, sizes, types])


def grid_ids(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_retailprice").cast("double").alias("price"), "p_type", "p_name")
    tiling = grid.tiling_id(F.col("p_size"), F.round(F.col("price") / 1000, 2))
    feature = grid.feature_name(F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(" "))
    return part.select("p_partkey", tiling.alias("tiling_id"), grid.bag_id(tiling, feature).alias("bag_id"), grid.canonical_hash(F.col("p_name")).alias("hash"), grid.run_hash(F.col("p_name")).alias("run_hash"), grid.safe_name(F.concat(F.col("p_name"), F.lit(" / x"))).alias("safe"))


def mixed_radix(spark, sf_dir):
    return grid.product(spark, {"extractor": ["a", "b"], "tile_px": [128, 256, 512], "color_norm": [], "mpp": [0.5, 1.0]})


def compatible(spark, sf_dir):
    lists = {"representation": ["mean", "mosaic"], "search": ["single", "patch"], "feature_level": ["slide", "patch"]}
    known = spark.createDataFrame([("mean", "slide", "single"), ("mean", "patch", "single"), ("mosaic", "patch", "patch")], "representation string, feature_level string, search string")
    return grid.compatible(grid.product(spark, lists), known)


def entry_ids(spark, sf_dir):
    found = bags.build(annotations(spark, sf_dir), "patient")
    return found.select("sample_id", grid.entry_id(F.col("slides")).alias("entry_id"))


def label_lookup(spark, sf_dir):
    notes = annotations(spark, sf_dir).withColumn("category", F.when(F.col("slide").endswith("7"), F.lit(None)).when(F.col("slide").endswith("3"), F.lit("  ")).otherwise(F.concat(F.lit(" "), "category")))
    ids = notes.select(F.col("patient").alias("sample_id")).unionByName(notes.select(F.concat(F.lit("none"), "patient").alias("sample_id")))
    return rel.label_lookup(notes, ids, "patient", "category")


def histogram(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return rel.histogram(counts, "n", 4).withColumn("low", F.round("low", 6))


def work(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return rel.work_status(events.select(F.col("event_type").alias("state")))


def pending(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("work_id"), F.when(F.col("event_type") == "purchase", "success").otherwise(F.col("event_type")).alias("state"))
    return rel.pending(events.select("work_id").distinct(), events).select("work_id")


def hamming(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select("vec_id", vectors.falls(F.col("embedding")).alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), vectors.falls(F.col("embedding")).alias("b")), "vec_id")
    return pairs.select("vec_id", vectors.hamming(F.col("a"), F.col("b")).alias("distance"))


def survival_bins(spark, sf_dir):
    from tessera.plans.domain import survival

    rows = survival(spark, sf_dir)
    return vectors.bin_times(rows, "time", 4, "quantile").select("id", "bin")


def sdm(spark, sf_dir):
    from tessera.operators import select

    return select.distance_groups(tiles(spark, sf_dir)).select("slide", "tile_idx", "group")


def thumbnails(spark, sf_dir):
    found = tiles(spark, sf_dir)
    return vectors.bounds(found, "x0", "y0", SIDE, 32.0, 2)


def summary_sets(spark, sf_dir):
    """Sample ids that are queries or hits: a union without repeats."""
    notes = annotations(spark, sf_dir)
    return notes.select(F.col("slide").alias("sample_id")).where("sample_id LIKE '%1'").union(notes.where("dataset = 'query_ds'").select("slide")).distinct()


QUERIES = {
    "annotations_of_dataset": lambda s, d: rel.of_dataset(annotations(s, d), "query_ds").select("slide", "category"),
    "annotations_configured": lambda s, d: rel.configured(annotations(s, d), _config(s)).groupBy("used_for").agg(F.count("*").alias("n")),
    "annotations_missing": lambda s, d: rel.missing_slides(annotations(s, d), _wanted(s, d)),
    "annotations_semi": lambda s, d: rel.existing(annotations(s, d), _wanted(s, d)).select("dataset", "slide"),
    "annotations_anti": lambda s, d: rel.absent(_wanted(s, d), annotations(s, d)),
    "annotations_union": lambda s, d: rel.inference_rows(_wanted(s, d), annotations(s, d)),
    "metadata_left_join": metadata_join,
    "patient_split_roles": lambda s, d: rel.split_by_patient(annotations(s, d), ["training", "validation", "testing"]).select("dataset", "slide", "patient"),
    "label_lookup_validation": label_lookup,
    "bag_build_slide": bag_build("slide"),
    "bag_build_case": bag_build("case"),
    "bag_build_patient": bag_build("patient"),
    "bag_resize_down": bag_resize(5),
    "bag_resize_up": bag_resize(19),
    "bag_mean_pool": bag_pool("mean"),
    "bag_max_pool": bag_pool("max"),
    "bag_attention_pool": attention,
    "bag_padded": padded,
    "bag_output_dim": lambda s, d: bags.output_dim(annotations(s, d), "classification"),
    "bag_entry_ids": entry_ids,
    "tile_nth_match": nth_match,
    "feature_level": feature_level,
    "param_grid": param_grid,
    "param_grid_indexed": mixed_radix,
    "param_grid_compatible": compatible,
    "grid_ids": grid_ids,
    "leaderboard": lambda s, d: rel.leaderboard(runs(s, d)).select("run_index", "status", "objective_value", "rank"),
    "leaderboard_best": lambda s, d: rel.best_runs(runs(s, d), 10, "val_loss").select("run_index", "objective_value"),
    "work_status_summary": work,
    "work_pending": pending,
    "tile_histogram": histogram,
    "vector_hamming": hamming,
    "survival_bins": survival_bins,
    "sdm_groups": sdm,
    "thumbnail_bounds": thumbnails,
    "sample_ids_union": summary_sets,
}

_BAG = "bag AS (SELECT patient AS sample_id, row_number() OVER (PARTITION BY patient ORDER BY slide, tile_idx) - 1 AS position, slide, tile_idx, vec, count(*) OVER (PARTITION BY patient) AS n FROM annotations JOIN tiles USING (slide))"


def _build(level: str) -> str:
    return with_views("annotations") + f"""SELECT "{level}" AS sample_id, string_agg(slide, ',' ORDER BY slide) AS slides, min(category) AS category, count(DISTINCT category) AS categories,
      any_value(patient) AS patient, string_agg(DISTINCT "case", ',' ORDER BY "case") AS cases FROM annotations GROUP BY "{level}\""""


def _resize(size: int) -> str:
    return with_views("annotations tiles", _BAG) + f", w AS (SELECT DISTINCT sample_id, n, unnest(range({size})) AS place FROM bag) SELECT sample_id, place, position, slide, tile_idx FROM (SELECT w.sample_id, place, CASE WHEN n >= {size} THEN round_even(place * (n - 1) / {float(size - 1)}, 0)::BIGINT ELSE place % n END AS position FROM w) JOIN bag USING (sample_id, position)"


def _pool(how: str) -> str:
    return with_views("annotations tiles", _BAG) + f"SELECT sample_id, i - 1 AS dim, round({how}(vec[i]::DOUBLE), 6) AS value FROM bag, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL"


def _g(x: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.6f', {x}), '0+$', ''), '\\.$', '')"


_TILING = f"p_size || 'px_' || {_g('round(p_retailprice / 1000, 2)')} || 'mpp'"
_SPLIT = """people AS (SELECT patient, row_number() OVER (ORDER BY md5('0:' || patient), patient) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT patient FROM annotations)),
  cut AS (SELECT *, greatest(1, least(round_even(n * 0.4, 0), n - 2)) AS a FROM people), cut2 AS (SELECT *, greatest(1, least(round_even(n * 0.2, 0), n - a - 1)) AS b FROM cut)"""

ORACLES = {
    "annotations_of_dataset": with_views("annotations") + "SELECT slide, category FROM annotations WHERE dataset = 'query_ds'",
    "annotations_configured": with_views("annotations") + "SELECT CASE dataset WHEN 'ref_ds' THEN 'reference' ELSE 'query' END AS used_for, count(*) AS n FROM annotations GROUP BY 1",
    "annotations_missing": with_views("annotations", _WANTED) + "SELECT DISTINCT slide FROM wanted ANTI JOIN annotations USING (slide)",
    "annotations_semi": with_views("annotations", _WANTED) + "SELECT dataset, slide FROM annotations SEMI JOIN wanted USING (dataset, slide)",
    "annotations_anti": with_views("annotations", _WANTED) + "SELECT dataset, slide FROM wanted ANTI JOIN annotations USING (dataset, slide)",
    "annotations_union": with_views("annotations", _WANTED) + "SELECT a.* FROM annotations a SEMI JOIN wanted USING (dataset, slide) UNION ALL BY NAME SELECT DISTINCT dataset, slide, slide AS patient, slide AS \"case\", 'unknown' AS category FROM wanted ANTI JOIN annotations USING (dataset, slide)",
    "metadata_left_join": """WITH f AS (SELECT 'slide_' || o_orderkey AS slide, CASE WHEN o_orderkey % 10 <> 0 THEN 'C' || o_custkey END AS case_id, o_orderstatus AS category, '/data/slide_' || o_orderkey || '.svs' AS wsi_path FROM orders),
      c AS (SELECT 'C' || c_custkey AS case_id, c_mktsegment AS label FROM customer WHERE c_custkey % 2 = 0)
      SELECT slide, f.case_id AS patient, category, wsi_path, 'remote' AS source, label FROM f LEFT JOIN c ON c.case_id = f.case_id WHERE f.case_id IS NOT NULL""",
    "patient_split_roles": with_views("annotations", _SPLIT) + "SELECT dataset || '__' || CASE WHEN place <= a THEN 'training' WHEN place <= a + b THEN 'validation' ELSE 'testing' END AS dataset, slide, patient FROM annotations JOIN cut2 USING (patient)",
    "label_lookup_validation": with_views("annotations") + """, n AS (SELECT patient, CASE WHEN slide LIKE '%7' THEN NULL WHEN slide LIKE '%3' THEN '  ' ELSE ' ' || category END AS label FROM annotations),
      g AS (SELECT patient, count(*) FILTER (label IS NULL) AS nulls, list_sort(list_distinct(list(nullif(trim(label), '')) FILTER (nullif(trim(label), '') IS NOT NULL))) AS labels FROM n GROUP BY 1),
      i AS (SELECT DISTINCT patient AS sample_id FROM n UNION SELECT DISTINCT 'none' || patient FROM n)
      SELECT sample_id, CASE WHEN g.patient IS NOT NULL AND nulls = 0 AND len(labels) = 1 THEN labels[1] END AS label,
        CASE WHEN g.patient IS NULL THEN 'no row' WHEN nulls > 0 THEN 'null label' WHEN coalesce(len(labels), 0) = 0 THEN 'blank label' WHEN len(labels) > 1 THEN 'several labels' END AS problem
      FROM i LEFT JOIN g ON g.patient = i.sample_id""",
    "bag_build_slide": _build("slide"),
    "bag_build_case": _build("case"),
    "bag_build_patient": _build("patient"),
    "bag_resize_down": _resize(5),
    "bag_resize_up": _resize(19),
    "bag_mean_pool": _pool("avg"),
    "bag_max_pool": _pool("max"),
    "bag_attention_pool": with_views("annotations tiles", _BAG) + ", w AS (SELECT *, exp(vec[1]::DOUBLE - max(vec[1]::DOUBLE) OVER (PARTITION BY sample_id)) AS w FROM bag) SELECT sample_id, i - 1 AS dim, round(sum(w * vec[i]::DOUBLE) / sum(w), 6) AS mean, round(sum(w * vec[i]::DOUBLE * vec[i]::DOUBLE) / sum(w) - (sum(w * vec[i]::DOUBLE) / sum(w)) ** 2, 6) AS var FROM w, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL",
    "bag_padded": with_views("annotations tiles", _BAG) + ", s AS (SELECT sample_id, unnest(range((SELECT max(n) FROM bag))) AS position FROM (SELECT DISTINCT sample_id FROM bag)) SELECT s.sample_id, s.position, b.vec IS NOT NULL AS mask, i - 1 AS dim, round(coalesce(b.vec[i]::DOUBLE, 0), 6) AS value FROM s CROSS JOIN (SELECT unnest(range(1, 65)) AS i) LEFT JOIN bag b ON b.sample_id = s.sample_id AND b.position = s.position",
    "bag_output_dim": with_views("annotations") + "SELECT count(DISTINCT category) AS output_dim FROM annotations",
    "bag_entry_ids": with_views("annotations") + "SELECT patient AS sample_id, 'members_' || sha1(string_agg(slide, '||' ORDER BY slide)) AS entry_id FROM annotations GROUP BY 1",
    "tile_nth_match": with_views("tiles") + f", a AS (SELECT x0 AS x, y0 AS y, vec_id, row_number() OVER (PARTITION BY x0, y0 ORDER BY vec_id) AS n FROM tiles), b AS (SELECT x0 AS x, y0 AS y, {SIDE} + vec_id % 5 AS size, row_number() OVER (PARTITION BY x0, y0 ORDER BY vec_id) AS n FROM tiles WHERE vec_id % 3 <> 0) SELECT a.x, a.y, a.vec_id, b.size FROM a LEFT JOIN b ON a.x = b.x AND a.y = b.y AND a.n = b.n",
    "feature_level": with_views("tiles") + ", f AS (SELECT slide, count(*) AS f FROM tiles WHERE slide_no % 5 <> 0 OR tile_idx = 0 GROUP BY 1), t AS (SELECT slide, count(*) AS t FROM tiles WHERE slide_no % 7 <> 0 GROUP BY 1) SELECT slide, CASE WHEN coalesce(f, 0) = coalesce(t, 0) AND f > 1 THEN 'patch' WHEN f = 1 AND t = 1 THEN 'unknown' WHEN f = 1 AND t > 1 THEN 'slide' ELSE 'invalid' END AS level FROM f FULL JOIN t USING (slide)",
    "param_grid": "SELECT * FROM (SELECT DISTINCT p_brand FROM part), (SELECT DISTINCT p_size FROM part), (SELECT DISTINCT p_type FROM part)",
    "param_grid_indexed": "SELECT (e.i * 3 + t.i) * 2 + m.i AS combo_index, extractor, tile_px, CAST(NULL AS VARCHAR) AS color_norm, mpp FROM (VALUES (0, 'a'), (1, 'b')) e(i, extractor), (VALUES (0, '128'), (1, '256'), (2, '512')) t(i, tile_px), (VALUES (0, '0.5'), (1, '1.0')) m(i, mpp)",
    "param_grid_compatible": "SELECT (r.i * 2 + s.i) * 2 + f.i AS combo_index, representation, search, feature_level, CASE WHEN representation = 'mean' AND search = 'single' OR representation = 'mosaic' AND search = 'patch' AND feature_level = 'patch' THEN NULL WHEN representation = 'mosaic' AND search = 'patch' THEN 'feature level' ELSE 'representation and search' END AS reason FROM (VALUES (0, 'mean'), (1, 'mosaic')) r(i, representation), (VALUES (0, 'single'), (1, 'patch')) s(i, search), (VALUES (0, 'slide'), (1, 'patch')) f(i, feature_level)",
    "grid_ids": f"SELECT p_partkey, {_TILING} AS tiling_id, {_TILING} || '__' || p_type || CASE WHEN p_partkey % 2 = 0 THEN '_' || p_name ELSE '' END AS bag_id, substr(sha256(p_name), 1, 16) AS hash, substr(md5(p_name), 1, 8) AS run_hash, regexp_replace(regexp_replace(p_name || ' / x', '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS safe FROM part",
    "leaderboard": with_views("runs") + "SELECT run_index, status, objective_value, CASE WHEN good THEN row_number() OVER (PARTITION BY good ORDER BY objective_value DESC, run_index) END AS rank FROM (SELECT *, status IN ('success', 'complete', 'completed') AND objective_value IS NOT NULL AS good FROM runs)",
    "leaderboard_best": with_views("runs") + "SELECT run_index, objective_value FROM runs WHERE status IN ('success', 'complete', 'completed') ORDER BY objective_value, run_index LIMIT 10",
    "work_status_summary": "SELECT event_type AS state, count(*) AS jobs FROM events GROUP BY 1",
    "work_pending": "SELECT DISTINCT event_id AS work_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')",
    "tile_histogram": "WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT min(n)::DOUBLE AS low, (max(n) - min(n)) / 4.0::DOUBLE AS w FROM c) SELECT bin, round(low + bin * w, 6) AS low, count(*) AS n FROM (SELECT least(floor((n - low) / w)::INT, 3) AS bin, low, w FROM c, e) GROUP BY bin, low, w",
    "vector_hamming": "WITH b AS (SELECT vec_id, list_transform(range(1, len(embedding)), lambda i: embedding[i + 1] - embedding[i] < 0) AS b FROM embeddings) SELECT x.vec_id, list_sum(list_transform(list_zip(x.b, y.b), lambda z: CAST(z[1] <> z[2] AS INT)))::BIGINT AS distance FROM b x JOIN b y ON y.vec_id = x.vec_id + 1",
    "survival_bins": with_views("survival") + ", s AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS n FROM survival), c AS (SELECT time AS cut FROM s, (VALUES (0.25), (0.5), (0.75)) q(q) WHERE i = floor(q * (n - 1))) SELECT id, 1 + (SELECT count(*) FROM c WHERE survival.time > cut) AS bin FROM survival",
    "sdm_groups": with_views("tiles") + ", m AS (SELECT slide, i, avg(vec[i]::DOUBLE) AS m FROM tiles, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), d AS (SELECT slide, tile_idx, round_even(10 * sqrt(sum((vec[i]::DOUBLE - m) ** 2)), 0)::BIGINT AS b FROM tiles JOIN m USING (slide) GROUP BY slide, tile_idx) SELECT slide, tile_idx, dense_rank() OVER (PARTITION BY slide ORDER BY b) - 1 AS \"group\" FROM d",
    "thumbnail_bounds": with_views("tiles") + f"SELECT slide, greatest(floor(min(x0) / 32.0) - 2, 0)::INT AS left, greatest(floor(min(y0) / 32.0) - 2, 0)::INT AS top, (ceil((max(x0) + {SIDE}) / 32.0) + 2)::INT AS right, (ceil((max(y0) + {SIDE}) / 32.0) + 2)::INT AS bottom FROM tiles GROUP BY 1",
    "sample_ids_union": with_views("annotations") + "SELECT slide AS sample_id FROM annotations WHERE slide LIKE '%1' UNION SELECT slide FROM annotations WHERE dataset = 'query_ds'",
}
