"""Relational operators, bags, grids, selection and sources on small cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import registry, vectors
from tessera.operators import bags, grid, models, select, slides
from tessera.operators import relational as rel
from tessera.operators import task_metrics as tm
from tessera.sources import results, tables
from tessera.sources.store import Store


def test_validated(spark):
    with pytest.raises(ValueError, match="category"):
        rel.validated(spark.createDataFrame([("a",)], "slide string"))
    row = rel.validated(spark.createDataFrame([("a", "x", None)], "slide string, category string, patient string")).first()
    assert (row.patient, row.dataset) == (None, "default")  # a null patient stays null


def test_resolve_and_direction(spark):
    assert rel.resolve(spark.createDataFrame([("a",)], "slide_id string"), "slide") == "slide_id"
    with pytest.raises(ValueError):
        rel.resolve(spark.createDataFrame([("a",)], "x string"), "slide")
    assert rel.minimizes("val_loss") and rel.minimizes("RMSE") and not rel.minimizes("brier_score")


def test_wsi_samples(spark):
    notes = spark.createDataFrame([("d", "001", "p", "t", None, "0.5"), ("d", "002", "p", "t", None, "x"), ("d", "003", "p", "t", "/own", "-1"), ("e", "001", "p", "t", None, None)], "dataset string, slide string, patient string, category string, wsi_path string, fallback_mpp string")
    files = spark.createDataFrame([("/f/001.svs",), ("/f/002.svs",), ("/g/002.tif",)], "path string")
    got = {r.slide: (r.path, r.fallback_mpp) for r in rel.wsi_samples(notes, files, "d").collect()}
    assert got == {"001": ("/f/001.svs", 0.5), "003": ("/own", None)}


def test_metadata_join_matches_null_keys(spark):
    files = spark.createDataFrame([("a", None), ("b", "k")], "slide string, case_id string")
    meta = spark.createDataFrame([(None, "x"), ("k", "y")], "case_id string, category string")
    assert {(r.slide, r.category) for r in rel.with_metadata(files, meta, required=("slide",)).collect()} == {("a", "x"), ("b", "y")}


def test_inference_rows_need_the_level(spark):
    notes = spark.createDataFrame([("d", "s1", "p", "c", "t")], "dataset string, slide string, patient string, case string, category string")
    wanted = spark.createDataFrame([("d", "s1"), ("d", "s2")], "dataset string, slide string")
    rows = {r.slide: (r.patient, r.category) for r in rel.inference_rows(wanted, notes).collect()}
    assert rows == {"s1": ("p", "t"), "s2": ("s2", "unknown")}
    with pytest.raises(Exception, match="no patient"):
        rel.inference_rows(wanted, notes, "patient").collect()


def test_split_keeps_patients_together(spark):
    notes = spark.createDataFrame([("d", f"s{i}", f"p{i // 3}") for i in range(60)], "dataset string, slide string, patient string")
    rows = rel.split_by_patient(notes, ["training", "validation"], 0.25).collect()
    roles = {}
    for r in rows:
        roles.setdefault(r.patient, set()).add(r.dataset)
    assert len(rows) == 60 and all(len(v) == 1 for v in roles.values())
    assert sum(v == {"d__validation"} for v in roles.values()) == 5


def test_leaderboard(spark):
    runs = spark.createDataFrame([(0, "success", 0.81), (1, "failed", None), (2, "success", 0.93)], "run_index int, status string, objective_value double")
    assert {r.run_index: r["rank"] for r in rel.leaderboard(runs).collect()} == {2: 1, 0: 2, 1: None}
    assert {r.run_index: r["rank"] for r in rel.leaderboard(runs, "loss").collect()} == {2: 2, 0: 1, 1: None}


@pytest.mark.parametrize(("rows", "expected"), [(6, [0, 2, 3, 5]), (2, [0, 1, 0, 1])])
def test_resize(spark, rows, expected):
    bag = spark.createDataFrame([("b", i) for i in range(rows)], "sample_id string, position int")
    assert [r.position for r in bags.resized(bag, 4).orderBy("place").collect()] == expected


def test_bag_checks(spark):
    notes = spark.createDataFrame([("s1", "c", "p", "t"), ("s2", "c", "q", "t")], 'slide string, case string, patient string, category string')
    with pytest.raises(Exception, match="several values of patient"):
        bags.build(notes, "case").collect()
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("b", [1.0, 2.0]), ("c", [float("nan")])], "sample_id string, vec array<double>")
    assert {r.sample_id for r in bags.schema_problems(rows).collect()} == {"b", "c"}


def test_grid(spark):
    rows = grid.product(spark, {"a": [1, 2], "b": ["x", "y"], "color_norm": []}).orderBy("combo_index").collect()
    assert [(r.a, r.b, r.color_norm) for r in rows] == [("1", "x", None), ("1", "y", None), ("2", "x", None), ("2", "y", None)]
    with pytest.raises(ValueError):
        grid.product(spark, {"a": []})
    assert grid.metric_request("hit_at_5") == ("hit_at_k", {"k": 5})
    assert grid.hyperparameter("k", int, 3, {"k": "99"}, high=10) == 10
    one = spark.range(1).select(grid.tiling_id(F.lit(256), F.lit(0.5)).alias("t"), grid.feature_name(F.lit("e"), F.lit(" ")).alias("f")).first()
    assert (one.t, one.f) == ("256px_0.5mpp", "e")
    drawn = grid.suggestions(spark.range(50).withColumnRenamed("id", "trial"), "x", {"type": "int", "low": 2, "high": 8, "step": 3}, 1)
    assert {r.x for r in drawn.collect()} == {2, 5, 8}


def test_splice():
    group, chosen = select.splice(np.array([[0.0, 0], [0.01, 0], [5.0, 0]]), None, 75)
    assert (group.tolist(), chosen) == ([0, 0, 1], [0, 2])


def test_selection(spark, sf_dir):
    from tessera.plans import domain

    tiles = domain.tiles(spark, sf_dir)
    for strategy in (select.hshr, select.splice, select.mosaic, select.prototype_mosaic(np.eye(3, 64), ["a", "exclude", "b"])):
        first, again = (select.per_bag(tiles, strategy).orderBy("slide", "tile_idx").collect() for _ in range(2))
        assert first == again and len(first) == tiles.count()
        for slide in {r.slide for r in first}:
            own = [r for r in first if r.slide == slide]
            assert any(r.selected for r in own) or all(r.group == 0 for r in own)
    assert select.nearest_unused(np.array([[0.0], [1.0]]), np.array([[0.0], [0.0]])) == [0, 1]


def test_mixture_shares():
    x = np.random.default_rng(0).normal(size=(50, 4))
    prob, mean, cov, share = select.fit_mixture(x, x[:3])
    assert np.allclose(share.sum(1), 1) and np.isclose(prob.sum(), 1) and (cov > 0).all()


def test_mixture_equals_plain_loops():
    """Moments of the rows a component holds and of tau rows of its prior, row by row."""
    x = np.random.default_rng(1).normal(size=(300, 8))
    start, tau, eps = x[:5], 10.0, 0.1
    prob, mean, cov = [1 / 5] * 5, [p.copy() for p in start], [np.full(8, eps) for _ in start]

    def shares():
        rows = []
        for row in x:
            like = [np.log(prob[k]) + sum(-0.5 * (np.log(2 * np.pi * cov[k][d]) + (row[d] - mean[k][d]) ** 2 / cov[k][d]) for d in range(8)) for k in range(5)]
            like = [np.exp(v - max(like)) for v in like]
            rows.append([v / sum(like) for v in like])
        return rows

    for _ in range(10):
        held = shares()
        weight = [sum(r[k] for r in held) + tau for k in range(5)]
        prob = [w / sum(weight) for w in weight]
        first = [(sum(r[k] * row for r, row in zip(held, x, strict=True)) + tau * start[k]) / weight[k] for k in range(5)]
        second = [(sum(r[k] * row**2 for r, row in zip(held, x, strict=True)) + tau * (start[k] ** 2 + eps)) / weight[k] for k in range(5)]
        mean, cov = first, [np.maximum(s - m**2, 1e-8) for s, m in zip(second, first, strict=True)]
    got = select.fit_mixture(x, start)
    for a, b in zip(got, (prob, mean, cov, shares()), strict=True):
        assert np.allclose(a, b)


def test_bundle(spark):
    rows = spark.createDataFrame([("a", 256, "e"), ("b", 256, "f"), ("c", 512, "f"), ("d", 512, "f")], "name string, px int, extractor string")
    assert grid.one_bundle(rows, px=256, extractor="f").first().name == "b"
    for wanted, problem in (({"px": 512}, "several"), ({"px": 1}, "no bundles")):
        with pytest.raises(ValueError, match=problem):
            grid.one_bundle(rows, **wanted)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = np.random.default_rng(3)
    data = [(float(x), i, float(v)) for i, (x, v) in enumerate(zip(rng.integers(0, 40, 500), rng.uniform(0.5, 1, 500), strict=True))] + [(None, 500, 0.5), (None, 501, 0.25)]
    rows = spark.createDataFrame(data, "x double, i int, v double")
    got = {r.i: (r.s, r.p) for r in rel.running(rows, "x", {"s": (F.col("v"), "sum"), "p": (F.col("v"), "product")}, descending, ["i"]).collect()}
    order = sorted(data, key=lambda r: ((r[0] is None) == descending, (-1 if descending else 1) * (r[0] or 0), r[1]))
    total, product = 0.0, 1.0
    for x, i, v in order:
        total, product = total + v, product * v
        assert got[i] == (pytest.approx(total), pytest.approx(product))
    assert rel.running(rows.limit(0), "x", {"s": (F.col("v"), "sum")}).count() == 0


def test_kaplan_meier(spark):
    def curve(rows):
        return [tuple(r) for r in tm.kaplan_meier(spark.createDataFrame(rows, "time double, event int")).orderBy("time").collect()]

    assert curve([(5.0, 1), (10.0, 0), (10.0, 0)]) == [(0.0, 1.0), (5.0, pytest.approx(2 / 3))]
    assert curve([(2.0, 1), (2.0, 1), (4.0, 0)]) == [(0.0, 1.0), (2.0, pytest.approx(1 / 3))]
    assert curve([(2.0, 0), (3.0, 0), (4.0, 0)]) == [(0.0, 1.0)]


def test_concordance(spark):
    rows = spark.createDataFrame([(2.5, 1.0, 1), (1.0, 2.0, 1), (0.5, 4.0, 0), (-0.2, 5.0, 0)], "risk double, time double, event int")
    assert tm.concordance(rows).first().c_index == 1.0
    rng = np.random.default_rng(4)
    data = [(int(i), float(rng.integers(0, 30)), int(rng.integers(0, 2)), float(rng.integers(0, 9))) for i in range(300)]
    pairs = [(a, b) for a in data for b in data if a[2] and a[1] < b[1]]
    score = sum(1 if a[3] > b[3] else 0.5 if a[3] == b[3] else 0 for a, b in pairs)
    got = tm.concordance(spark.createDataFrame(data, "id int, time double, event int, risk double"), buckets=5).first()
    assert got.pairs == len(pairs) and got.c_index == pytest.approx(score / len(pairs))
    assert tm.concordance(rows.where("event = 0")).first().c_index is None


def test_hazards(spark):
    p = [0.2, 0.5, 0.8]
    row = spark.createDataFrame([([float(np.log(x / (1 - x))) for x in p], [2.0, 4.0, 8.0])], "l array<double>, w array<double>")
    assert row.select(vectors.hazards(F.col("l"), F.col("w")).alias("h")).first().h == pytest.approx([-np.log(1 - x) / w for x, w in zip(p, (2, 4, 8), strict=True)])


def test_vector_expressions(spark):
    row = spark.createDataFrame([([1.0, 3.0, 2.0, 2.0], [True, False, True], [True, True, False])], "v array<double>, a array<boolean>, b array<boolean>")
    got = row.select(
        vectors.falls(F.col("v")).alias("falls"), vectors.rises(F.col("v")).alias("rises"), vectors.hamming(F.col("a"), F.col("b")).alias("h"), vectors.packed(F.col("a")).alias("packed"),
        vectors.softmin(F.col("v"), 0.5).alias("softmin"), vectors.softmax(F.col("v")).alias("softmax"), vectors.argmax(F.col("v")).alias("argmax"), vectors.discrete_survival(F.array(F.lit(0.5), F.lit(0.5))).alias("s"),
    ).first()
    v = np.array([1.0, 3, 2, 2])
    assert got.falls == [False, True, False] and got.rises == [False, True, False, True] and got.h == 2 and got.packed == [5] and got.argmax == 1 and got.s == [0.5, 0.25]
    assert got.softmin == pytest.approx(-0.5 * np.log(np.mean(np.exp(-(v - 1) / 0.5))) + 1) and got.softmax == pytest.approx((np.exp(v) / np.exp(v).sum()).tolist())


def test_wide_and_long(spark):
    wide = spark.createDataFrame([("q", "a", 1.5, "", None, "b", None)], "query_sample_id string, rank_1_sample_id string, rank_1_score double, rank_2_sample_id string, rank_2_score double, rank_3_sample_id string, rank_3_score double")
    assert [tuple(r) for r in results.to_long(wide).orderBy("rank").collect()] == [("q", 1, "a", 1.5), ("q", 3, "b", 0.0)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("slide;category;time\n007;x;1.5\n008;y;none\n")
    rows = tables.read_annotations(spark, str(tmp_path / "a.csv"), None).orderBy("slide").collect()
    assert [(r.slide, r.time) for r in rows] == [("007", 1.5), ("008", None)]
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(2, 3))
    assert [r.vec for r in tables.read_arrays(spark, str(tmp_path)).orderBy("row_idx").collect()] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]
    square = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    features = [{"geometry": {"type": "Polygon", "coordinates": square}}, {"geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}]
    (tmp_path / "t.geojson").write_text(json.dumps({"features": features}))
    shapes = tables.read_polygons(spark, str(tmp_path / "t.geojson"))
    assert [r.polygon for r in shapes.collect()] == [square] * 3
    back = tables.polygons_from_json(tables.polygons_json(shapes.withColumnRenamed("path", "slide")))
    assert [r.polygon for r in back.collect()] == [square] * 3
    (tmp_path / "p.geojson").write_text(json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [0, 0]}}]}))
    with pytest.raises(Exception, match="no polygon"):
        tables.read_polygons(spark, str(tmp_path / "p.geojson")).collect()


def test_store_and_stream(spark, tmp_path):
    from tessera.streaming import cache

    store = Store(spark, str(tmp_path / "store"))
    keys = spark.createDataFrame([("s1",), ("s2",)], "slide string")
    made = []

    def make(missing):
        made.append(sorted(r.slide for r in missing.collect()))
        return missing.select("slide", F.lit(0).alias("tile_idx"), F.lit("t").alias("tiling_id"), F.lit("mean").alias("name"), F.array(F.lit(1.0)).alias("vec"))

    assert store.get_or_create("descriptors", keys, ["slide"], make, name="mean").count() == 2
    assert store.get_or_create("descriptors", keys.union(spark.createDataFrame([("s3",)], "slide string")), ["slide"], make, name="mean").count() == 3
    assert made == [["s1", "s2"], ["s3"]]
    keys.union(spark.createDataFrame([("s4",)], "slide string")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("slide string").parquet(str(tmp_path / "in"))
    cache.fill_cache(stream, store, "descriptors", ["slide"], make, str(tmp_path / "checkpoint"), name="mean").awaitTermination()
    assert made[-1] == ["s4"] and store.read("descriptors", name="mean").count() == 4


def test_catalogue_source(spark, tmp_path):
    from tessera.sources.catalogue_source import CatalogueSource

    (tmp_path / "one.csv").write_text("file_name,case_id,label\nf1.svs,c1,a\n")
    (tmp_path / "two.tsv").write_text("file_name\tlabel\nf2.svs\tb\n")
    spark.dataSource.register(CatalogueSource)
    rows = spark.read.format("tessera_catalogue").option("path", str(tmp_path)).load()
    assert sorted(map(tuple, rows.collect()), key=str) == [("f1.svs", "c1", "a"), ("f2.svs", None, "b")]


def test_registry():
    r = registry.Registry("thing")

    @r.register("My_Name")
    def f():
        return 1

    assert r.get("my-name") is f and r.is_available("MY-NAME")
    with pytest.raises(ValueError):
        r.register("my_name", f)
    compute, args = registry.metrics.resolve("slide-retrieval", "precision_at_3")
    assert args == {"k": 3} and compute.__name__ == "precision_at_k"
    with pytest.raises(KeyError):
        registry.metrics.resolve("slide-retrieval", "hit_at_0")

    class A:
        k = registry.Parameter(int, 5, low=1, high=9)

    class B(A):
        tau = registry.Parameter(float, 0.5)

    assert set(registry.parameters(B)) == {"k", "tau"} and registry.parameters(B)["k"].resolve("k", {"k": 50}) == 9


def test_models(spark):
    rng = np.random.default_rng(0)
    data = [(str(i), float(x[0] > 0), float(3 * x[0] - x[1]), x.tolist()) for i, x in enumerate(rng.normal(size=(200, 3)))]
    rows = spark.createDataFrame(data, "sample_id string, label double, y double, v array<double>")
    long = rows.select("sample_id", F.posexplode("v").alias("dim", "value"))
    rows = models.slide_vectors(long).join(rows.drop("v"), "sample_id")
    model = models.fit("logistic_regression", rows)
    assert models.evaluate(model, rows, "classification").first().accuracy > 0.95
    assert all(abs(sum(r.probs) - 1) < 1e-9 for r in models.probabilities(model, rows).collect())
    line = rows.drop("label").withColumnRenamed("y", "label")
    assert models.evaluate(models.fit("linear_regression", line), line, "regression").first().r2 > 0.99


def test_targets(spark):
    rows = spark.createDataFrame([("2", 1.5, 1)], "category string, survival_time double, event int")
    assert slides.with_target(rows, "classification").first().target == 2
    assert tuple(slides.with_target(rows, "survival").first().target) == (1.5, 1)
    with pytest.raises(Exception, match="CAST"):
        slides.with_target(rows.withColumn("category", F.lit("x")), "classification").collect()
    mpp = slides.base_mpp(spark.createDataFrame([("a", "0", "0.5"), ("b", "0.25", None), ("c", "x", "-1")], "slide string, slide_mpp string, fallback_mpp string"))
    assert [r.mpp for r in mpp.orderBy("slide").collect()] == [0.5, 0.25, None]
    allowed = spark.createDataFrame([(0.5, 0.5), (0.4995, 0.5), (0.4, 0.5), (1.0, 0.5)], "r double, o double").select(slides.resolution_allowed(F.col("r"), F.col("o")).alias("a"))
    assert [r.a for r in allowed.collect()] == [True, True, False, True]


def test_geometry(spark):
    grid_ = slides.tile_grid(spark.createDataFrame([("s", 700, 520), ("t", 100, 900)], "slide string, width int, height int"), 256)
    assert [(r.tile_idx, r.x0, r.y0) for r in grid_.orderBy("tile_idx").collect()] == [(0, 0, 0), (1, 256, 0), (2, 0, 256), (3, 256, 256)]
    runs = slides.merged_runs(grid_.withColumn("g", F.lit(1)).where("tile_idx <> 2"), "g", 256)
    assert sorted((r.y0, r.x0, r.x1) for r in runs.collect()) == [(0, 0, 512), (256, 256, 512)]
    px = slides.to_pixels(grid_.withColumns({"read_w": F.lit(256), "read_h": F.lit(1)}), 32, 32).where("tile_idx = 1").first()
    assert (px.px, px.py, px.pw, px.ph) == (8, 0, 8, 1)
    one = slides.blurred(spark.createDataFrame([("s", 5, 5, 1.0)], "slide string, px int, py int, score double"), 1.0).toPandas()
    assert np.isclose(one.score.sum(), 1) and one.loc[one.score.idxmax(), ["px", "py"]].tolist() == [5, 5]
    rgb = slides.mean_rgb(spark.createDataFrame([("s", 0, 255, 0, 51), ("s", 0, 0, 0, 51)], "slide string, tile_idx int, r int, g int, b int")).first()
    assert rgb.vec == [0.5, 0.0, 0.2]


@pytest.mark.parametrize("text", ['["a", "exclude"]', '{"0": "a", "1": "exclude"}', '[{"id": 1, "label": "exclude"}, {"id": 0, "label": "a"}]'])
def test_prototype_labels(spark, text):
    rows = spark.createDataFrame([(text,)], "value string")
    assert [tuple(r) for r in slides.prototype_labels(rows, 2).orderBy("proto").collect()] == [(0, "a"), (1, "exclude")]
    with pytest.raises(Exception, match="prototype 2"):
        slides.prototype_labels(rows, 3).collect()


def test_rows(spark):
    nested = spark.createDataFrame([((1, ("x",)), [1, 2])], "a struct<b: int, c: struct<d: string>>, e array<int>")
    flat = slides.flattened(nested)
    assert flat.columns == ["a.b", "a.c.d", "e"] and tuple(flat.first()) == (1, "x", "[1,2]")
    runs = spark.createDataFrame([(0, {"px": "256"})], "run_index int, params map<string,string>")
    assert slides.summary_rows(runs, ["px", "mpp"], task="mil").first().asDict() == {"run_index": 0, "px": "256", "mpp": None, "task": "mil"}
    work = slides.work_records(grid.product(spark, {"a": [1, 2]}), spark.createDataFrame([("f1",), ("f0",)], "work_id string"))
    assert [(r.work_id, r.dependencies) for r in work.orderBy("work_id").collect()] == [("benchmark-00000", ["f0", "f1"]), ("benchmark-00001", ["f0", "f1"])]
    assert slides.subset(runs, None) is runs
