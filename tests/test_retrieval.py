"""Search strategies and retrieval metrics on small literal cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval_metrics as metrics
from tessera.operators import keyed, search


def _frames(spark, queries, hits):
    q = spark.createDataFrame(queries, "query_id string, query_label string, exclusion_key string")
    h = spark.createDataFrame(hits, "query_id string, rank int, sample_id string, hit_label string, score double")
    return q, metrics.labelled(h.drop("hit_label"), h.select("sample_id", F.col("hit_label").alias("category")).distinct())


def _values(frame):
    return {(r.scope, r.label): r.value for r in frame.collect()}


def test_hit_and_vote(spark):
    q, h = _frames(spark, [("q1", "tumor", None), ("q2", "normal", None)], [("q1", 1, "a", "tumor", 0.0), ("q2", 1, "a", "tumor", 0.0), ("q2", 2, "b", "normal", 0.0)])
    got = _values(metrics.summary(metrics.hit_at_k(q, h, 1), "hit"))
    assert got == {("label", "tumor"): 1.0, ("label", "normal"): 0.0, ("macro", None): 0.5, ("micro", None): 0.5}
    votes = {r.query_id: r.predicted for r in metrics.votes_at_k(q, h, 5).collect()}
    assert votes == {"q1": "tumor", "q2": None}  # a tie is no majority


def test_no_hits(spark):
    q, h = _frames(spark, [("q1", "tumor", None)], [("q9", 1, "a", "tumor", 0.0)])
    assert _values(metrics.summary(metrics.hit_at_k(q, h, 5), "hit"))[("micro", None)] == 0.0
    assert _values(metrics.macro_f1_at_k(q, h, 5))[("macro", None)] == 0.0


def test_short_rankings(spark):
    q, h = _frames(spark, [("q1", "t", None)], [("q1", 1, "q1", "t", 0.0), ("q1", 2, "a", "t", 0.0), ("q1", 3, "b", "n", 0.0)])
    assert metrics.precision_at_k(q, h, 5).first().value == 0.2  # the hit on itself is out, the rest is divided by k
    assert metrics.map_at_k(q, h, 5).first().value == 0.0
    assert metrics.map_at_k(q, h, 2).first().value == 1.0


def test_ndcg(spark):
    q, h = _frames(spark, [("S1", "tumor", "P1")], [("S1", 1, "S2", "tumor", 0.0), ("S1", 2, "S4", "normal", 0.0), ("S1", 3, "S3", "tumor", 0.0)])
    pool = spark.createDataFrame([("S2", "tumor", "P2"), ("S3", "tumor", "P3"), ("S4", "normal", "P4"), ("S1", "tumor", "P1"), ("S7", "tumor", "P1")], "sample_id string, category string, exclusion_key string")
    available = metrics.relevant_items(q, pool)
    assert available.first().relevant == 2
    assert math.isclose(metrics.ndcg_at_k(q, h, 3, available).first().value, 1.5 / (1 + 1 / math.log2(3)))


def test_barcode_distance():
    bits = search.Barcodes()
    left, right = np.array([[1.0, 1], [1, -1]], np.float32), np.array([[1.0, 1], [-1, -1]], np.float32)
    assert bits.score((left, np.array([2])), (right, np.array([2])))[0] == 0.5
    rng = np.random.default_rng(7)
    a, b = (rng.integers(0, 2, (13, 31)), rng.integers(0, 2, (17, 31)))
    brute = np.median([min((x != y).sum() for y in b) for x in a])
    assert bits.score((2.0 * a - 1, np.array([13])), (2.0 * b - 1, np.array([17])))[0] == brute
    assert np.isinf(bits.score((left[:0], np.array([0])), (right, np.array([2]))))


def test_prototypes(spark):
    one = [[1.0, 1.0]] * 2
    rows = [("q", "p0", [[0.0, 0.0], [10.0, 10.0], *one]), ("close", "p1", [[1.0, 0.0], [99.0, 99.0], *one]), ("far", "p2", [[5.0, 0.0], [10.0, 10.0], *one])]
    items = spark.createDataFrame(rows, "sample_id string, exclusion_key string, vecs array<array<double>>")
    hits = search.topk(items.where("sample_id = 'q'"), items, search.Prototypes(tau=0.5), 2).orderBy("rank").collect()
    assert len(hits) == 2 and {h.sample_id for h in hits} == {"close", "far"}
    masked = spark.createDataFrame([(i, k, [v[0], v[2]]) for i, k, v in rows], items.schema)  # the second prototype excluded
    hits = search.topk(masked.where("sample_id = 'q'"), masked, search.Prototypes(tau=0.5), 2).orderBy("rank").collect()
    assert [h.sample_id for h in hits] == ["close", "far"]


def test_exclusion_keeps_null_keys(spark):
    items = spark.createDataFrame([("a", "p", [[1.0, 0.0]]), ("b", "p", [[1.0, 0.1]]), ("c", None, [[0.9, 0.0]])], "sample_id string, exclusion_key string, vecs array<array<double>>")
    found = lambda who: [r.sample_id for r in search.topk(items.where(F.col("sample_id") == who), items, search.Cosine(), 9).orderBy("rank").collect()]
    assert found("a") == ["c"]
    assert set(found("c")) == {"a", "b", "c"}  # a query without a key excludes none


def test_chunks_change_nothing(spark):
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(f"i{i}", None, [rng.normal(size=8).tolist()]) for i in range(40)], "sample_id string, exclusion_key string, vecs array<array<double>>")
    a, b = (sorted(map(tuple, search.topk(items, items, search.Barcodes(), 5, chunk=n).collect())) for n in (7, 4096))
    assert a == b


def test_retccl(spark):
    rows = [("query", "patient-query", "t", [[1.0, 0.0], [0.0, 1.0]]), ("same", "patient-query", "t", [[1.0, 0.0], [0.0, 1.0]]), ("slide-a", "pa", "t", [[1.0, 0.0], [0.95, 0.05]]), ("slide-b", "pb", "n", [[0.0, 1.0], [0.05, 0.95]])]
    items = spark.createDataFrame(rows, "sample_id string, exclusion_key string, category string, vecs array<array<double>>")
    hits = search.retccl(items.where("sample_id = 'query'"), items, k=2, threshold=0.7, top=2).orderBy("rank").collect()
    assert [(h.rank, h.sample_id) for h in hits] == [(1, "slide-a"), (2, "slide-b")]


def test_sish(spark):
    bits = lambda s: [c == "1" for c in s]
    rows = [("query", "p", "t", 20, 0, bits("1111")), ("same", "p", "t", 19, 0, bits("1111")), ("slide-a", "a", "t", 19, 0, bits("1111")), ("slide-b", "b", "t", 21, 0, bits("1110"))]
    items = spark.createDataFrame(rows, "sample_id string, exclusion_key string, category string, key long, vec_idx int, bits array<boolean>")
    hits = keyed.sish(items.where("sample_id = 'query'"), items, fanout=1, steps=1, threshold=8).orderBy("rank").collect()
    assert [(h.sample_id, h.score) for h in hits] == [("slide-a", 0.0), ("slide-b", 1.0)]


def test_neighbours(spark):
    keys = spark.createDataFrame([(k,) for k in (3, 9, 4, 40, 41)], "key long")
    got = {r.key: (r.predecessor, r.successor) for r in search.neighbours(keys, spark.createDataFrame([(1,), (4,), (10,), (41,), (99,)], "key long")).collect()}
    assert got == {1: (None, 3), 4: (3, 9), 10: (9, 40), 41: (40, None), 99: (41, None)}


def _plain_walks(entries, key, bits, group, interval, fanout, steps, threshold):
    """Walks from every seed to both sides, key by key, over a list of all (key, sample, group, label, bits)."""
    seen, found = [], []
    for sign in (-1, 1):
        for n in range(fanout):
            seed = key + sign * n * interval
            for walk in (sorted({e[0] for e in entries if e[0] < seed}, reverse=True), sorted({e[0] for e in entries if e[0] > seed})):
                taken = 0
                for at in walk:
                    if taken == steps or at in seen:
                        break
                    here = [(sum(x != y for x, y in zip(e[4], bits, strict=True)), i, e) for i, e in enumerate(entries) if e[0] == at and (group is None or e[2] != group)]
                    if here:
                        far, _, nearest = min(here, key=lambda x: x[:2])
                        taken += 1
                        if far <= threshold:
                            seen.append(at)
                            found.append((far, nearest[1], nearest[3]))
    return found


TILE = "sample_id string, exclusion_key string, category string, key long, vec_idx int, bits array<boolean>"


@pytest.mark.parametrize("seed, fanout, steps, threshold", [(1, 3, 4, 5), (2, 2, 1, 3), (3, 1, 60, 6), (4, 4, 9, 4)])
def test_probes_equal_plain_walks(spark, seed, fanout, steps, threshold):
    """Small blocks, so that walks cross them; one key holds a third of the entries, and one group runs of keys that are closed to it."""
    rng = np.random.default_rng(seed)
    bits = lambda: rng.integers(0, 2, 12).astype(bool).tolist()
    refs = [(f"s{i % 9}", [f"p{i % 4}", None][i % 7 == 0], f"l{i % 3}", 77 if i % 3 == 0 else int(rng.integers(0, 200)), i, bits()) for i in range(90)]
    refs += [("hot", "p1", "l1", k, 1000 + k, bits()) for k in range(210, 260)]
    asked = [(f"q{i % 6}", ["p1", "p2", None][i % 3], "l0", [77, int(rng.integers(0, 300))][i % 2], i, bits()) for i in range(40)]
    got = keyed.probed(spark.createDataFrame(asked, TILE), spark.createDataFrame(refs, TILE), 7, fanout, steps, threshold, block=4, met=8)
    found = {r.vec_idx: [(r.hits[i].distance, r.hits[i].sample_id, r.hits[i].category) for i in keyed.replay([tuple(w) for w in r.walks], [h.no for h in r.hits])] for r in got.collect()}
    entries = [(k, s, g, c, b) for s, g, c, k, _, b in sorted(refs, key=lambda r: (r[0], r[4]))]
    plain = {i: _plain_walks(entries, k, b, g, 7, fanout, steps, threshold) for _, g, _, k, i, b in asked}
    assert {i: f for i, f in found.items() if f} == {i: f for i, f in plain.items() if f}
    assert any(found.values())


def _random_bags(spark, n, parts):
    rng = np.random.default_rng(9)
    rows = [(f"s{i:03}", [f"p{i % 7}", None][i % 5 == 0], [f"l{i % 3}", None][i % 11 == 0], rng.normal(0, 1, (1 + i % 4, 6)).round(1).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "sample_id string, exclusion_key string, category string, vecs array<array<double>>").repartition(parts)


def test_tile_matches_equal_plain_loops_over_many_partitions(spark, monkeypatch):
    """Blocks and chunks are small; what leaves the tasks doesn't grow with the partitions of the references."""
    monkeypatch.setattr(search, "MATCHED_AT_ONCE", 4)
    monkeypatch.setattr(search, "TILES_AT_ONCE", 50)
    rows, refs = _random_bags(spark, 120, 100)
    weights = {"l0": 1.0, "l1": 2.0, "l2": 0.0}
    got = search.tile_matches(refs.where("sample_id < 's020'"), refs, weights, 0.3, 3, chunk=12).collect()
    unit = {r[0]: np.array(r[3]) / np.linalg.norm(np.array(r[3]), axis=1, keepdims=True) for r in rows}
    pairs = {}
    for q in rows[:20]:
        for t, x in enumerate(unit[q[0]]):
            met = [(round(float(x @ y), 12), r[0], i, r[2]) for r in rows if r[0] != q[0] and (q[1] is None or r[1] != q[1]) for i, y in enumerate(unit[r[0]])]
            pairs[q[0], t] = [m for m in met if m[0] >= 0.3]
    best, sums = {}, {}
    for r in got:
        if r.kind == "match":
            best.setdefault((r.query_id, r.tile), []).append((-round(r.similarity, 9), r.sample_id, r.position, r.label))
        else:
            sums[r.query_id, r.tile, r.label] = sums.get((r.query_id, r.tile, r.label), 0.0) + r.weight
    assert {k: sorted(v, key=lambda x: x[:3])[:3] for k, v in best.items()} == {k: sorted(((-round(s, 9), n, i, x) for s, n, i, x in v), key=lambda x: x[:3])[:3] for k, v in pairs.items() if v}
    plain = {}
    for (q, t), met in pairs.items():
        for s, _, _, label in met:
            plain[q, t, label] = plain.get((q, t, label), 0.0) + (s + 1) / 2 * weights.get(label, 0.0)
    assert sums.keys() == plain.keys() and all(math.isclose(sums[k], v, abs_tol=1e-9) for k, v in plain.items())
    assert len(got) <= len(pairs) * 7 * 2 * spark.sparkContext.defaultParallelism


def test_retccl_matches_once(spark, monkeypatch):
    """Every reference meets a chunk of queries in one pass, though matches and labels are both read."""
    told, matched = spark.sparkContext.accumulator(0), search._matched

    def counted(*given):
        run = matched(*given)

        def seen(batches):
            for batch in batches:
                told.add(sum(len(r.get("ids") or [0]) for r in batch.to_pylist()))
                yield batch

        return lambda batches: run(seen(batches))

    monkeypatch.setattr(search, "_matched", counted)
    _, refs = _random_bags(spark, 60, 4)
    assert search.retccl(refs.where("sample_id < 's010'"), refs, threshold=0.3).collect()
    assert told.value == 60


def test_full_keys_are_told_once_per_tile(spark, monkeypatch):
    """Many entries on few keys: what leaves the comparisons is about a row for each tile and key, not one for each part as well."""
    rng = np.random.default_rng(5)
    bits = lambda: rng.integers(0, 2, 12).astype(bool).tolist()
    refs = [(f"s{i}", None, "l", i % 20, 0, bits()) for i in range(4000)]
    told, compare = spark.sparkContext.accumulator(0), keyed._compare

    def counted(threshold):
        run = compare(threshold)

        def counting(tiles, entries):
            found = run(tiles, entries)
            told.add(len(found))
            return found

        return counting

    monkeypatch.setattr(keyed, "_compare", counted)
    rows = keyed.probed(spark.createDataFrame(refs[:50], TILE), spark.createDataFrame(refs, TILE), 1, 1, 30, 12, met=200).collect()
    assert len(rows) == 50 and {len(r.hits) for r in rows} == {19}  # a walk leaves out its own key
    assert told.value <= 3 * 50 * 20


def test_probes_of_nothing(spark):
    row = [("a", None, None, 5, 0, [True, False]), ("b", "p", "t", None, 1, [True, True]), ("c", "p", "t", 5, 2, None)]
    rows, none = spark.createDataFrame(row, TILE), spark.createDataFrame([], TILE)
    for queries, refs in ((rows, none), (none, rows), (none, none)):
        assert keyed.sish(queries, refs, fanout=1, steps=1, threshold=2).count() == 0
    twice = rows.unionByName(rows.withColumn("key", F.col("key") + 1))
    assert {(h.query_id, h.sample_id) for h in keyed.sish(twice, twice, fanout=1, steps=1, threshold=2).collect()} == {("a", "a")}
