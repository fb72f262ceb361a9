"""Line dedup and SimHash against brute force, and their edge cases."""

import random

import numpy as np
import xxhash
from conftest import same_rows

from tessera.llm import common, line_dedup, queries, simhash

ODD = "doc_id long, text string, K1 string, dedup_k1 int, fp string, key string, kept_k1 int"


def brute_fingerprint(text, n=3):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, ids):
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    low = np.arange(len(fps))
    while True:
        new = np.array([low[row].min() for row in near])
        if (new == low).all():
            break
        low = new
    first = {}
    for g, i in zip(low, ids, strict=True):
        if i is not None:
            first[g] = min(first.get(g, i), i)
    return [first.get(g) for g in low]


def test_fingerprint():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("abAB é\t\n\x0b\x1c ") for _ in range(rng.randint(0, 80)))
        assert simhash.fingerprint(text) == brute_fingerprint(text), repr(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    long = " ".join(f"w{i % 7001}" for i in range(150_000))
    assert simhash.fingerprint(long) == brute_fingerprint(long)


def test_close_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(6)])
    fps = rng.permutation(np.concatenate([fps, fps[:9]]))
    groups = np.sort(rng.integers(0, 5, len(fps)))
    i, j = simhash.close_pairs(fps, groups)
    brute = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if groups[a] == groups[b] and int(fps[a] ^ fps[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == brute
    for radius in (0, 1, 2):
        i, _ = simhash.close_pairs(fps, np.zeros(len(fps), int), radius)
        assert len(i) == sum(int(fps[a] ^ fps[b]).bit_count() <= radius for a in range(len(fps)) for b in range(a))


def test_every_link_is_found(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(simhash, "BLOCK", 8)  # buckets of several blocks
    fps = np.unique(np.concatenate([[x ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))] for x in rng.integers(0, 1 << 62, 5).tolist()]).astype(np.int64))
    found = common.components(simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"))).collect()
    roots = {r.node: r.root for r in found}
    groups = brute_groups(fps.view(np.uint64), range(len(fps)))
    by_group, by_root = {}, {}
    for x, g in zip(fps.tolist(), groups, strict=True):
        by_group.setdefault(g, set()).add(x)
        by_root.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, by_group.values())) == sorted(map(sorted, by_root.values()))


def test_near_duplicates(spark, sf_dir):
    got = queries.QUERIES["op7_simhash_near_dedup"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    fps = [int(x, 16) for x in got.fingerprint]
    assert fps == [brute_fingerprint(texts[i]) for i in got.doc_id]
    assert got.component_id.tolist() == brute_groups(fps, got.doc_id.tolist())
    kept = simhash.keep_first(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(got.component_id))


def test_simhash_edges(spark):
    rows = [(5, None), (4, ""), (9, " \n"), (None, "one two three four"), (7, "One two THREE four"), (7, "One two THREE four"), (8, "x y"), (None, "alone here now then")]
    docs = spark.createDataFrame([(i, t, "a", 1, "b", "c", 2) for i, t in rows], ODD)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 4), (4, 4), (9, 4), (None, 7), (7, 7), (7, 7), (8, 8), (None, None)], key=str)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(4, ""), (7, "One two THREE four"), (8, "x y"), (None, "alone here now then")], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.keep_first(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (300, 250)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(docs, window=3):
    """docs: distinct (id, text) in order; the covered lines of later occurrences go."""
    first, gone = {}, {}
    for number, (_, text) in enumerate(docs):
        lines = text.split("\n") if text is not None else []
        for p in range(len(lines) - window + 1):
            key = tuple(lines[p : p + window])
            if key in first:
                gone.setdefault(number, set()).update(range(p, p + window))
            else:
                first[key] = (number, p)
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(n, ())) for n, (_, t) in enumerate(docs)]


def test_line_dedup(spark):
    rng = random.Random(2)
    docs = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "a\nb"), (203, "\n\n\n\n\n\n"), (204, "x\r\ny\nz\n" * 3)]
    frame = spark.createDataFrame([(i, t, "a", 1, "b", "c", 2) for i, t in rng.sample(docs, len(docs))], ODD)
    out = line_dedup.remove_repeated_windows(frame, counts=("before", "removed"))
    assert out.columns == [*frame.columns, "before", "removed"]
    assert [r.text for r in out.orderBy("doc_id").collect()] == brute_lines(docs)


def test_line_dedup_edges(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc\nd"), (2, "q\na\nb\nc")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.remove_repeated_windows(docs).collect()), key=str)
    assert got == sorted([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "d"), (2, "q")], key=str)  # equal rows are one document
    assert line_dedup.remove_repeated_windows(docs.limit(0)).count() == 0


def test_line_dedup_oracle(spark, sf_dir, duck):
    name = "op10_line_dedup"
    same_rows(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLES[name]).df())


def test_line_dedup_is_native(spark, sf_dir):
    plan = queries.QUERIES["op10_line_dedup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_long_text(spark):
    text = "\n".join(f"line {i % 5000}" for i in range(20_000))
    row = line_dedup.remove_repeated_windows(spark.createDataFrame([(1, text)], "doc_id long, text string"), counts=("n", "gone")).first()
    assert row.n == 20_000 and row.text == brute_lines([(1, text)])[0]
