"""Near-duplicates by Jaccard similarity against brute force."""

import random

import pytest

from tessera.llm import common, jaccard


def brute_kept(docs, n=5, least=(4, 5)):
    """Smallest ids of the components of texts whose n-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, text in docs:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    low = list(range(len(docs)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or len(x & sets[j]) * least[1] >= least[0] * len(x | sets[j]):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    first = {}
    for i, (doc, _) in enumerate(docs):
        first[root(i)] = min(first.get(root(i), doc), doc)
    return sorted(first.values())


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


def planted():
    """Copies with more and more edits, a crowd around one text near the bound, and a passage that many texts share."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 200))]
        texts += [" ".join(edited(rng, base, share)) for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.04)]
    crowd, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts += [" ".join(edited(rng, crowd, 0.018)) for _ in range(90)]
    texts += [" ".join(passage + [word() for _ in range(rng.randint(10, 40))]) for _ in range(60)]
    texts += ["", None, " \n", "One two", "one TWO"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [2048, 12])
def test_keep_first_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = planted()
    kept = jaccard.keep_first(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, keys string"))
    assert kept.columns == ["doc_id", "text", "keys"]
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(docs)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (None, "x y"), (2, None), (1, "")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in jaccard.keep_first(docs).collect()), key=str) == sorted([(3, "a b c"), (None, "x y"), (1, "")], key=str)
    assert jaccard.keep_first(docs.limit(0)).count() == 0


def test_stage_removes_similar_texts(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = common.materialize(stage(spark, docs, sf_dir), "test")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, sf_dir).collect()) == brute_kept(rows)


def test_fine_bitmaps_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(4)
    for size in (0, 1, 3, 700, 5000):
        for more in (0, 1, 40, 900):
            a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
            b = np.unique(np.concatenate((a[: size // 2 + 1], rng.integers(0, 1 << 63, more, np.uint64))))
            far = jaccard.differing(jaccard.fine(a), jaccard.fine(b))
            exact = len(np.setxor1d(a, b))
            assert far <= exact and (exact - far) % 2 == 0
            assert far >= 0.3 * exact


def test_stage_follows_links_of_simhash_too(spark):
    """Fingerprints count repeats, sets don't: 1 and 2 are linked by SimHash alone, 2 and 3 by their sets alone."""
    import corpus_pipeline
    from tessera.llm import simhash

    own = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    one, two = ("a b c " * 400 + own(c, 40) for c in "xy")
    rows = [(1, one), (2, two), (3, "a b c " * 3 + own("y", 40)), (4, own("z", 50))]
    far = [(simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[j][1])).bit_count() for i, j in ((0, 1), (1, 2))]
    assert far[0] <= simhash.RADIUS < far[1] and brute_kept(rows) == [1, 2, 4]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()) == [1, 4]


def test_all_pairs_of_a_crowd_come_in_bounded_batches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "COMPARED_AT_ONCE", 1000)
    n, bits = 300, jaccard.bitmap(np.arange(40, dtype=np.uint64) << np.uint64(33))
    columns = {"key": pa.array([7] * n), "a": pa.array([0] * n, pa.int32()), "b": pa.array([0] * n, pa.int32()), "node": pa.array(range(n)), "n": pa.array([40] * n, pa.int32()), "label": pa.array(range(n)), "bits": pa.array([bits] * n)}
    batches = list(jaccard._candidates(8000, jaccard.ROUNDS - 1)(iter([pa.RecordBatch.from_pydict(columns)])))
    assert max(b.num_rows for b in batches) < 1000 + n
    found = [(x, y) for b in batches for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
    assert sorted(found) == [(x, y) for x in range(n) for y in range(x + 1, n)]
