"""PII, nearest neighbours, images, revisits and the pipeline."""

import re
import struct
import unicodedata
import zlib

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from tessera.llm import ann, common, images, pii, queries, revisits

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    found += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(*m.span(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_plain_spans(spark, sf_dir):
    rng = np.random.default_rng(3)
    for _ in range(20_000):
        text = "".join(rng.choice(list("ab1230@@..-+() 45é%"), rng.integers(0, 40)))
        assert pii.plain_spans(text) == brute_spans(text), text
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        assert pii.find(r.text) == (brute_spans(r.text), [])  # clean texts get no disguised spans


@pytest.mark.parametrize(
    ("text", "found", "kind"),
    [
        ("mail john dot smith at mail dot example dot com now", "john dot smith at mail dot example dot com", "email"),
        ("mail john at mail.example dot com now", "john at mail.example dot com", "email"),
        ("escribe a ana at correo dot com dot ar hoy", "ana at correo dot com dot ar", "email"),
        ("nul \x00 and bob at corp dot com", "bob at corp dot com", "email"),
        ("x john(at)example.com", "john(at)example.com", "email"),
        ("x john [at] example [dot] net!", "john [at] example [dot] net", "email"),
        ("jоhn@exаmple.com", "jоhn@exаmple.com", "email"),
        ("john＠example．com", "john＠example．com", "email"),
        ("call plus one four one five five five five two six seven one ok", "plus one four one five five five five two six seven one", "phone"),
        ("+1 four one five 555 two six seven one", "+1 four one five 555 two six seven one", "phone"),
        ("ip one nine two dot one six eight dot zero dot one here", "one nine two dot one six eight dot zero dot one", "ip"),
        ("４111​ 1111 1111 1111", "４111​ 1111 1111 1111", "card"),
    ],
)
def test_disguises(text, found, kind):
    plain, more = pii.find(text)
    assert [(text[s:e], k) for s, e, k in more] == [(found, kind)]
    assert pii.redacted(text) == text.replace(found, f"[{kind.upper()}]")


def test_clean_text_stays():
    for text in ("look at home dot we go", "one of the two men", "cinq deux trois", "", "a dot b", "at 5 dot 3", "Москва at night", "42 ٣"):
        assert pii.find(text) == ([], []) and pii.redacted(text) == text
    assert pii.find(None) == ([], []) and pii.redacted(None) is None


@pytest.mark.parametrize("text", ["1" * 100_000, "a" * 100_000 + "@", "1 " * 50_000, "+1" + "(" * 100_000, "one " * 20_000, "1." * 50_000, "a@b." * 20_000, "x at " * 20_000])
def test_long_texts_take_linear_time(text):
    pii.find(text)


def test_pii_query(spark, sf_dir):
    import hashlib

    got = queries.QUERIES["op4_pii"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id").text
    for r in got.itertuples():
        spans = brute_spans(docs[r.doc_id])
        text = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        assert (r.spans, r.base_sha256) == (text, hashlib.sha256(text.encode()).hexdigest())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in spans) for k in pii.KINDS]
    edge = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "x@y.z", "c"), (1, "x@y.z", "c")], "doc_id long, text string, spans string")
    assert sorted(r.spans for r in pii.spans(edge).collect()) == ["", "", "email:0:5", "email:0:5"]
    assert sorted((r.text or "-", r.spans) for r in pii.redact(edge).collect()) == [("-", "a"), ("-", "b"), ("[EMAIL]", "c"), ("[EMAIL]", "c")]
    assert pii.spans(edge.limit(0)).count() == 0


def brute_neighbours(ids, vectors, k=20):
    order = np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    out = {}
    for q, v in zip(ids, vectors, strict=True):
        if q % 20 == 0:
            score = (vectors * v).sum(1)
            score[ids == q] = -np.inf
            best = np.lexsort((ids, -score))[: min(k, len(ids) - 1)]
            out[int(q)] = [(int(ids[b]), float(score[b])) for b in best]
    return out


def _recall(got, brute):
    found = got.groupby("query_id").vec_id.apply(set).to_dict()
    return sum(len({i for i, _ in want} & found.get(q, set())) for q, want in brute.items()) / sum(map(len, brute.values()))


def test_neighbours_query(spark, sf_dir):
    got = queries.QUERIES["op3_nearest_neighbours"](spark, sf_dir).toPandas()
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    vectors = np.array(rows.embedding.tolist(), np.float64)
    brute = brute_neighbours(rows.vec_id.to_numpy(), vectors)
    assert len(got) == sum(map(len, brute.values())) and _recall(got, brute) >= 0.9
    at = dict(zip(rows.vec_id, vectors, strict=True))
    assert np.allclose(got.score, [at[q] @ at[v] for q, v in zip(got.query_id, got.vec_id, strict=True)], rtol=0, atol=1e-12)
    for _, own in got.sort_values("rank").groupby("query_id"):
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and own.score.is_monotonic_decreasing


def test_neighbours_with_a_crowd(spark, monkeypatch):
    """A third of the vectors are one, another third near copies; norms differ; several chunks and blocks."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    vectors = np.concatenate([np.tile(base, (700, 1)), base + rng.normal(size=(700, 16)) * 0.02, rng.normal(size=(700, 16)) * rng.uniform(0.1, 2, (700, 1))])
    ids = rng.permutation(3000)[:2100]
    monkeypatch.setattr(ann, "QUERIES", 40)
    monkeypatch.setattr(ann, "BLOCK", 200)
    frame = spark.createDataFrame([(int(i), v.tolist(), "x", 1) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, v string, score int")
    got = ann.neighbours(frame, F.col("vec_id") % 20 == 0).toPandas()
    assert _recall(got, brute_neighbours(ids, vectors)) > 0.98


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (20, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.neighbours(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]  # a tie goes to the smaller id
    assert ann.neighbours(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.neighbours(frame.where("vec_id = 1"), F.col("vec_id") % 20 == 0).count() == 0


def test_codes_favour_the_parallel_part():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    unit = x / np.sqrt((x**2).sum(1, keepdims=True))

    def parallel(quantiser):
        coded = quantiser.books[np.arange(8), quantiser.encode(x)].reshape(len(x), -1)
        return float((((x - coded) * unit).sum(1) ** 2).mean())

    assert parallel(ann.fit(x, threshold=0.5)) < 0.7 * parallel(ann.fit(x, threshold=0.0))


def _png(grey, filters):
    raw, above = b"", np.zeros(grey.shape[1], int)
    for y, row in enumerate(grey.astype(int)):
        left, corner = np.concatenate(([0], row[:-1])), np.concatenate(([0], above[:-1]))
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        kind = filters[y % len(filters)]
        raw += bytes([kind]) + ((row - [0 * row, left, above, (left + above) // 2, paeth][kind]) & 255).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_decode():
    grey = np.random.default_rng(0).integers(0, 256, (11, 7))
    assert (images.decode(_png(grey, [0, 1, 2, 3, 4])) == grey).all()
    assert (images.decode(b"P5 # note\n7 11\n255\n" + grey.astype(np.uint8).tobytes()) == grey).all()
    for bad in (None, b"", b"P5", b"P5 9 9 255\n", b"GIF89a", _png(grey, [0])[:40]):
        assert images.decode(bad) is None


def test_image_copies(spark, sf_dir):
    got = queries.QUERIES["op5_image_copies"](spark, sf_dir).toPandas()
    family = got.vec_id // 4 * 4
    assert (got.copy_group >= family).all()  # no image joins another scene
    assert (got.copy_group == family).mean() > 0.95


def test_image_edges(spark):
    one, two = images.scene(0), images.scene(40)
    frame = spark.createDataFrame([(3, one, "a"), (9, one, "b"), (9, one, "b"), (4, None, "c"), (5, b"junk", "d"), (None, two, "e"), (None, None, "f"), (7, two, "g")], "id long, image binary, points string")
    got = sorted(((r.id, r.copy_group) for r in images.copies(frame).collect()), key=str)
    assert got == sorted([(3, 3), (9, 3), (9, 3), (4, 4), (5, 5), (None, 7), (None, None), (7, 7)], key=str)
    assert images.copies(frame.limit(0)).count() == 0


def test_revisits_oracle(spark, sf_dir, duck):
    name = "op9_warc_revisits"
    same_rows(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLES[name]).df())


def test_canonical(spark):
    urls = {
        "http://WWW.Example.com:80/a/?b=2&utm_source=x&a=1#top": "example.com/a?a=1&b=2",
        "https://user@example.com/A//": "example.com/A",
        "example.com?sid=4": "example.com",
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.c for r in rows.select("url", revisits.canonical(F.col("url")).alias("c")).collect()} == urls


SCHEMA = "record_id long, kind string, url string, time long, status int, headers map<string,string>, payload string, bucket string"


def test_revisits(spark):
    full = lambda i, t, tag, body, url="http://a/x", **h: (i, "response", url, t, 200, {"ETag": tag, "Content-Type": "text/html", **h}, body, "b")
    asks = lambda i, t, url="https://www.a/x/#f", **h: (i, "revisit", url, t, 304, {k.replace("_", "-"): v for k, v in h.items()}, None, "b")
    rows = [
        full(1, 10, '"v1"', "one", **{"Last-Modified": "d1"}), full(2, 20, '"v2"', "two"), full(3, 20, '"v3"', "three"), full(4, 15, '"no"', None), full(None, 22, '"v9"', "x"),
        asks(11, 12, ETAG='W/"v1"', Content_Type="text/plain", Cache_Control="new"), asks(12, 20, etag='"v1"'), asks(13, 25, etag='"v3"'), asks(14, 25, etag='"v2"'), asks(15, 10, etag='"v1"'),
        asks(16, 14, last_modified="d1"), asks(17, 14), asks(18, 99, url=None, etag="x"), asks(19, None, etag="x"), asks(19, None, etag="x"), (20, None, "http://a/x", 30, 200, None, "y", "b"),
        (21, "revisit", "http://a/x", 14, 304, None, None, "b"),
    ]
    got = sorted(revisits.resolve(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.record_id)
    told = [(r.record_id, r.source_id, r.outcome, r.payload) for r in got]
    ok, differ, none = revisits.RESOLVED, revisits.CHANGED, revisits.NO_VALIDATOR
    assert told == [
        (11, 1, ok, "one"), (12, 1, ok, "one"), (13, 3, ok, "three"), (14, 3, differ, None), (15, None, revisits.NO_RESPONSE, None), (16, 1, ok, "one"), (17, 1, none, None),
        (18, None, revisits.NO_URL, None), (19, None, revisits.NO_RESPONSE, None), (19, None, revisits.NO_RESPONSE, None), (21, 1, none, None),
    ]
    assert got[0].headers == {"etag": 'W/"v1"', "content-type": "text/html", "last-modified": "d1", "cache-control": "new"}
    assert revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_revisits_of_one_url(spark):
    """Many records of one URL over many buckets, against a scan."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        t = int(rng.integers(0, 500))
        rows.append((i, "response", "http://a/", t, 200, {"etag": "t"}, f"p{i}", "b") if i % 3 else (i, "revisit", "http://a/", t, 304, {"etag": "t"}, None, "b"))
    got = {r.record_id: r.source_id for r in revisits.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    for r in rows:
        if r[1] == "revisit":
            earlier = [(x[3], x[0]) for x in rows if x[1] == "response" and x[3] < r[3]]
            assert got[r[0]] == (max(earlier)[1] if earlier else None)


def test_pipeline(spark, sf_dir):
    """Each stage against a plain version of it, on what the stage before has kept."""
    import corpus_pipeline
    from test_dedup import brute_lines
    from test_jaccard import brute_kept
    from test_tokens import check_packed

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, None
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "PII", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = common.materialize(stage(spark, docs, sf_dir), "test")
        if name == "best-fit packing":
            rows = docs.toPandas()
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language ID":
            assert after == {i: t for i, t in before.items() if t and any(unicodedata.category(c).startswith("L") for c in t)}  # clean texts stay
        if name == "line dedup":
            order = sorted(before)
            assert after == dict(zip(order, brute_lines([(i, before[i]) for i in order]), strict=True))
        if name == "SimHash near-dedup":
            assert sorted(after) == brute_kept(sorted(before.items()))  # five words, Jaccard similarity of 0.8 or more
        if name == "PII":
            assert set(after) == set(before) and not any(brute_spans(t) for t in after.values())
    check_packed(rows)
    assert set(rows.doc_id) == set(before)


def test_pipeline_on_an_empty_table(spark, tmp_path, sf_dir):
    import corpus_pipeline

    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
