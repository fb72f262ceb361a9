"""Packing, byte-level BPE, language ID and LM scores against brute force."""

import base64
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import bpe, ctw, grams, langid, packing, queries

ALPHABET = " \t\n\r\x0b\x0c\x1c\x1d\x85\xa0 　'stremldTHEabcéßñ012٣.,!?-—你好\U0001f600éⅧİΣςW̊"


def texts(n, size=60, seed=2, alphabet=ALPHABET):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_word_tokens_equal_the_tokenizer():
    coder = packing.tokenizer(P.path("word_bpe_49k.json"))
    rows = texts(2000) + texts(300, 200, 3, "the cat, sat. On<|endoftext|> \n") + ["", None, "x" * 500, "a \x01 b", "\x01\x01 , ,"]
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json")).encode_batch([t or "" for t in rows], add_special_tokens=False)
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.batch(rows)] == [e.ids for e in plain]


def check_packed(rows, context=2048):
    rows = rows.sort_values(["sequence_id", "offset"])
    before = (rows.offset + rows.length).groupby(rows.sequence_id).shift(fill_value=0)
    assert (before == rows.offset).all()  # gapless from 0
    assert rows.groupby("sequence_id").length.sum().max() <= context
    return rows.sequence_id.nunique(), -(-int(rows.length.sum()) // context)


def test_packing(spark, sf_dir):
    got = queries.QUERIES["op1_best_fit_packing"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    coder = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == doc_id].sort_values("piece")
        parts = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        assert own.piece.tolist() == list(range(len(parts))) and own.start.tolist() == list(range(0, len(ids), 2048)) and own.length.tolist() == [len(p) for p in parts]
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in parts]
    used, least = check_packed(got)
    assert used <= least * 1.02 + 1


def test_plan():
    rng = np.random.default_rng(0)
    for counts in (np.bincount(rng.integers(1, 2049, 3000), minlength=2049), np.bincount([2048] * 50 + [1] * 7, minlength=2049), np.bincount([1500] * 100, minlength=2049), np.zeros(2049, int), np.bincount([700] * 3000 + [648] * 1000, minlength=2049)):
        where = packing.plan(counts)
        length = np.repeat(np.arange(2049), counts)
        rank = np.concatenate([np.arange(n) for n in counts])
        sequence, offset = packing.place(where, length, rank) if len(length) else (length, length)
        assert len(np.unique(sequence)) == where.sequences
        order = np.lexsort((offset, sequence))
        end = 0
        for i, k in enumerate(order):
            end = 0 if not i or sequence[k] != sequence[order[i - 1]] else end
            assert offset[k] == end
            end += length[k]
            assert end <= 2048
    shapes = packing.patterns(np.array([5, 3, 2, 10]), 10)
    assert {tuple(sorted(x[x > 0])) for x in shapes} == {(10,), (5, 5), (2, 3, 5)}


def test_packing_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "a cat", "z"), (2, "word " * 5000, "z"), (2, "word " * 5000, "z")], "doc_id long, text string, chunk string")
    got = packing.packed(docs, P.path("word_bpe_49k.json")).toPandas()
    check_packed(got)
    assert len(got) == 3 + 2 * 3 and got[got.doc_id == 1].length.tolist() == [1, 1]
    assert packing.packed(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0
    ids = packing.packed(docs, P.path("word_bpe_49k.json"), with_ids=True).toPandas()
    assert all(zlib.crc32(x) == c and len(x) == 4 * n for x, c, n in zip(ids.ids, ids.ids_crc32, ids.length, strict=True))


def test_bpe_equals_tiktoken():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.Vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rows = texts(3000) + texts(500, 300, 4, "ethaionsrt") + ["", "a" * 5000, "ab" * 4000, "   x", "x   ", " \n \n y"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(rows)] == [plain.encode_ordinary(t) for t in rows]
    assert [coder.decode(x) for x in coder.encode(rows)] == [t.encode() for t in rows]


def test_rank_queue():
    queue, rng, held = bpe.RankQueue(), random.Random(1), defaultdict(list)
    for i in range(3000):
        rank = rng.randrange(0, 60_000)
        queue.push(rank, i)
        held[rank].append(i)
    out = []
    while (entry := queue.pop()) is not None:
        out.append(entry)
    assert out == sorted(held.items())


def test_bpe_query(spark, sf_dir):
    import hashlib

    got = queries.QUERIES["op8_byte_bpe"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id").text
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
    for r in got.itertuples():
        ids = plain.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    edge = spark.createDataFrame([(None, None, "a"), (1, "", "b")], "doc_id long, text string, ids string")
    rows = bpe.digests(edge, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert [r.n_tokens for r in rows] == [0, 0] and len({r.ids_sha256 for r in rows}) == 1


def ppm_bits(model_counts, text, order):
    data, total = bytes([grams.BEFORE]) * order + grams.lowered(text, "all") + bytes([grams.END]), 0.0
    for i in range(order, len(data)):
        p = 1.0
        for d in range(order, -1, -1):
            seen = model_counts.get(data[i - d : i])
            if seen is None:
                continue
            n, q = sum(seen.values()), len(seen)
            if data[i] in seen:
                p *= seen[data[i]] / (n + q)
                break
            p *= q / (n + q)
        else:
            p /= 256
        total -= math.log2(p)
    return total


def test_ppm(spark):
    rows = [("en", "the cat sat on the mat"), ("en", "The dog"), ("fr", "le chat est là"), ("fr", "élan"), ("en", "")]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    counts = {x: defaultdict(Counter) for x in model.languages}
    for lang, text in rows:
        data = bytes([grams.BEFORE]) * langid.ORDER + grams.lowered(text, "all") + bytes([grams.END])
        for i in range(langid.ORDER, len(data)):
            for d in range(langid.ORDER + 1):
                counts[lang][data[i - d : i]][data[i]] += 1
    asked = ["the chat", "zzz Ω", "ÉLAN", "", "a" * 3000]
    got = model.code_lengths([grams.lowered(t, "all") for t in asked])
    brute = np.array([[ppm_bits(counts[x], t, langid.ORDER) for x in model.languages] for t in asked])
    assert np.allclose(got, brute, rtol=1e-5)


def test_language_id(spark, sf_dir):
    got = queries.QUERIES["op6_language_id"](spark, sf_dir).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    assert [bool(x) for x in got.held_out] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]
    held = got[got.held_out]
    assert (held.lang_pred == docs.lang[held.index]).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_id_edges(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(8)] + [(i + 10, "le chat et le chien", "fr") for i in range(8)]
    rows += [(50, None, "en"), (51, "", None), (52, "12 34 !!", "fr"), (None, "the dog", "xx"), (53, "le chien", None), (53, "le chien", None)]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {(r.doc_id, r.lang_pred) for r in langid.languages(docs).collect()}
    assert {(50, "und"), (51, "und"), (52, "und"), (53, "fr"), (None, "en")} <= got and langid.languages(docs).count() == len(rows)
    unlabelled = docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang IS NULL")
    assert {r.lang_pred for r in langid.languages(unlabelled).collect()} == {"und"}
    assert langid.languages(docs.limit(0)).count() == 0


def brute_ctw(train, order):
    """Scores by adding a bit to the sequences: W after / W before at the root of each binary node's context tree."""
    count, kids = defaultdict(lambda: [0, 0]), defaultdict(set)
    wrap = lambda t: bytes([grams.BEFORE]) * order + grams.lowered(t, "ascii") + bytes([grams.END])
    for data in map(wrap, train):
        for i in range(order, len(data)):
            for k in range(8):
                prefix, bit = 1 << k | data[i] >> (8 - k), data[i] >> (7 - k) & 1
                for d in range(order + 1):
                    count[data[i - d : i], prefix][bit] += 1
                    if d:
                        kids[data[i - d + 1 : i], prefix].add((data[i - d : i], prefix))

    def kt(z, o):
        return (math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)) / math.log(2)

    known = {}

    def weight(node):
        if node not in known:
            own = kt(*count[node])
            known[node] = own if len(node[0]) == order else np.logaddexp2(own - 1, sum(map(weight, kids[node])) - 1)
        return known[node]

    def bit_log(context, prefix, bit):
        up = 0.0
        for d in range(order, -1, -1):
            node = (context[len(context) - d :], prefix)
            z, o = count[node] if node in count else (0, 0)
            new = kt(z + (not bit), o + bit)
            if d < order:
                child = (context[len(context) - d - 1 :], prefix)
                new = np.logaddexp2(new - 1, sum(weight(x) for x in kids.get(node, ()) if x != child) + up - 1)
            up = new
        root = (b"", prefix)
        return up - (weight(root) if root in count else 0.0)

    def score(text):
        data = wrap(text)
        return sum(bit_log(data[i - order : i], 1 << k | data[i] >> (8 - k), data[i] >> (7 - k) & 1) for i in range(order, len(data)) for k in range(8)) * math.log10(2)

    return score


def test_ctw(spark):
    rows = list(enumerate(["The cat sat on the mat. the cat sat", "Le chat est là", "", None, "a b  c\tthe cat", "unseen zzz Ωé", "the mat the mat the mat"] * 2)) + [(None, "null id"), (3, "dup"), (3, "dup")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, words string, held_out int")
    whole = ctw.scores(docs).toPandas()
    key = ["doc_id", "score"]
    parts = ctw.scores(docs, shard=40).toPandas().sort_values(key).reset_index(drop=True)  # several passes
    whole = whole.sort_values(key).reset_index(drop=True)
    assert len(whole) == len(parts) == len(rows)
    for c in ("n_tokens", "n_known", "base_score", "score"):
        assert np.allclose(whole[c].astype(float), parts[c].astype(float))
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for t in train for w in [*grams.lowered(t, "ascii").split(), None])
    n, v = sum(count.values()), len(count)
    score = brute_ctw(train, ctw.ORDER)
    for i, text in rows:
        own = whole[whole.doc_id.isna() if i is None else whole.doc_id == i]
        words = [*grams.lowered(text, "ascii").split(), None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert any(r.n_tokens == len(words) and r.n_known == sum(count[w] > 0 for w in words) and r.train_tokens == n and math.isclose(r.base_score, base) and math.isclose(r.score, score(text), rel_tol=1e-4) for r in own.itertuples())
    assert ctw.scores(docs.limit(0)).count() == 0
    alone = ctw.scores(docs.where("doc_id IS NULL")).first()
    assert math.isclose(alone.score, -8 * 8 * math.log10(2)) and alone.train_tokens == 0


def test_ctw_improves_on_words(spark, sf_dir):
    got = queries.QUERIES["op2_lm_scoring"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id").text
    held = got[got.held_out]
    size = sum(len(docs[i].encode()) for i in held.doc_id)
    assert -held.score.sum() / math.log10(2) / size < 3.0  # bits per byte on texts not learned from


def test_gram_keys():
    laid = grams.Texts([b"ab", b"", b"c"], 2)
    whole = [b"\xfe\xfea", b"\xfeab", b"ab\xff", b"\xfe\xfe\xff", b"\xfe\xfec", b"\xfec\xff"]
    assert laid.keys().tolist() == [int.from_bytes(x, "big") for x in whole] and laid.bounds().tolist() == [0, 3, 4]
    hashes, of = grams.Texts([b"one two", b"", b" two\tone\n"], 2).words()
    assert of.tolist() == [0, 0, 2, 2] and hashes[0] == hashes[3] and hashes[1] == hashes[2] and hashes[0] != hashes[1]
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64))
    found = grams.KeyTable(keys[::2]).find(keys)
    assert (found[::2] == np.arange(len(keys[::2]))).all() and (found[1::2] == -1).all()
