"""Input that once failed: words that are tokens, long digit runs, number signs, special tokens, long paths, hot keys."""

import base64
import hashlib
import math
import unicodedata

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_rest import brute_spans

from tessera.llm import bpe, common, langid, packing, pii, revisits


def plain_bpe():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})


@pytest.mark.parametrize("text", ["hello world", "the", "a", " ", "1 2", "", "the the", "\n"])
def test_words_that_are_tokens(text):
    plain, coder = plain_bpe(), bpe.Vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for rows in ([text], [text], ["unmergeable qzxj wörds"], [text], [text, "the"]):  # cold, warm, after another batch
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(rows)] == [plain.encode_ordinary(t) for t in rows]


def test_single_documents_pass_through_digests(spark):
    plain = plain_bpe()
    for text in ("hello world", "the", "a", " "):
        row = bpe.digests(spark.createDataFrame([(1, text)], "doc_id long, text string"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).first()
        ids = plain.encode_ordinary(text)
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_long_digit_runs():
    zeros = "0" * 5000
    for text, spans in (
        (zeros + ".1.1.1", [(0, 5006, "ip")]), (f"1.{zeros}9.2.{zeros}255", [(0, 10009, "ip")]), (f"1.{zeros}256.2.3", []),
        ("9" * 5000 + ".1.1.1", []), ("1" * 5000, []),
    ):
        assert [s for s in pii.plain_spans(text) if s[2] == "ip"] == spans
    short = "00" + ".1.1.1"
    assert pii.plain_spans(short) == brute_spans(short)


def test_number_signs_are_no_letters(spark):
    docs = [(i, "the cat and the dog", "en") for i in range(8)]
    odd = ["½ ² ①", "Ⅷ", "٣ 42", "½a", "ǅ", "ʰ", "中", "́"]
    rows = docs + [(100 + i, t, None) for i, t in enumerate(odd)]
    got = {r.doc_id: r.lang_pred for r in langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t in enumerate(odd):
        assert (got[100 + i] == "und") == (not any(unicodedata.category(c).startswith("L") for c in t)), t


def test_special_tokens_are_the_tokenizer_s():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    fresh, coder = Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    rows = ["x <|endoftext|> y", "x<|endoftext|>y,", "<|endoftext|>.", "<|ENDOFTEXT|>.", "a <|startoftext|>b! c", "<|endoftext|", "<|endoftext|><|endoftext|>", "end <|EndOfText|>it."]
    assert len(fresh.encode(rows[0], add_special_tokens=False).ids) == 3
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.batch(rows)] == [fresh.encode(t, add_special_tokens=False).ids for t in rows]


def test_a_path_takes_few_rounds(spark, monkeypatch):
    rounds, materialize = [], common.materialize

    def counted(df, name):
        rounds.append(name)
        return materialize(df, name)

    monkeypatch.setattr(common, "materialize", counted)
    monkeypatch.setattr(common, "FEW_EDGES", 0)
    n = 10_000
    edges = spark.range(n).select((F.col("id") * 7919 % (n + 1)).alias("a"), ((F.col("id") + 1) * 7919 % (n + 1)).alias("b"))
    got = common.components(edges).agg(F.count("*"), F.min("root"), F.max("root")).first()
    assert tuple(got) == (n + 1, 0, 0)
    assert rounds.count("hooks") <= 20 and rounds.count("hooks") >= math.log2(n) / 2


@pytest.mark.parametrize("few", [0, 500, 100_000])
def test_a_crowd_is_one_component(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    monkeypatch.setattr(common, "FEW", few // 50)
    star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    clique = [(a, b) for a in range(5000, 5040) for b in range(a)if b >= 5000]
    got = common.components(star.union(spark.createDataFrame(clique, "a long, b long")))
    assert {tuple(r) for r in got.groupBy("root").count().collect()} == {(0, 3000), (5000, 40)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_deals_out_hot_keys(spark, how):
    left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 400).alias("k"), F.col("id").alias("n"))
    right = spark.range(300).select(F.col("id").cast("long").alias("k"), (F.col("id") * 2).alias("v"))
    got = common.lookup(left, right, "k", left.count(), how)
    plain = left.join(right, "k", how)
    assert got.columns == plain.columns and got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0


def test_one_response_that_serves_most_revisits(spark):
    rows = [(1, "response", "http://a.example/x", 1, 200, {"ETag": '"1"'}, "body")]
    rows += [(i, "revisit", "http://a.example/x", 2 + i % 5, 304, {"etag": '"1"'}, None) for i in range(2, 2000)]
    got = revisits.resolve(spark.createDataFrame(rows, "record_id long, kind string, url string, time long, status int, headers map<string,string>, payload string"))
    assert [tuple(r) for r in got.groupBy("source_id", "outcome", "payload").count().collect()] == [(1, "resolved", "body", 1998)]


def test_scratch_is_refused_where_it_can_t_be_shared(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.scratch_root(Session())


def test_a_table_is_few_files(spark):
    import os

    from tessera.llm import common

    most = common.FILES_PER_CORE * spark.sparkContext.defaultParallelism
    written = common.materialize(spark.range(0, 5000, 1, 211), "many")
    files = [f for f in os.listdir(written._scratch.removeprefix("file:")) if f.endswith(".parquet")]
    assert len(files) <= most and sorted(r.id for r in written.collect()) == list(range(5000))


def test_shuffle_files_go_with_the_write(spark):
    from tessera.llm import common

    def kept():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {b.toString() for b in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllBlocks()) if b.toString().startswith("shuffle_")}

    before = kept()
    counted = spark.range(0, 5000, 1, 7).repartition(5, "id").groupBy((F.col("id") % 100).alias("k")).count()
    written = common.materialize(counted, "counted")
    assert not kept() - before
    assert written.count() == 100 == counted.count()
    assert spark.conf.get(common.CLEANUP) == "false"


def test_a_local_scratch_file_has_no_checksum_file(spark):
    import os

    from tessera.llm import common

    written = common.materialize(spark.range(0, 5000, 1, 3), "plain")
    names = os.listdir(written._scratch.removeprefix("file:"))
    assert sum(n.endswith(".parquet") for n in names) == 3 and not [n for n in names if n.endswith(".crc")]
    assert sorted(r.id for r in written.collect()) == list(range(5000))
    common.discard(written)
    assert not os.path.exists(written._scratch.removeprefix("file:"))


def test_near_dedup_runs_without_the_tokenizers_of_a_worker():
    import pandas as pd

    from tessera.llm import bpe, common, jaccard, packing

    def held():
        return [name for name, kept in (("words", packing._TOKENIZERS), ("bytes", bpe._VOCABULARIES)) if "kept" in kept]

    def hold():
        packing._TOKENIZERS["kept"] = bpe._VOCABULARIES["kept"] = None
        assert held() == ["words", "bytes"]

    hold()
    assert len(jaccard._sets(5).func(pd.Series(["a b c d e f"]))[0]) == 2 and not held()
    hold()
    task = common.roomy(lambda batches: ((b, held()) for b in batches))(iter([1, 2]))
    assert next(task) == (1, [])
    hold()
    assert list(task) == [(2, ["words", "bytes"])] and not held()
