"""Language-model scores by context-tree weighting over bytes.

A byte is coded as eight binary decisions. For each node of that binary tree there is a context tree over the last ORDER
bytes. Every context node keeps the counts of zeros and ones seen there and their Krichevsky-Trofimov probability KT; the
weighted probability of a node is W = 1/2 KT + 1/2 (product of its children's W), and KT at full depth. Under frozen counts
the probability of a bit is mixed along its context path: a node's own KT estimate has the weight 1/2 KT / W, and what lies
below has the rest. A text's score is the log10 of the product over its bytes and an end symbol.

The counts are gathered from all training texts. Grams of ORDER + 1 bytes are grouped by the last two context bytes, so all
nodes from depth 2 down are worked out where their grams are; depths 0 and 1 have 65,535 nodes at most. For scoring, the
model is cut into shards by the same two bytes, of SHARD entries and one bucket more at most, and texts are passed over once per
shard; the parts add up. There are as many shards as the model needs, and one at a time is in the driver's memory and
broadcast. Word counts for the base score are cut likewise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import grams
from tessera.llm.common import arrow_batches, materialize, row_key, shuffle_partitions, union_all

ORDER = 5
#: Entries of the model, and words, that are sent to the executors for one pass; what is broadcast is 16 bytes each.
SHARD = 2_000_000
#: Parts that the model and the words are written in, at least and at most (one for each pair of bytes); a shard takes whole ones.
BUCKETS, MOST_BUCKETS = 512, 1 << 16


def log2_gamma(x: np.ndarray) -> np.ndarray:
    """log2 of the gamma function for x > 0, by Stirling's series at x + 8."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = np.ones_like(y)
    for k in range(8):
        shift = shift * (x + k)
    return (series - np.log(shift)) / np.log(2)


def log2_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log2 of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log2_gamma(zeros + 0.5) + log2_gamma(ones + 0.5) - log2_gamma(zeros + ones + 1.0) - np.log2(np.pi)


def weighted(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(log2 W, the weight of the node's own estimate); below: sum of log2 W of the children, None at full depth."""
    own = log2_kt(zeros, ones)
    if below is None:
        return own, np.ones(len(own))
    own, below = own - 1.0, below - 1.0
    both = np.logaddexp2(own, below)
    return both, np.exp2(own - both)


@dataclass
class Nodes:
    """Nodes of one depth, sorted by key (context bytes, newest highest, then the bits of the symbol so far behind a 1)."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    log2_w: np.ndarray
    weight: np.ndarray

    def estimate(self) -> np.ndarray:
        """Probability of a one by the node's own counts."""
        return (self.ones + 0.5) / (self.zeros + self.ones + 1.0)


def tree_keys(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context with the newest byte highest, symbol) of grams as grams.Texts.keys gives them."""
    context = np.zeros(len(keys), np.uint64)
    for d in range(1, order + 1):
        context = context << np.uint64(8) | (keys >> np.uint64(8 * d)) & np.uint64(255)
    return context, keys & np.uint64(255)


def deep_nodes(context: np.ndarray, symbol: np.ndarray, n: np.ndarray, order: int, to: int = 2) -> dict[int, Nodes]:
    """Nodes of the depths order to `to` from the counts of whole subtrees."""
    found: dict[int, Nodes] = {}
    below = None
    for depth in range(order, to - 1, -1):
        at = context >> np.uint64(8 * (order - depth))
        keys, zeros, ones = [], [], []
        for k in range(8):
            prefix = np.uint64(1 << k) | symbol >> np.uint64(8 - k)
            bit = (symbol >> np.uint64(7 - k)) & np.uint64(1) == 1
            key, row = np.unique(at << np.uint64(8) | prefix, return_inverse=True)
            keys.append(key)
            zeros.append(np.bincount(row, np.where(bit, 0, n), len(key)))
            ones.append(np.bincount(row, np.where(bit, n, 0), len(key)))
        keys, zeros, ones = np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones)
        rank = np.argsort(keys)
        keys, zeros, ones = keys[rank], zeros[rank], ones[rank]
        if below is not None:
            lower = np.bincount(np.searchsorted(keys, parent_keys(below.keys)), below.log2_w, len(keys))
        found[depth] = below = Nodes(keys, zeros, ones, *weighted(zeros, ones, lower if below is not None else None))
    return found


def parent_keys(keys: np.ndarray) -> np.ndarray:
    """The same symbol bits in the context without its oldest byte."""
    return keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255)


@dataclass
class Top:
    """Estimates and weights of depths 0 and 1, by key."""

    estimate: list[np.ndarray]
    weight: list[np.ndarray]


def top_nodes(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Top:
    """Depths 1 and 0 from the sums over the children of each node of depth 1."""
    top = Top([np.full(256, 0.5), np.full(65536, 0.5)], [np.ones(256), np.ones(65536)])
    log2_w, weight = weighted(zeros, ones, below)
    at = keys.astype(np.int64)
    top.estimate[1][at], top.weight[1][at] = (ones + 0.5) / (zeros + ones + 1.0), weight
    prefix = at & 255
    z, o, lower = (np.bincount(prefix, x, 256) for x in (zeros, ones, log2_w))
    _, weight = weighted(z, o, lower)
    top.estimate[0], top.weight[0] = (o + 0.5) / (z + o + 1.0), weight
    return top


def path_bits(context: np.ndarray, symbol: np.ndarray, order: int, top: Top, deep) -> np.ndarray:
    """log2 probability of each symbol in its context. deep(depth, keys) gives (found, estimate, weight)."""
    total = np.zeros(len(symbol))
    for k in range(8):
        prefix = np.uint64(1 << k) | symbol >> np.uint64(8 - k)
        p = np.full(len(symbol), 0.5)
        for depth in range(order, -1, -1):
            keys = context >> np.uint64(8 * (order - depth)) << np.uint64(8) | prefix
            if depth < 2:
                at = keys.astype(np.int64)
                estimate, weight = top.estimate[depth][at], top.weight[depth][at]
                p = weight * estimate + (1 - weight) * p
            else:
                there, estimate, weight = deep(depth, keys)
                p = np.where(there, weight * estimate + (1 - weight) * p, 0.5)
        one = (symbol >> np.uint64(7 - k)) & np.uint64(1) == 1
        total += np.log2(np.where(one, p, 1 - p))
    return total


def _buckets(count: int) -> np.ndarray:
    """Bucket of each pair of newest context bytes; count is a power of two."""
    return (np.arange(1 << 16) * 40503 % (1 << 16)) // ((1 << 16) // count)


def _cut(sizes: list[tuple[int, int]], count: int, shard: int) -> list[tuple[int, int]]:
    """Ranges of buckets of at most `shard` entries each, but for a bucket that has more by itself; they cover all buckets."""
    ranges, low, held = [], 0, 0
    for bucket, size in sorted(sizes):
        if held and held + size > shard:
            ranges.append((low, bucket))
            low, held = bucket, 0
        held += size
    return [*ranges, (low, count)]


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, first bytes first."""
    return zlib.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), 1) if values.size else b""


def _opened(parts: list[bytes], sizes: list[int], kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    found = [np.ascontiguousarray(np.frombuffer(zlib.decompress(p), np.uint8).reshape(width, n).T).view(kind)[:, 0] for p, n in zip(parts, sizes, strict=True)]
    return np.concatenate([*found, np.empty(0, kind)])


def _packed(key: np.ndarray, bucket: np.ndarray, columns: list[np.ndarray], lead: list) -> Iterator[pa.RecordBatch]:
    """One row per bucket: lead, bucket, size, and the entries in the order of their keys; keys as differences."""
    order = np.lexsort((key, bucket))
    bucket, key = bucket[order], key[order]
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.empty(0, np.int64)
    for low in range(0, len(first), 64):
        ends = [*first[low + 1 : low + 65].tolist(), len(bucket)][: len(first[low : low + 64])]
        spans = list(zip(first[low : low + 64].tolist(), ends, strict=True))
        gaps = pa.array([_squeezed(np.diff(key[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary())
        values = [pa.array([_squeezed(c[a:b]) for a, b in spans], pa.binary()) for c in columns]
        heads = [pa.array([x] * len(spans), pa.int32()) for x in lead]
        arrays = [*heads, pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), pa.array([b - a for a, b in spans], pa.int64()), gaps, *values]
        yield pa.RecordBatch.from_arrays(arrays, names=[f"c{n}" for n in range(len(arrays))])


def _keys(parts: list[bytes], sizes: list[int]) -> np.ndarray:
    """The keys of the parts, one after the other, from their differences."""
    found = _opened(parts, sizes, np.uint64)
    for low, n in zip(np.cumsum([0, *sizes[:-1]]).tolist() if sizes else [], sizes, strict=True):
        np.cumsum(found[low : low + n], out=found[low : low + n])
    return found


def _gather(batches: Iterator[pa.RecordBatch], order: int):
    """The grams of a partition, by tree keys."""
    parts = [(b.column("key").to_numpy().view(np.uint64), b.column("n").to_numpy()) for b in batches]
    if not parts:
        return None
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    return keys, *tree_keys(keys, order), n.astype(np.float64)


class Shard:
    """What a pass needs: grams with their code, the deep nodes for grams not seen, and words with their counts.

    It travels as compressed bytes; each worker opens it and builds its tables once.
    """

    def __init__(self, rows: pa.Table, words: pa.Table | None, order: int, top: Top, own: tuple[int, int], own_words: tuple[int, int], buckets: int):
        self.order, self.top, self.own, self.own_words, self.buckets = order, top, own, own_words, buckets
        self.raw = {}
        for d in range(2, order + 2):
            own = rows.filter(pc.equal(rows.column("depth"), d))
            self.raw[d] = tuple(own.column(c).to_pylist() for c in ("size", "key", "a", "b"))
        self.raw_words = None if words is None else tuple(words.column(c).to_pylist() for c in ("size", "key", "n"))

    def open(self) -> None:
        if hasattr(self, "tables"):
            return
        self.parts, self.tables = {}, {}
        for d in sorted(self.raw):
            sizes, key, a, b = self.raw.pop(d)
            key = _keys(key, sizes)
            rank = np.argsort(key, kind="stable")
            self.parts[d] = key[rank], _opened(a, sizes, np.float32)[rank], _opened(b, sizes, np.float32)[rank] if d <= self.order else None
            self.tables[d] = grams.KeyTable(self.parts[d][0])
        bucket = _buckets(self.buckets)
        self.mine = (bucket >= self.own[0]) & (bucket < self.own[1])
        if self.raw_words is not None:
            sizes, key, n = self.raw_words
            key = _keys(key, sizes)
            rank = np.argsort(key, kind="stable")
            self.words = key[rank], _opened(n, sizes, np.int64)[rank]
            self.word_table = grams.KeyTable(self.words[0])
        self.raw = self.raw_words = None

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """log2 probabilities of grams; 0 for those of other shards."""
        if self.mine.all():
            return self._bits(keys)
        out = np.zeros(len(keys))
        newest = (keys >> np.uint64(8)) & np.uint64(255)
        newest = (newest << np.uint64(8) | (keys >> np.uint64(16)) & np.uint64(255)).astype(np.int64)
        at = np.flatnonzero(self.mine[newest])
        out[at] = self._bits(keys[at])
        return out

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        row = self.tables[self.order + 1].find(keys)
        codes = self.parts[self.order + 1][1]
        out = codes[row].astype(np.float64) if len(codes) else np.zeros(len(keys))
        new = np.flatnonzero(row < 0)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)

            def deep(depth, at):
                _, estimate, weight = self.parts[depth]
                row = self.tables[depth].find(at)
                return (row >= 0, estimate[row], weight[row]) if len(estimate) else (row >= 0, 0.5, 1.0)

            out[new] = path_bits(*tree_keys(fresh, self.order), self.order, self.top, deep)[back]
        return out

    def word_logs(self, laid: grams.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: words and end, those of them that training has, and the sum of log10(count + 0.5); of this shard only."""
        hashes, of = laid.words()
        hashes, of = np.concatenate((hashes, np.full(laid.count, grams.END_WORD))), np.concatenate((of, np.arange(laid.count)))
        if self.own_words != (0, self.buckets):
            bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
            mine = (bucket >= self.own_words[0]) & (bucket < self.own_words[1])
            hashes, of = hashes[mine], of[mine]
        row = self.word_table.find(hashes)
        n = np.where(row >= 0, self.words[1][row], 0) if len(self.words[1]) else np.zeros(len(hashes))
        return np.bincount(of, minlength=laid.count), np.bincount(of, row >= 0, laid.count), np.bincount(of, np.log10(n + 0.5), laid.count)


def _score(df: DataFrame, shared, name: str) -> DataFrame:
    """df (doc_id, k1, k2, held_out, text) with the parts of a broadcast shard in place of the text, written."""
    kept = [c for c in df.columns if c != "text"]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", words long, known long, logs double, bits double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        model.open()
        counts_words = hasattr(model, "words")
        for batch in batches:
            texts = [grams.lowered(t, "ascii") for t in batch.column("text").to_pylist()]
            words, known, logs, bits = [], [], [], []
            at = 0
            while at < len(texts):
                held, size = [], 0
                while at < len(texts) and size < grams.AT_ONCE // 2:
                    held.append(texts[at])
                    size += len(texts[at])
                    at += 1
                laid = grams.Texts(held, model.order)
                bits.append(np.add.reduceat(model.bits(laid.keys()), laid.bounds()))
                for out, x in zip((words, known, logs), model.word_logs(laid) if counts_words else [np.zeros(laid.count)] * 3, strict=True):
                    out.append(x)
            values = [np.concatenate([*x, np.empty(0)]) for x in (words, known, logs, bits)]
            columns = [batch.column(c) for c in kept] + [pa.array(v.astype(np.int64) if i < 2 else v) for i, v in enumerate(values)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "words", "known", "logs", "bits"])

    return materialize(df.mapInArrow(run, schema), name)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 5; a null id: no."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


def scores(df: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, shard: int = SHARD) -> DataFrame:
    """One row per row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is an empty one: its only token is its end. Rows with a null id are scored, but neither held out nor
    learned from. Repeated rows are learned from and returned as often as they occur. With nothing to learn from all bits
    have probability 1/2. Extra columns are ignored.
    """
    if order < 2:
        raise ValueError("the model is cut by the last two bytes, so the order is 2 at least")
    spark = df.sparkSession
    arrow_batches(spark)
    k1, k2 = row_key(doc_id, text)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held_out"), k1.alias("k1"), k2.alias("k2"))
    learned = rows.where("doc_id IS NOT NULL AND NOT held_out").select(F.lit(0).alias("part"), "text")
    found = materialize(grams.counts(learned, order, words=True).select("kind", "key", "n"), "counts")
    words = found.where(F.col("kind") == grams.WORD).select("key", "n")
    vocabulary, train_tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    distinct, count = found.count(), BUCKETS
    while count < MOST_BUCKETS and 32 * distinct > shard * count:  # a bucket is a small part of a shard
        count *= 2

    newest = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    counted = found.where(F.col("kind") == grams.GRAM).select("key", "n").repartition(shuffle_partitions(spark), newest)

    def sums(batches):
        if (got := _gather(batches, order)) is not None:
            _, context, symbol, n = got
            nodes = deep_nodes(context, symbol, n, order)[2]
            yield pa.RecordBatch.from_arrays([pa.array(parent_keys(nodes.keys).view(np.int64)), pa.array(nodes.zeros), pa.array(nodes.ones), pa.array(nodes.log2_w)], names=["key", "zeros", "ones", "below"])

    ones = counted.mapInArrow(sums, "key long, zeros double, ones double, below double")
    upper = ones.groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
    top = top_nodes(*(upper.column(c).to_numpy() for c in ("key", "zeros", "ones", "below")))

    def model(batches):
        if (got := _gather(batches, order)) is not None:
            keys, context, symbol, n = got
            nodes = deep_nodes(context, symbol, n, order)
            tables = {d: grams.KeyTable(x.keys) for d, x in nodes.items()}
            estimates = {d: x.estimate() for d, x in nodes.items()}

            def deep(depth, at):
                row = tables[depth].find(at)
                return row >= 0, estimates[depth][row], nodes[depth].weight[row]

            buckets = _buckets(count)
            bucket = lambda where: buckets[(where >> np.uint64(8 * (order - 2))).astype(np.int64)]
            bits = path_bits(context, symbol, order, top, deep)
            yield from _packed(keys, bucket(context), [bits.astype(np.float32), np.empty((len(keys), 0), np.float32)], [order + 1])
            for d, x in nodes.items():
                where = x.keys >> np.uint64(8) << np.uint64(8 * (order - d))
                yield from _packed(x.keys, bucket(where), [estimates[d].astype(np.float32), x.weight.astype(np.float32)], [d])

    def packed_words(batches):
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)
            yield from _packed(key, (key % np.uint64(count)).astype(np.int64), [batch.column("n").to_numpy()], [])

    entries = materialize(counted.mapInArrow(model, "depth int, bucket int, size long, key binary, a binary, b binary"), "nodes")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    words = materialize(words.mapInArrow(packed_words, "bucket int, size long, key binary, n binary"), "words")
    arrow_batches(spark)
    ranges, word_ranges = ([*_cut([tuple(r) for r in t.groupBy("bucket").agg(F.sum("size")).collect()], count, shard)] for t in (entries, words))
    parts = []
    for number in range(max(len(ranges), len(word_ranges))):
        own = ranges[number] if number < len(ranges) else (count, count)
        own_words = word_ranges[number] if number < len(word_ranges) else (count, count)
        inside = lambda low, high: (F.col("bucket") >= low) & (F.col("bucket") < high)
        model_rows = entries.where(inside(*own)).select("depth", "size", "key", "a", "b").toArrow()
        word_rows = words.where(inside(*own_words)).toArrow() if number < len(word_ranges) else None
        shared = spark.sparkContext.broadcast(Shard(model_rows, word_rows, order, top, own, own_words, count))
        del model_rows, word_rows
        parts.append(_score(rows, shared, f"pass{number}"))
        shared.destroy()
        pa.default_memory_pool().release_unused()
    if len(parts) == 1:
        whole = parts[0]
    else:  # rows that are equal get equal parts, so their sums are divided by how many there are
        tagged = union_all([p.withColumn("pass", F.lit(i)) for i, p in enumerate(parts)])
        by = tagged.groupBy("doc_id", "held_out", "k1", "k2").agg(F.count_if(F.col("pass") == 0).alias("copies"), *(F.sum(c).alias(c) for c in ("words", "known", "logs", "bits")))
        by = by.withColumns({c: (F.col(c) / F.col("copies")).cast(t) for c, t in (("words", "long"), ("known", "long"), ("logs", "double"), ("bits", "double"))})
        whole = by.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    floor = float(np.log10(train_tokens + 0.5 * (vocabulary + 1)))
    return whole.select(
        "doc_id", "held_out", F.col("words").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("words") * F.lit(floor)).alias("base_score"), (F.col("bits") * F.lit(float(np.log10(2)))).alias("score"),
    )
