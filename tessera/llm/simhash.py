"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius.

Fingerprints are compared bit-sliced: the bits of many fingerprints lie in vertical planes (one machine word holds one
bit of 64 fingerprints), distances of one fingerprint to 64 others grow together in carry-save counters, and a word is
abandoned once all its lanes exceed the radius. A pigeonhole split decides which fingerprints meet: with a radius of 3
the two agree in one of four 16-bit bands, and in one of four quarters of the other 48 bits, so 16 keys of 28 bits
find every pair. Buckets above BLOCK fingerprints are cut into blocks, and pairs of blocks are compared apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batches, components, lookup, materialize, reached, room, roomy, row_key, shuffle_partitions, unused

SEED = 42
RADIUS = 3
#: Fingerprints in a block of a bucket; two blocks at most meet in a task at once.
BLOCK = 2048
#: (fingerprint, word) comparisons held in memory at once.
COMPARED_AT_ONCE = 1 << 19
#: Shingle hashes counted at once, for texts of any length.
HASHED_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text: A-Z lower-cased, words between ASCII white space, repeats count."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    take = max(1, len(words) - shingle + 1)
    ends = ends[len(words) - take :]
    digest, over = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, take, HASHED_AT_ONCE):
        pairs = zip(starts[at : min(at + HASHED_AT_ONCE, take)].tolist(), ends[at : at + HASHED_AT_ONCE].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in pairs], np.uint64)
        over += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * over > take, bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """df with the signed 64-bit fingerprint of a text column. Null and blank texts get 0; extra columns stay."""
    arrow_batches(df.sparkSession)


    @F.pandas_udf("long")
    def fingerprints(texts):
        import pandas as pd

        room()
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(out, fingerprints(F.col(text)))


def _keys(fp: Column) -> Column:
    """The 16 bucket keys of a fingerprint: table number, a 16-bit band, 12 of the other 48 bits."""
    bands = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = []
    for i in range(4):
        a, b, c = (bands[k] for k in range(4) if k != i)
        rest = a.bitwiseOR(F.shiftleft(b, 16)).bitwiseOR(F.shiftleft(c, 32))
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)
            keys.append(F.lit(4 * i + j).cast("long") * F.lit(1 << 28) + bands[i] * F.lit(1 << 12) + part)
    return F.array(*keys)


def close_pairs(fps: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of the same group whose fingerprints differ in radius bits or fewer. groups: ascending numbers."""
    n = len(fps)
    width = -(-n // 64)
    padded = np.zeros(width * 64, np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    masks = np.ascontiguousarray(bits[:n].T).astype(np.uint64) * np.uint64(0xFFFFFFFFFFFFFFFF)
    last = np.searchsorted(groups, groups, side="right") - 1
    first_word = np.arange(n) // 64
    words = last // 64 - first_word + 1
    words[last == np.arange(n)] = 0
    ends = np.cumsum(words)
    found_i, found_j = [], []
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + COMPARED_AT_ONCE, side="right")))
        count = words[low:high]
        q = np.repeat(np.arange(low, high), count)
        w = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) + first_word[q]
        q, w, alive = _within(planes, masks, q, w, radius)
        lanes = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(lanes)
        i, j = q[row], w[row] * 64 + lane
        keep = (j > i) & (j <= last[i])
        found_i.append(i[keep])
        found_j.append(j[keep])
        low = high
    return np.concatenate([*found_i, np.empty(0, np.int64)]), np.concatenate([*found_j, np.empty(0, np.int64)])


def _within(planes, masks, q, w, radius):
    """Carry-save counters of fingerprints q against the 64 lanes of words w; returns what stays within the radius."""
    size = max(1, radius.bit_length())
    spare = (1 << size) - 1 - radius  # preset, so that the counter overflows one past the radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    counter = [np.full(len(q), full if spare >> k & 1 else 0, np.uint64) for k in range(size)]
    over = np.zeros(len(q), np.uint64)
    for b in range(0, 64, 2):
        x, y = planes[b][w] ^ masks[b][q], planes[b + 1][w] ^ masks[b + 1][q]
        half = counter[0] ^ x
        carry = (counter[0] & x) | (half & y)  # full adder: two planes enter the lowest counter bit at once
        counter[0] = half ^ y
        for k in range(1, size):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if b % 8 == 6:
            live = over != full
            if live.mean() < 0.75:
                q, w, over, counter = q[live], w[live], over[live], [c[live] for c in counter]
    live = over != full
    return q[live], w[live], ~over[live]


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (key, a, b); the last, open group of a batch waits for the next batch."""
        rest = None
        for batch in _ended(batches):
            if batch is not None:
                columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "a", "b", "fp")]
                rest = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns, strict=True)]
                if len(rest[0]) < 50_000:
                    continue
            if rest is None or not len(rest[0]):
                continue
            key, a, b, fp = rest
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            cut = len(key) if batch is None else int(np.flatnonzero(new)[-1])
            rest = [x[cut:] for x in rest]
            if not cut:
                continue
            fps = fp[:cut].view(np.uint64)
            root = reached(cut, *close_pairs(fps, np.cumsum(new[:cut]), radius))
            at = np.flatnonzero(root != np.arange(cut))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[root[at]])], names=["a", "b"])

    return run


def _ended(batches):
    yield from batches
    yield None


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within the radius.

    The links of one bucket are reduced to one per fingerprint where they are found; they connect the same
    fingerprints as all pairs would. Complete for a radius up to 3.
    """
    if radius > 3:
        raise ValueError("the bucket keys are complete up to a radius of 3")
    parts = shuffle_partitions(fps.sparkSession)
    keyed = fps.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    met = lookup(keyed, sizes.withColumn("size", F.col("times")).drop("times"), "key", 16 * fps.count(), counts=sizes).withColumn("blocks", F.ceil(F.col("size") / F.lit(float(BLOCK))).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = met.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    met = met.repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b")
    return met.mapInArrow(roomy(_links(radius)), "a long, b long")


def _clustered(fps: DataFrame, radius: int) -> DataFrame:
    """fps (doc_id, fp, more) with root, the smallest fingerprint of the component, and its smallest doc_id, lowest."""
    counted = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("times"))
    firsts = materialize(counted, "firsts")
    joined = materialize(components(links(firsts.select("fp"), radius)), "components")
    rooted = joined.join(firsts.drop("times"), joined.node == firsts.fp).select("node", "root", "first")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("lowest"))
    linked = lookup(rooted, lowest, "root", joined.count()).select(F.col("node").alias("fp"), "root", "lowest")
    known = firsts.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("lowest", "first").alias("lowest"))
    return lookup(fps, known, "fp", fps.count(), counts=firsts)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row (doc_id, fingerprint as 16 hex digits, component_id) for each row of df.

    component_id is the smallest doc_id among the rows that are reachable over links. Texts that are null, empty or
    blank share the fingerprint 0 and so one component. Rows with a null doc_id take part; a component without any
    doc_id has a null component_id. Repeated rows are all returned. An empty table gives an empty result. Extra
    columns of df are ignored.
    """
    fps = with_fingerprint(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), out="fp", shingle=shingle)
    fps = materialize(fps.select("doc_id", "fp"), "fingerprints")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _clustered(fps, radius).select("doc_id", digits.alias("fingerprint"), F.col("lowest").alias("component_id"))


def grouped(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, k1, k2, fp, root, lowest) for each row of df: its row key, its fingerprint, and those of its component."""
    k1, k2 = row_key(doc_id, text)
    fps = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), k1.alias("k1"), k2.alias("k2"))
    fps = materialize(with_fingerprint(fps, out="fp", shingle=shingle).drop("text"), "fingerprints")
    return _clustered(fps, radius)


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """The rows of df that are first in their component, with all their columns.

    First is the smallest doc_id (nulls last), then, among rows that share it, the smallest hash of id and text. Of
    rows equal in id and text one stays.
    """
    k1, k2 = row_key(doc_id, text)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    first = grouped(df, doc_id, text, shingle, radius).groupBy("root").agg(F.min(order).alias("first"))
    x, y = unused(df, "kept_k1"), unused(df, "kept_k2")
    kept = first.select(F.col("first.k1").alias(x), F.col("first.k2").alias(y))
    marked = df.withColumns({x: k1, y: k2}).join(kept, [x, y], "left_semi")
    return marked.dropDuplicates([x, y]).select(*df.columns)
