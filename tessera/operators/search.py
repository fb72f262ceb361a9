"""Similarity search of bags: every query against all reference items, in blocks.

Queries are broadcast in chunks of bounded size. Each task scores the reference rows it reads against a chunk with NumPy,
keeps the k best per query, and a window merges what the tasks kept; references are never shuffled. Ties go to the
smaller reference id. An item is excluded when the query has an exclusion key and the item's is equal to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import scratch

#: Queries in one broadcast chunk.
QUERIES = 4096
#: Query bags in one broadcast chunk of tile matching.
BAGS = 2048
MATCHES = "query_id string, tile int, kind string, label string, weight double, sample_id string, position int, similarity double"
#: Reference bags that a task matches at once.
MATCHED_AT_ONCE = 256
#: Reference bags in one partition at most, and similarities that are worked on at once.
REFERENCES, TILES_AT_ONCE = 1 << 15, 1 << 19
PACKED = "ids array<string>, keys array<string>, labels array<string>, sizes array<int>, vecs binary"


def exclusion_key(level: str, aggregation: str = "slide"):
    """The column that keeps a query from its own group: level none, slide, case or patient."""
    if level == "none":
        return F.lit(None).cast("string")
    if level == "slide":
        if aggregation != "slide":
            raise ValueError("exclusion by slide needs aggregation by slide")
        return F.col("sample_id")
    return F.col(level)


class Barcodes:
    """Median over the query's rows of the smallest Hamming distance to the item's rows; bits are falls along the vector."""

    def prepare(self, vecs: list) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(v) for v in vecs], np.int64)
        rows = [np.where(np.diff(np.asarray(x, np.float32)) < 0, 1.0, -1.0) for v in vecs for x in v]
        return np.array(rows, np.float32).reshape(len(rows), -1), sizes

    def score(self, query, refs) -> np.ndarray:
        (q, _), (r, sizes) = query, refs
        out = np.full(len(sizes), np.inf)
        if not len(q) or not len(r):
            return out
        distance = (q.shape[1] - q @ r.T) / 2
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        out[sizes > 0] = np.median(np.minimum.reduceat(distance, starts, axis=1), axis=0)
        return out


class Cosine:
    """Negative cosine of single vectors; a zero vector has cosine 0."""

    def prepare(self, vecs: list) -> np.ndarray:
        x = np.array([v[0] for v in vecs], np.float64)
        return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-300)

    def score(self, query, refs) -> np.ndarray:
        return -(refs * query[0]).sum(1)


class Prototypes:
    """Soft-min over prototypes of the Mahalanobis distance between means; vecs holds the means, then the covariances."""

    def __init__(self, eps: float = 1e-6, tau: float = 0.5):
        self.eps, self.tau = eps, tau

    def prepare(self, vecs: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bags of equal shape together: (their numbers, means, covariances), each with a row per bag."""
        halves = [np.array(v, np.float64) for v in vecs]
        shapes: dict[tuple, list[int]] = {}
        for i, h in enumerate(halves):
            shapes.setdefault(h.shape, []).append(i)
        found = []
        for own in shapes.values():
            both = np.stack([halves[i] for i in own])
            half = both.shape[1] // 2
            found.append((np.array(own), both[:, :half], np.maximum(both[:, half:], 0.0)))
        return found

    def score(self, query, refs) -> np.ndarray:
        ((_, (mean,), (cov,)),) = query
        out = np.full(sum(len(own) for own, _, _ in refs), np.inf)
        for own, other, spread in refs:
            n = min(len(mean), other.shape[1])
            if n:
                d = min(mean.shape[-1], other.shape[-1])
                x = np.sqrt(((mean[:n, :d] - other[:, :n, :d]) ** 2 / (cov[:n, :d] + spread[:, :n, :d] + self.eps)).sum(-1))
                low = x.min(1)
                out[own] = -self.tau * np.log(np.exp(-(x - low[:, None]) / self.tau).mean(1)) + low
        return out


def topk(queries: DataFrame, refs: DataFrame, distance, k: int = 10, chunk: int = QUERIES) -> DataFrame:
    """hits(query_id, rank, sample_id, score): the k reference items of least distance for each query.

    Both sides: sample_id, exclusion_key, vecs (array of vectors). distance has prepare() and score(), as above.
    """
    spark = queries.sparkSession
    parts = max(1, -(-queries.count() // chunk))
    found = []
    for number in range(parts):
        own = queries.where(F.pmod(F.xxhash64("sample_id"), F.lit(parts)) == number) if parts > 1 else queries
        shared = spark.sparkContext.broadcast([(r.sample_id, r.exclusion_key, distance.prepare([r.vecs])) for r in own.select("sample_id", "exclusion_key", "vecs").collect()])
        found.append(refs.select("sample_id", "exclusion_key", "vecs").mapInArrow(_kept(shared, distance, k), "query_id string, sample_id string, score double"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "sample_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "sample_id", "score")


def _kept(shared, distance, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[tuple[float, str]]] = {}
        for batch in batches:
            ids = np.array(batch.column("sample_id").to_pylist(), object)
            if not len(ids):
                continue
            keys = np.array(batch.column("exclusion_key").to_pylist(), object)
            refs = distance.prepare(batch.column("vecs").to_pylist())
            for query, key, prepared in shared.value:
                scores = distance.score(prepared, refs)
                open_ = np.flatnonzero(keys != key) if key is not None else np.arange(len(ids))
                if len(open_) > k:
                    floor = np.partition(scores[open_], k - 1)[k - 1]
                    open_ = open_[scores[open_] <= floor]
                best[query] = sorted([*best.get(query, []), *zip(scores[open_].tolist(), ids[open_].tolist(), strict=True)])[:k]
        rows = [(q, i, s) for q, kept in best.items() for s, i in kept]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["query_id", "sample_id", "score"])

    return run


def class_weights(labels: DataFrame, label: str = "category", factor: float = 10.0) -> DataFrame:
    """(label, weight): inverse frequencies over all rows with a label, scaled to sum to factor."""
    counts = labels.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum(1.0 / F.col("n")).alias("total"))
    return counts.join(F.broadcast(total)).select("label", (F.lit(factor) / F.col("n") / F.col("total")).alias("weight"))


def tile_matches(queries: DataFrame, refs: DataFrame, weights: dict[str, float], threshold: float = 0.7, top: int = 5, chunk: int = BAGS) -> DataFrame:
    """For each query tile the matches of cosine >= threshold: (query_id, tile, label, weight) sums and the top matches.

    queries and refs: sample_id, exclusion_key, category, vecs. Returns query_id, tile, kind ("label" or "match"), label,
    weight, sample_id, position, similarity. Only the top matches of a task leave it; the weights leave it summed. References are
    packed once into few partitions, so that what leaves the tasks doesn't grow with the number of files.
    """
    spark = queries.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")  # a packed block is a wide row
    bags = scratch.written(queries.select("sample_id", "exclusion_key", "vecs"), "querybags")
    parts = max(1, -(-bags.count() // chunk))
    most = 2 * spark.sparkContext.defaultParallelism
    split = max(1, -(-most // parts), -(-refs.count() // REFERENCES))
    packed = refs.select("sample_id", "exclusion_key", "category", "vecs").repartition(split).mapInArrow(_packed, PACKED)
    packed = scratch.written(packed, "references")
    found = None
    for number in range(parts):
        rows = bags.where(F.pmod(F.xxhash64("sample_id"), F.lit(parts)) == number).collect()
        shared = spark.sparkContext.broadcast([(r.sample_id, r.exclusion_key, _unit(np.array(r.vecs, np.float64))) for r in rows])
        part = packed.mapInArrow(_matched(shared, weights, threshold, top), MATCHES)
        found = part if found is None else found.unionByName(part)
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x**2).sum(-1, keepdims=True)) + 1e-12)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of MATCHED_AT_ONCE bags in the order of their labels; their unit vectors are the bytes of one matrix."""
    for batch in batches:
        for low in range(0, batch.num_rows, MATCHED_AT_ONCE):
            part = pa.Table.from_batches([batch.slice(low, MATCHED_AT_ONCE)]).sort_by([("category", "ascending")]).combine_chunks()
            ids, keys, labels, vecs = (part.column(c).combine_chunks() for c in ("sample_id", "exclusion_key", "category", "vecs"))
            sizes = pc.list_value_length(vecs).fill_null(0).to_numpy(zero_copy_only=False)
            flat = np.asarray(vecs.flatten().flatten().to_numpy(zero_copy_only=False), np.float64)
            if sizes.sum():
                x = _unit(flat.reshape(int(sizes.sum()), -1))
                columns = [pa.array([v], t) for v, t in ((ids.to_pylist(), pa.list_(pa.string())), (keys.to_pylist(), pa.list_(pa.string())), (labels.to_pylist(), pa.list_(pa.string())), (sizes.tolist(), pa.list_(pa.int32())), (x.tobytes(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "keys", "labels", "sizes", "vecs"])


def _matched(shared, weights: dict[str, float], threshold: float, top: int) -> Callable:
    """Similarities are rounded to 12 decimals, so that tiles alike score alike wherever they stand."""
    cut = (np.ceil(np.round(threshold * 1e12, 3)) - 0.5) / 1e12  # what rounds to the threshold or more

    def run(batches):
        if not shared.value:
            return
        names, keys, bags = zip(*shared.value, strict=True)
        tiles, sizes = np.concatenate(bags), np.array([len(b) for b in bags])
        owner, first = np.repeat(np.arange(len(bags)), sizes), np.cumsum(sizes) - sizes
        of_name, of_key = ({} for _ in range(2))
        for i, (name, key) in enumerate(zip(names, keys, strict=True)):
            of_name.setdefault(name, []).append(i)
            if key is not None:
                of_key.setdefault(key, []).append(i)
        sums: dict[str | None, np.ndarray] = {}
        floor = np.full(len(tiles), cut)  # what a further match must have to be among the top
        best = [np.empty(0, np.int64), np.empty(0), np.empty(0, object), np.empty(0, np.int32), np.empty(0, object)]  # tile, similarity, item, position, label
        for batch in batches:
            for row in range(batch.num_rows):
                refs, groups, labels, count = (batch.column(c)[row].as_py() for c in ("ids", "keys", "labels", "sizes"))
                count = np.array(count)
                x = np.frombuffer(batch.column("vecs")[row].as_py(), np.float64).reshape(count.sum(), -1)
                of, ends = np.repeat(np.arange(len(refs)), count), np.cumsum(count)
                closed = [(ref, q) for ref, (name, key) in enumerate(zip(refs, groups, strict=True)) for q in {*of_name.get(name, ()), *of_key.get(key, ())}]
                tile_label = np.array([*labels, None], object)[of]
                runs = np.flatnonzero(np.concatenate(([True], tile_label[1:] != tile_label[:-1])))
                new = []
                for label in tile_label[runs]:
                    sums.setdefault(label, np.full(len(tiles), np.nan))
                at_once = max(1, TILES_AT_ONCE // len(x))
                barred = sorted((int(first[q]), int(sizes[q]), int(ends[ref] - count[ref]), int(ends[ref])) for ref, q in closed)
                for low in range(0, len(tiles), at_once):
                    high = min(low + at_once, len(tiles))
                    raw = tiles[low:high] @ x.T
                    raw[np.isnan(raw)] = -np.inf
                    for start, size, left, right in barred:
                        if start < high and start + size > low:
                            raw[max(0, start - low) : max(0, start + size - low), left:right] = -np.inf
                    if raw.shape[1] > top and (floor[low:high] == cut).all():
                        floor[low:high] = np.maximum(cut, np.partition(raw, -top, axis=1)[:, -top] - 1e-12)
                    t, r = np.nonzero(raw >= floor[low:high, None])
                    new.append((t + low, np.round(raw[t, r], 12), r))
                    open_ = raw >= cut
                    raw += 1
                    raw *= 0.5
                    raw[~open_] = 0.0
                    here = np.add.reduceat(raw, runs, axis=1)
                    seen = np.logical_or.reduceat(open_, runs, axis=1)
                    for k, label in enumerate(tile_label[runs]):
                        own, add = sums[label][low:high], seen[:, k]
                        own[add] = np.nan_to_num(own[add]) + here[add, k] * weights.get(label, 0.0)
                t, s, r = (np.concatenate(v) for v in zip(*new, strict=True))
                position = (r - (ends - count)[of[r]]).astype(np.int32)
                best = [np.concatenate(v) for v in zip(best, (t, s, np.array([*refs, None], object)[of[r]], position, tile_label[r]), strict=True)]
                rank = np.unique(best[2].astype(str), return_inverse=True)[1]
                order = np.lexsort((best[3], rank, -best[1], best[0]))
                start = np.concatenate(([True], best[0][order][1:] != best[0][order][:-1])) if len(order) else np.empty(0, bool)
                place = np.arange(len(order)) - np.flatnonzero(start)[np.cumsum(start) - 1] if len(order) else order
                best = [v[order][place < top] for v in best]
                last = np.flatnonzero(place[place < top] == top - 1)
                floor[best[0][last]] = np.maximum(cut, best[1][last] - 1e-12)
        ids, told = np.array([*names, None], object), []
        for label, w in sums.items():
            t = np.flatnonzero(~np.isnan(w))
            told.append((t, "label", np.full(len(t), label, object), w[t], None, None, None))
        told.append((best[0], "match", best[4], None, best[2], best[3], best[1]))
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.int32(), pa.float64()]
        for t, kind, *rest in told:
            columns = [ids[owner[t]], (t - first[owner[t]]).astype(np.int32), np.full(len(t), kind, object), *rest]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(t), o) if c is None else pa.array(c, o) for c, o in zip(columns, types, strict=True)], names=["query_id", "tile", "kind", "label", "weight", "sample_id", "position", "similarity"])

    return run


def entropies(matches: DataFrame) -> DataFrame:
    """(query_id, tile, entropy): natural entropy of the shares of the labels of a tile's matches."""
    sums = matches.where("kind = 'label'").groupBy("query_id", "tile", "label").agg(F.sum("weight").alias("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy("query_id", "tile"))
    return sums.withColumn("p", share).groupBy("query_id", "tile").agg(F.coalesce(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p"))), F.lit(0.0)).alias("entropy"))


def retccl(queries: DataFrame, refs: DataFrame, k: int = 5, threshold: float = 0.7, top: int = 5, factor: float = 10.0) -> DataFrame:
    """hits(query_id, rank, sample_id, score) by tile matching: certain tiles vote for one slide each.

    Tiles are taken by falling entropy of their matches; those whose mean top similarity is below the mean of all tiles of
    the query drop out; each other tile names the slide of its first match with its most common label.
    """
    weights = {r.label: r.weight for r in class_weights(refs, factor=factor).collect()}  # one row per label
    matches = scratch.written(tile_matches(queries, refs, weights, threshold, top), "matches")  # read for the matches and for the labels
    own = F.row_number().over(Window.partitionBy("query_id", "tile").orderBy(F.desc("similarity"), "sample_id", "position"))
    best = matches.where("kind = 'match'").withColumn("own", own).where(F.col("own") <= top)
    means = best.groupBy("query_id", "tile").agg(F.avg("similarity").alias("mean"), F.array_sort(F.collect_list(F.struct("own", "label", "sample_id"))).alias("top"))
    tiles = queries.select(F.col("sample_id").alias("query_id"), F.posexplode("vecs").alias("tile", "_")).drop("_")
    tiles = tiles.join(means, ["query_id", "tile"], "left").join(entropies(matches), ["query_id", "tile"], "left")
    tiles = tiles.withColumn("eta", F.avg(F.coalesce("mean", F.lit(0.0))).over(Window.partitionBy("query_id"))).where("top IS NOT NULL AND mean >= eta")
    votes = tiles.select("query_id", "tile", "mean", "entropy", F.posexplode("top").alias("own", "m")).select("*", "m.label", "m.sample_id")
    labels = votes.groupBy("query_id", "tile", "mean", "entropy", "label").agg(F.count("*").alias("n"), F.min("own").alias("first"), F.min_by("sample_id", "own").alias("sample_id"))
    pick = F.row_number().over(Window.partitionBy("query_id", "tile").orderBy(F.desc("n"), "first"))
    named = labels.withColumn("pick", pick).where("pick = 1")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("entropy"), "tile"))
    first = F.row_number().over(Window.partitionBy("query_id", "sample_id").orderBy("order"))
    named = named.withColumn("order", order).withColumn("first", first).where("first = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("mean"), "order"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "sample_id", F.col("mean").alias("score"))


def neighbours(keys: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, predecessor, successor): the nearest smaller and larger distinct key of each distinct probe, strictly.

    One sort by range partitions: keys and probes are ordered together within ranges, and each range's last and first
    key come from an aggregate over the ranges, so no task sees all keys.
    """
    spark = keys.sparkSession
    both = keys.select("key").distinct().withColumn("known", F.lit(1)).unionByName(probes.select("key").distinct().withColumn("known", F.lit(0)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = keys.agg(F.percentile_approx("key", F.array(*[F.lit(i / parts) for i in range(1, parts)] or [F.lit(0.5)]), 1000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    both = both.groupBy("key").agg(F.max("known").alias("known"), F.min("known").alias("asked")).withColumn("bucket", bucket)
    known = F.when(F.col("known") == 1, F.col("key"))
    ends = both.groupBy("bucket").agg(F.max(known).alias("last"), F.min(known).alias("first"))  # one row per range
    left, right = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select("bucket", F.max("last").over(left).alias("before"), F.min("first").over(right).alias("after"))
    # each frame grows from its start; one that ends at the partition's end would be summed anew for every row
    up, down = (Window.partitionBy("bucket").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("key", F.desc("key")))
    both = both.withColumns({"low": F.max(known).over(up), "high": F.min(known).over(down)})
    return both.where("asked = 0").join(F.broadcast(ends), "bucket").select("key", F.coalesce("low", "before").alias("predecessor"), F.coalesce("high", "after").alias("successor"))
