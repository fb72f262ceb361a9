"""Nearest neighbours by inner product with score-aware (anisotropic) quantisation.

Vectors are cut into pairs of components, each pair coded in four bits. Codebooks and codes minimise a loss in which the
part of the residual that is parallel to the vector weighs more than the rest, as that part moves large inner products.
A scan adds up table entries, two codes per lookup; the best of each block are scored again on the original vectors in
double precision. Every row is indexed; only the codebooks are fitted on a bounded sample. Queries are broadcast in
chunks of bounded size, and the index is scanned once per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, union_all

#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 8192
#: Cosine above which a query's inner product with a vector is meant to count; sets the weight of the parallel residual.
THRESHOLD = 0.2
WIDTH = 2
CODES = 16
#: Standard deviations of the table scores' error that a row is given before it is passed over.
MARGIN = 2.0
#: Rows in a block.
BLOCK = 16384
#: Queries in one broadcast chunk.
QUERIES = 16384
_SCAN = 64


@dataclass
class Quantiser:
    """books: (parts, 16, WIDTH); vectors are padded with zeros to parts * WIDTH components."""

    books: np.ndarray
    ratio: float

    def pad(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.books) * WIDTH), np.float32)
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), len(self.books), WIDTH)

    def encode(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes (rows, parts) by coordinate descent on the anisotropic loss."""
        x = self.pad(x)
        unit = x / np.maximum(np.sqrt((x**2).sum(axis=(1, 2), keepdims=True)), 1e-30)
        rows = np.arange(len(x))
        parts = len(self.books)
        error = np.stack([((x[:, m, None] - self.books[m]) ** 2).sum(-1) for m in range(parts)], 1)
        along = np.stack([((x[:, m, None] - self.books[m]) * unit[:, m, None]).sum(-1) for m in range(parts)], 1)
        codes = error.argmin(-1)
        total = np.take_along_axis(along, codes[..., None], 2)[..., 0].sum(1)
        for _ in range(sweeps):
            for m in range(parts):
                rest = total - along[rows, m, codes[:, m]]
                codes[:, m] = (error[:, m] + (self.ratio - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                total = rest + along[rows, m, codes[:, m]]
        return codes.astype(np.uint8)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes per byte."""
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(bytes, 256, queries): what each packed byte adds to each query's score."""
        lut = np.einsum("qmw,mcw->mcq", self.pad(queries), self.books).astype(np.float32)
        if len(lut) % 2:
            lut = np.concatenate([lut, np.zeros_like(lut[:1])])
        return (lut[1::2, :, None] + lut[::2, None]).reshape(len(lut) // 2, 256, -1)


def fit(x: np.ndarray, threshold: float = THRESHOLD, rounds: int = 8) -> Quantiser:
    """Codebooks for the rows of x: k-means on each part, then anisotropic updates in closed form."""
    parts = -(-x.shape[1] // WIDTH)
    ratio = max(1.0, (x.shape[1] - 1) * threshold**2 / (1 - threshold**2))
    quantiser = Quantiser(np.zeros((parts, CODES, WIDTH), np.float32), ratio)
    padded = quantiser.pad(x)
    first = np.linspace(0, len(x) - 1, CODES).astype(int)
    for m in range(parts):
        rank = np.argsort(padded[:, m].sum(-1), kind="stable")
        quantiser.books[m] = padded[rank[first], m]
        for _ in range(rounds):
            code = ((padded[:, m, None] - quantiser.books[m]) ** 2).sum(-1).argmin(1)
            n = np.bincount(code, minlength=CODES)
            for w in range(WIDTH):
                quantiser.books[m, n > 0, w] = (np.bincount(code, padded[:, m, w], CODES) / np.maximum(n, 1))[n > 0]
    unit = padded / np.maximum(np.sqrt((padded**2).sum(axis=(1, 2), keepdims=True)), 1e-30)
    rows = np.arange(len(x))
    for _ in range(rounds // 2):
        codes = quantiser.encode(x)
        norm = (padded * unit).sum((1, 2))
        for m in range(parts):
            chosen = quantiser.books[np.arange(parts), codes]  # (rows, parts, WIDTH)
            rest = norm - (chosen * unit).sum((1, 2)) + (chosen[:, m] * unit[:, m]).sum(1)
            for c in range(CODES):
                at = rows[codes[:, m] == c]
                if len(at):
                    u = unit[at, m].astype(np.float64)
                    left = len(at) * np.eye(WIDTH) + (ratio - 1) * u.T @ u
                    right = padded[at, m].sum(0) + (ratio - 1) * (rest[at, None] * u).sum(0)
                    quantiser.books[m, c] = np.linalg.solve(left, right)
    return quantiser


class _Best:
    """The k best candidates of each query so far: score descending, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids = [np.empty(0, np.int64)] * queries
        self.scores = [np.empty(0)] * queries

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids[query], ids)), np.concatenate((self.scores[query], scores))
        if len(ids) > 4 * self.k:
            near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[near], scores[near]
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[query], self.scores[query] = ids[order], scores[order]


def scan(quantiser: Quantiser, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, best: _Best) -> None:
    """Scan one block: table scores choose the rows that exact scores then rank.

    The error of a table score has about the standard deviation |query| |residual| / sqrt(dimensions). A row is scored
    again unless it stays below the k-th best even with MARGIN deviations in its favour and against the others', so
    that crowds of rows that the codes can't tell apart are scored again as a whole.
    """
    packed = quantiser.pack(codes)
    coded = quantiser.books[np.arange(len(quantiser.books)), codes]
    slack = MARGIN * np.sqrt(((quantiser.pad(vectors) - coded) ** 2).sum((1, 2)) / vectors.shape[1])
    for low in range(0, len(queries), _SCAN):
        at = slice(low, min(low + _SCAN, len(queries)))
        tables = quantiser.tables(queries[at])
        guess = np.zeros((len(ids), at.stop - low), np.float32)
        for j in range(len(tables)):
            guess += tables[j][packed[:, j]]
        guess = np.ascontiguousarray(guess.T)
        spread = slack * np.sqrt((queries[at] ** 2).sum(1, keepdims=True))
        guess[ids == query_ids[at, None]] = -np.inf
        if len(ids) > best.k:
            floor = np.partition(guess - spread, len(ids) - best.k, axis=1)[:, len(ids) - best.k, None]
            take = guess + spread >= floor
        else:
            take = guess > -np.inf
        for i in range(at.stop - low):
            rows = np.flatnonzero(take[i])
            # summed row by row, so that rows alike score alike
            best.add(low + i, ids[rows], (vectors[rows] * queries[low + i]).sum(axis=1))


def neighbours(df: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows by inner product for every row that is_query (a Column over vec_id) holds for.

    Returns query_id, rank (from 1), vec_id, score: nearest first, ties to the smaller id; a query's own id is no
    candidate. Rows take no part if their id is null, or if their vector is null, zero, of another length than most, or
    holds a null or non-finite component. Of rows that share an id the one with the smallest vector counts. Fewer than k
    candidates are all returned; an empty table gives an empty result. Extra columns are ignored.
    """
    spark = df.sparkSession
    x = F.col("v")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    usable = rows.where("vec_id IS NOT NULL AND v IS NOT NULL").where(~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0))
    usable = materialize(usable.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    sizes = usable.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = usable.where(F.size("v") == sizes.d)
    draw = F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(1 << 30))
    drawn = usable.where(draw * F.lit(float(sizes.n)) < F.lit(1.3 * SAMPLE * (1 << 30))).orderBy(draw, "vec_id").limit(SAMPLE)
    quantiser = fit(np.array([r.v for r in drawn.collect()], np.float32).reshape(-1, sizes.d))
    asked = usable.where(is_query)
    chunks = max(1, -(-asked.count() // QUERIES))
    found = []
    for chunk in range(chunks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == chunk).collect() if chunks > 1 else asked.collect()
        own.sort(key=lambda r: r.vec_id)
        if own:
            shared = spark.sparkContext.broadcast((np.array([r.vec_id for r in own], np.int64), np.array([r.v for r in own], np.float64)))
            found.append(usable.mapInArrow(_search(quantiser, shared, k, sizes.d), "query_id long, ids array<long>, scores array<double>"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    each = union_all(found).select("query_id", F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(quantiser: Quantiser, shared, k: int, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        best = _Best(len(queries), k)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block() -> None:
            ids, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(ids)
            ids, vectors = ids[order], vectors[order]
            scan(quantiser, query_ids, queries, ids, quantiser.encode(vectors.astype(np.float32)), vectors, best)
            held.clear()

        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            if len(ids):
                held.append((ids, batch.column("v").flatten().to_numpy().reshape(len(ids), dimensions)))
            if sum(len(x) for x, _ in held) >= BLOCK:
                block()
        if held:
            block()
        for low in range(0, len(queries), 1024):
            own = slice(low, low + 1024)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[own]), pa.array(best.ids[own], pa.list_(pa.int64())), pa.array(best.scores[own], pa.list_(pa.float64()))],
                names=["query_id", "ids", "scores"],
            )

    return run
