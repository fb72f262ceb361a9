"""Best-fit packing by length patterns: non-negative least squares over a length histogram.

Documents become pieces of at most CONTEXT tokens. All patterns of up to three piece lengths that fill a sequence
exactly are enumerated, repeat counts are fitted to the histogram by non-negative least squares and rounded so that no
length is used more often than it occurs, and what is left is packed best-fit decreasing. The driver sees only the
histogram, which has CONTEXT bins at any size of the corpus; each piece finds its place from its rank among the pieces
of its length, counted within (length, chunk) groups so that a frequent length is spread over many tasks.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Memory, arrow_batches, kept, materialize, shuffle_partitions, uncollected

CONTEXT = 2048
END_ID = 0
#: Chunks of text whose ids a worker remembers in each of two generations, the longest of them, and chunks encoded at once.
REMEMBERED = 500_000
REMEMBERED_BYTES = 48
TOGETHER = 4000
#: ASCII marks that end a chunk; behind a letter or digit they are a pre-token of their own.
TAIL = b".,;:!?*%&$#|"
ITERATIONS = 120


class ChunkTokenizer:
    """Ids of a text as little-endian bytes, chunk by chunk.

    The tokenizer of the file drops white space and never joins over it, so the ids of a text are those of its
    chunks between ASCII white space; those of short chunks are remembered. Of a chunk not met before, a
    word and the marks after it are looked up apart; what is new is encoded as one text, with a mark of one id between.
    """

    MARK = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks, self.words = Memory(REMEMBERED), Memory(REMEMBERED)
        ids = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = ids[0] if len(ids) == 1 else None

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        together = f" {self.MARK} ".join(c.decode("utf-8") for c in chunks)
        if self.mark is None or together.count(self.MARK) >= len(chunks):
            return [self._encode(c.decode("utf-8")).tobytes() for c in chunks]
        ids = self._encode(together)
        ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
        if len(ends) != len(chunks):
            return [self._encode(c.decode("utf-8")).tobytes() for c in chunks]
        raw, at, out = ids.tobytes(), 0, []
        for end in ends:
            out.append(raw[4 * at : 4 * end])
            at = end + 1
        return out

    def _parts(self, chunk: bytes) -> tuple[bytes, bytes]:
        """(word, tail) of a chunk whose trailing marks make a pre-token of their own; else (chunk, nothing)."""
        word = chunk.rstrip(TAIL)
        if len(word) == len(chunk) or not word or any(s in chunk.lower() for s in self.special):
            return chunk, b""
        # the last character must still be a letter when the tokenizer has normalised it
        if not (word[-1:].isalnum() or unicodedata.normalize("NFC", word.decode("utf-8")[-1]).lower()[-1].isalpha()):
            return chunk, b""
        return (word.lower() if word.isascii() else word), chunk[len(word) :]

    def _fill(self, missing: set[bytes], long: dict[bytes, bytes]) -> None:
        cut = {c: self._parts(c) for c in missing}
        words = self.words.new
        fresh = [w for w in {w for pair in cut.values() for w in pair} if w not in words and self.words.get(w) is None]
        once: dict[bytes, bytes] = {}
        for at in range(0, len(fresh), TOGETHER):
            part = fresh[at : at + TOGETHER]
            for word, ids in zip(part, self._learn(part), strict=True):
                (words if len(word) <= REMEMBERED_BYTES else once)[word] = ids
        for chunk, (word, tail) in cut.items():
            ids = (words[word] if word in words else once[word]) + (words[tail] if tail in words else once[tail])
            (self.chunks.new if len(chunk) <= REMEMBERED_BYTES else long)[chunk] = ids

    @uncollected()
    def batch(self, texts: list[str | None]) -> list[bytes]:
        self.chunks.turn()
        self.words.turn()
        known, long = self.chunks.new, {}
        out: list[bytes | None] = []
        missing: set[bytes] = set()
        waiting = []
        for text in texts:
            row = (text or "").encode("utf-8").split()
            try:
                out.append(b"".join(map(known.__getitem__, row)))
            except KeyError:
                missing.update(c for c in row if c not in known and self.chunks.get(c) is None)
                waiting.append((len(out), row))
                out.append(None)
        if missing:
            self._fill(missing, long)
        for at, row in waiting:
            out[at] = b"".join([known[c] if c in known else long[c] for c in row]) if long else b"".join(map(known.__getitem__, row))
        return out


_TOKENIZERS: dict[str, ChunkTokenizer] = kept({})


def tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def pieces(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", context: int = CONTEXT, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, and ids (binary) when asked for."""
    arrow_batches(df.sparkSession)
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, end, step = tokenizer(path), np.array([END_ID], "<u4").tobytes(), 4 * context
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, coded in enumerate(coder.batch(batch.column("text").to_pylist())):
                coded += end
                for i, at in enumerate(range(0, len(coded), step)):
                    part = coded[at : at + step]
                    rows.append(row)
                    piece.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return source.mapInArrow(run, schema)


def patterns(lengths: np.ndarray, context: int = CONTEXT) -> np.ndarray:
    """All multisets of one, two or three of the lengths whose sum is context; rows of three, padded with 0."""
    there = np.zeros(context + 1, bool)
    there[lengths] = True
    there[0] = True  # an empty slot
    found = []
    for a in np.flatnonzero(there)[1:]:
        b = np.arange((context - a + 1) // 2, min(a, context - a) + 1)
        c = context - a - b
        keep = there[b] & there[c] & (b > 0) if a < context else b == 0
        found.append(np.column_stack([np.full(keep.sum(), a), b[keep], c[keep]]))
    return np.concatenate([*found, np.empty((0, 3), np.int64)])


def fit(counts: np.ndarray, shapes: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Repeat counts x >= 0 that bring sum_p x[p] * shapes[p] near counts: accelerated projected gradient steps.

    Residuals are relative to the root of the counts, so rare lengths weigh as much as their numbers allow.
    """
    if not len(shapes):
        return np.zeros(0)
    weight = 1 / np.sqrt(np.maximum(counts, 1.0))
    weight[0] = 0.0
    target = weight * counts

    def forward(x):
        return weight * sum(np.bincount(shapes[:, k], x, len(counts)) for k in range(3))

    def back(r):
        r = weight * r
        return r[shapes[:, 0]] + r[shapes[:, 1]] + r[shapes[:, 2]]

    v = np.ones(len(shapes))
    for _ in range(12):
        v = back(forward(v / np.linalg.norm(v)))
    step = 1 / (1.1 * np.linalg.norm(v))
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(iterations):
        new = np.maximum(0.0, y - step * back(forward(y) - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


@dataclass
class Plan:
    """Slots sorted by (length, first rank): piece number rank of a length goes to sequence base + (rank - first)."""

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    #: Copies in one sequence that follow each other: piece rank takes place (rank - first) % each of its sequence.
    each: np.ndarray
    sequences: int


def plan(counts: np.ndarray, context: int = CONTEXT) -> Plan:
    """Where the pieces of each length go; counts[n] pieces have n tokens."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    used, slots, sequences = np.zeros_like(left), [], 0

    def put(length, repeats, base, offset, each):
        nonlocal slots
        slots.append((length, used[length], base, offset, each))
        used[length] += repeats * each
        left[length] -= repeats * each

    shapes = patterns(np.flatnonzero(left), context)
    x = fit(left, shapes)
    for p in np.argsort(-x, kind="stable"):
        if x[p] <= 1e-3:
            break
        parts, times = np.unique(shapes[p][shapes[p] > 0], return_counts=True)
        repeats = int(min(max(1, round(x[p])), *(left[parts] // times)))
        if repeats:
            at = 0
            for n, each in zip(parts.tolist(), times.tolist(), strict=True):
                put(n, repeats, sequences, at, each)
                at += n * each
            sequences += repeats
    # Best fit decreasing over what is left; sequences alike are one entry (base, number) of a fill level.
    room: dict[int, list[tuple[int, int]]] = {}
    spaces = np.zeros(context + 1, bool)
    for n in np.flatnonzero(left)[::-1].tolist():
        while left[n]:
            free = n + int(np.argmax(spaces[n:])) if spaces[n:].any() else 0
            if not free:
                each = min(context // n, int(left[n]))
                base, number = sequences, max(1, int(left[n]) // each)
                sequences += number
                at, space = 0, context
            else:
                base, number = room[free].pop()
                spaces[free] = bool(room[free])
                each = min(free // n, int(left[n]))
                at, space = context - free, free
            take = min(number, int(left[n]) // each)
            put(n, take, base, at, each)
            for b, k, s in ((base, take, space - n * each), (base + take, number - take, space)):
                if k and s:
                    room.setdefault(s, []).append((b, k))
                    spaces[s] = True
    rows = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return Plan(*rows.T, sequences=sequences)


def place(where: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces with these lengths and ranks."""
    at = np.searchsorted(where.length << 44 | where.first, length << 44 | rank, side="right") - 1
    copy, turn = np.divmod(rank - where.first[at], where.each[at])
    return where.base[at] + copy, where.offset[at] + turn * length


def pack(parts: DataFrame, context: int = CONTEXT) -> DataFrame:
    """parts (doc_id, piece, length, more) with sequence_id and offset.

    Sequences are gapless from offset 0 and hold at most context tokens. Rows equal in doc_id and piece are placed
    apart, in any order among them; an empty table gives an empty result.
    """
    spark = parts.sparkSession
    parts = materialize(parts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * shuffle_partitions(spark)))), "pieces")
    sizes = parts.groupBy("length", "chunk").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    counts = np.zeros(context + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("size").alias("n")).collect():  # one row for each of context lengths at most
        counts[row.length] = row.n
    where = plan(counts, context)
    own = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = parts.withColumn("rank", own.cast("long")).join(starts, ["length", "chunk"])
    ranked = ranked.select(*(c for c in parts.columns if c != "chunk"), (F.col("rank") + F.col("before")).alias("rank"))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length, rank):
        import pandas as pd

        sequence, offset = place(where, length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return ranked.withColumn("at", placed("length", "rank")).select("*", "at.*").drop("at", "rank")


def packed(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", context: int = CONTEXT, with_ids: bool = False) -> DataFrame:
    """Tokenize and pack all documents of df: one row per piece.

    Columns: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset. A null text is an empty one, whose
    only token is the end id. Null ids and repeated rows are packed like others; extra columns of df are ignored.
    """
    return pack(pieces(df, path, doc_id, text, context, with_ids), context)
