"""Byte grams of many texts at once, in NumPy: packed keys, counts, word hashes, and a hash table of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batches

#: Bytes that never occur in UTF-8: what stands before a text, and the symbol that ends it.
BEFORE, END = 0xFE, 0xFF
#: Bytes of text that are turned into keys at once.
AT_ONCE = 1 << 21


class Texts:
    """Texts laid end to end, each behind `order` BEFORE bytes and followed by END."""

    def __init__(self, texts: list[bytes], order: int):
        pad, end = bytes([BEFORE]) * order, bytes([END])
        self.order, self.count = order, len(texts)
        self.bytes = np.frombuffer(b"".join([x for t in texts for x in (pad, t, end)]) or b"", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.symbols = lengths  # bytes and the end
        self.starts = np.cumsum(lengths + order) - lengths  # of each text behind its pad

    def keys(self) -> np.ndarray:
        """The last order + 1 bytes at every symbol of every text, packed, oldest byte highest."""
        b = self.bytes.astype(np.uint64)
        n = len(b) - self.order
        if n <= 0:
            return np.empty(0, np.uint64)
        key = b[:n].copy()
        for i in range(1, self.order + 1):
            np.left_shift(key, np.uint64(8), out=key)
            np.bitwise_or(key, b[i : n + i], out=key)
        first = np.zeros(n, np.int8)  # drop what ends inside a pad
        first[self.starts - self.order] += 1
        stop = self.starts - self.order + self.symbols
        first[stop[stop < n]] -= 1
        return key[np.cumsum(first, dtype=np.int8).view(bool)] if self.order else key

    def bounds(self) -> np.ndarray:
        """Where the keys of each text begin."""
        return np.cumsum(self.symbols) - self.symbols

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit hashes, text number) of the runs of bytes that aren't ASCII white space."""
        b = self.bytes
        inside = np.concatenate(([False], ~_BREAK[b], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edge[::2], edge[1::2]
        power, inverse = _powers(len(b) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODE[b] * power[: len(b)], dtype=np.uint64)))
        h = (total[stop] - total[start]) * inverse[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return h, np.searchsorted(self.starts, start, side="right") - 1


_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, BEFORE, END]] = True
_CODE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, AT_ONCE + AT_ONCE // 4)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size, x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


class KeyTable:
    """Row numbers of sorted distinct 64-bit keys: a one-probe hash table, and a sorted rest for keys whose slot is taken."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(4, min(24, int(2 * len(keys)).bit_length())))
        self.table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        slot = self._slot(keys)
        rows = np.arange(len(keys), dtype=np.int32)
        self.table[slot[::-1]] = rows[::-1]
        self.rest = rows[self.table[slot] != rows]
        self.rest_keys = keys[self.rest]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it isn't there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        found = self.table[self._slot(keys)].astype(np.int64)
        wrong = np.flatnonzero(self.keys[found] != keys)
        if len(wrong):
            if len(self.rest):
                at = np.minimum(np.searchsorted(self.rest_keys, keys[wrong]), len(self.rest) - 1)
                found[wrong] = np.where(self.rest_keys[at] == keys[wrong], self.rest[at], -1)
            else:
                found[wrong] = -1
        return found


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Counter:
    """Counts of keys, merged now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        if len(self.parts) > 8:
            self.parts = [self.total()]

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))


#: What key stands for in the counts: a gram, or a word.
GRAM, WORD = 0, 1
#: The key of the end of a text among the word counts.
END_WORD = np.uint64(0)


def counts(df: DataFrame, order: int, words: bool, lower: str = "ascii") -> DataFrame:
    """(part, kind, key, n): occurrences of grams of order + 1 bytes, and of words and ends, over all rows of df.

    df has text and part, a small integer that is counted apart. Nulls are empty texts. Each task counts its rows
    before the shuffle. lower: "ascii" lower-cases A-Z, "all" every letter.
    """
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[tuple[int, int], Counter] = {}

        def count(part: int, held: list[bytes]) -> None:
            texts = Texts(held, order)
            counters.setdefault((part, GRAM), Counter()).add(texts.keys())
            if words:
                hashes, _ = texts.words()
                counters.setdefault((part, WORD), Counter()).add(np.concatenate((hashes, np.full(texts.count, END_WORD))))

        held: dict[int, list[bytes]] = {}
        size: dict[int, int] = {}
        for batch in batches:
            for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(part, []).append(raw := lowered(text, lower))
                size[part] = size.get(part, 0) + len(raw) + order + 1
                if size[part] > AT_ONCE:
                    count(part, held.pop(part))
                    size[part] = 0
        for part, rows in held.items():
            count(part, rows)
        for (part, kind), counter in counters.items():
            keys, n = counter.total()
            for at in range(0, len(keys), 100_000):
                k = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), part, np.int32)), pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n[at : at + 100_000].astype(np.int64))],
                    names=["part", "kind", "key", "n"],
                )

    found = df.select("part", "text").mapInArrow(run, "part int, kind byte, key long, n long")
    return found.groupBy("part", "kind", "key").agg(F.sum("n").alias("n"))


def lowered(text: str | None, lower: str) -> bytes:
    text = text or ""
    return (text.lower() if lower == "all" else text).encode("utf-8", "surrogatepass").lower()
