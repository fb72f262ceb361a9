"""Byte-level BPE with a hierarchical-bitmap rank queue.

The merges of one pre-token are taken in the order of their ranks, leftmost first. Positions of candidate pairs wait in
buckets, one per rank, as linked lists; a bitmap in two levels tells which buckets hold any, so that the next rank is
found by two find-first-set steps. Symbols form a doubly linked list; an entry whose pair has changed since it was
queued is stale and is skipped. A pre-token of n bytes takes O(n) queue steps, whatever its length. The new pre-tokens of
a batch share one queue, as their order among each other is of no account.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memory, arrow_batches, kept, uncollected

#: White space as the pattern's \\s has it (Unicode White_Space), for cutting a text before the pattern proper.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Chunks and words that a worker remembers in each of two generations, and the longest that it does.
REMEMBERED = 400_000
REMEMBERED_CHARS = 48
#: Marks that end a piece; behind letters they are a pre-token of their own.
TAIL = ".,;:!?*%&$#|"
#: Bytes of pre-tokens that share one queue.
TOGETHER = 1 << 20


class RankQueue:
    """Positions by rank: push(rank, position); pop() gives the smallest rank with its positions in ascending order.

    top has a bit for each leaf that holds any, a leaf a bit for each of 64 ranks.
    """

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.leaves: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        leaf = rank >> 6
        self.leaves[leaf] = self.leaves.get(leaf, 0) | 1 << (rank & 63)
        self.top |= 1 << leaf

    def fill(self, ranks: np.ndarray) -> None:
        """Push every position whose rank isn't negative, position i with ranks[i]."""
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        if not len(order):
            return
        distinct, first = np.unique(ranks[order], return_index=True)
        positions, ends = order.tolist(), [*first[1:].tolist(), len(order)]
        for rank, a, b in zip(distinct.tolist(), first.tolist(), ends, strict=True):
            if rank in self.buckets:
                self.buckets[rank] += positions[a:b]
            else:
                self.push(rank, positions[a])
                self.buckets[rank] = positions[a:b]

    def pop(self) -> tuple[int, list[int]] | None:
        if not self.top:
            return None
        leaf = (self.top & -self.top).bit_length() - 1
        bits = self.leaves[leaf]
        rank = leaf << 6 | (bits & -bits).bit_length() - 1
        self.leaves[leaf] = bits = bits & (bits - 1)
        if not bits:
            self.top ^= 1 << leaf
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class Vocabulary:
    """Ranks of a tiktoken file: token bytes to id; a merge has the rank of the token that it makes."""

    def __init__(self, path: str, pattern: str):
        import re

        import regex

        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ids.values(), default=-1) + 1)
        for token, rank in self.ids.items():
            self.tokens[rank] = token
        self.single = [bytes([b]) for b in range(256)]
        self.pairs = np.array([self.ids.get(a + b, -1) for a in self.single for b in self.single], np.int64)
        self.pattern = regex.compile(pattern)
        self.cut = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.double, self.plain = re.compile(f"[{SPACE}] "), re.compile(f"[^{SPACE}]*")
        self.chunks, self.words, self.spaced = Memory(REMEMBERED // 8), Memory(REMEMBERED), Memory(REMEMBERED + REMEMBERED // 4)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens. They share one queue, in which no pair reaches over the end of a word."""
        ids, queue = self.ids, RankQueue()
        find, push, buckets = ids.get, queue.push, queue.buckets
        cut = [w for w in words if w not in ids]
        if not cut:
            return [[ids[w]] for w in words]
        data = np.frombuffer(b"".join(cut), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        heads = [0, *ends.tolist()][: len(cut)]
        # before and after link the symbols of a word; waits is the rank for which a position waits now, and an entry of
        # another rank is stale
        ranks = np.full(len(data), -1, np.int64)
        ranks[:-1] = self.pairs[data[:-1].astype(np.int64) << 8 | data[1:]]
        follow, precede = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        ranks[ends - 1] = follow[ends - 1] = precede[np.array(heads, np.int64)] = -1
        queue.fill(ranks)
        symbol = list(map(self.single.__getitem__, data.tobytes()))
        waits, after, before = ranks.tolist(), follow.tolist(), precede.tolist()
        while (entry := queue.pop()) is not None:
            rank, positions = entry
            low = rank + 1
            for turn, i in enumerate(positions):
                if low <= rank:  # what a merge has just made goes before the rest of this bucket
                    for p in positions[turn:]:
                        push(rank, p)
                    break
                if waits[i] != rank:
                    continue
                j = after[i]
                symbol[i] = made = symbol[i] + symbol[j]
                waits[j] = new = -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    new = find(made + symbol[k], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            push(new, i)
                        if new < low:
                            low = new
                waits[i] = new
                h = before[i]
                if h >= 0:
                    new = find(symbol[h] + made, -1)
                    if new != waits[h]:
                        waits[h] = new
                        if new >= 0:
                            if new in buckets:
                                buckets[new].append(h)
                            else:
                                push(new, h)
                            if new < low:
                                low = new
        out, start = [], iter(heads)
        for word in words:
            if word in ids:
                out.append([ids[word]])
                continue
            own, i = [], next(start)
            while i >= 0:
                own.append(ids[symbol[i]])
                i = after[i]
            out.append(own)
        return out

    def _words(self, fresh: set[str], once: dict[str, bytes]) -> None:
        """Ids of pre-tokens not met before; those of long ones go to once."""
        rows = [w for w in fresh if w not in self.words.new and self.words.get(w) is None]
        at = 0
        while at < len(rows):
            part, size = [], 0
            while at < len(rows) and size < TOGETHER:
                part.append(rows[at])
                size += len(rows[at])
                at += 1
            for word, ids in zip(part, self.merge([w.encode("utf-8") for w in part]), strict=True):
                (self.words.new if len(word) <= REMEMBERED_CHARS else once)[word] = array("I", ids).tobytes()

    def _chunks(self, rows: list[list[str]]) -> list[bytes]:
        """Ids of texts that are given as their chunks."""
        known, once = self.chunks.new, {}
        missing = {c for row in rows for c in row if c not in known and self.chunks.get(c) is None}
        cut = {c: self.pattern.findall(c) for c in missing}
        self._words({w for row in cut.values() for w in row}, once)
        words, long = self.words.new, {}
        for chunk, row in cut.items():
            ids = b"".join([words[w] if w in words else once[w] for w in row])
            (known if len(chunk) <= REMEMBERED_CHARS else long)[chunk] = ids
        if long:
            return [b"".join([known[c] if c in known else long[c] for c in row]) for row in rows]
        return [b"".join(map(known.__getitem__, row)) for row in rows]

    def _pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces with the space before them; short ones without white space are remembered.

        Letters with marks behind them are two pre-tokens; other pieces are cut by the pattern.
        """
        cut, odd = [], []
        for piece in pieces:
            word = piece.rstrip(TAIL)
            if word.isalpha():
                cut.append((piece, " " + word, piece[len(word) :]))
            else:
                odd.append(piece)
        once: dict[str, bytes] = {"": b""}
        self._words({w for _, *pair in cut for w in pair if w}, once)
        words, spaced, long = self.words.new, self.spaced.new, {}
        for piece, word, tail in cut:
            ids = words[word] if word in words else once[word]
            if tail:
                ids += words[tail] if tail in words else once[tail]
            (spaced if len(piece) <= REMEMBERED_CHARS else long)[piece] = ids
        coded = self._chunks([self.cut.findall(" " + p) for p in odd])
        plain = self.plain.fullmatch
        for piece, ids in zip(odd, coded, strict=True):
            (spaced if len(piece) <= REMEMBERED_CHARS and plain(piece) else long)[piece] = ids
        return long

    @uncollected()
    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers.

        A text is cut into chunks at white space as the pattern would cut it, so that equal chunks are worked out once.
        Where no white space stands before a space, a cut at every space does that with less work.
        """
        for memory in (self.chunks, self.words, self.spaced):
            memory.turn()
        known = self.spaced.new
        out: list[bytes] = [b""] * len(texts)
        slow, late = [], []
        heads: list[tuple[int, list[str]]] = []
        missing: set[str] = set()
        for at, text in enumerate(texts):
            if self.double.search(text):
                slow.append(at)
                continue
            head, *pieces = text.split(" ")
            if head:
                heads.append((at, self.cut.findall(head)))
            try:
                out[at] = b"".join(map(known.__getitem__, pieces))
            except KeyError:
                late.append((at, pieces))
                missing.update(p for p in pieces if p not in known and self.spaced.get(p) is None)
        long = self._pieces(missing) if missing else {}
        for at, pieces in late:
            out[at] = b"".join([known[p] if p in known else long[p] for p in pieces]) if long else b"".join(map(known.__getitem__, pieces))
        for at, ids in zip([at for at, _ in heads], self._chunks([row for _, row in heads]), strict=True):
            out[at] = ids + out[at]
        for at, ids in zip(slow, self._chunks([self.cut.findall(texts[at]) for at in slow]), strict=True):
            out[at] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


_VOCABULARIES: dict[tuple[str, str], Vocabulary] = kept({})


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per worker process."""
    if (path, pattern) not in _VOCABULARIES:
        _VOCABULARIES[path, pattern] = Vocabulary(path, pattern)
    return _VOCABULARIES[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of a text column as binary (little-endian unsigned 32-bit). A null text is an empty one."""
    arrow_batches(df.sparkSession)

    @F.pandas_udf("binary")
    def encoded(texts):
        import pandas as pd

        coder = vocabulary(path, pattern)
        return pd.Series(coder.encode([t or "" for t in texts]), dtype=object)

    return df.withColumn(out, encoded(F.col(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that a column of ids stands for. Null ids stand for no bytes; an unknown id is an error."""
    arrow_batches(df.sparkSession)

    @F.pandas_udf("binary")
    def decoded(rows):
        import pandas as pd

        coder = vocabulary(path, pattern)
        return pd.Series([coder.decode(r or b"") for r in rows], dtype=object)

    return df.withColumn(out, decoded(F.col(ids)))


def digests(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, decode the ids again, and return doc_id, n_tokens, ids_sha256, decoded_sha256.

    One row per row of df, repeated ones and null ids included; a null text counts as empty (no ids). Extra columns
    are ignored.
    """
    coded = encode(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), path, pattern).drop("text")
    both = decode(coded, path, pattern)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
