"""Language identification by prediction by partial matching.

Each language has byte context trees up to ORDER bytes, counted on a bounded sample of labelled texts and then frozen.
The code length of a text under a language is the sum over its bytes of -log2 of the byte's probability: in the longest
context seen, n/(T + q) for a byte seen n times there, else the escape q/(T + q) times the probability in the next shorter
context (T: symbols seen in the context, q: distinct ones; method C, frozen, without exclusion); below order 0 all 256 bytes
are alike. The shortest code wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import grams
from tessera.llm.common import arrow_batches, materialize, room, unused

ORDER = 4
#: Labelled texts of each language that the trees are counted on.
SAMPLE = 2000
UNDETERMINED = "und"
#: A letter: Unicode category L. Number signs such as a half or a Roman eight are none.
LETTER = regex.compile(r"\p{L}")
#: Held-out labelled texts of each language that the limit of code lengths is fitted on.
LIMIT_SAMPLE = 500
#: The limit is SLACK times the 99.9th percentile of their bits per byte, within these bounds (8: no better than no model).
SLACK, LEAST_LIMIT, MOST_LIMIT = 1.5, 6.0, 8.0
#: Bytes that are added to each text's own, as the first bytes and very short texts cost more.
START = 32
_SPREAD = 1 << 30


def sample(df: DataFrame, doc_id: str, lang: str, text: str, size: int = SAMPLE) -> DataFrame:
    """(lang, text) of up to size rows of each language, chosen by a hash of id and text."""
    names = {"id": doc_id, "lang": lang, "text": text}
    labelled = df.select(*(F.col(c).cast("string").alias(n) for n, c in names.items())).where("lang IS NOT NULL AND text IS NOT NULL")
    there = labelled.groupBy("lang").agg(F.count("*").alias("there"))
    draw = F.pmod(F.xxhash64(F.lit(11), "id", "text"), F.lit(_SPREAD))
    # about 1.3 times as many first, so that a common language isn't ranked as a whole
    drawn = labelled.join(F.broadcast(there), "lang").withColumn("draw", draw).where(F.col("draw") * F.col("there") < F.lit(1.3 * size * _SPREAD))
    own = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", F.xxhash64("text")))
    return drawn.withColumn("own", own).where(F.col("own") <= size).select("lang", "text")


@dataclass
class Model:
    """log2 probabilities by order: keys of grams and contexts, and one column per language."""

    languages: list[str]
    order: int
    gram_keys: list[np.ndarray]
    gram_bits: list[np.ndarray]
    context_keys: list[np.ndarray]
    context_bits: list[np.ndarray]

    def tables(self):
        if not hasattr(self, "_tables"):
            self._tables = [grams.KeyTable(k) for k in self.gram_keys], [grams.KeyTable(k) for k in self.context_keys]
        return self._tables

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        laid = grams.Texts(texts, self.order)
        keys, n = laid.keys(), len(self.languages)
        bits = np.zeros((len(keys), n), np.float32)
        gram_tables, context_tables = self.tables()
        open_ = None  # positions not settled yet; None: all
        for d in range(self.order, -1, -1):
            own = (keys if open_ is None else keys[open_]) & np.uint64((1 << 8 * (d + 1)) - 1)
            row = gram_tables[d].find(own)
            known = row >= 0
            at = np.flatnonzero(known) if open_ is None else open_[known]
            bits[at] += self.gram_bits[d][row[known]]
            open_ = np.flatnonzero(~known) if open_ is None else open_[~known]
            if not len(open_):
                break
            context = context_tables[d].find(own[~known] >> np.uint64(8))
            bits[open_[context >= 0]] += self.context_bits[d][context[context >= 0]]
        if len(open_):
            bits[open_] -= 8.0
        return -np.add.reduceat(bits, laid.bounds(), axis=0, dtype=np.float64) if laid.count else np.zeros((0, n))


def train(labelled: DataFrame, order: int = ORDER) -> Model:
    """The model of (lang, text) rows. Its size is bounded by the sample; the driver gets the counts of grams."""
    labelled = materialize(labelled, "langsample")
    languages = [r.lang for r in labelled.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return Model([], order, [], [], [], [])
    number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1
    found = grams.counts(labelled.select(number.cast("int").alias("part"), "text"), order, words=False, lower="all")
    table = found.select("part", "key", "n").toArrow()
    part, key, n = (table.column(c).to_numpy() for c in ("part", "key", "n"))
    key = key.view(np.uint64)
    width = len(languages)
    gram_keys, gram_bits, context_keys, context_bits = [], [], [], []
    below_keys, below = np.empty(0, np.uint64), np.empty((0, width), np.float32)
    for d in range(order + 1):
        mask = np.uint64((1 << 8 * (d + 1)) - 1)
        keys, row = np.unique(key & mask, return_inverse=True)
        count = np.zeros((len(keys), width))
        np.add.at(count, (row, part), n)
        contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, distinct = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
        np.add.at(total, of, count)
        np.add.at(distinct, of, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2(distinct / (total + distinct)), 0.0)
            seen = np.log2(count / (total + distinct)[of])
        if d:
            at = np.searchsorted(below_keys, keys & (mask >> np.uint64(8)))
            shorter = below[at]  # a gram that was seen here was seen at every lower order
        else:
            shorter = np.full((len(keys), width), -8.0)
        bits = np.where(count > 0, seen, escape[of] + shorter).astype(np.float32)
        gram_keys.append(keys)
        gram_bits.append(bits)
        context_keys.append(contexts)
        context_bits.append(escape.astype(np.float32))
        below_keys, below = keys, bits
    return Model(languages, order, gram_keys, gram_bits, context_keys, context_bits)


def _lengths(model: Model, texts: list[str | None]):
    """(positions, bytes, code lengths) of the texts that have a letter, as many at once as fit."""
    known = [i for i, t in enumerate(texts) if t and model.languages and LETTER.search(t)]
    at = 0
    while at < len(known):
        held, size = [], 0
        while at < len(known) and size < grams.AT_ONCE // 4:
            held.append(known[at])
            size += len(texts[known[at]])
            at += 1
        data = [grams.lowered(texts[i], "all") for i in held]
        yield held, np.array([len(x) for x in data]), model.code_lengths(data)


def _decide(model: Model, texts: list[str | None], limit: float | None = None) -> tuple[list[str], list[float]]:
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    for held, size, lengths in _lengths(model, texts):
        best = lengths.argmin(axis=1)  # ties: the first name
        share = 1 / np.exp2(np.maximum(lengths.min(axis=1, keepdims=True) - lengths, -1000)).sum(axis=1)
        known = np.full(len(held), True) if limit is None else lengths.min(axis=1) <= limit * (size + START)
        for i, b, s, k in zip(held, best.tolist(), share.tolist(), known.tolist(), strict=True):
            if k:
                langs[i], scores[i] = model.languages[b], s
    return langs, scores


def fitted_limit(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", size: int = LIMIT_SAMPLE) -> float:
    """Most bits per byte (after START more bytes) of a text in a language of the model, from labelled rows it wasn't trained on."""
    arrow_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def cost(texts):
        import pandas as pd

        room()
        out = np.full(len(texts), np.nan)
        for held, n, lengths in _lengths(shared.value, texts.tolist()):
            out[held] = lengths.min(axis=1) / (n + START)
        return pd.Series(out)

    rows = sample(df.where(F.col(doc_id).isNotNull() & held_out(doc_id)), doc_id, lang, text, size)
    costs = materialize(rows.select(cost("text").alias("cost")), "langcosts").where("NOT isnan(cost)")
    high = costs.agg(F.percentile("cost", F.lit(0.999))).first()[0]
    return MOST_LIMIT if high is None else min(max(SLACK * high, LEAST_LIMIT), MOST_LIMIT)


def with_language(df: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score", limit: float | None = None) -> DataFrame:
    """df with the predicted language and its share (0 to 1) of the probability of the text over all languages.

    Texts that are null or hold no letter get "und" and 0; so do all texts if the model has seen no language, and, with a
    limit, texts that take more bits per byte than it even under their best language. All rows and other columns stay.
    """
    arrow_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    @F.pandas_udf(f"{out} string, {score} double")
    def decided(texts):
        import pandas as pd

        room()
        langs, scores = _decide(shared.value, texts.where(texts.notna(), None).tolist(), limit)
        return pd.DataFrame({out: pd.Series(langs, dtype=object), score: pd.Series(scores, dtype=float)})

    held = unused(df, "decided")
    return df.withColumn(held, decided(F.col(text))).select(*df.columns, f"{held}.{out}", f"{held}.{score}")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4; a null id: no."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fitted(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", size: int = SAMPLE, order: int = ORDER) -> Model:
    """The model of a labelled table, without the held-out rows and those of null id."""
    return train(sample(df.where(F.col(doc_id).isNotNull() & ~held_out(doc_id)), doc_id, lang, text, size), order)


def languages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of df: doc_id, held_out, lang_pred, score. Extra columns are ignored."""
    model = fitted(df, doc_id, text, lang)
    rows = df.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return with_language(rows, model).drop("text")
