"""Personal data in plain and in disguise, with spans in the source text.

Plain identifiers are found in the text as it is. For the others a chain of transducers rewrites the text (homoglyphs and
foreign digits, runs of spelled digits, at/dot disguises), each keeping for every character it writes the source span
that it stands for; the detectors run again, and what they find maps back to source characters. A mapped span counts
only if it holds a rewritten character, so that plain text gives the plain spans and no others.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: The first digit of a run only: a match never starts inside one, and trying would take squared time.
IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?<![0-9]{2})(?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From one @ to the next; the local part reaches back to the last match at most."""
    end, at = 0, text.find("@")
    while at >= 0:
        if found := DOMAIN.match(text, at + 1):
            start = at
            while start > end and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at:
                yield start, found.end()
                end = found.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Spans (start, end, kind) of the identifiers in text as it stands, by start and then in the order of KINDS."""
    spans = [(s, e, "email") for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                spans.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                spans.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    spans.append((*m.span(), "phone"))
    return in_order(spans)


def in_order(spans) -> list[Span]:
    return sorted(set(spans), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


# Letters that look like Latin ones, punctuation that stands for ASCII punctuation, invisible characters.
LOOKALIKES = dict(zip("АВЕКМНОРСТХУІЅЈаеорсухіѕјԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρ", "ABEKMHOPCTXYISJaeopcyxisjdhqwABEZHIKMNOPTYXoavip", strict=True))
PUNCTUATION = {"。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", "﹫": "@", "﹒": "."}
#: Last labels that a domain in spaced words must have to count.
ENDINGS = frozenset(
    "com net org edu gov mil info biz io co ai app dev eu us uk de fr es it nl be ch at pl se no fi dk pt ie ru cn jp kr in br mx ca au nz me tv"
    " xyz online site store shop tech cloud ar za gr cz hu ro ua tr il hk sg tw th vn id ph pk bd ng ke eg ma sa ae cl pe ve uy ec cr ee lv lt si sk hr bg rs kz lu mt cy li".split()
)
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}


def _glyphs() -> dict[str, str]:
    """Every character that one of the tables, a full-width form or a decimal digit of another script gives an ASCII one."""
    found = {chr(0xFF00 + c - 0x20): chr(c) for c in range(0x21, 0x7F)}
    found |= {c: str(unicodedata.decimal(c)) for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.decimal(c, None) is not None}
    return found | LOOKALIKES | PUNCTUATION | dict.fromkeys(INVISIBLE, "")


GLYPHS = _glyphs()
#: All of GLYPHS up to U+FFFF, and everything beyond, which is looked up.
GLYPH = re.compile("[" + "".join(re.escape(c) for c in sorted(GLYPHS) if c < "\U00010000") + "\U00010000-\U0010ffff]")


def _alternatives(words) -> str:
    """A pattern of the words, longest first, that tells them by their first letter before it tries any."""
    firsts = sorted({w[0] for w in words})
    return "(?:" + "|".join(f + "(?:" + "|".join(sorted((w[1:] for w in words if w[0] == f), key=lambda x: (-len(x), x))) + ")" for f in firsts) + ")"


_WORD = _alternatives(DIGIT_WORDS)
_JOIN = r"(?:[ \t\r\n]*[,-][ \t\r\n]*|[ \t\r\n]+)"
#: Two digit words in a row give a text away; a run is at least that, and may hold digits and the words plus and dot.
SPELLED = re.compile(rf"\b{_WORD}{_JOIN}{_WORD}\b", re.I)
SPELLED_RUN = re.compile(rf"(?:\bplus{_JOIN})?(?:\b{_WORD}\b|[0-9]+)(?:(?:{_JOIN}dot{_JOIN}|{_JOIN}|\.)(?:{_WORD}\b|[0-9]+))+", re.I)
SPELLED_ITEM = re.compile(rf"\b(?:{_WORD}|plus|dot)\b|[0-9]+|\.", re.I)
SPACED = re.compile(r"[ \t]")
BRACKETED = re.compile(r"[\[({<][ \t]{0,3}(?:at|dot|@|\.)[ \t]{0,3}[\])}>]", re.I)
AT = re.compile(r"[ \t]{0,3}[\[({<][ \t]{0,3}(?:at|@)[ \t]{0,3}[\])}>][ \t]{0,3}", re.I)
DOT = re.compile(r"[ \t]{0,3}[\[({<][ \t]{0,3}(?:dot|\.)[ \t]{0,3}[\])}>][ \t]{0,3}", re.I)
DOT_WORD = re.compile(r"(?<=[A-Za-z0-9])[ \t]{1,3}dot[ \t]{1,3}(?=[A-Za-z0-9])", re.I)
#: A spaced "at" counts where a domain with a disguised dot follows it; dots before that one may be plain.
AT_WORD = re.compile(r"(?<=[A-Za-z0-9])[ \t]{1,3}at[ \t]{1,3}(?=[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+\x00)", re.I)


class Rewritten:
    """A text with, for each character, the source span that it stands for, and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] = list(range(len(text)))
        self.ends: list[int] = list(range(1, len(text) + 1))
        self.changed = bytearray(len(text))

    def replace(self, pattern: re.Pattern, write: Callable[[re.Match], str]) -> None:
        """Rewrite each match; every character written stands for the whole match."""
        text, starts, ends, changed, at = [], [], [], bytearray(), 0
        for m in pattern.finditer(self.text):
            s, e = m.span()
            if s == e or (new := write(m)) == m[0]:
                continue
            text += (self.text[at:s], new)
            starts += self.starts[at:s] + [self.starts[s]] * len(new)
            ends += self.ends[at:s] + [self.ends[e - 1]] * len(new)
            changed += self.changed[at:s] + b"\x01" * len(new)
            if not new and ends and not changed[-1]:
                changed[-1] = 2  # something invisible was dropped after it
            at = e
        if at or text:
            self.text = "".join(text) + self.text[at:]
            self.starts, self.ends, self.changed = starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:]

    def spell(self) -> None:
        """Write runs of spelled digits as digits; every digit stands for its own word."""
        text, starts, ends, changed, at = [], [], [], bytearray(), 0
        for run in SPELLED_RUN.finditer(self.text):
            if not SPELLED.search(run[0]):
                continue
            s, e = run.span()
            text.append(self.text[at:s])
            starts += self.starts[at:s]
            ends += self.ends[at:s]
            changed += self.changed[at:s]
            for m in SPELLED_ITEM.finditer(self.text, s, e):
                word = m[0].lower()
                if word[0] in "0123456789.":
                    text.append(m[0])
                    starts += self.starts[m.start() : m.end()]
                    ends += self.ends[m.start() : m.end()]
                    changed += self.changed[m.start() : m.end()]
                else:
                    text.append({"plus": "+", "dot": "."}.get(word) or str(DIGIT_WORDS[word]))
                    starts.append(self.starts[m.start()])
                    ends.append(self.ends[m.end() - 1])
                    changed.append(1)
            at = e
        if at:
            self.text = "".join(text) + self.text[at:]
            self.starts, self.ends, self.changed = starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:]


def disguised_spans(text: str) -> list[Span]:
    """Source spans of identifiers that show only after rewriting."""
    glyphs = not text.isascii() and GLYPH.search(text)
    words = SPELLED.search(text)
    marks = BRACKETED.search(text) or DOT_WORD.search(text)
    if not (glyphs or words or marks):
        return []
    new = Rewritten(text)
    if glyphs:
        new.replace(GLYPH, lambda m: GLYPHS.get(m[0], m[0]))
        words, marks = SPELLED.search(new.text), BRACKETED.search(new.text) or DOT_WORD.search(new.text)
    if words:
        new.spell()
    if marks:
        new.replace(AT, lambda m: "@")
        # dots in disguise stay marked (NUL) until the spaced "at" before them has been seen; the text's own NULs, in no identifier, make way
        new.text = new.text.replace("\x00", "\x01")
        new.replace(DOT, lambda m: "\x00")
        new.replace(DOT_WORD, lambda m: "\x00")
        new.replace(AT_WORD, lambda m: "@")
        new.text = new.text.replace("\x00", ".")
    found = []
    for s, e, kind in plain_spans(new.text):
        if any(new.changed[s : e - 1]) or new.changed[e - 1] == 1:
            start, end = new.starts[s], new.ends[e - 1]
            spaced = kind == "email" and SPACED.search(text, start, end) and not BRACKETED.search(text, start, end)
            if not spaced or new.text[s:e].rpartition(".")[2].lower() in ENDINGS:
                found.append((start, end, kind))
    return in_order(found)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(plain spans, spans that only the rewritten text shows), code points, end exclusive. Null is empty."""
    text = text or ""
    plain = plain_spans(text)
    return plain, [x for x in disguised_spans(text) if x not in plain]


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str | None) -> str | None:
    """text with every found span replaced by its kind in brackets; spans that overlap become one, of the first kind."""
    if text is None:
        return None
    plain, more = find(text)
    out, at, held = [], 0, None
    for start, end, kind in [*in_order([*plain, *more]), (len(text) + 1, 0, "")]:
        if held and start < held[1]:
            held = (held[0], max(end, held[1]), held[2])
            continue
        if held:
            out += (text[at : held[0]], f"[{held[2].upper()}]")
            at = held[1]
        held = (start, end, kind)
    return "".join(out) + text[at:]


def spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_disguised.

    The counts and base_sha256 are of plain identifiers; spans lists these and the disguised ones, n_disguised counts
    the latter. Null and empty texts have none. Null ids and repeated rows are returned like others; extra columns are
    ignored.
    """
    arrow_batches(df.sparkSession)
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = [f"n_{k}" for k in KINDS]
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string, n_disguised long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id")]
            columns += [pa.array([sum(x[2] == k for x in plain) for plain, _ in found], pa.int64()) for k in KINDS]
            columns.append(pa.array([hashlib.sha256(written(plain).encode()).hexdigest() for plain, _ in found], pa.string()))
            columns.append(pa.array([written(in_order([*plain, *more])) for plain, more in found], pa.string()))
            columns.append(pa.array([len(more) for _, more in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *counts, "base_sha256", "spans", "n_disguised"])

    return source.mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a text column redacted; null texts stay null, all rows and other columns stay as they are."""
    arrow_batches(df.sparkSession)

    @F.pandas_udf("string")
    def cleaned(texts):
        import pandas as pd

        return pd.Series([redacted(t) for t in texts], dtype=object)

    return df.withColumn(text, cleaned(F.col(text)))
