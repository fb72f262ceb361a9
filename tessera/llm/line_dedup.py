"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Every run of three consecutive lines is hashed (128 bits). A window seen at more than one place stays at its first
place, in the order of doc_id and line number, and the lines it covers elsewhere go; overlapping windows merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lookup, materialize, row_key, unused

#: Lines in a window.
WINDOW = 3


def window_hashes(df: DataFrame, doc_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """A row (k1, k2, doc, pos, h1, h2) for each window; k1, k2 stand for id and text, pos counts from 0."""
    k1, k2 = row_key(doc_id, text)
    lines = df.select(F.col(doc_id).alias("doc"), k1.alias("k1"), k2.alias("k2"), F.split(text, "\n").alias("lines"))
    lines = lines.where(F.size("lines") >= window)

    def hashed(i):
        parts = [F.get("lines", i + k) for k in range(window)]
        return F.struct(i.alias("pos"), F.xxhash64(F.lit(1), *parts).alias("h1"), F.xxhash64(F.lit(2), *parts).alias("h2"))

    each = F.transform(F.sequence(F.lit(0), F.size("lines") - window), hashed)
    return lines.select("doc", "k1", "k2", F.inline(each))


def repeated_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(k1, k2, covered): for each document the positions of the lines that repeated windows cover after their first place."""
    places = window_hashes(df, doc_id, text, window)
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "k1", "k2", "pos")
    first = materialize(places.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1"), "windows")
    met = lookup(places, first.drop("times"), ["h1", "h2"], first.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0], by=["k1", "k2", "pos"], counts=first)
    later = met.where(place > F.col("first"))
    starts = later.groupBy("k1", "k2").agg(F.collect_set("pos").alias("starts"))
    spread = F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (window - 1))))
    return starts.select("k1", "k2", F.array_distinct(spread).alias("covered"))


def remove_repeated_windows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, counts: tuple[str, str] | None = None) -> DataFrame:
    """df with the covered lines removed from text; with counts, two more columns: lines before, and lines removed.

    All rows and columns stay, in no set order. A null text stays null and has no lines; an empty text is one empty
    line. Texts with fewer lines than a window lose nothing; a text whose lines all go becomes empty. Rows with a null
    doc_id come last in the order of places, ties in doc_id are ordered by a hash of id and text, and rows equal in
    both are one document: they lose the same lines, and don't count as copies of each other.
    """
    x, y, gone = unused(df, "dedup_k1"), unused(df, "dedup_k2"), unused(df, "dedup_covered")
    covered = repeated_lines(df, doc_id, text, window).toDF(x, y, gone)
    k1, k2 = row_key(doc_id, text)
    marked = df.withColumns({x: k1, y: k2}).join(covered, [x, y], "left")
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    cleaned = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    more = {counts[0]: F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)), counts[1]: F.coalesce(F.size(gone), F.lit(0))} if counts else {}
    return marked.withColumns(more | {text: cleaned}).select(*df.columns, *more)


ORACLE = f"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM {{documents}}),
places AS (
  SELECT doc_id, p.pos AS pos, list_slice(lines, p.pos, p.pos + {WINDOW - 1}) AS win
  FROM docs, LATERAL (SELECT unnest(generate_series(1, len(lines) - {WINDOW - 1})) AS pos) p WHERE len(lines) >= {WINDOW}
),
first AS (SELECT win, min((doc_id, pos)) AS first, count(*) AS times FROM places GROUP BY win HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + {WINDOW - 1})) AS line
  FROM places JOIN first USING (win) WHERE (doc_id, pos) > first.first
),
gone AS (SELECT doc_id, list(line) AS gone FROM covered GROUP BY doc_id),
cleaned AS (
  SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN text ELSE array_to_string(
      list_transform(list_filter(generate_series(1, len(lines)), lambda i: NOT list_contains(gone, i)), lambda i: lines[i]), chr(10)) END AS text
  FROM docs LEFT JOIN gone USING (doc_id)
)
"""
