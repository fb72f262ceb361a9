"""WARC revisits: a "not modified" record gets the payload of the latest earlier full response for its URL.

An as-of join by canonical URL. A URL may hold a third of all records, so time is cut into buckets: the latest response
of each (URL, bucket) is found by a plain aggregate, a window over those few rows carries it to later buckets, and only
records of the same (URL, bucket) meet in a window. Payloads take no part until the sources are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import lookup, materialize, shuffle_partitions

# Header fields that a 304 response must not change in a stored response (RFC 9110, RFC 9111 section 3.2).
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
)
# Query parameters that only track.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid|phpsessid|jsessionid|sid)"

RESOLVED, NO_URL, NO_RESPONSE, NO_VALIDATOR, CHANGED = "resolved", "no url", "no earlier response", "no validator", "validators differ"


def canonical(url: Column) -> Column:
    """One form for URLs that fetch the same page: no scheme, credentials, "www", default port, fragment, tracking or
    final slash; the host in lower case, the parameters in order. Null stays null, an empty URL is null."""
    url = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(rf"^{TRACKING}(=|$)")))
    whole = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(whole != "", whole)


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then clash the last value counts. Null is no headers."""
    entries = F.coalesce(F.map_entries(headers), F.array())
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    value = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, value))


def weak(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit of records.

    records: record_id, kind ("response" or "revisit"), url, time (long), status (int), headers (map of strings), payload.
    A full response has kind "response", status 200 and neither id, time nor payload null. A revisit takes the latest
    full response of its canonical URL with a smaller time; among responses of one time the largest record_id. The
    entity tags must agree (weak comparison) where the revisit has one, else the Last-Modified values. Returns record_id,
    canonical_url, time, source_id, outcome, status, headers, payload; the last three are of the source, with the revisit's
    permitted headers merged in, where the outcome is "resolved", else null, null and null. Of several responses that share
    an id one is used. A null kind is neither; repeated revisits are all returned; extra columns are ignored.
    """
    spark = records.sparkSession
    base = records.select("record_id", "kind", canonical(F.col("url")).alias("canonical_url"), F.col("time").cast("long").alias("time"), "status", "headers", "payload")
    full = base.where("kind = 'response' AND status = 200 AND record_id IS NOT NULL AND time IS NOT NULL AND payload IS NOT NULL")
    revisits = base.where("kind = 'revisit'")

    parts = shuffle_partitions(spark)
    cuts = full.agg(F.percentile_approx("time", F.array(*[F.lit(i / parts) for i in range(1, parts)] or [F.lit(0.5)]), 10_000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]), lambda c: c <= F.col("time"))) if cuts else F.lit(0)
    known = F.col("canonical_url").isNotNull() & F.col("time").isNotNull()
    events = full.where(known).select("canonical_url", "time", F.struct("time", "record_id").alias("at"), F.lit(False).alias("asks"))
    asked = revisits.where(known).select("canonical_url", "time").distinct().select("canonical_url", "time", F.lit(None).cast(events.schema["at"].dataType).alias("at"), F.lit(True).alias("asks"))
    events = events.unionByName(asked).withColumn("bucket", bucket)

    last = events.groupBy("canonical_url", "bucket").agg(F.max("at").alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("canonical_url", "bucket", F.max("last").over(before).alias("carried"))
    earlier = Window.partitionBy("canonical_url", "bucket").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("near", F.max("at").over(earlier)).where("asks").join(carried, ["canonical_url", "bucket"])
    found = found.select(F.col("canonical_url").alias("u"), F.col("time").alias("t"), F.coalesce("near", "carried")["record_id"].alias("source_id"))
    asked = revisits.join(found, (F.col("canonical_url") == F.col("u")) & (F.col("time") == F.col("t")), "left").drop("u", "t", "kind", "status", "payload")
    asked = materialize(asked, "revisits")

    used = asked.groupBy("source_id").agg(F.count("*").alias("times"))
    sources = full.select(F.col("record_id").alias("source_id"), F.col("status").alias("old_status"), lower_keys(F.col("headers")).alias("old"), F.col("payload").alias("old_payload"))
    met = lookup(asked.withColumn("new", lower_keys(F.col("headers"))), sources, "source_id", asked.count(), "left", by=["record_id", "time"], counts=used, few=0, pick=F.xxhash64("old_payload", "old_status"))
    tag, date = F.col("new")["etag"], F.col("new")["last-modified"]
    same = F.when(tag.isNotNull(), weak(tag).eqNullSafe(weak(F.col("old")["etag"]))).otherwise(F.trim(date).eqNullSafe(F.trim(F.col("old")["last-modified"])))
    outcome = (
        F.when(F.col("canonical_url").isNull(), NO_URL).when(F.col("source_id").isNull(), NO_RESPONSE)
        .when(tag.isNull() & date.isNull(), NO_VALIDATOR).when(same, RESOLVED).otherwise(CHANGED)
    )
    update = F.map_filter("new", lambda k, v: ~k.isin(*NOT_MERGED) & v.isNotNull())
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.map_contains_key(update, k)), update)
    done = F.col("outcome") == RESOLVED
    return met.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "time", "source_id", "outcome",
        F.when(done, F.col("old_status")).alias("status"), F.when(done, merged).alias("headers"), F.when(done, F.col("old_payload")).alias("payload"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl of pages(page_id, url, html): a response and a later revisit for every page.

    Page n is fetched at time 2n, and asked for again 1001 ticks later under another spelling of its URL. Every
    seventh revisit has an entity tag that the page never had, every fifth has only a date, every eleventh neither.
    """
    tag, n = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.col("page_id")
    date = F.concat(F.lit("day "), (n % 28).cast("string"))
    responses = pages.select(
        (2 * n).alias("record_id"), F.lit("response").alias("kind"), "url", (2 * n).alias("time"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), date, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
        F.col("html").alias("payload"),
    )
    other = F.concat(F.upper(F.regexp_extract("url", "^([a-z]*://)", 1)), F.regexp_replace(F.regexp_replace("url", "^[a-z]*://", ""), "#.*$", ""), F.lit("#again"))
    seen = F.when(n % 11 == 0, F.lit(None)).when(n % 5 == 0, F.lit(None)).when(n % 7 == 0, F.lit('"gone"')).otherwise(F.concat(F.lit("W/"), tag))
    revisits = pages.select(
        (2 * n + 1).alias("record_id"), F.lit("revisit").alias("kind"), other.alias("url"), (2 * n + 1001).alias("time"), F.lit(304).alias("status"),
        F.map_filter(
            F.create_map(F.lit("etag"), seen, F.lit("last-modified"), F.when(n % 11 != 0, date), F.lit("content-type"), F.lit("text/plain"), F.lit("cache-control"), F.lit("max-age=600")),
            lambda k, v: v.isNotNull(),
        ).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return responses.unionByName(revisits)


_CANONICAL = r"""
regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), '^www[0-9]*\.', ''), ':(80|443)$', '')
 || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
 || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END
"""
ORACLE = rf"""
WITH pages_ AS (SELECT *, 'day ' || (page_id % 28) AS date FROM pages),
raw AS (
  SELECT 2 * page_id AS record_id, url, 2 * page_id AS time, md5(html) AS tag, date, html, page_id, true AS is_full FROM pages_
  UNION ALL
  SELECT 2 * page_id + 1, url, 2 * page_id + 1001,
    CASE WHEN page_id % 11 = 0 OR page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'gone' ELSE md5(html) END,
    CASE WHEN page_id % 11 = 0 THEN NULL ELSE date END, NULL, page_id, false FROM pages_
),
cut AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM raw
),
parts AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'),
    lambda p: p <> '' AND NOT regexp_matches(lower(p), '^{TRACKING}(=|$)'))) AS kept FROM cut
),
records AS (SELECT *, {_CANONICAL} AS canonical_url FROM parts),
full_ AS (SELECT * FROM records WHERE is_full AND html IS NOT NULL),
met AS (
  SELECT r.record_id, r.canonical_url, r.time, f.record_id AS source_id, r.tag AS new_tag, r.date AS new_date, f.tag AS old_tag, f.date AS old_date, f.html
  FROM (SELECT * FROM records WHERE NOT is_full) r
  ASOF LEFT JOIN full_ f ON r.canonical_url = f.canonical_url AND r.time > f.time
),
told AS (
  SELECT *, CASE WHEN source_id IS NULL THEN '{NO_RESPONSE}' WHEN new_tag IS NULL AND new_date IS NULL THEN '{NO_VALIDATOR}'
    WHEN new_tag IS NOT NULL AND new_tag = old_tag OR new_tag IS NULL AND new_date = old_date THEN '{RESOLVED}' ELSE '{CHANGED}' END AS outcome FROM met
)
SELECT record_id, canonical_url, time, source_id, outcome,
  CASE WHEN outcome = '{RESOLVED}' THEN 200 END AS status,
  CASE WHEN outcome = '{RESOLVED}' THEN 'cache-control=max-age=600;content-type=text/html;etag=' || CASE WHEN new_tag IS NULL THEN '' ELSE 'W/' END || '"' || old_tag || '";last-modified=' || old_date END AS headers,
  CASE WHEN outcome = '{RESOLVED}' THEN sha256(html) END AS payload_sha256
FROM told
"""
