"""Queries of retrieval search and its metrics, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import scratch
from tessera.operators import retrieval_metrics as metrics
from tessera.operators import keyed, search
from tessera.plans import domain
from tessera.plans.domain import with_views

K = 10


def _items(spark, sf_dir, level="patient"):
    items = domain.items(spark, sf_dir).withColumn("exclusion_key", search.exclusion_key(level))
    return items.where("is_query"), items


def _bags(spark, sf_dir, level="patient"):
    notes = domain.annotations(spark, sf_dir)
    tiles = domain.tiles(spark, sf_dir).groupBy("slide").agg(F.transform(F.array_sort(F.collect_list(F.struct("tile_idx", "vec"))), lambda t: t["vec"]).alias("vecs"))
    found = notes.join(tiles, "slide").select(F.col("slide").alias("sample_id"), "case", "patient", "category", "dataset", "vecs").withColumn("exclusion_key", search.exclusion_key(level))
    return found.where("dataset = 'query_ds'"), found


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def topk_cosine(spark, sf_dir):
    hits = search.topk(*_items(spark, sf_dir), search.Cosine(), K)
    return _rounded(hits.withColumn("score", -F.col("score")))


def barcode(level):
    return lambda spark, sf_dir: search.topk(*_items(spark, sf_dir, level), search.Barcodes(), K)


def bag_barcode(spark, sf_dir):
    return search.topk(*_bags(spark, sf_dir), search.Barcodes(), K)


def _prototypes(spark, sf_dir):
    """Per slide two prototypes, even and odd tiles, with the mean and variance of every component."""
    long = domain.tiles(spark, sf_dir).select("slide", (F.col("tile_idx") % 2).alias("proto"), F.posexplode("vec").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    each = long.groupBy("slide", "proto", "dim").agg(F.avg("x").alias("m"), F.var_pop("x").alias("c"))
    whole = F.array_sort(F.collect_list(F.struct("dim", "m", "c")))
    stats = each.groupBy("slide", "proto").agg(whole.alias("s")).select("slide", "proto", F.transform("s", lambda x: x["m"]).alias("mean"), F.transform("s", lambda x: x["c"]).alias("cov"))
    both = stats.groupBy(F.col("slide").alias("sample_id")).agg(F.array_sort(F.collect_list(F.struct("proto", "mean", "cov"))).alias("p"))
    vecs = F.concat(F.transform("p", lambda x: x["mean"]), F.transform("p", lambda x: x["cov"]))
    notes = domain.annotations(spark, sf_dir).select(F.col("slide").alias("sample_id"), "dataset", F.col("patient").alias("exclusion_key"))
    found = both.select("sample_id", vecs.alias("vecs")).join(notes, "sample_id")
    return found.where("dataset = 'query_ds'"), found


def pbss(spark, sf_dir):
    return _rounded(search.topk(*_prototypes(spark, sf_dir), search.Prototypes(), K))


def retccl(spark, sf_dir):
    return _rounded(search.retccl(*_bags(spark, sf_dir), k=5, threshold=0.1))


def _keyed(spark, sf_dir):
    """Tiles with an integer key from three components, and sign bits."""
    key = (F.floor((F.col("vec")[0] + 1) * 10) * 10**11 + F.floor((F.col("vec")[1] + 1) * 10) * 10**6 + F.floor((F.col("vec")[2] + 1) * 10)).cast("long")
    tiles = domain.tiles(spark, sf_dir).select(F.col("slide").alias("sample_id"), F.col("tile_idx").alias("vec_idx"), key.alias("key"), F.transform("vec", lambda x: x > 0).alias("bits"))
    notes = domain.annotations(spark, sf_dir).select(F.col("slide").alias("sample_id"), "dataset", "category", F.col("patient").alias("exclusion_key"))
    found = tiles.join(notes, "sample_id")
    return found.where("dataset = 'query_ds'"), found


def sish(spark, sf_dir):
    return keyed.sish(*_keyed(spark, sf_dir), interval=10**11, threshold=30)


def asof_neighbours(spark, sf_dir):
    events = domain.table(spark, sf_dir, "events")
    keys = events.where("event_type = 'purchase'").select(F.col("event_id").alias("key"))
    return search.neighbours(keys, events.where("event_type <> 'view'").select(F.col("event_id").alias("key")))


def weights(spark, sf_dir):
    return search.class_weights(domain.annotations(spark, sf_dir)).select("label", F.round("weight", 9).alias("weight"))


def match_entropy(spark, sf_dir):
    queries, refs = _bags(spark, sf_dir)
    by = {r.label: r.weight for r in search.class_weights(refs).collect()}
    return search.entropies(search.tile_matches(queries, refs, by, 0.1)).withColumn("entropy", F.round("entropy", 6))


def _judged(spark, sf_dir):
    items = domain.items(spark, sf_dir)
    queries, refs = _items(spark, sf_dir)
    hits = metrics.labelled(search.topk(queries, refs, search.Barcodes(), K), items.select("sample_id", "category"))
    return queries.select(F.col("sample_id").alias("query_id"), F.col("category").alias("query_label"), "exclusion_key"), hits


def metric(name, compute, k):
    def run(spark, sf_dir):
        queries, hits = _judged(spark, sf_dir)
        rows = compute(queries, hits, k)
        rows = rows if "scope" in rows.columns else metrics.summary(rows, name)
        return rows.select("metric", "scope", F.coalesce("label", F.lit("-")).alias("label"), F.round("value", 6).alias("value"), "queries")

    return run


def ndcg(spark, sf_dir):
    queries, hits = _judged(spark, sf_dir)
    available = metrics.relevant_items(queries, _items(spark, sf_dir)[1])
    rows = metrics.summary(metrics.ndcg_at_k(queries, hits, 5, available), "ndcg")
    return rows.select("metric", "scope", F.coalesce("label", F.lit("-")).alias("label"), F.round("value", 6).alias("value"), "queries")


def relevant(spark, sf_dir):
    queries, items = _items(spark, sf_dir)
    return metrics.relevant_items(queries.select(F.col("sample_id").alias("query_id"), F.col("category").alias("query_label"), "exclusion_key"), items)


def votes(spark, sf_dir):
    queries, hits = _judged(spark, sf_dir)
    return metrics.votes_at_k(queries, hits, 5)


def dcg(spark, sf_dir):
    queries, hits = _judged(spark, sf_dir)
    top = hits.join(queries, "query_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", (F.col("hit_label") == F.col("query_label")).cast("double").alias("r")))), lambda x: x["r"]).alias("r"))
    return top.select("query_id", F.round(metrics.dcg(F.col("r")), 6).alias("dcg"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcode search with patient exclusion, scored by every metric: one row per metric, scope and label."""
    queries, hits = _judged(spark, sf_dir)
    hits = scratch.written(hits, "hits")  # six metrics read them, and the search runs once
    parts = [metrics.summary(f(queries, hits, k), f"{n}_at_{k}") for n, f, k in (("hit", metrics.hit_at_k, 1), ("hit", metrics.hit_at_k, 5), ("precision", metrics.precision_at_k, 5), ("map", metrics.map_at_k, 5), ("mmv", metrics.mmv_at_k, 5))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select("metric", "scope", F.coalesce("label", F.lit("-")).alias("label"), F.round("value", 6).alias("value"), "queries")


def pool(spark, sf_dir):
    return metrics.reference_pool(domain.annotations(spark, sf_dir), "slide")


def results_wide(spark, sf_dir):
    from tessera.sources import results

    return results.to_wide(search.topk(*_items(spark, sf_dir), search.Barcodes(), 3), 3)


def results_long(spark, sf_dir):
    from tessera.sources import results

    return results.to_long(results_wide(spark, sf_dir))


QUERIES = {
    "retrieval_flagship": flagship,
    "retrieval_topk_cosine": topk_cosine,
    "retrieval_barcode_topk": barcode("patient"),
    "retrieval_exclusion_none": barcode("none"),
    "retrieval_exclusion_slide": barcode("slide"),
    "retrieval_bag_barcode_topk": bag_barcode,
    "retrieval_pbss_topk": pbss,
    "retrieval_retccl_topk": retccl,
    "retrieval_retccl_entropy": match_entropy,
    "retrieval_sish_topk": sish,
    "retrieval_asof_neighbours": asof_neighbours,
    "retrieval_class_weights": weights,
    "metric_hit_at_5": metric("hit", metrics.hit_at_k, 5),
    "metric_precision_at_5": metric("precision", metrics.precision_at_k, 5),
    "metric_map_at_5": metric("map", metrics.map_at_k, 5),
    "metric_mmv_at_5": metric("mmv", metrics.mmv_at_k, 5),
    "metric_macro_f1_at_5": metric("f1", metrics.macro_f1_at_k, 5),
    "metric_ndcg_at_5": ndcg,
    "metric_relevant_items": relevant,
    "metric_votes_at_5": votes,
    "metric_dcg": dcg,
    "metric_reference_pool": pool,
    "results_wide": results_wide,
    "results_long": results_long,
}

_BITS = "bits AS (SELECT *, list_transform(range(1, len(vec)), lambda i: vec[i + 1] - vec[i] < 0) AS b FROM items)"


def _hits(level: str, k: int = K) -> str:
    key = {"patient": "AND r.patient <> q.patient", "none": "", "slide": "AND r.sample_id <> q.sample_id"}[level]
    far = "list_sum(list_transform(list_zip(q.b, r.b), lambda z: CAST(z[1] <> z[2] AS INT)))"
    return f"""{_BITS}, scored AS (SELECT q.sample_id AS query_id, q.category AS query_label, r.sample_id, r.category AS hit_label, {far}::DOUBLE AS score
      FROM bits q JOIN bits r ON q.is_query {key}),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, sample_id) AS rank FROM scored) WHERE rank <= {k})"""


_QUERIES = "queries AS (SELECT sample_id AS query_id, category AS query_label, patient FROM items WHERE is_query)"
_JUDGED = f"{_QUERIES}, judged AS (SELECT q.query_id, q.query_label, h.rank AS position, h.hit_label, coalesce(CAST(h.hit_label = q.query_label AS INT), 0) AS relevant FROM queries q LEFT JOIN hits h ON h.query_id = q.query_id AND h.rank <= 5)"
_VOTES = "won AS (SELECT query_id, hit_label AS predicted FROM (SELECT *, sum(n) OVER (PARTITION BY query_id) AS total FROM (SELECT query_id, hit_label, count(*) AS n FROM judged WHERE position IS NOT NULL GROUP BY ALL)) WHERE n >= total // 2 + 1), votes AS (SELECT query_id, query_label, predicted FROM queries LEFT JOIN won USING (query_id))"
_PER_QUERY = {
    "hit": "SELECT query_id, query_label, max(relevant)::DOUBLE AS value FROM judged GROUP BY ALL",
    "precision": "SELECT query_id, query_label, sum(relevant) / 5.0::DOUBLE AS value FROM judged GROUP BY ALL",
    "map": "SELECT query_id, query_label, CASE WHEN count(position) < 5 THEN 0 ELSE coalesce(avg(CASE WHEN relevant = 1 THEN running / position END), 0) END::DOUBLE AS value FROM (SELECT *, sum(relevant) OVER (PARTITION BY query_id ORDER BY position)::DOUBLE AS running FROM judged) GROUP BY ALL",
    "mmv": "SELECT query_id, query_label, coalesce(CAST(predicted = query_label AS INT), 0)::DOUBLE AS value FROM votes",
    "ndcg": "SELECT query_id, query_label, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END AS value FROM (SELECT query_id, query_label, sum(CASE WHEN relevant = 1 THEN 1 / log2(position + 1) ELSE 0 END) AS dcg, list_sum(list_transform(range(1, least(5, any_value(relevant_items.relevant_))::BIGINT + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM judged JOIN relevant_items USING (query_id) GROUP BY ALL)",
}
_RELEVANT = "relevant_items AS (SELECT q.query_id, count(r.sample_id) AS relevant_ FROM queries q LEFT JOIN items r ON r.category = q.query_label AND r.sample_id <> q.query_id AND r.patient <> q.patient GROUP BY ALL)"


def _summary(name: str, per_query: str, metric_name: str | None = None) -> str:
    return f"""SELECT '{metric_name or name}' AS metric, 'label' AS scope, query_label AS label, round(avg(value), 6) AS value, count(*) AS queries FROM ({per_query}) GROUP BY query_label
    UNION ALL SELECT '{metric_name or name}', 'macro', '-', round(avg(v), 6), sum(n) FROM (SELECT avg(value) AS v, count(*) AS n FROM ({per_query}) GROUP BY query_label)
    UNION ALL SELECT '{metric_name or name}', 'micro', '-', round(avg(value), 6), count(*) FROM ({per_query})"""


def _metric_sql(name: str) -> str:
    return with_views("items", _hits("patient"), _JUDGED, _VOTES, _RELEVANT) + _summary(name, _PER_QUERY[name])


_BAGS = "b AS (SELECT slide, tile_idx, list_transform(range(1, len(vec)), lambda i: vec[i + 1] - vec[i] < 0) AS b FROM tiles)"
_UNIT = "u AS (SELECT t.slide, t.tile_idx, t.vec::DOUBLE[] AS v, sqrt(list_dot_product(t.vec::DOUBLE[], t.vec::DOUBLE[])) + 1e-12 AS n, a.category, a.patient, a.dataset FROM tiles t JOIN annotations a USING (slide))"
_WEIGHT = "w AS (SELECT category AS label, 10.0 / n / sum(1.0 / n) OVER () AS weight FROM (SELECT category, count(*) AS n FROM annotations GROUP BY 1))"
_MATCH = "m AS (SELECT q.slide AS query_id, q.tile_idx AS tile, r.slide AS sample_id, r.tile_idx AS position, r.category AS label, list_dot_product(q.v, r.v) / (q.n * r.n) AS s FROM u q JOIN u r ON q.dataset = 'query_ds' AND r.slide <> q.slide AND r.patient <> q.patient WHERE list_dot_product(q.v, r.v) / (q.n * r.n) >= 0.1)"
_ENTROPY = "e AS (SELECT query_id, tile, sum(-p * ln(p)) AS entropy FROM (SELECT query_id, tile, x / sum(x) OVER (PARTITION BY query_id, tile) AS p FROM (SELECT query_id, tile, m.label, sum((s + 1) / 2 * weight) AS x FROM m JOIN w ON w.label = m.label GROUP BY ALL)) GROUP BY ALL)"
_RETCCL = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tile ORDER BY s DESC, sample_id, position) AS own FROM m) WHERE own <= 5),
all_tiles AS (SELECT slide AS query_id, tile_idx AS tile FROM u WHERE dataset = 'query_ds'),
mean AS (SELECT query_id, tile, avg(s) AS mean FROM best GROUP BY ALL),
kept AS (SELECT * FROM (SELECT t.*, mean, avg(coalesce(mean, 0)) OVER (PARTITION BY t.query_id) AS eta FROM all_tiles t LEFT JOIN mean USING (query_id, tile)) WHERE mean >= eta),
named AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tile ORDER BY n DESC, first) AS pick FROM
  (SELECT query_id, tile, mean, label, count(*) AS n, min(own) AS first, arg_min(sample_id, own) AS sample_id FROM best JOIN kept USING (query_id, tile) GROUP BY ALL)) WHERE pick = 1),
ordered AS (SELECT n.*, row_number() OVER (PARTITION BY query_id ORDER BY entropy DESC, tile) AS o FROM named n JOIN e USING (query_id, tile)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, sample_id ORDER BY o) AS f FROM ordered) WHERE f = 1)"""

#: Key probing: the walks of a tile one by one, each cut at the first key that an earlier one found; then the cleaning of its bags.
_SISH = f"""keyed AS (SELECT slide, tile_idx, category, patient, dataset, list_transform(vec, lambda x: x > 0) AS bits,
    floor((vec[1] + 1) * 10)::BIGINT * {10**11} + floor((vec[2] + 1) * 10)::BIGINT * {10**6} + floor((vec[3] + 1) * 10)::BIGINT AS key FROM tiles JOIN annotations USING (slide)),
asked AS (SELECT * FROM keyed WHERE dataset = 'query_ds'),
far AS (SELECT q.slide AS query_id, q.tile_idx AS tile, r.key, list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: CAST(z[1] <> z[2] AS INT))) AS d, r.slide, r.tile_idx, r.category FROM asked q JOIN keyed r ON r.patient <> q.patient),
near AS (SELECT query_id, tile, key, b.d AS d, b.slide AS sample_id, b.category AS label FROM (SELECT query_id, tile, key, min({{'d': d, 'slide': slide, 'tile': tile_idx, 'category': category}}) AS b FROM far GROUP BY ALL)),
seeds AS (SELECT slide AS query_id, tile_idx AS tile, 2 * n + w AS walk, w, CASE WHEN n < 10 THEN key - n * {10**11} ELSE key + (n - 10) * {10**11} END AS seed FROM asked, (SELECT unnest(range(20)) AS n), (SELECT unnest(range(2)) AS w)),
steps AS (SELECT *, row_number() OVER (PARTITION BY query_id, tile, walk ORDER BY abs(key - seed)) AS step FROM seeds JOIN near USING (query_id, tile) WHERE CASE WHEN w = 0 THEN key < seed ELSE key > seed END),
walks AS (SELECT query_id, tile, walk, list(key ORDER BY step) AS keys FROM steps WHERE step <= 375 AND d <= 30 GROUP BY ALL),
replayed AS (SELECT slide AS query_id, tile_idx AS tile, 0 AS walk, []::BIGINT[] AS found FROM asked
    UNION ALL SELECT r.query_id, r.tile, r.walk + 1, CASE WHEN k.keys IS NULL THEN found ELSE list_concat(found, k.keys[1:coalesce(nullif(list_position(list_transform(k.keys, lambda x: list_contains(found, x)), true), 0), len(k.keys) + 1) - 1]) END
    FROM replayed r LEFT JOIN walks k ON k.query_id = r.query_id AND k.tile = r.tile AND k.walk = r.walk WHERE r.walk < 40),
bags AS (SELECT *, row_number() OVER (PARTITION BY query_id, tile ORDER BY d, place) AS i FROM (SELECT query_id, tile, unnest(found) AS key, generate_subscripts(found, 1) AS place FROM replayed WHERE walk = 40) JOIN near USING (query_id, tile, key)),
counts AS (SELECT q.slide AS query_id, r.category AS label, count(*) AS n FROM (SELECT DISTINCT slide, patient FROM asked) q JOIN keyed r ON r.patient <> q.patient GROUP BY ALL),
weights AS (SELECT query_id, label, 10 / sum(1.0 / n) OVER (PARTITION BY query_id) / n AS weight FROM counts),
shares AS (SELECT *, v / sum(v) OVER (PARTITION BY query_id, tile) AS p FROM (SELECT query_id, tile, label, min(i) AS first, sum(weight / i) AS v FROM bags JOIN weights USING (query_id, label) GROUP BY ALL)),
sure AS (SELECT query_id, tile, round(-sum(p * log2(p)), 9) AS entropy, arg_max(label, (round(p, 9), -first)) AS top FROM shares GROUP BY ALL),
sized AS (SELECT query_id, tile, count(*) AS size, round(avg(d) FILTER (WHERE i <= 5), 9) AS mean FROM bags GROUP BY ALL),
whole AS (SELECT query_id, count(DISTINCT size) AS sizes, quantile_cont(size, 0.05) AS low, quantile_cont(size, 0.95) AS high FROM sized GROUP BY ALL),
fit AS (SELECT s.*, entropy, top, round(avg(mean) OVER (PARTITION BY query_id), 9) AS most FROM sized s JOIN sure USING (query_id, tile) JOIN whole USING (query_id) WHERE sizes <= 3 OR size > low AND size < high),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY entropy, tile) AS o FROM fit WHERE mean <= most),
votes AS (SELECT query_id, label, round(sum(p), 9) AS v, min((o, first)) AS first FROM rows_ JOIN shares USING (query_id, tile) WHERE o <= 5 GROUP BY ALL),
won AS (SELECT query_id, arg_min(label, (-v, first)) AS vote FROM votes v WHERE EXISTS (SELECT 1 FROM rows_ r WHERE r.query_id = v.query_id AND r.o <= 5 AND r.top = v.label) GROUP BY ALL),
taken AS (SELECT r.query_id, r.o, b.i, r.entropy, b.d, b.sample_id, r.o <= 5 AND r.top <> vote AS dissents, r.entropy = 0 AS sure,
    row_number() OVER (PARTITION BY r.query_id, b.sample_id ORDER BY r.o, b.i) AS nth FROM rows_ r JOIN bags b USING (query_id, tile) JOIN won USING (query_id) WHERE r.entropy = 0 OR b.d <= r.most),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY entropy, d, o, i) AS rank FROM taken WHERE (sure OR nth = 1) AND NOT dissents)"""

ORACLES = {
    "retrieval_topk_cosine": with_views("items") + f"SELECT query_id, rank, sample_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sample_id) AS rank FROM (SELECT q.sample_id AS query_id, r.sample_id, list_cosine_similarity(q.vec, r.vec) AS score FROM items q JOIN items r ON q.is_query AND r.patient <> q.patient)) WHERE rank <= {K}",
    **{name: with_views("items", _hits(level)) + "SELECT query_id, rank, sample_id, score FROM hits" for name, level in (("retrieval_barcode_topk", "patient"), ("retrieval_exclusion_none", "none"), ("retrieval_exclusion_slide", "slide"))},
    "retrieval_bag_barcode_topk": with_views("tiles annotations", _BAGS) + f"""SELECT query_id, rank, sample_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, sample_id) AS rank FROM
      (SELECT query_id, sample_id, median(d)::DOUBLE AS score FROM (SELECT q.slide AS query_id, r.slide AS sample_id, x.tile_idx, min(list_sum(list_transform(list_zip(x.b, y.b), lambda z: CAST(z[1] <> z[2] AS INT)))) AS d
        FROM annotations q JOIN annotations r ON q.dataset = 'query_ds' AND r.patient <> q.patient JOIN b x ON x.slide = q.slide JOIN b y ON y.slide = r.slide GROUP BY ALL) GROUP BY ALL)) WHERE rank <= {K}""",
    "retrieval_pbss_topk": with_views("tiles annotations") + f""", s AS (SELECT slide, tile_idx % 2 AS proto, i, avg(vec[i]::DOUBLE) AS m, var_pop(vec[i]::DOUBLE) AS c FROM tiles, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
      d AS (SELECT a.slide AS query_id, b.slide AS sample_id, x.proto, sqrt(sum((x.m - y.m) ** 2 / (x.c + y.c + 1e-6))) AS d
        FROM annotations a JOIN annotations b ON a.dataset = 'query_ds' AND a.patient <> b.patient JOIN s x ON x.slide = a.slide JOIN s y ON y.slide = b.slide AND y.proto = x.proto AND y.i = x.i GROUP BY ALL),
      scored AS (SELECT query_id, sample_id, -0.5 * ln(avg(exp(-(d - low) / 0.5))) + any_value(low) AS score FROM (SELECT *, min(d) OVER (PARTITION BY query_id, sample_id) AS low FROM d) GROUP BY ALL)
      SELECT query_id, rank, sample_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, sample_id) AS rank FROM scored) WHERE rank <= {K}""",
    "retrieval_retccl_entropy": with_views("tiles annotations", _UNIT, _WEIGHT, _MATCH, _ENTROPY) + "SELECT query_id, tile, round(entropy, 6) AS entropy FROM e",
    "retrieval_retccl_topk": with_views("tiles annotations", _UNIT, _WEIGHT, _MATCH, _ENTROPY, _RETCCL) + "SELECT query_id, rank, sample_id, round(mean, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mean DESC, o) AS rank FROM firsts) WHERE rank <= 5",
    "retrieval_sish_topk": with_views("tiles annotations", _SISH).replace("WITH", "WITH RECURSIVE", 1) + f"SELECT query_id, rank, sample_id, d::DOUBLE AS score FROM ranked WHERE rank <= {K}",
    "retrieval_asof_neighbours": "WITH k AS (SELECT DISTINCT event_id AS key FROM events WHERE event_type = 'purchase'), q AS (SELECT DISTINCT event_id AS key FROM events WHERE event_type <> 'view') SELECT q.key, p.key AS predecessor, s.key AS successor FROM q ASOF LEFT JOIN k p ON q.key > p.key ASOF LEFT JOIN k s ON q.key < s.key",
    "retrieval_class_weights": with_views("annotations") + "SELECT category AS label, round(10.0 / n / sum(1.0 / n) OVER (), 9) AS weight FROM (SELECT category, count(*) AS n FROM annotations GROUP BY 1)",
    **{f"metric_{n}_at_5": _metric_sql(n) for n in _PER_QUERY},
    "retrieval_flagship": with_views("items", _hits("patient"), _JUDGED, _VOTES) + " UNION ALL ".join([_summary("hit", "SELECT q.query_id, q.query_label, coalesce(max(CAST(h.hit_label = q.query_label AS INT)), 0)::DOUBLE AS value FROM queries q LEFT JOIN hits h ON h.query_id = q.query_id AND h.rank <= 1 GROUP BY ALL", "hit_at_1"), *(_summary(n, _PER_QUERY[n], f"{n}_at_5") for n in ("hit", "precision", "map", "mmv"))]),
    "metric_macro_f1_at_5": with_views("items", _hits("patient"), _JUDGED, _VOTES) + """, c AS (SELECT coalesce(t.label, f.label) AS label, tp, fn, coalesce(fp, 0) AS fp FROM
        (SELECT query_label AS label, sum(CAST(coalesce(predicted = query_label, false) AS INT)) AS tp, sum(CAST(NOT coalesce(predicted = query_label, false) AS INT)) AS fn FROM votes GROUP BY 1) t
        FULL JOIN (SELECT predicted AS label, count(*) AS fp FROM votes WHERE predicted <> query_label GROUP BY 1) f ON t.label = f.label),
      e AS (SELECT label, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END::DOUBLE AS value, (tp + fn)::BIGINT AS queries FROM c WHERE tp IS NOT NULL)
      SELECT 'f1' AS metric, 'label' AS scope, label, round(value, 6) AS value, queries FROM e UNION ALL SELECT 'f1', 'macro', '-', round(avg(value), 6), sum(queries)::BIGINT FROM e
      UNION ALL SELECT 'f1', 'micro', '-', round(CASE WHEN sum(2 * coalesce(tp, 0) + fp + coalesce(fn, 0)) > 0 THEN 2.0 * sum(tp) / sum(2 * coalesce(tp, 0) + fp + coalesce(fn, 0)) ELSE 0 END::DOUBLE, 6), sum(tp + fn)::BIGINT FROM c""",
    "metric_relevant_items": with_views("items", _QUERIES, _RELEVANT) + "SELECT query_id, relevant_ AS relevant FROM relevant_items",
    "metric_votes_at_5": with_views("items", _hits("patient"), _JUDGED, _VOTES) + "SELECT * FROM votes",
    "metric_dcg": with_views("items", _hits("patient")) + "SELECT query_id, round(sum(CASE WHEN hit_label = query_label THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS dcg FROM hits GROUP BY 1",
    "metric_reference_pool": with_views("annotations") + 'SELECT slide AS sample_id, category, "case", patient, dataset FROM annotations',
    "results_wide": with_views("items", _hits("patient", 3)) + "SELECT query_id AS query_sample_id, " + ", ".join(f"max(CASE WHEN rank = {i} THEN sample_id END) AS rank_{i}_sample_id, max(CASE WHEN rank = {i} THEN score END) AS rank_{i}_score" for i in (1, 2, 3)) + " FROM hits GROUP BY 1",
    "results_long": with_views("items", _hits("patient", 3)) + "SELECT query_id, rank, sample_id, score FROM hits",
}
