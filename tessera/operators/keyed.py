"""Key probing: tiles of a query walk over the integer keys of the reference tiles, to both sides of seeds around their own key.

Nothing is held whole anywhere. Distinct keys are numbered by ranges, so that a walk is a range of numbers; the ranges that skip
the keys closed to a query are found by counting below a place, in zones; and the keys are cut into blocks, whose entries
are compared with the tiles that walk there in matrix products. What a walk finds depends on what earlier walks of the same
tile found, so the walks of a tile are replayed at the end, on the entries within the threshold alone.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import scratch
from tessera.operators.relational import running

#: Keys in one block at most; where keys have many entries, a block has fewer keys, so that it holds about MET entries.
BLOCK = 1024
#: Entries, and query tiles, of a block that meet in one task; a block with more is cut.
MET = 2048
HITS = "query_id string, rank int, sample_id string, score double"


def clean(bags: list[list[tuple[int, str, str]]], weights: dict[str, float], k: int) -> list[tuple[str, float]]:
    """Slides from the tiles' result bags: certain tiles first, outliers by size and distance dropped, dissent removed.

    Entropies, means and votes that are equal to nine decimals are equal.
    """
    rows = []
    for number, bag in enumerate(bags):
        if bag:
            share: dict[str, float] = {}
            for i, (_, _, label) in enumerate(bag):
                share[label] = share.get(label, 0.0) + weights[label] / (i + 1)
            total = sum(share.values())
            share = {x: v / total for x, v in share.items()}
            near = sorted(d for d, _, _ in bag)[:5]
            rows.append((number, round(-sum(v * np.log2(v) for v in share.values()), 9), round(float(np.mean(near)), 9), len(bag), share))
    sizes = [r[3] for r in rows]
    if len(set(sizes)) > 3:
        low, high = np.percentile(sizes, [5, 95])
        rows = [r for r in rows if low < r[3] < high]
    if not rows:
        return []
    limit = round(float(np.mean([r[2] for r in rows])), 9)
    rows = sorted((r for r in rows if r[2] <= limit), key=lambda r: r[1])
    votes: Counter = Counter()
    for r in rows[:5]:
        votes.update(r[4])
    removed: set[int] = set()
    for vote, _ in sorted(votes.items(), key=lambda x: -round(x[1], 9)):
        removed = {r[0] for r in rows[:5] if max(r[4], key=lambda x: round(r[4][x], 9)) != vote}
        if len(removed) < len(rows[:5]):
            break
    kept, seen = [], set()
    for number, entropy, _, _, _ in rows:
        for d, sample, _ in bags[number]:
            if entropy == 0.0 or d <= limit and sample not in seen:
                kept.append((entropy, d, number, sample))
                seen.add(sample)
    kept = [x for x in sorted(kept, key=lambda x: x[:2]) if x[2] not in removed]
    return [(sample, float(d)) for _, d, _, sample in kept[:k]]


def _dealt(rows: DataFrame, table: DataFrame, *on: str) -> DataFrame:
    """rows inner joined to table, which has a row per key; the keys of more than a 256th of the rows, so 255 at most, are broadcast.

    100,000 rows are few enough for one task and are joined as they are.
    """
    n = rows.count()
    hot = rows.groupBy(*on).count().where(F.col("count") > n / 256).drop("count").collect() if n > 100_000 else []
    if not hot:
        return rows.join(table, list(on))
    hot = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(*on).schema))
    return rows.join(hot, list(on), "left_anti").join(table, list(on)).unionByName(rows.join(F.broadcast(table.join(hot, list(on))), list(on)))


def _below(points: DataFrame, asks: DataFrame, width: int) -> DataFrame:
    """(g, at, n): the points of group g below each distinct place asked; a task sees one zone of width places of a group."""
    both = points.select("g", "at", F.lit(1).alias("one")).unionByName(asks.select("g", "at", F.lit(0).alias("one")).distinct())
    both = both.withColumn("zone", F.expr(f"at div {width}"))
    inside = Window.partitionBy("g", "zone").orderBy("at", "one").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("g").orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)  # a row for each zone
    carried = both.groupBy("g", "zone").agg(F.sum("one").alias("n")).withColumn("n", F.coalesce(F.sum("n").over(before), F.lit(0)))
    here = both.withColumn("here", F.coalesce(F.sum("one").over(inside), F.lit(0))).where("one = 0")
    return here.join(carried, ["g", "zone"]).select("g", "at", (F.col("here") + F.col("n")).alias("n"))


def _walks(probes: DataFrame, numbers: DataFrame, closed: DataFrame, total: int, interval: int, fanout: int, steps: int) -> DataFrame:
    """(key, g, walk, lo, hi): per walk the numbers of the keys that it may visit; even walks go down from hi, odd ones up from lo."""
    seeds = [F.col("key") + F.lit(sign * i * interval) for sign in (-1, 1) for i in range(fanout)]
    ends = probes.select("key", "g", F.posexplode(F.array(*seeds)).alias("no", "seed"))
    ends = _dealt(ends, numbers.select(F.col("key").alias("seed"), (F.col("upto") - F.col("known")).alias("under"), "upto"), "seed").drop("seed")
    width = int(total**0.5) + 1
    own = ends.join(closed.select("g").distinct(), "g", "left_semi")  # the others have no closed key
    shut = _below(closed, own.select("g", F.explode(F.array("under", "upto")).alias("at")), width)
    for side in ("under", "upto"):
        ends = ends.join(shut.select("g", F.col("at").alias(side), F.col("n").alias(f"shut_{side}")), ["g", side], "left")
    # open keys before the walk's end, and the number of the key that has so many open ones before it
    ends = ends.withColumn("low", F.greatest(F.col("under") - F.coalesce("shut_under", F.lit(0)) - steps, F.lit(0)))
    ends = scratch.written(ends.withColumn("high", F.col("upto") - F.coalesce("shut_upto", F.lit(0)) + (steps - 1)), "ends")
    gone = closed.join(_below(closed, closed, width), ["g", "at"]).select("g", (F.col("at") - F.col("n")).alias("at"))
    asks = ends.join(closed.select("g").distinct(), "g", "left_semi").select("g", F.explode(F.array(F.col("low") + 1, F.col("high") + 1)).alias("at"))
    skip = scratch.written(_below(gone, asks, width), "skip")
    for side in ("low", "high"):
        ends = ends.withColumn("at", F.col(side) + 1).join(skip.withColumnRenamed("n", f"skip_{side}"), ["g", "at"], "left").drop("at")
    lo = F.col("low") + F.coalesce("skip_low", F.lit(0))
    hi = F.least(F.col("high") + F.coalesce("skip_high", F.lit(0)) + 1, F.lit(total))
    both = F.array(F.struct((2 * F.col("no")).alias("walk"), lo.alias("lo"), F.col("under").alias("hi")), F.struct((2 * F.col("no") + 1).alias("walk"), F.col("upto").alias("lo"), hi.alias("hi")))
    return ends.select("key", "g", F.explode(both).alias("w")).select("key", "g", "w.*").where("lo < hi")


def _compare(threshold: int):
    def run(tiles: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        names = ["id", "no", "distance", "sample_id", "vec_idx", "category"]
        if not len(tiles) or not len(entries):
            return pd.DataFrame({n: [] for n in names})
        entries = entries.sort_values(["no", "sample_id", "vec_idx", "category"], ignore_index=True)
        of = lambda f: np.where(np.stack(f.bits.to_numpy()), np.float32(1), np.float32(-1))
        left, right = of(tiles), of(entries)
        code = ((left.shape[1] - left @ right.T) / 2).astype(np.int64) * len(entries) + np.arange(len(entries))
        groups = pd.factorize(np.concatenate([tiles.g, entries.g]))[0]
        barred = (groups[: len(tiles), None] == groups[None, len(tiles) :]) & (tiles.g != "").to_numpy()[:, None]
        code[barred] = np.iinfo(np.int64).max
        starts = np.flatnonzero(np.diff(entries.no.to_numpy(), prepend=-1))
        best = np.minimum.reduceat(code, starts, axis=1)
        tile, at = np.nonzero(best < (threshold + 1) * len(entries))
        distance, first = np.divmod(best[tile, at], len(entries))
        found = entries.iloc[first]
        return pd.DataFrame({"id": tiles.id.to_numpy()[tile], "no": found.no.to_numpy(), "distance": distance, "sample_id": found.sample_id.to_numpy(), "vec_idx": found.vec_idx.to_numpy(), "category": found.category.to_numpy()}, columns=names)

    return run


def replay(walks: list[tuple[int, int, int]], numbers: list[int]) -> list[int]:
    """Places in numbers, which rise, in the order in which the walks (walk, lo, hi) come upon them; a walk ends at a key found before."""
    at, seen, found = np.asarray(numbers, np.int64), np.zeros(len(numbers), bool), []
    for walk, lo, hi in sorted(walks):
        here = np.arange(*np.searchsorted(at, [lo, hi]))
        here = here if walk % 2 else here[::-1]
        known = np.flatnonzero(seen[here])
        here = here[: known[0]] if len(known) else here
        seen[here] = True
        found += here.tolist()
    return found


def probed(queries: DataFrame, refs: DataFrame, interval: int, fanout: int, steps: int, threshold: int, block: int = BLOCK, met: int = MET) -> DataFrame:
    """(sample_id, vec_idx, g, walks, hits): per query tile its walks, and the nearest open entry of each key within the threshold in key order.

    Hits are of the blocks that a walk touches and may lie beyond it. A tile without a key or bits takes no part, and one without hits has no row. An entry is open unless its exclusion key is
    the query's; of equally near entries the smallest (sample_id, vec_idx) counts. A query may walk over any number of keys that are
    closed to it: they are counted, and blocks of nothing else are left out.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col("exclusion_key").cast("string")), F.lit("")).alias("g")
    taken = lambda d, *more: d.where("key IS NOT NULL AND bits IS NOT NULL").select(F.monotonically_increasing_id().alias("id"), "sample_id", F.col("vec_idx").cast("long").alias("vec_idx"), F.col("key").cast("long").alias("key"), group, "bits", *more)
    entries = scratch.written(taken(refs, F.coalesce(F.col("category").cast("string"), F.lit("None")).alias("category")), "entries")
    tiles = scratch.written(taken(queries), "tiles")
    asked = scratch.written(tiles.groupBy("key", "g").agg(F.count("*").alias("tiles")), "probes")
    seeds = [F.col("key") + F.lit(sign * i * interval) for sign in (-1, 1) for i in range(fanout)]
    known = scratch.written(entries.groupBy("key").agg(F.count("*").alias("entries"), F.min("g").alias("g"), F.max("g").alias("last")), "keys")
    both = known.select("key", F.lit(1).alias("known")).unionByName(asked.select(F.explode(F.array(*seeds)).alias("key"), F.lit(0).alias("known")))
    both = both.groupBy("key").agg(F.max("known").alias("known"))
    numbers = scratch.written(running(both, "key", {"upto": (F.col("known"), "sum")}), "numbers")
    index = scratch.written(known.join(numbers.where("known = 1"), "key").select("key", "entries", "g", "last", (F.col("upto") - 1).alias("no")), "index")
    total = index.count()
    # a part of a block tells its nearest entry of every key, so a block of many entries and keys would tell each key once per part
    held = index.agg(F.sum("entries")).first()[0] or 0
    block = max(1, min(block, met * total // max(held, 1)))
    closed = index.where("g = last AND g <> ''").select("g", F.col("no").alias("at")).join(asked.select("g").distinct(), "g", "left_semi")
    closed = scratch.written(closed, "closed")
    walks = scratch.written(_walks(asked.select("key", "g"), numbers, closed, total, interval, fanout, steps), "walks")
    # blocks of a walk, without those that are closed to the query from end to end
    blocks = walks.select("key", "g", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))).alias("block")).distinct()
    shut = closed.groupBy("g", F.expr(f"at div {block}").alias("block")).agg(F.count("*").alias("n"))
    shut = shut.where(F.col("n") == F.least(F.lit(block), F.lit(total) - F.col("block") * block)).drop("n")
    blocks = scratch.written(blocks.join(shut, ["g", "block"], "left_anti"), "blocks")
    cut = lambda n: F.ceil(F.sum(n) / met).cast("int")
    sizes = blocks.join(asked, ["key", "g"]).groupBy("block").agg(cut("tiles").alias("tile_parts"))
    sizes = sizes.join(index.groupBy(F.expr(f"no div {block}").alias("block")).agg(cut("entries").alias("entry_parts")), "block")
    sizes = scratch.written(sizes, "sizes")
    places = index.withColumn("block", F.expr(f"no div {block}")).select("key", "no", "block").join(sizes, "block")
    spread = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")
    copies = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    right = _dealt(entries, places, "key").select("block", spread("entry_parts").alias("entry_part"), copies("tile_parts").alias("tile_part"), "no", "sample_id", "vec_idx", "category", "g", "bits")
    per = walks.groupBy("key", "g").agg(F.collect_list(F.struct("walk", "lo", "hi")).alias("walks"))
    per = per.join(blocks.groupBy("key", "g").agg(F.collect_list("block").alias("blocks")), ["key", "g"])
    walking = scratch.written(_dealt(tiles, per, "key", "g"), "walking")
    left = _dealt(walking.select("id", "g", "bits", F.explode("blocks").alias("block")), sizes, "block")
    left = left.select("block", copies("entry_parts").alias("entry_part"), spread("tile_parts").alias("tile_part"), "id", "g", "bits")
    keys = ["block", "entry_part", "tile_part"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compare(threshold), "id long, no long, distance int, sample_id string, vec_idx long, category string")
    near = near.groupBy("id", "no").agg(F.min(F.struct("distance", "sample_id", "vec_idx", "category")).alias("e"))
    hits = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("no", "e.distance", "e.sample_id", "e.category"))).alias("hits"))
    return walking.select("id", "sample_id", "vec_idx", "g", "walks").join(hits, "id").drop("id")


def sish(queries: DataFrame, refs: DataFrame, k: int = 10, interval: int = 50 * 10**11, fanout: int = 10, steps: int = 375, threshold: int = 512) -> DataFrame:
    """hits(query_id, rank, sample_id, score) by key probing, for any number of reference tiles.

    Both sides: sample_id, exclusion_key, category, key, bits (array of booleans), a row per tile, and vec_idx. The tiles of one
    query bag are cleaned together, in one task. Empty sides give no rows.
    """
    rows = probed(queries, refs, interval, fanout, steps, threshold)
    label = F.coalesce(F.col("category").cast("string"), F.lit("None"))
    group = F.coalesce(F.concat(F.lit("="), F.col("exclusion_key").cast("string")), F.lit(""))
    counts = refs.where("key IS NOT NULL AND bits IS NOT NULL").groupBy(group.alias("g"), label.alias("category")).agg(F.count("*").alias("n"))
    counts = scratch.written(counts, "labels")
    every = {r.category: r.n for r in counts.groupBy("category").agg(F.sum("n").alias("n")).collect()}  # one row per label
    own = counts.where("g <> ''").groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("own"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_idx", kind="stable")
        less = dict(group.own.iloc[0]) if group.own.iloc[0] is not None else {}
        left = {x: n - less.get(x, 0) for x, n in every.items() if n > less.get(x, 0)}
        inverse = sum(1 / n for n in left.values())
        weights = {x: k / inverse / n for x, n in left.items()}
        bags = []
        for walks, hits in zip(group.walks, group.hits, strict=True):
            order = replay([(w["walk"], w["lo"], w["hi"]) for w in walks], [h["no"] for h in hits])
            bags.append(sorted(((hits[i]["distance"], hits[i]["sample_id"], hits[i]["category"]) for i in order), key=lambda x: x[0]))
        top = clean(bags, weights, k)
        return pd.DataFrame({"query_id": group.sample_id.iloc[0], "rank": range(1, len(top) + 1), "sample_id": [t[0] for t in top], "score": [t[1] for t in top]}, columns=["query_id", "rank", "sample_id", "score"])

    return rows.join(own, "g", "left").groupBy("sample_id").applyInPandas(run, HITS)
