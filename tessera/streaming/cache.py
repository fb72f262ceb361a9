"""Structured Streaming: filling a representation cache and counting arriving hits.

The reference engine has no streams; these are additions for slides and hits that keep arriving.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.store import Store


def fill_cache(arriving: DataFrame, store: Store, table: str, on: list[str], make: Callable[[DataFrame], DataFrame], checkpoint: str, **equal: str):
    """Start a query that makes and appends the rows of keys that the table lacks; batches that come again add nothing."""

    def each(batch: DataFrame, _: int) -> None:
        keys = batch.select(*on).distinct()
        _, missing = store.split(table, keys, on, **equal)
        if not missing.isEmpty():
            store.write(table, make(missing), append=True)

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hit_rates(hits: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, label, hits, relevant) per window of event time; hits later than the watermark are left out."""
    relevant = (F.col("hit_label") == F.col("query_label")).cast("int")
    return hits.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "query_label").agg(F.count("*").alias("hits"), F.sum(relevant).alias("relevant")).select(F.col("w.start").alias("start"), F.col("query_label").alias("label"), "hits", "relevant")
