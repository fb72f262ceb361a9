"""Helpers that the training-data operators share: scratch tables, row keys, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes an Arrow batch holds at most, so that a batch of long texts fits in a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, "16m"
#: A key of a lookup is salted if it has more than a SPREADth of the rows; so at most SPREAD keys are.
SPREAD = 256
#: Up to so many rows a lookup is a plain join, and up to so many edges one task finds the components: 16 bytes each.
FEW, FEW_EDGES = 20_000, 100_000
#: Files that a table is written as, for each core, and shuffle partitions that one file takes, where these make more files.
FILES_PER_CORE, PARTITIONS_PER_FILE = 4, 8
#: With this set, Spark removes a query's shuffle files when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Options of a write: in a local folder there is no checksum file beside each file, as its mode takes a process (chmod); other folders ignore them.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_KEPT: list[dict] = []


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows and the bytes of the Arrow batches that go to Python workers.

    Plans read the setting when they run, so the bound on bytes is the same for all operators: it holds whatever number of
    rows another one has set since.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one.

    Other sessions are refused: executors on other machines couldn't read a folder of the driver's.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-scratch-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files of the write go with it, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        few_files(df).write.options(**PLAIN).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    read = spark.read.schema(df.schema).parquet(path)
    read._scratch = path
    return read


def few_files(df: DataFrame) -> DataFrame:
    """df with fewer partitions, joined without a shuffle, if it has far more than the cores need.

    Without Hadoop's native code an executor starts some three processes (chmod) for each file that it writes to a local or mounted
    folder, two with PLAIN, and until such a process has begun, the executor's memory counts twice.
    """
    spark = df.sparkSession
    return df.coalesce(max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, shuffle_partitions(spark) // PARTITIONS_PER_FILE))


def discard(df: DataFrame) -> None:
    """Delete the table of a materialized frame that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lookup(left: DataFrame, right: DataFrame, on: str | list[str], rows: int, how: str = "inner", by: list[str] | None = None, counts: DataFrame | None = None, few: int = FEW, pick: Column | None = None) -> DataFrame:
    """left joined (inner or left) with right, which has one row for each key; no key's rows go to one task.

    Rows of a null key, and of a key that has more than a SPREADth of all rows, are dealt out by a hash of the columns in by
    (default: all of left but the key), and the key's row of right goes to each of their places. rows: how many rows left has (up to few: a plain join); as a key is dealt out
    only above that share, the keys that are broadcast are SPREAD at most. counts: the keys with column times, if known. pick: where right
    may have several rows for a key, the one with the smallest pick counts; they are picked where they are joined, with no shuffle
    of their own.
    """
    on = [on] if isinstance(on, str) else on

    def single(side: DataFrame, keys: list[str]) -> DataFrame:
        if pick is None:
            return side
        rest = [c for c in side.columns if c not in keys]
        return side.groupBy(*keys).agg(F.min_by(F.struct(*rest), pick).alias("picked")).select(*keys, "picked.*")

    if rows <= few:
        return left.join(single(right, on), on, how)
    most = -(-rows // SPREAD)
    counts = left.groupBy(*on).agg(F.count("*").alias("times")) if counts is None else counts.select(*on, "times")
    parts, salt = unused(left, "parts"), unused(left, "salt")
    hot = F.broadcast(counts.where(F.col("times") > most).select(*on, F.ceil(F.col("times") / F.lit(most)).cast("int").alias(parts)))
    chance = F.xxhash64(*(by or [c for c in left.columns if c not in on]))
    none = F.greatest(*(F.col(c).isNull() for c in on)) if len(on) > 1 else F.col(on[0]).isNull()  # these match nothing, but must go somewhere
    own = F.pmod(chance, F.when(none, SPREAD).otherwise(F.coalesce(F.col(parts), F.lit(1)))).cast("int")
    dealt = left.join(hot, on, "left").withColumn(salt, own).drop(parts)
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))
    copied = right.join(hot, on, "left").withColumn(salt, every).drop(parts)
    return dealt.join(single(copied, [*on, salt]), [*on, salt], how).drop(salt)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the caller's extra columns are called (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*columns: str) -> tuple[Column, Column]:
    """128 bits from the values of a row; rows of equal values share them. Nulls are told from empty strings."""
    parts = [p for c in columns for p in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph by local contraction.

    edges: long columns a, b. Returns (node, root): one row for each node that has an edge, root being the smallest node it
    reaches. In each round every node hooks to the one of itself and its neighbours that a hash of the round puts first, and
    edges are mapped to the hooks. Hashes differ from round to round, so a path of n links is done in about log2(n) rounds
    and a group of any shape in fewer. Once FEW_EDGES are left, one task joins their ends. The hooks of all rounds are then
    followed from the last to the first. All state stays in tables in the shared folder, none on the driver. Null ends and self
    loops are ignored.
    """
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(ordered(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")), "edges")
    hooks: list[DataFrame] = []
    while (n := edges.count()) > FEW_EDGES:
        sides = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = lambda c: F.struct(F.xxhash64(F.lit(len(hooks)), c).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        first = sides.groupBy("a").agg(F.min(place("b")).alias("low"))
        hooks.append(materialize(first.select(F.col("a").alias("at"), F.least("low", place("a"))["node"].alias("to")), "hooks"))
        mapped = edges
        for end, other in (("a", "b"), ("b", "a")):
            mapped = lookup(mapped, hooks[-1].withColumnRenamed("at", end), end, n).select(F.col("to").alias(end), other)
        last, edges = edges, materialize(ordered(mapped), "edges")
        discard(last)
    roots = materialize(edges.repartition(1).mapInArrow(_joined, "node long, root long"), "labels")
    discard(edges)
    if not hooks:
        return roots
    for hook in reversed(hooks):
        found = hook.select(F.col("at").alias("node"), F.col("to").alias("root"))
        further = roots.select(F.col("node").alias("root"), F.col("root").alias("end"))
        found = lookup(found, further, "root", hook.count(), "left").select("node", F.coalesce("end", "root").alias("root"))
        last, roots = roots, materialize(found, "labels")
        discard(hook)
        discard(last)
    # a component's own root hooks to itself in its last round, and the least node of the group takes its place
    least = roots.groupBy("root").agg(F.min("node").alias("least"), F.count("*").alias("times"))
    return lookup(roots, least.drop("times"), "root", roots.count(), counts=least).select("node", F.col("least").alias("root"))


def reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of the rows 0 to n - 1 that each of them reaches over the pairs i, j."""
    low = np.arange(n)
    while len(i):
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, low[i], least)
        np.minimum.at(low, low[j], least)
        while not np.array_equal(low, up := low[low]):
            low = up
        open_ = low[i] != low[j]
        i, j = i[open_], j[open_]
    return low


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the edges (a, b) of one task, FEW_EDGES at most."""
    sides = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if sides:
        a, b = (np.concatenate(x) for x in zip(*sides, strict=True))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[reached(len(nodes), at[: len(a)], at[len(a) :])])], names=["node", "root"])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@contextmanager
def uncollected() -> Iterator[None]:
    """The cyclic collector waits meanwhile: very many small lists, none in a cycle, would start it again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def kept(cache: dict) -> dict:
    """cache, which a worker process keeps from task to task until room() empties it."""
    _KEPT.append(cache)
    return cache


def room() -> None:
    """Empty what this worker process has kept, and give its free memory back to the system.

    Spark hands a worker from task to task, so one that has tokenized would hold its tokenizer and what that remembers
    beside whatever runs next.
    """
    for cache in _KEPT:
        cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def roomy(run: Callable) -> Callable:
    """The function of a mapInArrow, with room() before and after each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room()
        try:
            yield from run(batches)
        finally:
            room()

    return task


class Memory:
    """A bounded map in two generations: what was used since the last turn survives the next one."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        value = self.old.get(key)
        if value is not None:
            self.new[key] = value
        return value

    def turn(self) -> None:
        if len(self.new) > self.size:
            self.new, self.old = {}, self.new
