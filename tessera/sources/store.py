"""Artifact tables as partitioned Parquet: tiles, features, descriptors, heatmaps, representations, specs, thumbnails.

Writing replaces the partitions that the rows touch and no others. Reading prunes by the partition columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partition columns and row identity of each table.
TABLES = {
    "tiles": (("tiling_id",), ("slide", "tile_idx")),
    "features": (("tiling_id", "extractor"), ("slide", "tile_idx")),
    "descriptors": (("tiling_id", "name"), ("slide", "tile_idx")),
    "heatmaps": (("bag_id", "name"), ("slide", "x", "y")),
    "representations": (("representation_id",), ("tiling_id", "entry_id", "vec_idx")),
    "tiling_specs": (("tiling_id",), ("slide",)),
    "tissue": ((), ("slide",)),
    "thumbnails": ((), ("slide",)),
}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        if table not in TABLES:
            raise KeyError(f"no table {table}")
        return f"{self.root}/{table}"

    def write(self, table: str, rows: DataFrame, append: bool = False) -> None:
        parts, identity = TABLES[table]
        if missing := {*parts, *identity} - set(rows.columns):
            raise ValueError(f"{table} needs {sorted(missing)}")
        writer = rows.write.mode("append" if append else "overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*parts) if parts else writer).parquet(self.path(table))

    def read(self, table: str, **equal: str) -> DataFrame:
        rows = self.spark.read.parquet(self.path(table))
        for column, value in equal.items():
            rows = rows.where(F.col(column) == value)
        return rows

    def exists(self, table: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def split(self, table: str, keys: DataFrame, on: list[str], **equal: str) -> tuple[DataFrame, DataFrame]:
        """(cached rows, keys without any): a cache lookup by key."""
        if not self.exists(table):
            return keys.limit(0), keys
        cached = self.read(table, **equal)
        return cached.join(keys.select(*on).distinct(), on, "left_semi"), keys.join(cached.select(*on).distinct(), on, "left_anti")

    def get_or_create(self, table: str, keys: DataFrame, on: list[str], make, **equal: str) -> DataFrame:
        """Rows of the keys; make(missing keys) gives those that the table lacks, which are appended first."""
        _, missing = self.split(table, keys, on, **equal)
        if not missing.isEmpty():
            self.write(table, make(missing), append=True)
        return self.split(table, keys, on, **equal)[0]

    def complete(self, table: str, expected: DataFrame, **equal: str) -> DataFrame:
        """(slide, complete): whether a slide has as many rows as expected(slide, rows)."""
        have = self.read(table, **equal).groupBy("slide").agg(F.count("*").alias("have"))
        return expected.join(have, "slide", "left").select("slide", (F.coalesce("have", F.lit(0)) == F.col("rows")).alias("complete"))


def pad_shapes(tiles: DataFrame, side: str = "tile_px", downsample: str = "downsample") -> DataFrame:
    """Tile rows with read_w and read_h, in the order of numeric tile ids, and the square polygon of each."""
    size = F.round(F.col(side) * F.col(downsample)).cast("int")
    corner = lambda dx, dy: F.array((F.col("x0") + dx * size).cast("double"), (F.col("y0") + dy * size).cast("double"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    number = F.expr("try_cast(tile_id AS int)")
    return tiles.withColumns({"read_w": size, "read_h": size, "polygon": ring, "tile_no": number})
