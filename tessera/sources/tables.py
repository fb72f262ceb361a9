"""Sources and sinks: annotation CSV, slide files, array files, polygons, status files."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Read as text whatever they look like; a numeric slide id keeps its zeros.
TEXT = ("slide", "slide_id", "case", "patient", "dataset", "category", "wsi_path")
NUMBERS = ("fallback_mpp", "time", "survival_time", "os_time")
RING = "array<array<array<array<double>>>>"


def read_annotations(spark: SparkSession, path: str, delimiter: str | None = ",") -> DataFrame:
    """A CSV with a header; ids are text, known number columns double, all else text. delimiter None: from the first line."""
    if delimiter is None:
        first = spark.read.text(path).first()
        delimiter = csv.Sniffer().sniff(first.value, ",;\t|").delimiter if first and any(c in first.value for c in ",;\t|") else ","
    rows = spark.read.csv(path, header=True, sep=delimiter, inferSchema=False)
    return rows.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in rows.columns if c in NUMBERS})


def write_annotations(annotations: DataFrame, path: str) -> None:
    annotations.write.mode("overwrite").csv(path, header=True)


def slide_files(spark: SparkSession, folder: str, suffixes: Sequence[str] = ("svs", "tif", "tiff", "ndpi", "mrxs", "dcm")) -> DataFrame:
    """(path) of the slide files below a folder; only names are read."""
    pattern = "*.{" + ",".join(suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path")


def first_by_name(files: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """(slide, path): of the files of a slide with a registered suffix the first by name."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return files.where(suffix.isin(*suffixes)).groupBy(F.regexp_replace(name, r"\.[^.]*$", "").alias("slide")).agg(F.min("path").alias("path"))


def read_arrays(spark: SparkSession, folder: str, ndim: int = 2) -> DataFrame:
    """(path, row_idx, vec) of .npy and .npz files, one row per matrix row; an .npz must hold one array."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{npy,npz}").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                if path.endswith(".npz"):
                    if len(array.files) != 1:
                        raise ValueError(f"{path} holds {len(array.files)} arrays")
                    array = array[array.files[0]]
                if array.ndim != ndim:
                    raise ValueError(f"{path} has {array.ndim} dimensions, not {ndim}")
                array = array.reshape(len(array), -1).astype(np.float32)
                for low in range(0, len(array), 4096):
                    part = array[low : low + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(low, low + len(part), dtype=np.int32)), pa.array(list(part), pa.list_(pa.float32()))], names=["path", "row_idx", "vec"])

    return files.mapInArrow(run, "path string, row_idx int, vec array<float>")


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(path, polygon) of GeoJSON feature collections: a list of rings each; a geometry of another kind raises."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    kind = "features array<struct<geometry: struct<type: string, coordinates: string>>>"
    features = text.select("path", F.explode(F.from_json("value", kind)["features"]).alias("f")).select("path", "f.geometry.type", "f.geometry.coordinates")
    single, many = F.from_json("coordinates", "array<array<array<double>>>"), F.from_json("coordinates", RING)
    shapes = F.when(F.col("type") == "Polygon", F.array(single)).when(F.col("type") == "MultiPolygon", many).otherwise(F.raise_error(F.concat(F.lit("no polygon: "), "type")).cast(RING))
    return features.select("path", F.explode(shapes).alias("polygon"))


def polygons_json(polygons: DataFrame, by: str = "slide") -> DataFrame:
    """(by, tissue): all polygons of a slide as one JSON text."""
    return polygons.groupBy(by).agg(F.to_json(F.collect_list("polygon")).alias("tissue"))


def polygons_from_json(tissue: DataFrame, by: str = "slide") -> DataFrame:
    return tissue.select(by, F.explode(F.from_json("tissue", RING)).alias("polygon"))


def read_status(spark: SparkSession, folder: str) -> DataFrame:
    """One row per job from a folder of JSON status files, with its file name."""
    schema = "work_id string, stage string, state string, started_at string, finished_at string, hostname string, error string, result string"
    return spark.read.schema(schema).json(folder, multiLine=True).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def write_status_table(status: DataFrame, path: str) -> None:
    """One CSV ordered by file name; status files are as many as jobs."""
    status.orderBy("file").coalesce(1).write.mode("overwrite").csv(path, header=True)
