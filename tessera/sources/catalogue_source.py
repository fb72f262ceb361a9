"""A Python data source for a local catalogue: a folder of metadata tables (CSV) read as one table, a file per partition.

    spark.dataSource.register(CatalogueSource)
    spark.read.format("tessera_catalogue").option("path", folder).schema(...).load()
"""

from __future__ import annotations

import csv
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class CatalogueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_catalogue"

    def schema(self) -> str:
        return "file_name string, case_id string, label string"

    def reader(self, schema) -> CatalogueReader:
        return CatalogueReader(schema, self.options)


class CatalogueReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns, self.path = [f.name for f in schema.fields], options["path"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith((".csv", ".tsv"))]

    def read(self, partition: InputPartition):
        with open(partition.value, newline="") as rows:
            for row in csv.DictReader(rows, delimiter="\t" if partition.value.endswith(".tsv") else ","):
                yield tuple(row.get(c) or None for c in self.columns)
