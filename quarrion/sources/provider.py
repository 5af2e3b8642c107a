"""Captured candidates as a data source of its own: one line of JSON a candidate, a folder per provider."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "key string, source string, name string, address string, city string, state string, zip string, phone string, website string"


class CandidateSource(DataSource):
    """``spark.read.format("candidates").option("source", name).load(folder)``. A provider must not raise: lines and files that cannot be read are left out."""

    @classmethod
    def name(cls) -> str:
        return "candidates"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.source = options["path"], options.get("source", "captured")

    def partitions(self) -> list[_File]:
        """A partition a file, so that a folder of many files is read by many tasks."""
        import os

        try:
            return [_File(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder))] or [_File("")]
        except OSError:
            return [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        import json

        names = [c.split()[0] for c in SCHEMA.split(", ")[2:]]
        try:
            with open(partition.path, encoding="utf-8") as f:
                for n, line in enumerate(f):
                    try:
                        row = json.loads(line)
                        yield (f"{self.source}:{row.get('id', n)}", self.source, *(None if row.get(c) is None else str(row[c]) for c in names))
                    except (ValueError, AttributeError):
                        continue
        except (OSError, UnicodeDecodeError):
            return


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CandidateSource)
