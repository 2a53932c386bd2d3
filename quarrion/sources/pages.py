"""A batch data source over a table of pages, standing for a fetcher: spark.read.format("pages").

It shows the interface that a source with a network behind it would have; here pages come from files of JSON lines in a folder
that the driver and the executors see under the same path. files.stored_pages reads such files from any store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_File(str(p)) for p in sorted(Path(self.folder).glob("*.jsonl"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as lines:
            for line in lines:
                row = json.loads(line)
                yield row.get("url"), row.get("status"), row.get("html")


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, status int, html string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
