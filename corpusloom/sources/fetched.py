"""A data source over any fetcher: comments, feeds or pages that a function brings by key."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class FetchedSource(DataSource):
    """``spark.read.format("fetched")`` with options fetcher ("module:function", key -> texts) and keys (comma-joined): one partition
    a key, rows (key, value)."""

    @classmethod
    def name(cls) -> str:
        return "fetched"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return FetchedReader(self.options["fetcher"], [k for k in self.options["keys"].split(",") if k])


class FetchedReader(DataSourceReader):
    def __init__(self, fetcher: str, keys: list[str]) -> None:
        self.fetcher, self.keys = fetcher, keys

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in self.keys]

    def read(self, partition: InputPartition):
        module, _, name = self.fetcher.partition(":")
        for text in getattr(import_module(module), name)(partition.value):
            yield partition.value, text
