"""A paged remote API as a Spark data source. The transport is injected by name, so nothing here opens a connection.

    spark.dataSource.register(RemotePages)
    spark.read.format("remote_pages").option("transport", "package.module:function").option("target", ...).load()

transport(target, page, per_page) returns a list of JSON texts; pages are read by tasks, a page each, until the cap.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PER_PAGE = 100


class _Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Page]:
        cap = int(self.options.get("cap", 30))
        if cap < 1:
            raise ValueError("cap must be 1 at least")
        return [_Page(k) for k in range(1, -(-cap // PER_PAGE) + 1)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        module, _, name = self.options["transport"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        cap = int(self.options.get("cap", 30))
        room = cap - (partition.number - 1) * PER_PAGE
        found = fetch(self.options.get("target", ""), partition.number, PER_PAGE)
        for place, text in enumerate(found[:room]):
            yield partition.number, place, text, None
        if len(found) > room or len(found) == PER_PAGE and room == PER_PAGE and partition.number * PER_PAGE == cap:
            yield partition.number, None, None, f"cap of {cap} reached: what follows was not fetched"


class RemotePages(DataSource):
    """(page, place, value, miss): a row for each item; where a cap cuts off, a row that says so instead of an item."""

    @classmethod
    def name(cls) -> str:
        return "remote_pages"

    def schema(self) -> str:
        return "page int, place int, value string, miss string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
