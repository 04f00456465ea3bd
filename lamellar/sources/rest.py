"""A paged REST source on the Python Data Source API: one partition for each page, fetched by the executors.

options: fetch (registered name), size (page size), max_results. The transport is injected, so tests need no network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_PAGE, TRIES, DELAY = 10_000, 3, 1.0


def retried(call: Callable[[], dict], tries: int = TRIES, delay: float = DELAY) -> dict:
    """Three tries, waiting longer after each; then RuntimeError."""
    for i in range(1, tries + 1):
        try:
            return call()
        except Exception as e:  # noqa: BLE001  any transport's error
            if i == tries:
                raise RuntimeError(f"no answer after {tries} tries: {e}") from e
            time.sleep(delay * i)
    raise AssertionError


def pages(total: int, size: int, most: int | None) -> list[tuple[int, int]]:
    """(from, size) of all pages; the step is the size the service grants, and the last page is cut to `most`."""
    size, total = min(size, MAX_PAGE), min(total, most) if most else total
    return [(at, min(size, total - at)) for at in range(0, total, size)]


def rest_source(name: str, fetch: Callable[[dict], dict], ddl: str, filters: dict | None = None, fields: list[str] | None = None, delay: float = DELAY) -> type[DataSource]:
    """A data source class. fetch(params) answers {"hits": [dict], "total": int}; params: from, size, filters, fields."""

    class Page(InputPartition):
        def __init__(self, at: int, size: int):
            self.at, self.size = at, size

    class Reader(DataSourceReader):
        def __init__(self, schema, options):
            self.schema, self.size, self.most = schema, int(options.get("size", 100)), int(options.get("max_results", 0)) or None

        def ask(self, at: int, size: int) -> dict:
            params = {"from": at, "size": size, "filters": json.dumps(filters or {}), "fields": ",".join(fields or [f.name for f in self.schema])}
            return retried(lambda: fetch(params), delay=delay)

        def partitions(self):
            return [Page(at, n) for at, n in pages(self.ask(0, 0)["total"], self.size, self.most)] or [Page(0, 0)]

        def read(self, partition):
            for hit in self.ask(partition.at, partition.size)["hits"][: partition.size] if partition.size else []:
                yield tuple(hit.get(f.name) for f in self.schema)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return ddl

        def reader(self, schema):
            return Reader(schema, self.options)

    return Source


def read_rest(spark: SparkSession, source: type[DataSource], size: int = 100, max_results: int | None = None):
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("size", size)
    return (reader.option("max_results", max_results) if max_results else reader).load()
