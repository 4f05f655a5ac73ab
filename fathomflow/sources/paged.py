"""A data source over paged services: ``spark.read.format("paged")``.

A service has collections (codes, categories) and gives each in pages, newest first. The driver plans partitions of PAGES pages of a collection, so they are
fetched in parallel and no collection is held by one task; a filter on the collection prunes partitions, and one on the time ends the paging as soon as a page is past it. A page that
fails is asked for again, with longer pauses, and fails the task after the last try; Spark then runs the partition anew.

Clients are pluggable by the name of a class (``module:Class``); ``FolderClient`` serves JSON lines in folders by collection from any file system that Arrow
opens, and stands for services that this library has no network for. Options: client, location, schema (DDL with ``collection string`` and ``at
timestamp``), pages, tries, pause."""

from __future__ import annotations

import datetime
import importlib
import json
import time
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition

PAGE_ROWS, PAGES, TRIES, PAUSE = 200, 64, 4, 0.05


class Client(Protocol):
    """A service: its collections with their numbers of pages, and a page of one (rows as dicts, newest first)."""

    def collections(self) -> dict[str, int]: ...
    def page(self, collection: str, number: int) -> list[dict]: ...


class FolderClient:
    """JSON lines in folders named collection=<name>, a file a page, in the order of their names."""

    def __init__(self, location: str):
        self.system, self.root = fs.FileSystem.from_uri(location)
        self.files: dict[str, list[str]] = {}

    def _pages(self, collection: str) -> list[str]:
        if collection not in self.files:
            found = self.system.get_file_info(fs.FileSelector(f"{self.root}/collection={collection}"))
            self.files[collection] = sorted(f.path for f in found if f.base_name.endswith(".json"))
        return self.files[collection]

    def collections(self) -> dict[str, int]:
        found = self.system.get_file_info(fs.FileSelector(self.root))
        return {n: len(self._pages(n)) for n in sorted(i.base_name.partition("=")[2] for i in found if i.base_name.startswith("collection="))}

    def page(self, collection: str, number: int) -> list[dict]:
        with self.system.open_input_stream(self._pages(collection)[number]) as file:
            return [json.loads(line) for line in file.read().decode().split("\n") if line]


@dataclass
class Pages(InputPartition):
    collection: str
    first: int
    end: int


def _client(options: Mapping[str, str]) -> Client:
    module, _, name = options.get("client", f"{__name__}:FolderClient").partition(":")
    return getattr(importlib.import_module(module), name)(options["location"])


class PagedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]):
        self.schema, self.options = schema, dict(options)
        self.names: set[str] | None = None
        self.since: datetime.datetime | None = None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("collection",):
                names = set(f.value) if isinstance(f, In) else {f.value}
                self.names = names if self.names is None else self.names & names
                continue
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("at",):
                since = f.value.replace(tzinfo=None) if f.value.tzinfo is None else f.value.astimezone(datetime.UTC).replace(tzinfo=None)
                self.since = since if self.since is None else max(self.since, since)
            yield f  # Spark looks at each row again: pages hold older rows, too

    def partitions(self) -> list[Pages]:
        known, pages = _client(self.options).collections(), int(self.options.get("pages", PAGES))
        return [Pages(c, i, min(i + pages, n)) for c, n in known.items() if self.names is None or c in self.names for i in range(0, n, pages)]

    def _page(self, client: Client, collection: str, number: int) -> list[dict]:
        tries = int(self.options.get("tries", TRIES))
        for n in range(tries):
            try:
                return client.page(collection, number)
            except OSError:
                if n == tries - 1:
                    raise
                time.sleep(float(self.options.get("pause", PAUSE)) * 2**n)
        raise AssertionError

    def read(self, partition: Pages) -> Iterator[tuple]:
        client, fields = _client(self.options), [f.name for f in self.schema.fields]
        for number in range(partition.first, partition.end):
            at = None
            for row in self._page(client, partition.collection, number):
                at = datetime.datetime.fromisoformat(row["at"]).astimezone(datetime.UTC)
                yield tuple(partition.collection if f == "collection" else at if f == "at" else row.get(f) for f in fields)
            if self.since is not None and at is not None and at.replace(tzinfo=None) < self.since:
                return


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(schema, self.options)


def read_paged(spark: SparkSession, location: str, schema: str, **options: str) -> DataFrame:
    """The rows of a paged service; filters go down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").options(location=location, schema=schema, **options).load()


def serve(rows: DataFrame, location: str, page_rows: int = PAGE_ROWS) -> None:
    """Rows (collection, at and further columns) as the pages that ``FolderClient`` serves: ranges of each collection, newest first."""
    newest = ["collection", F.desc("at")]
    ordered = rows.repartitionByRange(*newest).sortWithinPartitions(*newest)
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "maxRecordsPerFile": page_rows}
    ordered.write.options(**options).partitionBy("collection").json(location)
