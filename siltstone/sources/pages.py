"""Services that answer in pages as a data source: batches with a partition a page, streams whose offset is the page token.

    spark.dataSource.register(PagedSource)
    spark.read.format("pages").option("service", "package.module:Service").option("schema", "id long, name string").load()

Service(options) is made where pages are read, from all options as texts. It has fetch(token) -> (rows as dicts, the token
after them; None where nothing more is to be had now); the first token is "". A service that can list its pages also has
tokens() -> the tokens from "" on, the last of them that after the newest page: then batches and micro-batches read a
partition for each page. Otherwise one task follows the tokens of a batch, and a stream's driver fetches a page a micro-batch.
"""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Iterator
from typing import Protocol

from pyspark.errors import PySparkNotImplementedError
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class Service(Protocol):
    def fetch(self, token: str) -> tuple[list[dict], str | None]: ...


class FolderLog:
    """A folder of JSON lines as a log: each file is a page, in the order of names; a token is the last file read. For
    folders that all executors mount (option `path`)."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")

    def _files(self) -> list[str]:
        return sorted(x for x in os.listdir(self.path) if x.endswith(".json"))

    def tokens(self) -> list[str]:
        return ["", *self._files()]

    def fetch(self, token: str) -> tuple[list[dict], str | None]:
        name = next((x for x in self._files() if x > token), None)
        if name is None:
            return [], None
        with open(os.path.join(self.path, name), encoding="utf-8") as f:
            return [json.loads(line) for line in f if line.strip()], name


def _service(options) -> Service:
    module, _, name = options["service"].partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


def _tuples(rows: list[dict], schema: StructType) -> Iterator[tuple]:
    return (tuple(r.get(c) for c in schema.names) for r in rows)


class _From(InputPartition):
    def __init__(self, token: str, follow: bool):
        self.token, self.follow = token, follow


class PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema, self.options = schema, dict(options)

    def partitions(self) -> list[_From]:
        tokens = getattr(_service(self.options), "tokens", None)
        return [_From(t, False) for t in tokens()[:-1]] if tokens else [_From("", True)]

    def read(self, partition: _From | None) -> Iterator[tuple]:
        if partition is None:  # Spark asks so where there are no partitions
            return
        service, token = _service(self.options), partition.token
        while token is not None:
            rows, token = service.fetch(token)
            yield from _tuples(rows, self.schema)
            if not partition.follow:
                return


class ListedPageStreamReader(PageReader, DataSourceStreamReader):
    """Pages between two tokens, each read by a task of its own; a micro-batch that runs again reads the same ones."""

    def initialOffset(self) -> dict:
        return {"token": ""}

    def latestOffset(self) -> dict:
        return {"token": _service(self.options).tokens()[-1]}

    def partitions(self, start: dict, end: dict) -> list[_From]:
        tokens = _service(self.options).tokens()
        return [_From(t, False) for t in tokens[tokens.index(start["token"]) : tokens.index(end["token"])]]

    def commit(self, end: dict) -> None:
        pass


class PageStreamReader(SimpleDataSourceStreamReader):
    """One page a call; a page that was read before is read again by its token, so a restarted stream gets the same rows."""

    def __init__(self, schema: StructType, options):
        self.schema, self.service = schema, _service(options)

    def initialOffset(self) -> dict:
        return {"token": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, token = self.service.fetch(start["token"])
        return _tuples(rows, self.schema), {"token": start["token"] if token is None else token}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        token = start["token"]
        while token != end["token"]:
            rows, token = self.service.fetch(token)
            if token is None:
                raise ValueError(f"the page after {start['token']!r} is gone")
            yield from _tuples(rows, self.schema)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, self.options)

    def streamReader(self, schema: StructType) -> ListedPageStreamReader:
        if not hasattr(_service(self.options), "tokens"):
            raise PySparkNotImplementedError(errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "streamReader"})
        return ListedPageStreamReader(schema, self.options)

    def simpleStreamReader(self, schema: StructType) -> PageStreamReader:
        return PageStreamReader(schema, self.options)
