"""Recorded responses as a Spark data source: batches of requests, paging, redirects, failures as rows. No network.

A folder holds one folder for each batch (batch=<n>), with JSON lines: url, ord (null: not asked for itself), status, type, location,
next, error, body. A batch is one partition: its requests are answered in order, each from what was recorded; a redirect is followed
inside the batch, a next page as well. Each request and page gives a row, an answer or a failure:

batch int, ord int, page int, url string, final_url string, status int, type string, body string, failure string
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "batch int, ord int, page int, url string, final_url string, status int, type string, body string, failure string"


class _Batch(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


def _files(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.types = tuple(t for t in options.get("types", "text/html,application/json").split(",") if t)
        self.most_bytes = int(options.get("mostbytes", options.get("mostBytes", 4_000_000)))
        self.hops, self.pages = int(options.get("hops", 5)), int(options.get("pages", 10))
        self.hosts = tuple(h for h in options.get("hosts", "").split(",") if h)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = _files(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=False))
        return [_Batch(int(f.base_name.split("=")[1]), f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.startswith("batch=")]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        from pyarrow import fs

        files, _ = _files(self.path)
        answers, asked = {}, []
        for file in files.get_file_info(fs.FileSelector(partition.path, recursive=False)):
            if file.is_file and not file.base_name.startswith(("_", ".")):
                with files.open_input_stream(file.path) as lines:
                    for line in lines.read().splitlines():
                        answer = json.loads(line)
                        answers.setdefault(answer["url"], answer)
                        if answer.get("ord") is not None:
                            asked.append((answer["ord"], answer["url"]))
        for order, url in sorted(asked):
            page, at = 1, url
            while at is not None and page <= self.pages:
                row, at = self._answer(answers, at)
                yield (partition.number, order, page, url, *row)
                page += 1

    def _answer(self, answers: dict, url: str) -> tuple[tuple, str | None]:
        """The row of a request, and the address of the next page."""
        at, hops = url, 0
        while True:
            found = answers.get(at)
            if found is None:
                return (at, None, None, None, "not recorded"), None
            status, kind, body = found.get("status"), found.get("type"), found.get("body") or ""
            if found.get("error"):
                return (at, status, kind, None, found["error"]), None
            if status is not None and 300 <= status < 400:
                hops += 1
                if hops > self.hops:
                    return (at, status, kind, None, "too many redirects"), None
                at = urljoin(at, found.get("location") or "")
                if urlsplit(at).scheme not in ("http", "https") or not self._allowed(url, at):
                    return (at, status, kind, None, "redirect to another site"), None
                continue
            if status is None or status >= 400:
                return (at, status, kind, None, f"HTTP {status}"), None
            if not (kind or "").startswith(self.types):
                return (at, status, kind, None, f"type {kind}"), None
            if len(body.encode()) > self.most_bytes:
                return (at, status, kind, None, "too large"), None
            following = found.get("next")
            return (at, status, kind, body, None), urljoin(at, following) if following else None

    def _allowed(self, asked: str, reached: str) -> bool:
        """The same host, or one of the hosts that redirects may lead to."""
        host = (urlsplit(reached).hostname or "").removeprefix("www.")
        return host == (urlsplit(asked).hostname or "").removeprefix("www.") or any(host == h or host.endswith("." + h) for h in self.hosts)


class RecordedSource(DataSource):
    """Format "recorded"; options: path, types, mostBytes, hops, pages, hosts (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_recorded(spark: SparkSession, path: str, **options: str):
    """The rows of a folder of recorded responses."""
    spark.dataSource.register(RecordedSource)
    return spark.read.format("recorded").option("path", path).options(**options).load()
