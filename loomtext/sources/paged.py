"""A Spark data source over paged JSON: an API that answers page by page, or a folder of its pages.

``spark.dataSource.register(PagedSource)`` makes the format ``paged`` known. Options:

* ``path``: where to read; several, one on each line, are tried in their order until one
  answers. A path with ``{page}`` is a template of pages 1, 2, ...; another one is a page file or a folder of them.
* ``fields``: the columns as DDL; a field that a record lacks is null, one that isn't of the column's
  kind is its JSON text (string columns) or an error.
* ``rows``: the field of the page that holds the records; without it a page is the array itself.
* ``pages``: the field of the first page that says how many pages there are (templates only).
* ``tries``: attempts for each page of an HTTP source. Answers 429 and 5xx are asked again after the
  seconds in Retry-After, else after 1, 2, 4 ... seconds, at most ``longest``.

Each page is a partition: it is fetched where it is used, so a lost executor's pages are fetched again.
Local and mounted folders are read through pyarrow, which also knows hdfs and object stores.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegralType, StringType, StructType


@dataclass
class Page(InputPartition):
    where: str

    def __init__(self, where: str) -> None:
        super().__init__(where)
        self.where = where


def waits(tries: int, longest: float) -> Iterator[float]:
    """Seconds between attempts, doubled up to a limit."""
    for k in range(tries - 1):
        yield min(2.0**k, longest)


def fetch(where: str, tries: int = 5, longest: float = 10.0, sleep=time.sleep) -> bytes:
    """The bytes of a page."""
    if not where.startswith(("http://", "https://")):
        store, path = fs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (fs.LocalFileSystem(), where)
        with store.open_input_stream(path) as f:
            return f.read()
    pauses = waits(tries, longest)
    while True:
        try:
            with urllib.request.urlopen(where, timeout=60) as answer:
                return answer.read()
        except urllib.error.HTTPError as error:
            pause = next(pauses, None)
            if pause is None or (error.code != 429 and error.code < 500):
                raise
            asked = error.headers.get("Retry-After", "")
            sleep(float(asked) if asked.isdigit() else pause)
        except urllib.error.URLError:
            if (pause := next(pauses, None)) is None:
                raise
            sleep(pause)


def _files(where: str) -> list[str]:
    """The page files of a folder, hidden ones left out, or the file itself."""
    scheme = where[: where.index("://") + 3] if "://" in where else "file://" if where.startswith("file:") else ""
    store, path = fs.FileSystem.from_uri(where) if scheme else (fs.LocalFileSystem(), where)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(where)
    if info.type == fs.FileType.File:
        return [where]
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(scheme + f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["fields"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.options = schema, options
        self.tries, self.longest = int(options.get("tries", "5")), float(options.get("longest", "10"))

    def _page(self, where: str):
        return json.loads(fetch(where, self.tries, self.longest))

    def _partitions_of(self, where: str) -> list[Page]:
        if "{page}" not in where:
            if not where.startswith(("http://", "https://")):
                return [Page(f) for f in _files(where)]
            self._page(where)  # does it answer?
            return [Page(where)]
        first = self._page(where.replace("{page}", "1"))
        n = int(first[self.options["pages"]])
        return [Page(where.replace("{page}", str(k))) for k in range(1, n + 1)]

    def partitions(self) -> list[Page]:
        """The pages of the first path that answers."""
        failed: list[str] = []
        for where in filter(None, map(str.strip, self.options["path"].splitlines())):
            try:
                return self._partitions_of(where)
            except (OSError, ValueError, KeyError) as error:
                failed.append(f"{where}: {error!r}")
        raise OSError("no path answers: " + "; ".join(failed))

    def read(self, partition: Page) -> Iterator[tuple]:
        page = self._page(partition.where)
        for record in page[self.options["rows"]] if "rows" in self.options else page:
            yield tuple(_cast(record.get(f.name), f.dataType) for f in self.schema.fields)


def _cast(value, kind):
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, IntegralType):
        return int(value)
    return kind.fromInternal(value) if kind.needConversion() else value
