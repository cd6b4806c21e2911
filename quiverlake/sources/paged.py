"""A paged listing as a data source, batch and stream: a partition for each page, offsets that can be resumed.

Services that hand out their rows by pages are staged as a folder with a folder ``page=<n>`` for each page, numbers
from 1, whose files hold one JSON object: ``{"list": [rows], "pager": {"page": n, "totalRows": all}}``.  A batch
reads as many pages as the first one's pager says; a stream takes the pages that are there and goes on behind
the last one that it has finished.  Pages are opened where they are read, by the file system that the folder's
address names, so that none passes the driver.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("pageSize", 100).load(folder)
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _Folder:
    """The staged pages."""

    def __init__(self, address: str, schema: StructType):
        self.address, self.names = address.rstrip("/"), [f.name for f in schema if f.name != "page"]
        self.schema = schema

    def _system(self):
        from pyarrow import fs

        address = self.address[5:] if self.address.startswith("file:") else self.address
        while address.startswith("//"):  # file:///x and file:/x name the same folder
            address = address[1:]
        return fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)

    def page(self, number: int) -> dict | None:
        """The object of a page, or None where the page isn't there."""
        from pyarrow import fs

        system, root = self._system()
        found = system.get_file_info(fs.FileSelector(f"{root}/page={number}", allow_not_found=True))
        files = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        if not files:
            return None
        with system.open_input_stream(files[0]) as f:
            return json.loads(f.read())

    def last(self) -> int:
        """The greatest number up to which all pages are there."""
        from pyarrow import fs

        system, root = self._system()
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        numbers = {int(f.base_name[5:]) for f in found if f.base_name.startswith("page=") and f.base_name[5:].isdigit()}
        n = 0
        while n + 1 in numbers:
            n += 1
        return n

    def rows(self, number: int) -> Iterator[tuple]:
        body = self.page(number)
        if body is None:
            raise FileNotFoundError(f"page {number} of {self.address} is missing")
        for row in body.get("list") or []:
            yield tuple(number if f.name == "page" else row.get(f.name) for f in self.schema)


class _Reader(DataSourceReader):
    def __init__(self, folder: _Folder, size: int):
        self.folder, self.size = folder, size

    def partitions(self) -> list[InputPartition]:
        first = self.folder.page(1)
        total = int(((first or {}).get("pager") or {}).get("totalRows") or 0)
        return [_Page(n) for n in range(1, max(1, -(-total // self.size)) + 1)] if first is not None else []

    def read(self, partition: _Page) -> Iterator[tuple]:
        return self.folder.rows(partition.number) if isinstance(partition, _Page) else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": self.folder.last()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Page(n) for n in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        return self.folder.rows(partition.number)

    def commit(self, end: dict) -> None:
        """Pages stay where they are; the checkpoint holds the offset."""


class PagedSource(DataSource):
    """Format ``paged``; options ``path`` and ``pageSize`` (rows of a full page, 100)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, path string, content string, version long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Folder(self.options["path"], schema), int(self.options.get("pagesize") or self.options.get("pageSize") or 100))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(_Folder(self.options["path"], schema))
