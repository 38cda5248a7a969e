"""A data source of file trees that a service lists and hands out folder by folder and file by file.

spark.dataSource.register(FileTree)
spark.read.format("file_tree").option("root", folder).option("content", "true").load()

Planning lists only the first folders; each becomes a partition (small ones share one), which lists what lies below and fetches it
in its task. A partition may make `calls` calls; what it had no call left for has no content, and folders that it couldn't
list are told by a row of their own. `most` files are kept of each partition's listing. `truncated` says that a
partition's listing was cut or not finished. Rows: path, size, content, error, truncated, partition.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size long, content binary, error string, truncated boolean, partition int"


class Throttled(Exception):
    """A service's answer that asks to wait."""


class Folder:
    """The service by default: folders that all machines see. Others have the same two calls."""

    def list(self, path: str) -> list[tuple[str, int | None]]:
        """(path, size) of what is in a folder; a folder's size is None."""
        with os.scandir(path) as found:
            return sorted((e.path, None if e.is_dir(follow_symlinks=False) else e.stat().st_size) for e in found)

    def fetch(self, path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()


@dataclass
class Part(InputPartition):
    number: int
    folders: tuple[str, ...]
    files: tuple[tuple[str, int], ...]

    def __init__(self, number: int, folders: tuple, files: tuple):
        super().__init__(number)
        self.number, self.folders, self.files = number, folders, files


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["root"]
        self.most = int(options.get("most", "5000"))
        self.calls = int(options.get("calls", "5000"))
        self.parts = int(options.get("parts", "8"))
        self.content = options.get("content", "false").lower() == "true"
        self.wait = float(options.get("wait", "1"))
        self.service: Callable = SERVICES[options.get("service", "folder")]

    def partitions(self) -> list[Part]:
        found = self.service().list(self.root)
        folders = [p for p, size in found if size is None]
        files = tuple((p, size) for p, size in found if size is not None)
        dealt = [tuple(folders[i :: self.parts]) for i in range(min(self.parts, len(folders)))]
        return [Part(0, (), files), *[Part(i, fs, ()) for i, fs in enumerate(dealt, 1)]]

    def read(self, part: Part) -> Iterator[tuple]:
        service, left = self.service(), self.calls

        def called(call: Callable, path: str, tries: int = 3):
            nonlocal left
            for n in range(tries):
                left -= 1
                try:
                    return call(path)
                except Throttled:
                    if n == tries - 1 or left <= 0:
                        raise
                    time.sleep(self.wait * 2**n)

        todo, files, unlisted = list(reversed(part.folders)), list(part.files), []
        while todo and len(files) <= self.most:
            folder = todo.pop()
            if left <= 0:
                unlisted.append((folder, "no call left"))
                continue
            try:
                found = called(service.list, folder)
            except Exception as e:  # noqa: BLE001 - one folder's failure is a row, not the read's
                unlisted.append((folder, str(e) or type(e).__name__))
                continue
            files += [x for x in found if x[1] is not None]
            todo += [p for p, size in reversed(found) if size is None]
        truncated = bool(len(files) > self.most or unlisted or todo)
        for path, size in files[: self.most]:
            content, error = None, None
            if self.content:
                try:
                    content, error = (called(service.fetch, path), None) if left > 0 else (None, "no call left")
                except Exception as e:  # noqa: BLE001
                    error = str(e) or type(e).__name__
            yield path, size, content, error, truncated, part.number
        for folder, error in unlisted:
            yield folder, None, None, error, True, part.number


#: Services by name; a caller adds its own before it reads.
SERVICES: dict[str, Callable] = {"folder": Folder}


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))
