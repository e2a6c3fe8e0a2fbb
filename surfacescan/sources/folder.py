"""A data source over folders that lists everything and opens only what is asked for.

Spark's file sources skip names that begin with a dot or an underscore, follow links and fail on what they
cannot read; a scanner must see such files. This source gives a row for every entry below a root: files,
hidden ones included, links (never followed), and what cannot be listed or opened, with `problem` saying
why there is no content. The tree is cut into partitions by its folders; conditions on packages decide before
a folder is listed, those on paths and lengths before a file is opened. They are options, not filters pushed
down: Spark 4.1 keeps one Python reader a relation, so that what is pushed for one use of a DataFrame would
reach its other uses (a self-join then loses rows). Folders are listed and files opened in the tasks; the
driver lists until it has enough of them to deal out.
"""

from __future__ import annotations

import errno
import json
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from ..functions.paths import SCAN_LIMIT
from ..schemas import FILES, batch

SCHEMA = f"{FILES}, problem string"
NAME = "surfacescan_folder"
#: Rows and bytes of one outgoing batch; folders dealt out, unless the option `splits` says otherwise.
BATCH_ROWS, BATCH_BYTES, SPLITS = 1000, 8 << 20, 200
FILE, FOLDER, LINK, OTHER = "file", "folder", "link", "other"
TOO_LARGE = "above the limit"


class Entry(NamedTuple):
    name: str
    kind: str
    size: int | None
    problem: str | None = None


class Local:
    """Folders that every executor mounts."""

    def entries(self, folder: str) -> Iterator[Entry]:
        with os.scandir(folder) as it:
            for e in it:
                try:
                    found = e.stat(follow_symlinks=False)
                except OSError as err:
                    yield Entry(e.name, OTHER, None, _why(err))
                    continue
                kind = LINK if stat.S_ISLNK(found.st_mode) else FOLDER if stat.S_ISDIR(found.st_mode) else FILE if stat.S_ISREG(found.st_mode) else OTHER
                yield Entry(e.name, kind, found.st_size if kind == FILE else None, None if kind != OTHER else "not a regular file")

    def open(self, path: str) -> BinaryIO:
        """A file to read; never a link, and never waiting for a pipe that took a file's place."""
        f = os.fdopen(os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK | os.O_CLOEXEC), "rb")
        if stat.S_ISREG(os.fstat(f.fileno()).st_mode):
            return f
        f.close()
        raise OSError(errno.EINVAL, "not a regular file")

    def read(self, path: str, most: int) -> bytes:
        """The content, one byte more than `most` at most."""
        with self.open(path) as f:
            return f.read(most + 1)


class Store:
    """Folders of a store that Arrow can open (hdfs://, s3://, gs://)."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri)

    def entries(self, folder: str) -> Iterator[Entry]:
        from pyarrow import fs

        kinds = {fs.FileType.File: FILE, fs.FileType.Directory: FOLDER}
        for e in self.fs.get_file_info(fs.FileSelector(folder)):
            kind = kinds.get(e.type, OTHER)
            yield Entry(e.base_name, kind, e.size if kind == FILE else None, None if kind != OTHER else "not a regular file")

    def open(self, path: str) -> BinaryIO:
        return self.fs.open_input_file(path)

    def read(self, path: str, most: int) -> bytes:
        with self.open(path) as f:
            return f.read(most + 1)


def _why(e: OSError) -> str:
    return f"unreadable: {e.strerror or type(e).__name__}"


def opened(root: str) -> tuple[Local | Store, str]:
    """A root's store, and the root within it."""
    if root.startswith("/"):
        return Local(), root.rstrip("/") or "/"
    if root.startswith("file:"):
        return Local(), "/" + root.removeprefix("file:").strip("/")
    store = Store(root)
    return store, store.root.rstrip("/")


def _listed(store: Local | Store, folder: str) -> Iterator[Entry]:
    """The entries; one without a name, for the folder itself, where it cannot be listed to its end."""
    try:
        yield from store.entries(folder)
    except OSError as e:
        yield Entry("", OTHER, None, _why(e))


def _text(name: str) -> str:
    """A file name as valid UTF-8."""
    return name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


@dataclass
class Folders(ds.InputPartition):
    """Folders below the root: (path, whether with all below it)."""

    paths: list[tuple[str, bool]]


class Wanted:
    """Conditions on what is read: packages by name, paths by an expression found in them, lengths up to `largest`."""

    def __init__(self, options: dict) -> None:
        self.packages = frozenset(json.loads(options["packages"])) if "packages" in options else None
        self.match = re.compile(options["match"]) if "match" in options else None
        self.largest = int(options["largest"]) if "largest" in options else None

    @staticmethod
    def options(packages: list[str] | None = None, match: str | None = None, largest: int | None = None) -> dict[str, str]:
        out = {} if packages is None else {"packages": json.dumps(list(packages))}
        return out | ({} if match is None else {"match": match}) | ({} if largest is None else {"largest": str(largest)})

    def package(self, name: str) -> bool:
        return self.packages is None or name in self.packages

    def file(self, path: str, size: int | None) -> bool:
        """Whether a file is wanted; one of unknown length is, whatever the largest."""
        return (self.match is None or self.match.search(path) is not None) and (self.largest is None or size is None or size <= self.largest)


class FolderReader(ds.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.package = options["path"], options.get("package")
        self.limit, self.splits = int(options.get("limit", SCAN_LIMIT)), int(options.get("splits", SPLITS))
        self.content = str(options.get("content", "true")).lower() == "true"
        self.wanted = Wanted(options)

    def partitions(self) -> list[Folders]:
        """Folders with all below them, and those that the driver has listed on the way with their own files only."""
        store, root = opened(self.root)
        whole, own = [""], []
        while whole and len(whole) + len(own) < self.splits:
            at = whole.pop(0)
            try:
                below = [f"{at}{e.name}/" for e in store.entries(f"{root}/{at}") if e.kind == FOLDER]
            except OSError as e:
                if not at:
                    raise FileNotFoundError(f"{self.root}: {_why(e)}") from e
                below = []
            own.append(at)
            whole += sorted(x for x in below if at or self.package is not None or self.wanted.package(_text(x[:-1])))
        units = [(x, True) for x in whole] + [(x, False) for x in own]
        return [Folders(units[i :: self.splits]) for i in range(min(self.splits, len(units)))]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.root)
        rows, held = [], 0
        for row in self._rows(store, root, partition.paths):
            rows.append(row)
            held += len(row[4] or b"") + 200
            if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                yield batch(rows, SCHEMA)
                rows, held = [], 0
        if rows:
            yield batch(rows, SCHEMA)

    def _rows(self, store: Local | Store, root: str, paths: list[tuple[str, bool]]) -> Iterator[tuple]:
        todo = list(paths)
        while todo:
            at, deep = todo.pop()
            for e in _listed(store, f"{root}/{at}"):
                if e.kind == FOLDER:
                    if deep:
                        todo.append((f"{at}{e.name}/", True))
                    continue
                below = _text(at + e.name)
                package, inside = (self.package, below) if self.package is not None else below.split("/", 1) if "/" in below else (".", below)
                if not self.wanted.package(package) or not self.wanted.file(inside, e.size):
                    continue
                content, problem = None, e.problem
                if e.kind == FILE and e.size > self.limit:
                    problem = TOO_LARGE
                elif e.kind == FILE and self.content:
                    try:
                        content = store.read(f"{root}/{at}{e.name}", self.limit)
                        if len(content) > self.limit:  # it has grown
                            content, problem = None, TOO_LARGE
                    except OSError as err:
                        problem = _why(err)
                yield package, None, inside, e.size, content, e.kind == LINK, problem


class FolderSource(ds.DataSource):
    """Options: path; package (else each folder below the root is one); limit of content in bytes; content (true or false); splits; those of Wanted."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(dict(self.options))
