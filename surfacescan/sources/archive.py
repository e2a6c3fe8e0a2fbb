"""Tar archives: headers, verdicts and files, read as streams without extracting anything."""

from __future__ import annotations

import fnmatch
import gzip
import hashlib
import heapq
import io
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.paths import SCAN_LIMIT
from ..schemas import ENTRIES, FILES, batch
from .folder import BATCH_BYTES, BATCH_ROWS, FILE, FOLDER, SPLITS, Local, Wanted, opened

# Default caps, and bytes skipped at a time.
MAX_ENTRIES, MAX_BYTES, MAX_RATIO, CHUNK = 100_000, 2 * 1024**3, 256, 1024**2
ARCHIVE_LIMIT = 2 * 1024**3
KINDS = {b"\0": "file", b"0": "file", b"1": "hardlink", b"2": "symlink", b"5": "dir"}


class Refused(ValueError):
    """The archive must not be read any further."""


class Entry(NamedTuple):
    name: str
    type: str
    linkname: str
    size: int


def _field(block: bytes, a: int, b: int) -> str:
    return block[a:b].split(b"\0", 1)[0].decode("utf-8", "replace")


class Hashed:
    """A file read once from its start, with the hash and the number of the bytes so far."""

    def __init__(self, f: BinaryIO) -> None:
        self.f, self.sha, self.n = f, hashlib.sha256(), 0

    def read(self, n: int = CHUNK) -> bytes:
        out = self.f.read(n)
        self.sha.update(out)
        self.n += len(out)
        return out

    def digest(self) -> str:
        """The hash of the whole file."""
        while self.read():
            pass
        return self.sha.hexdigest()


def walk(source: bytes | BinaryIO | Hashed, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES, max_ratio: float | None = MAX_RATIO, keep: int = 0, length: int | None = None) -> Iterator[tuple[Entry, bytes | None]]:
    """Each header and, for files of at most `keep` bytes, the content. Anything unsound raises Refused.

    The archive is read as a stream, CHUNK bytes and one kept content at a time. length: its size, where it is not given whole.
    """
    if isinstance(source, bytes):
        source, length = io.BytesIO(source), len(source)
    head = source.read(512)
    raw = io.BufferedReader(_Chained(head, source), CHUNK)
    if head[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=raw)
    elif head[257:262] == b"ustar" or (len(head) >= 512 and head.strip(b"\0") and head[156:157] in KINDS):
        stream = raw
    else:
        raise Refused("neither gzip nor plain tar")
    seen = read = 0

    def take(n: int) -> bytes:
        nonlocal read
        try:
            out = stream.read(n)
        except (OSError, EOFError, zlib.error) as e:
            raise Refused(f"damaged: {e}") from e
        read += len(out)
        return out

    while True:
        block = take(512)
        if not block.strip(b"\0"):
            if len(block) not in (0, 512) or not seen and not block:
                raise Refused("truncated")
            return
        if len(block) < 512:
            raise Refused("truncated header")
        digits = block[124:136].replace(b"\0", b" ").strip()
        try:
            size = int(digits, 8) if digits else 0
        except ValueError:
            raise Refused("bad size") from None
        if not 0 <= size <= 2**31 - 1:
            raise Refused("bad size")
        seen += 1
        if seen > max_entries:
            raise Refused(f"more than {max_entries} entries")
        prefix, name = _field(block, 345, 500) if block[257:262] == b"ustar" else "", _field(block, 0, 100)
        entry = Entry(f"{prefix}/{name}" if prefix else name, KINDS.get(block[156:157], "other"), _field(block, 157, 257), size)
        left, parts, wanted = -(-size // 512) * 512, [], entry.type == "file" and size <= keep
        while left:
            part = take(min(CHUNK, left))
            if not part:
                raise Refused("truncated data")
            left -= len(part)
            if wanted:
                parts.append(part)
            if read > max_bytes:
                raise Refused(f"more than {max_bytes} bytes")
            if max_ratio and read > max_ratio * length:
                raise Refused(f"expands more than {max_ratio} times")
        yield entry, b"".join(parts)[:size] if wanted else None


class _Chained(io.RawIOBase):
    """Some bytes, then a file."""

    def __init__(self, head: bytes, rest: BinaryIO | Hashed) -> None:
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        out, self.head = (self.head[: len(into)], self.head[len(into) :]) if self.head else (self.rest.read(len(into)), b"")
        into[: len(out)] = out
        return len(out)


def problems(entries: list[Entry]) -> list[str]:
    """What speaks against extracting these entries; empty: nothing."""
    path = lambda e: [p for p in e.name.split("/") if p not in ("", ".")]
    checks = {
        "links": sum(e.type in ("symlink", "hardlink") for e in entries),
        "unknown entry types": sum(e.type == "other" for e in entries),
        "path traversal": sum(".." in e.name.split("/") for e in entries),
        "absolute paths": sum(e.name.startswith("/") or e.name[1:2] == ":" for e in entries),
        "backslashes": sum("\\" in e.name for e in entries),
        "control characters or empty names": sum(not e.name or any(ord(c) < 32 for c in e.name) for e in entries),
    }
    out = [f"{n} {what}" for what, n in checks.items() if n]
    tops = {path(e)[0] for e in entries if path(e)}
    return out + ([f"{len(tops)} top-level folders"] if len(tops) != 1 else [])


def archive_name(path: str) -> tuple[str, str | None]:
    """Package and version from a file name: before and after the first underscore."""
    stem = path.rsplit("/", 1)[-1]
    for suffix in (".tar.gz", ".tgz", ".tar"):
        stem = stem.removesuffix(suffix)
    name, _, version = stem.partition("_")
    return name, version or None


ARCHIVE = f"{FILES}, verdict string, archive_sha256 string"
SIZES = "package string, compressed_size long, uncompressed_size long, ratio double, cap_hit boolean, error string"
MODES = {"files": ARCHIVE, "verdicts": ARCHIVE, "entries": ENTRIES, "sizes": SIZES}
SUFFIXES = (".tar.gz", ".tgz", ".tar")


class Verdict(NamedTuple):
    why: str | None
    digest: str | None


@dataclass
class Archives(ds.InputPartition):
    """(path, size) of archives."""

    found: list[tuple[str, int]]


def listed(path: str) -> list[tuple[str, int]]:
    """Archives at a folder, a file or a glob, with their sizes; hidden ones too, links not."""
    store, root = opened(path)
    above, name = root.rsplit("/", 1)
    matching = lambda folder, pattern: [(f"{folder}/{e.name}", e) for e in store.entries(folder or "/") if fnmatch.fnmatchcase(e.name, pattern)]
    try:
        own = [e for e in store.entries(above or "/") if e.name == name or root == "/"]
    except OSError:
        own = []
    if own:
        found = [(root, own[0])] if own[0].kind == FILE else [(f"{root.rstrip('/')}/{e.name}", e) for e in store.entries(root)]
    elif any(c in root for c in "*?["):
        tops = [""]
        for part in above.strip("/").split("/"):
            tops = [at for top in tops for at, e in matching(top, part) if e.kind == FOLDER]
        found = [x for top in tops for x in matching(top, name)]
    else:
        raise FileNotFoundError(path)
    scheme = "" if isinstance(store, Local) else path.split("://", 1)[0] + "://"
    return [(scheme + p, e.size) for p, e in found if e.kind == FILE and e.name.endswith(SUFFIXES)]


class ArchiveReader(ds.DataSourceReader):
    """Reads archives as streams: the headers first, for the verdict; then, of sound ones, the contents."""

    def __init__(self, options: dict) -> None:
        self.paths, self.mode = json.loads(options["paths"]), options["mode"]
        self.keep, self.limit, self.splits = int(options["keep"]), int(options["archive_limit"]), int(options["splits"])
        self.caps = json.loads(options["caps"])
        self.wanted = Wanted(options)

    def partitions(self) -> list[Archives]:
        """Archives dealt out by size, the largest first, to whichever part has least."""
        found = sorted({x for p in self.paths for x in listed(p)}, key=lambda x: (-x[1], x[0]))
        found = [x for x in found if self.wanted.package(archive_name(x[0])[0])]
        parts = [(0, i, []) for i in range(min(self.splits, len(found)))]
        for path, size in found:
            held, i, part = heapq.heappop(parts)
            part.append((path, size))
            heapq.heappush(parts, (held + size + CHUNK, i, part))
        return [Archives(part) for _, _, part in parts]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        make = {"files": self._files, "verdicts": self._files, "entries": self._entries, "sizes": self._sizes}[self.mode]
        rows, held = [], 0
        for path, size in partition.found:
            for row in make(path, size):
                rows.append(row)
                held += 200 + (len(row[4] or b"") if self.mode == "files" else 0)
                if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                    yield batch(rows, MODES[self.mode])
                    rows, held = [], 0
        if rows:
            yield batch(rows, MODES[self.mode])

    def _walk(self, path: str, length: int, keep: int = 0, **caps) -> Iterator[tuple[Entry, bytes | None] | Verdict]:
        """What walk() yields, then the verdict so far with the digest of the whole archive."""
        if length > self.limit:
            yield Verdict(f"archive of more than {self.limit} bytes", None)
            return
        store, at = opened(path)
        try:
            with store.open(at) as f:
                raw, why = Hashed(f), None
                try:
                    yield from walk(raw, keep=keep, length=length, **self.caps | caps)
                except Refused as e:
                    why = str(e)
                yield Verdict(why, raw.digest())
        except OSError as e:
            yield Verdict(f"unreadable: {e.strerror or type(e).__name__}", None)

    def _files(self, path: str, length: int) -> Iterator[tuple]:
        package, version = archive_name(path)
        entries: list[Entry] = []
        for x in self._walk(path, length):
            if isinstance(x, Verdict):
                why, digest = x
            else:
                entries.append(x[0])
        if why is None:
            found = problems(entries)
            why = "; ".join(found) if found else None if any(e.name.split("/")[0] == package for e in entries) else f"no folder {package}"
        if self.mode == "verdicts":
            yield package, version, None, None, None, None, why, digest
            return
        if why is None:
            for x in self._walk(path, length, self.keep):
                if isinstance(x, Verdict):
                    if x.digest != digest:
                        why = "changed while it was read"
                elif x[0].type == "file" and self.wanted.file(name := x[0].name.split("/", 1)[-1], x[0].size):
                    yield package, version, name, x[0].size, x[1], False, None, digest
        if why is not None:
            yield package, version, None, None, None, None, why, digest

    def _entries(self, path: str, length: int) -> Iterator[tuple]:
        package = archive_name(path)[0]
        for x in self._walk(path, length):
            if not isinstance(x, Verdict):
                yield package, *x[0]
            elif x.why:
                yield package, None, "refused", x.why, None

    def _sizes(self, path: str, length: int) -> Iterator[tuple]:
        total, error = 0, None
        for x in self._walk(path, length):
            if isinstance(x, Verdict):
                error = x.why
            else:
                total += 512 + -(-x[0].size // 512) * 512
        yield archive_name(path)[0], length, total, total / length if length else None, bool(error and error.startswith("more than") and error.endswith("bytes")), error


class ArchiveSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "surfacescan_archives"

    def schema(self) -> str:
        return MODES[self.options["mode"]]

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def _load(spark: SparkSession, path: str | list[str], mode: str, keep: int = 0, archive_limit: int = ARCHIVE_LIMIT, splits: int = SPLITS, wanted: dict | None = None, **caps) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    paths = json.dumps([path] if isinstance(path, str) else list(path))
    options = {"paths": paths, "mode": mode, "keep": str(keep), "archive_limit": str(archive_limit), "splits": str(splits), "caps": json.dumps(caps)}
    return spark.read.format(ArchiveSource.name()).options(**options, **Wanted.options(**wanted or {})).load()


def read_archives(spark: SparkSession, path: str | list[str], keep: int = SCAN_LIMIT, **caps) -> DataFrame:
    """Files of all archives at a path (folder, file or glob; or a list of these), one row a file; a refused archive is one row with its verdict and no file.

    Archives are read as streams, twice: headers for the verdict, then contents, a batch of bounded bytes
    at a time. caps: archive_limit (a larger archive is refused unopened), splits, wanted (packages, match
    and largest, as for read_tree; what is not wanted is not read, or not kept), and those of walk().
    """
    return _load(spark, path, "files", keep, **caps)


def archive_verdicts(spark: SparkSession, path: str | list[str], **caps) -> DataFrame:
    """As read_archives, but one row an archive, from its headers alone; without a verdict it is sound."""
    return _load(spark, path, "verdicts", **caps)


def tar_entries(spark: SparkSession, path: str | list[str], **caps) -> DataFrame:
    """Headers of all archives at a path; a refused one ends with a row of type "refused" whose linkname says why."""
    return _load(spark, path, "entries", **caps)


def archive_sizes(spark: SparkSession, path: str | list[str], **caps) -> DataFrame:
    """Compressed and uncompressed size of each archive, the ratio, whether the cap of bytes was hit, and why reading ended early."""
    return _load(spark, path, "sizes", **caps)


def validate_entries(entries: DataFrame) -> DataFrame:
    """Counts of what speaks against each archive, and whether it is sound."""
    name = F.col("name")
    flags = {
        "n_links": F.col("type").isin("symlink", "hardlink"), "n_other": F.col("type").isin("other", "refused"), "n_traversal": name.rlike(r"(^|/)\.\.(/|$)"),
        "n_absolute": name.rlike(r"^(/|.:)"), "n_backslash": name.contains("\\"), "n_unprintable": name.rlike(r"[\x00-\x1f]") | (name == ""),
    }
    counted = entries.groupBy("package").agg(
        F.count("*").alias("n_entries"), *(F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in flags.items()),
        F.countDistinct(F.substring_index(F.regexp_replace("name", r"^(\./)+", ""), "/", 1)).alias("n_toplevel"),
    )
    return counted.withColumn("sound", sum((F.col(n) for n in flags), F.lit(0)).eqNullSafe(0) & (F.col("n_toplevel") == 1))
