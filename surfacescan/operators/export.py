"""Export of what was not analyzed here, for other tools: jobs, guards, a manifest and the files."""

from __future__ import annotations

import contextlib
import errno
import os
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BYTES = 64 * 1024**2


def export_jobs(coverage: DataFrame) -> DataFrame:
    """One row a file and language to export: first and last line, whether whole, and whether others want the same target."""
    rows = coverage.where("status = 'exportable'").groupBy("package", "version", "file_context", "language").agg(
        F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.bool_or(F.col("bytes").isNotNull()).alias("whole"))
    target = F.when(F.col("whole"), F.col("file_context")).otherwise(F.concat_ws(".", "file_context", "language"))
    rows = rows.withColumn("target", F.concat_ws("/", "package", "version", target))
    return rows.withColumn("collides", F.count("*").over(Window.partitionBy("target")) > 1)


def unsafe(path: Column) -> Column:
    """Whether a path could lead out of the folder it is put in."""
    return path.isNull() | (path == "") | path.startswith("/") | path.contains("\\") | path.rlike(r"[\x00-\x1f]|^[A-Za-z]:") | F.exists(F.split(path, "/"), lambda x: x.isin("", ".", ".."))


def export_manifest(jobs: DataFrame, files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Jobs with content and `note`, the first thing that speaks against writing (null: none)."""
    f = files.select(F.col("package").alias("f_package"), F.col("version").alias("f_version"), F.col("file_context").alias("f_file"), "bytes", "content", "is_symlink")
    rows = jobs.join(f, (jobs.package == f.f_package) & jobs.version.eqNullSafe(f.f_version) & (jobs.file_context == f.f_file), "left")
    note = (
        F.when(unsafe(F.col("target")), "unsafe path").when(F.col("collides"), "name collides with another export").when(F.col("is_symlink"), "symlink")
        .when(F.col("f_file").isNull(), "unreadable").when(F.col("bytes") > max_bytes, "over max_bytes").when(F.col("content").isNull(), "unreadable")
    )
    return rows.select(F.col("target").alias("path"), "package", "file_context", "language", "first_line", "last_line", "whole", "content", note.alias("note"))


def blanked(content: bytes, first: int, last: int) -> bytes:
    """The lines first to last at their own numbers, empty lines for the others."""
    lines = content.split(b"\n")
    return b"\n".join(x if first <= i <= last else b"" for i, x in enumerate(lines, 1))


def _folder(at: int, parts: list[str]) -> int:
    """Descend from an open folder, making folders on the way; each is opened in the one before without following a link, so nothing planted meanwhile leads elsewhere. The caller closes it."""
    here = os.dup(at)
    try:
        for part in parts:
            with contextlib.suppress(FileExistsError):
                os.mkdir(part, 0o700, dir_fd=here)
            below = os.open(part, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW | os.O_CLOEXEC, dir_fd=here)
            os.close(here)
            here = below
    except OSError:
        os.close(here)
        raise
    return here


def _write(top: int, path: str, body: bytes, overwrite: bool) -> str | None:
    """Write one file below an open folder; what stood against it, if anything. A file that a lost task has left there whole counts as written."""
    *folders, name = path.split("/")
    try:
        here = _folder(top, folders)
    except OSError as e:
        return "escapes target" if e.errno in (errno.ELOOP, errno.ENOTDIR) else "could not write"
    try:
        # Under another name first: a task that is killed leaves no half file under the right one.
        own = f".{name[:200]}.{uuid.uuid4().hex}"
        with os.fdopen(os.open(own, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW | os.O_CLOEXEC, 0o600, dir_fd=here), "wb") as f:
            f.write(body)
        try:
            if overwrite:
                os.rename(own, name, src_dir_fd=here, dst_dir_fd=here)
            else:
                os.link(own, name, src_dir_fd=here, dst_dir_fd=here, follow_symlinks=False)
        except FileExistsError:
            with os.fdopen(os.open(name, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK | os.O_CLOEXEC, dir_fd=here), "rb") as f:
                if f.read(len(body) + 1) != body:
                    return "could not write"
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(own, dir_fd=here)
    except OSError:
        return "could not write"
    finally:
        os.close(here)
    return None


def export_unscanned(manifest: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Write what the manifest allows below a folder that all executors share; the manifest with `written`. Never deletes what it has not made or follows links.

    A folder that is not empty is refused, unless overwrite says that files there may be replaced.
    """
    os.makedirs(folder, exist_ok=True)
    if not overwrite and next(os.scandir(folder), None) is not None:
        raise ValueError(f"{folder} is not empty")

    def run(it):
        import pandas as pd

        top = os.open(folder, os.O_RDONLY | os.O_DIRECTORY | os.O_CLOEXEC)
        try:
            for pdf in it:
                out = []
                for r in pdf.itertuples(index=False):
                    note = r.note if isinstance(r.note, str) else _write(top, r.path, r.content if r.whole else blanked(r.content, int(r.first_line), int(r.last_line)), overwrite)
                    out.append((r.path, r.file_context, r.language, r.first_line, r.last_line, note is None, note))
                df = pd.DataFrame(out, columns=["path", "file_context", "language", "first_line", "last_line", "written", "note"])
                yield df.astype({"first_line": "Int32", "last_line": "Int32"})
        finally:
            os.close(top)

    return manifest.mapInPandas(run, "path string, file_context string, language string, first_line int, last_line int, written boolean, note string")
