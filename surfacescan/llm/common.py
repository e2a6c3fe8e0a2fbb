"""Shared helpers: bounded Arrow batches, scratch tables and vectorised word hashes."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch: bounds a Python worker's memory whatever the row size.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def configure(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers see."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text only, so that other columns cannot clash."""
    configure(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow by position, which takes columns of any name (dots included)."""
    configure(df.sparkSession)
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that no taken name equals, whatever the case."""
    have, out = {x.lower() for x in taken}, []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- scratch


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, a local one in local mode (tests) and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        root = os.environ.get("SURFACESCAN_CHECKPOINTS") or tempfile.mkdtemp(prefix="checkpoints-")
        os.environ["SURFACESCAN_CHECKPOINTS"] = root
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, outlives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/scratch/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, once nothing reads it any more."""
    _forget(df.sparkSession, df._scratch)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def width(spark: SparkSession, factor: int = 1) -> int:
    """A partition count that follows the session's shuffle setting."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)


# ---------------------------------------------------------------- words

#: ASCII white space: space and 9 to 13.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_rng = np.random.default_rng(20240817)
_TABLE = _rng.integers(0, 2**64, size=256, dtype=np.uint64)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All texts (null: empty) end to end with a line feed between; and where each begins, plus the end."""
    parts = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    raw = b"\n".join(parts)
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=starts[1:])
    return np.frombuffer(raw.lower() if lower else raw, dtype=np.uint8), starts


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    lens = ends - starts
    out = np.empty(len(starts), dtype=np.uint64)
    long = lens > _LONG
    if long.any():
        for i in np.flatnonzero(long):
            out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
        pick = np.flatnonzero(~long)
    else:
        pick = np.arange(len(starts))
    size = lens[pick].astype(np.uint8)
    order = pick[np.argsort(size, kind="stable")[::-1]]
    at, size = starts[order], lens[order]
    h = size.astype(np.uint64)
    alive = len(order) - np.searchsorted(size[::-1], np.arange(_LONG + 1), side="right")
    for k in range(_LONG):
        m = alive[k]
        if not m:
            break
        head = h[:m]
        head *= _MULT
        head += _TABLE[buf[at[:m] + k]]
    out[order] = h
    return mix(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of non-space bytes, A-Z lowered), and each text's bounds in them (n+1)."""
    buf, starts = joined(column)
    if not len(buf):
        return np.empty(0, dtype=np.uint64), np.zeros(len(column) + 1, dtype=np.int64)
    first, last = runs(~IS_SPACE[buf])
    return hash_spans(buf, first, last), np.searchsorted(first, starts)


def portions(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that have `most` bytes together at most, or are one text."""
    sizes = pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if sizes:
        yield start, len(sizes)


def release() -> None:
    """Give memory that earlier batches and tasks have freed back to the system: a worker serves many stages, and would keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    release()
    for b in it:
        if b.num_rows:
            yield b
        del b
    release()
