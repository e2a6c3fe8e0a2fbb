"""Vector code compression: product codes whose codebooks are learnt by Elkan's Lloyd iteration.

A vector's components become integers floor(4096 * x) and are cut into PARTS equal consecutive parts; each
part position has a codebook of ENTRIES entries, which begins as that part of the smallest vec_ids. A round
assigns every part to its nearest entry (ties to the lower index), then replaces each entry by its parts'
componentwise floor(sum / count); unused entries stay.

Elkan's bounds spare most distances. With each vector a table keeps, for every part, its entry, an upper
bound of the distance to it and one lower bound for every entry. When entries have moved, the upper bound
grows by its entry's movement and lower bounds shrink by theirs. By the triangle inequality an entry cannot
be nearest if its lower bound, or half its distance to the part's own entry, is strictly above the upper
bound; no entry can be if half the distance from the own entry to its nearest neighbour is. Bounds are
rounded to the safe side, and whatever is not strictly beyond them is decided, ties included, by exact
squared distances in 64-bit integers.

One map-only pass a round reads the table of bounds, writes the next one to the shared folder and adds, in
the last row of each task, the sums by entry; these are added up in Spark, and parts * entries * (length of
a part + 1) numbers reach the driver, whatever the rows. Old tables are deleted. Nothing else is shuffled but
the sums by label.

Cases: vectors that are null or hold null or non-finite components take no part, and neither do those
whose length is not that of the smallest vec_id's vector or is no positive multiple of the parts; with
fewer kept rows than entries the codebooks are so much smaller; rows that repeat a vec_id are rows of their
own (of equal ids the smaller vector comes first, a null id last); an empty table gives no rows; other
columns are ignored. Components beyond 8,192 in absolute value end the job with an error: exact squared
distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, configure, discard, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: The largest component for which squared distances of parts of up to 1,024 components fit into 64 bits.
WIDEST = 8192
#: Relative slack for the rounding of square roots.
UP, DOWN = 1 + 1e-12, 1 - 1e-12
#: Lower bounds are whole numbers of 16 bits: rounded down, and never above this.
TOP = 65_535


@dataclass
class Codes:
    """codes: vec_id, label, code (bytes, an entry for each part), error, compared (distances computed in all rounds, of parts * entries * (rounds + 1)); books: (parts, entries, length) integers."""

    codes: DataFrame
    books: np.ndarray


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def _apart(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part: half the distances between entries, and half of each entry's distance to the nearest other one; rounded down."""
    d = book[:, :, None, :] - book[:, None, :, :]
    half = np.sqrt(np.einsum("pefd,pefd->pef", d, d).astype(np.float64)) * (DOWN / 2)
    others = half.copy()
    others[:, np.arange(book.shape[1]), np.arange(book.shape[1])] = np.inf
    return half, others.min(axis=2)


@dataclass
class Bounds:
    """Of n vectors: code (n, parts), upper (n, parts), lower (n, parts, entries) and the distances computed so far (n)."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    compared: np.ndarray


def _root_up(sq: np.ndarray) -> np.ndarray:
    return np.nextafter((np.sqrt(sq.astype(np.float64)) * UP).astype(np.float32), np.float32(np.inf))


def _root_down(sq: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.sqrt(sq.astype(np.float64)) * DOWN), TOP).astype(np.uint16)


def first(q: np.ndarray, book: np.ndarray) -> Bounds:
    """The first assignment: every distance. q: (n, parts, length) integers."""
    sq = np.einsum("npd,npd->np", q, q)[:, :, None] - 2 * np.einsum("npd,ped->npe", q, book) + np.einsum("ped,ped->pe", book, book)
    code = sq.argmin(axis=2)
    own = np.take_along_axis(sq, code[:, :, None], 2)[:, :, 0]
    return Bounds(code.astype(np.uint8), _root_up(own), _root_down(sq), np.full(len(q), sq[0].size if len(q) else 0, dtype=np.int64))


def shifted(b: Bounds, moved: np.ndarray) -> Bounds:
    """The bounds after entries have moved (parts, entries) at most so far."""
    p = np.arange(moved.shape[0])
    upper = np.nextafter((b.upper.astype(np.float64) + moved[p, b.code]).astype(np.float32), np.float32(np.inf))
    lower = np.maximum(b.lower.astype(np.int64) - np.minimum(np.ceil(moved), TOP).astype(np.int64), 0).astype(np.uint16)
    return Bounds(b.code, upper, lower, b.compared)


def again(q: np.ndarray, book: np.ndarray, b: Bounds) -> Bounds:
    """A later assignment, from shifted bounds."""
    half, gap = _apart(book)
    code, upper, lower, compared = b.code.copy(), b.upper.copy(), b.lower.copy(), b.compared.copy()
    i, p = np.nonzero(upper >= gap[np.arange(len(book)), code])
    if not len(i):
        return Bounds(code, upper, lower, compared)
    was, at = code[i, p].astype(np.int64), np.arange(len(i))
    own = _exact(q[i, p], book[p, was])
    limit = _root_up(own).astype(np.float64)
    lower[i, p, was] = _root_down(own)
    need = (lower[i, p] <= limit[:, None]) & (half[p, was] <= limit[:, None])
    need[at, was] = False
    k, e = np.nonzero(need)
    sq = _exact(q[i[k], p[k]], book[p[k], e])
    lower[i[k], p[k], e] = _root_down(sq)
    seen = np.full((len(i), book.shape[1]), np.iinfo(np.int64).max)
    seen[at, was] = own
    seen[k, e] = sq
    now = seen.argmin(axis=1)
    code[i, p], upper[i, p] = now, _root_up(seen[at, now])
    compared += np.bincount(i, minlength=len(q)) + np.bincount(i[k], minlength=len(q))
    return Bounds(code, upper, lower, compared)


# ---------------------------------------------------------------- the table of bounds

STATE = "vec_id long, label {label}, q binary, code binary, upper binary, lower binary, compared long, sums array<long>"


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a contiguous array."""
    data = np.ascontiguousarray(rows).reshape(len(rows), -1)
    width = data.shape[1] * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(data)])


def _values(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _rows(ids: pa.Array, labels: pa.Array, q: np.ndarray, b: Bounds, names: list[str]) -> pa.RecordBatch:
    none = pa.nulls(len(ids), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([ids, labels, _binary(q.astype(np.int32)), _binary(b.code), _binary(b.upper), _binary(b.lower), pa.array(b.compared), none], names=names)


def _state(b: pa.RecordBatch, parts: int) -> tuple[np.ndarray, Bounds]:
    q = _values(b.column(2), np.int32).astype(np.int64).reshape(len(b), parts, -1)
    lower = _values(b.column(5), np.uint16).reshape(len(b), parts, -1)
    return q, Bounds(_values(b.column(3), np.uint8), _values(b.column(4), np.float32), lower, b.column(6).to_numpy())


def _sums(q: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """By part and entry: the sum of each component, then the count."""
    parts, length = q.shape[1:]
    rows = np.concatenate((q, np.ones((len(q), parts, 1), dtype=np.int64)), axis=2)
    at = (np.arange(parts) * entries + code)[:, :, None] * (length + 1) + np.arange(length + 1)
    return np.bincount(at.ravel(), weights=rows.ravel(), minlength=parts * entries * (length + 1)).astype(np.int64)


def _pass(book: np.ndarray, moved: np.ndarray | None, names: list[str], kind: pa.DataType):
    """The assignment of all rows, then one row of sums. moved: None in the first round, when rows hold components as numbers."""
    parts, entries, length = book.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts * entries * (length + 1), dtype=np.int64)
        for b in batches(it):
            if moved is None:
                x = np.floor(b.column(2).flatten().to_numpy().reshape(len(b), parts, length) * SCALE)
                if np.abs(x).max() > WIDEST * SCALE:
                    raise ValueError(f"a component lies beyond {WIDEST}: squared distances would leave 64 bits")
                q = x.astype(np.int64)
                bounds = first(q, book)
            else:
                q, bounds = _state(b, parts)
                bounds = again(q, book, shifted(bounds, moved))
            total += _sums(q, bounds.code, entries)
            yield _rows(b.column(0), b.column(1), q, bounds, names)
        last = [pa.nulls(1, t) for t in (pa.int64(), kind, *[pa.binary()] * 4, pa.int64())]
        yield pa.RecordBatch.from_arrays([*last, pa.array([total.tolist()], pa.list_(pa.int64()))], names=names)

    return run


def _moved(table: DataFrame, book: np.ndarray) -> np.ndarray:
    """The entries after a round."""
    parts, entries, length = book.shape
    sums = table.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    of = {r["at"]: int(r["n"]) for r in sums.collect()}
    out = book.copy()
    for p in range(parts):
        for e in range(entries):
            at = (p * entries + e) * (length + 1)
            if count := of.get(at + length, 0):
                out[p, e] = [of[at + j] // count for j in range(length)]
    return out


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes | None:
    """Codes of all kept vectors and the codebooks; None where no vector is kept."""
    spark = embeddings.sparkSession
    configure(spark)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where("forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))")
    head = rows.where(f"size(x) > 0 AND size(x) % {parts} = 0").orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(1).collect()
    if not head:
        return None
    width = len(head[0]["x"])
    rows = rows.where(f"size(x) = {width}")
    start = np.array([r["x"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()])
    book = np.floor(start * SCALE).astype(np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)
    if np.abs(start).max() > WIDEST:
        raise ValueError(f"a component lies beyond {WIDEST}: squared distances would leave 64 bits")

    schema = STATE.format(label=rows.schema["label"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")[:7]] + ["sums"]
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema["label"].dataType)
    table, old, moved = rows, None, None
    for _ in range(rounds):
        table = materialise(table.mapInArrow(_pass(book, moved, names, kind), schema), "bounds")
        new = _moved(table, book)
        step = new - book
        moved = np.sqrt(np.einsum("ped,ped->pe", step, step).astype(np.float64)) * UP
        if old is not None:
            discard(old)
        book, old, table = new, table, table.where("sums IS NULL")

    def last(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            q, bounds = _state(b, parts)
            bounds = again(q, book, shifted(bounds, moved))
            n, p = np.divmod(np.arange(bounds.code.size), parts)
            error = _exact(q[n, p], book[p, bounds.code.ravel()]).reshape(len(b), parts).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(bounds.code), pa.array(error), pa.array(bounds.compared)], names=["vec_id", "label", "code", "error", "compared"])

    label = rows.schema["label"].dataType.simpleString()
    codes = materialise(table.mapInArrow(last, f"vec_id long, label {label}, code binary, error long, compared long"), "codes")
    discard(old)
    return Codes(codes, book)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if found is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    digest = hashlib.sha256(",".join(str(v) for v in found.books.ravel().tolist()).encode()).hexdigest()
    # Written first: a hot label then meets a small table, which Spark broadcasts or splits the other side for.
    by_label = materialise(found.codes.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "l_label")
    rows = found.codes.join(by_label, F.col("label").eqNullSafe(F.col("l_label")))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The contract in DuckDB: the rounds one after the other, every distance computed."""
    square = "list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - v[j]) * (x[j] - v[j])))"
    out = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, p, list_slice(q, p * (len(q) // {PARTS}) + 1, (p + 1) * (len(q) // {PARTS})) AS x FROM kept, range({PARTS}) AS t(p)),
book0 AS MATERIALIZED (SELECT p, row - 1 AS e, x AS v FROM parts WHERE row <= {ENTRIES})"""]
    for r in range(ROUNDS + 1):
        out.append(f"near{r} AS MATERIALIZED (SELECT row, p, arg_min({{'e': e, 'd': d}}, {{'d': d, 'e': e}}) AS best FROM (SELECT row, parts.p AS p, e, {square} AS d FROM parts JOIN book{r} USING (p)) GROUP BY row, p)")
        if r < ROUNDS:
            out.append(f"""mean{r} AS MATERIALIZED (SELECT p, e, list(m ORDER BY j) AS v FROM (
  SELECT p, best.e AS e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS m FROM near{r} JOIN parts USING (row, p), range(1, (SELECT max(len(x)) + 1 FROM parts)) AS t(j) GROUP BY p, best.e, j) GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{r}.v, book{r}.v) AS v FROM book{r} LEFT JOIN mean{r} USING (p, e))""")
    return "WITH " + ",\n".join(out) + f""",
digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) AS d FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS j FROM book{ROUNDS})),
coded AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT d FROM digest) AS codebooks_sha256 FROM kept JOIN coded USING (row)
"""


ORACLE = _oracle()
