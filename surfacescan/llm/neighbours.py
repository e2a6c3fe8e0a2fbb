"""Approximate nearest neighbours by shifted space-filling curves.

Each of several curves orders all vectors by the Hilbert index of a shifted random projection. The
orderings are cut into key ranges of near-equal size; a query goes to the ranges that its curve's
window of neighbouring keys touches, and each range answers with its exact nearest among its rows.
Answers of all curves and ranges are merged and reranked by exact distance on the original vectors.

The projections' scales, the curves' quantiles and the range bounds are fitted on a bounded sample,
the SAMPLE rows with the smallest hashes of their id. The window is calibrated on the table itself:
the first CALIBRATE of these rows are held against every row, and the window is the number of sample
quantiles within which TARGET of their true neighbours lie on some curve. As rows grow, neighbours get
nearer and the window gets narrower. The number of curves, of those in CURVES, is the one with the
least work: pairs that the windows compare, and rows dealt to every curve. All rows are indexed.

A range with many rows, such as one vector repeated, is cut into cells of a bounded number of rows.
A task holds one cell's rows and lets its queries, of any number, stream past; nothing is capped.

Cases: a vector that is null, empty, zero, or holds null or non-finite components takes no part, nor
does a null id or a vector whose length is not the most frequent one (ties: the longer); rows that
repeat an id count once, with the nearest; ties in distance go to the smaller id; with fewer
candidates all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import BATCH_BYTES, batches, configure, width

#: Numbers of curves to choose from; projected dimensions and bits of each; neighbours wanted.
CURVES, DIMS, BITS, K = (4, 8, 16, 32), 8, 6, 10
#: Rows of a range, bounds of the number of ranges, and rows of a cell.
RANGE_ROWS, MIN_RANGES, MAX_RANGES, CELL_ROWS = 1024, 32, 1024, 16384
#: Rows in the fit; rows of it that calibrate the window; share of their neighbours that it must reach.
SAMPLE, CALIBRATE, TARGET = 4096, 256, 0.97
#: Dealing a row to one more curve takes about as long as comparing it with this many queries.
DEAL = 250


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of integer points (one a row) in a cube of 2**bits to each side."""
    x = cells.T.astype(np.int64).copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | row >> bit & 1
    return key


class Index(NamedTuple):
    """projections: (curve, dim, projected); low, span, shift: (curve, projected); quantiles: (curve, sampled) keys in order; bounds: (curve, ranges - 1) keys; reach: the window to each side, in quantiles."""

    centre: np.ndarray
    projections: np.ndarray
    low: np.ndarray
    span: np.ndarray
    shift: np.ndarray
    quantiles: np.ndarray
    bounds: np.ndarray
    reach: int

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(curve, row) Hilbert keys."""
        out = []
        for p, low, span, shift in zip(self.projections, self.low, self.span, self.shift, strict=True):
            place = np.clip(((vectors - self.centre) @ p - low) / span, 0, 1) / 2 + shift
            out.append(hilbert(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS))
        return np.array(out)

    def ranges(self, keys: np.ndarray) -> np.ndarray:
        return np.array([np.searchsorted(b, k, side="right") for b, k in zip(self.bounds, keys, strict=True)])

    def gaps(self, keys: np.ndarray, other: np.ndarray) -> np.ndarray:
        """(curve, row) quantiles strictly between keys and other; 0 where they are equal."""
        lo, hi = np.minimum(keys, other), np.maximum(keys, other)
        between = [np.searchsorted(s, h, side="left") - np.searchsorted(s, x, side="right") for s, x, h in zip(self.quantiles, lo, hi, strict=True)]
        return np.maximum(0, np.array(between))

    def windows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(curve, row) first and last range that holds keys of a gap up to reach."""
        first, last = [], []
        for s, b, k in zip(self.quantiles, self.bounds, keys, strict=True):
            lo, hi = np.searchsorted(s, k, side="left") - self.reach - 1, np.searchsorted(s, k, side="right") + self.reach
            first.append(np.where(lo < 0, 0, np.searchsorted(b, s[np.maximum(lo, 0)], side="right")))
            last.append(np.where(hi >= len(s), len(b), np.searchsorted(b, s[np.minimum(hi, len(s) - 1)], side="right")))
        return np.array(first), np.array(last)

    def first(self, curves: int, reach: int) -> Index:
        """The first so many curves, with that window."""
        return Index(self.centre, *(x[:curves] for x in self[1:7]), reach)


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, slack: float = 1e-9) -> list[np.ndarray]:
    """For each query the rows that may be among its k nearest: the k by a fast formula, and all within rounding of the last."""
    square = (rows * rows).sum(1)
    out = []
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        own = (q * q).sum(1)[:, None]
        d = own + square[None] - 2 * (q @ rows.T)
        if len(rows) > k:
            last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            out += [np.flatnonzero(x) for x in d <= last + slack * (own + square.max())]
        else:
            out += [np.arange(len(rows))] * len(q)
    return out


def fit(sample: np.ndarray, total: int, curves: int) -> Index:
    """Curves fitted on sampled vectors (one a row) for a table of `total` rows; the window is still 0."""
    rng = np.random.default_rng(17)
    dim, m = sample.shape[1], min(DIMS, sample.shape[1])
    centre = sample.mean(0)
    projections = np.array([np.linalg.qr(rng.normal(size=(dim, m)))[0] for _ in range(curves)])
    placed = np.einsum("nd,cdm->cnm", sample - centre, projections)
    low, span = placed.min(1), np.maximum(placed.max(1) - placed.min(1), 1e-12)
    none = np.zeros((curves, 0), dtype=np.int64)
    index = Index(centre, projections, low, span, rng.random((curves, m)) / 2, none, none, 0)
    quantiles = np.sort(index.keys(sample), axis=1)
    count = int(np.clip(total // RANGE_ROWS, MIN_RANGES, MAX_RANGES))
    bounds = quantiles[:, np.arange(1, count) * len(sample) // count]
    return index._replace(quantiles=quantiles, bounds=bounds)


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of batches put together, up to BATCH_BYTES and a batch more."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches(it):
        held.append((b.column(0).to_numpy(), _matrix(b.column(1))))
        if sum(x.nbytes for _, x in held) >= BATCH_BYTES:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _gaps(index: Index, ids: np.ndarray, asked: np.ndarray, k: int):
    """The k nearest of each asked vector among a task's rows, with their gaps on each curve."""
    own = index.keys(asked)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, np.ndarray]]] = [[] for _ in ids]
        for names, vectors in _blocks(it):
            for q, near in enumerate(nearest(asked, vectors, k + 1)):
                d = np.sqrt(((vectors[near] - asked[q]) ** 2).sum(1))
                pool = best[q] + [(x, int(names[i]), vectors[i].copy()) for x, i in zip(d.tolist(), near, strict=True) if names[i] != ids[q]]
                best[q] = sorted(pool, key=lambda r: r[:2])[:k]
        rows = [(q, *r) for q, found in enumerate(best) for r in found]
        if rows:
            q = np.array([r[0] for r in rows], dtype=np.int32)
            gaps = index.gaps(own[:, q], index.keys(np.array([r[3] for r in rows]))).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(q), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int64()), pa.array(gaps.tolist(), pa.list_(pa.int32()))], names=["q", "score", "vec_id", "gaps"]
            )

    return run


def calibrate(index: Index, rows: DataFrame, ids: np.ndarray, asked: np.ndarray, queries: float, k: int, target: float, choices: tuple[int, ...]) -> Index:
    """The index with the window, and of `choices` the number of curves, that reach `target` of the asked vectors' k nearest with the least work."""
    near = rows.mapInArrow(_gaps(index, ids, asked, k), "q int, score double, vec_id long, gaps array<int>")
    near = near.selectExpr("gaps", "row_number() OVER (PARTITION BY q ORDER BY score, vec_id) AS nth").where(f"nth <= {k}")
    gaps = np.array([r[0] for r in near.select("gaps").collect()])  # CALIBRATE times k rows
    if not len(gaps):
        return index.first(choices[0], 0)
    options = []
    for n in choices:
        reach = int(np.quantile(gaps[:, :n].min(1), target, method="higher"))
        share = min(1.0, (2 * reach + 1) / index.quantiles.shape[1] + 1 / (index.bounds.shape[1] + 1))
        options.append((n * (share * queries + DEAL), n, reach))
    _, n, reach = min(options)
    return index.first(n, reach)


def usable(table: DataFrame) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part."""
    rows = table.selectExpr("CAST(vec_id AS BIGINT) AS vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS vector").where(
        "vec_id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(vector, x -> x <> 0)"
    )
    most = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("vector") == (most["dim"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers from first to last (exclusive) of each pair, and the pair that each is of."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[of], of


def _deal(index: Index, starts: np.ndarray, every: int, kind: str):
    """Rows to (cell, query, vec_id, raw): each row to a cell of its range on each curve, each query to all cells of its windows too.

    starts: the first cell of each range, curve by curve, and the number of cells.
    """
    count = index.bounds.shape[1] + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            ids, vectors = b.column(0).to_numpy(), _matrix(b.column(1))
            keys = index.keys(vectors)
            base = np.arange(len(keys))[:, None] * count
            at = (base + index.ranges(keys)).ravel()
            who = np.tile(np.arange(len(ids)), len(keys))
            # Rows that repeat an id or a vector are dealt in turn.
            cell = starts[at] + (ids[who].astype(np.uint64) * np.uint64(2654435761) % np.uint64(1 << 32) + who.astype(np.uint64)).astype(np.int64) % (starts[at + 1] - starts[at])
            asks = np.flatnonzero(ids % every == 0)
            lo, hi = index.windows(keys[:, asks])
            cells, of = _spread(starts[(base + lo).ravel()], starts[(base + hi + 1).ravel()])
            cell, query = np.concatenate([cell, cells]), np.arange(len(cell) + len(cells)) >= len(cell)
            who = np.concatenate([who, np.tile(asks, len(keys))[of]])
            raw = pa.array([x.tobytes() for x in vectors.astype(kind)], pa.binary())
            step = max(1, BATCH_BYTES // max(1, 8 * vectors.shape[1]))
            for x in range(0, len(who), step):
                y = who[x : x + step]
                yield pa.RecordBatch.from_arrays([pa.array(cell[x : x + step]), pa.array(query[x : x + step]), pa.array(ids[y]), raw.take(pa.array(y))], names=["cell", "query", "vec_id", "raw"])

    return run


def _answers(k: int, kind: str):
    """The k nearest of each query in each cell; rows come by cell, those of the index before the queries."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for b in batches(it):
            cells, ids, asks = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            vectors = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=kind).reshape(len(ids), -1).astype(np.float64)
            edge = np.concatenate([[0], np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1, [len(cells)]])
            out: list[tuple[int, int, float]] = []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if cells[lo] != cell:
                    cell, held = cells[lo], []
                if not asks[lo]:
                    held.append((ids[lo:hi], vectors[lo:hi]))
                elif held:
                    if len(held) > 1:
                        held = [tuple(map(np.concatenate, zip(*held, strict=True)))]
                    names, rows = held[0]
                    # One row more than wanted: the query itself may be among them.
                    for q, v, near in zip(ids[lo:hi].tolist(), vectors[lo:hi], nearest(vectors[lo:hi], rows, k + 1), strict=True):
                        near = near[names[near] != q]
                        d = np.sqrt(((rows[near] - v) ** 2).sum(1))
                        order = np.lexsort((names[near], d))[:k]
                        out += zip([q] * len(order), names[near][order].tolist(), d[order].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def search(table: DataFrame, every: int = 100, k: int = K, curves: tuple[int, ...] = CURVES, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id `every` divides."""
    spark = table.sparkSession
    configure(spark)
    kind = "<f4" if isinstance(table.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    rows = usable(table)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = rows.count()
    ids, vectors = np.array([r["vec_id"] for r in sample]), np.array([r["vector"] for r in sample])
    index = calibrate(fit(vectors, total, max(curves)), rows, ids[:CALIBRATE], vectors[:CALIBRATE], total / every, k, target, curves)
    count = index.bounds.shape[1] + 1

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            at = index.ranges(index.keys(_matrix(b.column(1)))) + np.arange(len(index.bounds))[:, None] * count
            at, n = np.unique(at.ravel(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["at", "n"])

    # One row a curve and range: a bounded number.
    cells = np.ones(len(index.bounds) * count, dtype=np.int64)
    for at, n in rows.mapInArrow(placed, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        cells[at] = -(-n // CELL_ROWS)
    starts = np.concatenate([[0], np.cumsum(cells)])
    dealt = rows.mapInArrow(_deal(index, starts, every, kind), "cell long, query boolean, vec_id long, raw binary")
    dealt = dealt.repartition(width(spark, 2), "cell").sortWithinPartitions("cell", "query")
    found = dealt.mapInArrow(_answers(k, kind), "query_id long, vec_id long, score double")
    # One exchange for both: copies of an answer from several curves, then ranks.
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.selectExpr("query_id", "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank", "vec_id", "score")
    return ranked.where(f"rank <= {k}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
