"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams, hashed to a fixed number of slots (byte trigrams of the whole text, words, word
pairs, and runs of one to four of the words' pattern, in which a word is only "the one before again" or
not), are scaled by the log ratio of their smoothed counts in the two classes; a linear hinge-loss model
over the scaled, length-normalised indicators is fitted by dual coordinate descent; its margins become
probabilities by a logistic fit on labelled rows kept aside from the descent.

The fit reads a bounded sample: of the labelled rows that may be learnt from, the `sample` ones with the
smallest hashes of their doc_id, in that order as far as they hold `budget` indicators in all (a text
has 2 ** SLOTS_LOG2 at most, however long). One executor task fits; only the model, an array of fixed
size, comes to the driver. The scoring pass is map only, reads every whole text, and ships the weights.

Cases: a null or empty text has no indicators and gets the score of the bias alone; a null doc_id is
scored, not held out and never learnt from; labels that are null are left out, several labels of a
document each count; without labels of both classes every score is the smoothed share of label 1;
repeated rows each give their row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, IS_SPACE, batches, hash_spans, mapped, mix, runs, texts

#: Slots of the hashed indicators; most labelled rows in the fit, and most indicators of all of them (four bytes each).
SLOTS_LOG2, SAMPLE, BUDGET = 18, 8000, 24_000_000
#: Longest run of the words' pattern.
PATTERN = 4
#: Count smoothing, hinge penalty, passes of the descent; every CALIBRATE-th sampled row calibrates.
ALPHA, PENALTY, EPOCHS, CALIBRATE = 1.0, 1.0, 12, 4
#: Score from which a document counts as good.
KEEP = 0.7

_SLOTS = 1 << SLOTS_LOG2
_SHIFT = np.uint64(64 - SLOTS_LOG2)


def pattern(words: np.ndarray) -> np.ndarray:
    """Codes of the runs of 1 to PATTERN words' pattern: whether each is the word before it again."""
    again = np.concatenate(([False], words[1:] == words[:-1]))[: len(words)].astype(np.uint64)
    out, code = [], np.ones(len(words), dtype=np.uint64)
    for k in range(min(PATTERN, len(words))):
        code = code[: len(words) - k] * np.uint64(2) + again[k:]
        out.append(np.unique(code))
    return np.concatenate(out) + np.uint64(1 << 20) if out else np.empty(0, dtype=np.uint64)


def indicators(text: bytes, flags: np.ndarray) -> np.ndarray:
    """The sorted slots of the text's n-grams. flags: a zeroed scratch array of _SLOTS, left zeroed."""
    raw = np.frombuffer(text, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.int64)
    for at in range(0, len(raw), BATCH_BYTES):  # a very long text in pieces that overlap by two bytes
        b = raw[at : at + BATCH_BYTES + 2].astype(np.uint64)
        if len(b) > 2:
            flags[((b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15) >> _SHIFT).astype(np.int64)] = True
    low = np.frombuffer(text.lower(), dtype=np.uint8)
    words = hash_spans(low, *runs(~IS_SPACE[low]))
    flags[(words >> _SHIFT).astype(np.int64)] = True
    if len(words) > 1:
        flags[(mix(words[:-1] * np.uint64(3) + words[1:]) >> _SHIFT).astype(np.int64)] = True
    flags[(mix(pattern(words)) >> _SHIFT).astype(np.int64)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


class Model(NamedTuple):
    """weights: of the slots, ratios included; margin = weights over the indicators / root of their count + bias."""

    weights: np.ndarray | None
    bias: float
    slope: float
    offset: float  # without weights: the log odds of label 1

    def score(self, found: np.ndarray) -> float:
        margin = 0.0 if self.weights is None else float(self.weights[found].sum()) / max(1.0, len(found)) ** 0.5 + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50))))


def descend(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, penalty: np.ndarray, epochs: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Dual coordinate descent for the hinge loss over rows ratio[found] / sqrt(len): weights (ratio included), bias (a weight of a constant 1) and the dual variables."""
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    scale = np.array([1 / max(1.0, len(x)) ** 0.5 for x in rows])
    square = np.array([ratio[x] @ ratio[x] * c * c + 1.0 for x, c in zip(rows, scale, strict=True)])
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x = rows[i]
            v = ratio[x] * scale[i]
            step = alpha[i] - (signs[i] * (w[x] @ v + bias) - 1) / square[i]
            new = min(max(step, 0.0), penalty[i])
            change = (new - alpha[i]) * signs[i]
            if change:
                alpha[i] = new
                w[x] += change * v
                bias += change
                moved = max(moved, abs(change))
        if moved < 1e-4:
            break
    return w * ratio, bias, alpha


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton steps, with smoothed targets and a light pull to slope 1."""
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -50, 50)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum() + 1e-3 * b])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margins**2).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Of each slot the log of its smoothed share of label 1's indicators over that of label 0's."""
    counts = np.full((2, _SLOTS), ALPHA)
    for x, y in zip(rows, labels, strict=True):
        counts[y, x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on indicators and labels 0/1."""
    up = int(labels.sum())
    if up in (0, len(labels)):
        return Model(None, 0.0, 1.0, float(np.log((up + 1) / (len(labels) - up + 1))))
    ratio = log_ratios(rows, labels)
    aside = np.arange(len(rows)) % CALIBRATE == CALIBRATE - 1
    if len(set(labels[aside])) < 2 or len(set(labels[~aside])) < 2:
        aside[:] = False
    signs = np.where(labels == 1, 1.0, -1.0)
    penalty = np.where(labels == 1, PENALTY * len(labels) / (2 * up), PENALTY * len(labels) / (2 * (len(labels) - up)))
    pick = np.flatnonzero(~aside)
    weights, bias, _ = descend([rows[i] for i in pick], signs[pick], ratio, penalty[pick], EPOCHS)
    use = np.flatnonzero(aside) if aside.any() else pick
    margins = np.array([weights[rows[i]].sum() / max(1.0, len(rows[i])) ** 0.5 + bias for i in use])
    return Model(weights.astype(np.float32), bias, *logistic(margins, labels[use]))


def fold(doc_id: str = "doc_id") -> str:
    """Spark SQL: the fold of a document, 0 to 3 (null for a null doc_id)."""
    return f"crc32(CAST(CAST({doc_id} AS STRING) AS BINARY)) % 4"


MODEL = "weights binary, bias double, slope double, offset double"


def _train(budget: int):
    """Rows (order, doc_id, label, found), sorted: one row, the model."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, labels, held = [], [], 0
        for b in batches(it):
            for label, raw in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                held += len(raw) // 4
                if held <= budget:
                    found.append(np.frombuffer(raw, dtype="<i4"))
                    labels.append(label)
        order = np.random.default_rng(5).permutation(len(found))
        m = fit_rows([found[i] for i in order], np.array([labels[i] for i in order], dtype=np.int64))
        weights = None if m.weights is None else m.weights.astype("<f4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([weights], pa.binary()), *(pa.array([float(x)]) for x in m[1:])], names=[x.split()[0] for x in MODEL.split(", ")])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, budget: int = BUDGET) -> Model:
    """Fit on the labelled rows outside fold 2."""
    known = labels.selectExpr("CAST(doc_id AS BIGINT) AS l_doc", "CAST(quality AS INT) AS label").where(f"label IN (0, 1) AND {fold('l_doc')} <> 2")
    known = known.orderBy(F.xxhash64("l_doc"), "l_doc", "label").limit(sample)  # at most `sample` rows of 12 bytes
    rows = texts(docs).join(F.broadcast(known), F.col("doc_id") == F.col("l_doc")).select("doc_id", "text", "label")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(_SLOTS, dtype=bool)
        for b in batches(it):
            found = [indicators(x or b"", flags).astype("<i4").tobytes() for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary())], names=["doc_id", "label", "found"])

    found = rows.mapInArrow(run, "doc_id long, label int, found binary").selectExpr("xxhash64(doc_id) AS at", "doc_id", "label", "found")
    got = found.repartition(1).sortWithinPartitions("at", "doc_id", "label", "found").mapInArrow(_train(budget), MODEL).first()
    if got is None:  # no partition at all: nothing to learn from
        return fit_rows([], np.empty(0, dtype=np.int64))
    return Model(None if got["weights"] is None else np.frombuffer(got["weights"], dtype="<f4"), *got[1:])


def _scores(model: Model, column: pa.Array, flags: np.ndarray) -> np.ndarray:
    return np.array([model.score(indicators(x or b"", flags)) for x in column.cast(pa.binary()).to_pylist()])


def score(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. how: sample and budget of the fit."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(_SLOTS, dtype=bool)
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(model.value, b.column(1), flags))], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double").selectExpr(
        "doc_id", f"coalesce({fold()} = 2, false) AS held_out", "score", f"CAST(score >= {KEEP} AS INT) AS predicted")


def kept(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that score KEEP or more, columns as they are. how: sample and budget of the fit."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(_SLOTS, dtype=bool)
        for b in batches(it):
            yield b.filter(pa.array(_scores(model.value, b.column(at), flags) >= KEEP))

    return mapped(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
