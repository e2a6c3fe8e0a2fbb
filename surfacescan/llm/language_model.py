"""Language-model scoring by deleted interpolation of trigram, bigram and unigram estimates.

With maximum-likelihood estimates f3 = c(u v w) / c(u v), f2 = c(v w) / c(v), f1 = c(w) / N and
f0 = 1 / (V + 1), each order mixes with the one below it:

    P1 = L1 f1 + (1 - L1) f0,  P2 = L2[c(v)] f2 + (1 - L2) P1,  P3 = L3[c(u v)] f3 + (1 - L3) P2

u and v stand before w (starts before a text's first words); L2 and L3 are looked up by the context's
frequency on a doubling scale and are 0 for a context not seen. Each order's weights come from
expectation-maximisation over a fold of the training documents, counted with that fold deleted from all
counts, lower orders first; scoring uses all training counts. The distribution over words, one unknown
word and the end is proper. Without evidence for a weight, L1 is that of add-0.1 smoothing and L2 and L3
that of the next lower bucket (0 below the first).

Counting and looking up are exchanges of packed keys. Documents go to batches by hash; a batch sends its
distinct unigrams and bigrams (hashes, sorted, delta-coded) with their training counts to the bucket of
each key; a bucket adds up all batches' counts and sends each batch the totals of the keys it asked for,
in the same order. Trigrams follow in a second exchange, and only those that the bigram totals leave
open: a trigram in a training text with a bigram that occurs once in training occurs once itself, and is
asked for only where texts outside training hold both of its bigrams; one with a bigram not seen at all
occurs never. So a frequent n-gram costs one key a batch, every count covers all training documents, and
nothing is broadcast but the weights. What EM needs is a histogram of (bucket, ratio of estimates) for
each order, bounded by its bins.

Scale: key buckets follow the number of batches, so both fit a worker; above GROW bytes of text batches
grow with its root, so that rows of the exchange, batches times buckets, grow in proportion to the text.
Hashes have 26 bits more than the text's byte count, 64 at most. Rows that repeat doc_id and text alike
share a batch.

Cases: a null or empty text is the end alone; a null doc_id is scored, not held out and never learnt
from; repeated rows each give their row and count each; an empty table gives no rows; with nothing to
learn from every token has probability 1; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, materialise, mix, texts, width, word_hashes

#: Folds by crc32 of the doc_id; the held-out one; the training one that weights are learnt on.
FOLDS, HELD_OUT, DELETED = 10, 0, 1
#: Added to every unigram count.
ADD = 0.1
#: Bytes of text in a batch; bytes of all text from which batches grow; fewest key buckets (a power of two).
BATCH_TEXT, GROW, MIN_BUCKETS = 8_000_000, 1 << 40, 16
#: Bits of a key beyond those of the text's byte count.
SPARE_BITS = 26
#: Context-count buckets (doubling), bins of log2 of the ratio (BINS to each doubling, as far as REACH), EM steps.
CONTEXTS, BINS, REACH, STEPS = 40, 8, 40, 300

END, START = np.uint64(0xE0E0E0E0E0E0E0E1), np.uint64(0x5757575757575759)


def fold(doc_id: str = "doc_id") -> str:
    return f"CAST(crc32(CAST(CAST({doc_id} AS STRING) AS BINARY)) % {FOLDS} AS INT)"


# ---------------------------------------------------------------- packing


def _squeeze(x: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unsqueeze(b: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def _fragments(n_batches: int, hold: int = 24_000_000):
    """Rows (batch, fold, doc_id, text) to packed rows of many documents each."""

    def flush(kept: list[tuple]) -> pa.RecordBatch:
        kept.sort(key=lambda r: r[0])
        rows, at = [], 0
        while at < len(kept):
            end = at
            while end < len(kept) and kept[end][0] == kept[at][0]:
                end += 1
            part = kept[at:end]
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(r[3] for r in part))
            rows.append((part[0][0], [r[1] for r in part], [r[2] for r in part], [len(r[3]) for r in part], blob))
            at = end
        kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["batch", "ids", "folds", "sizes", "blob"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for b in batches(it):
            for batch, f, i, x in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3).cast(pa.binary()).to_pylist(), strict=True):
                # Batches from n_batches on hold the deleted fold only.
                kept.append((batch + n_batches * (f == DELETED), i, -1 if f is None else f, x or b""))
                held += len(kept[-1][3]) + 64
            if held > hold:
                yield flush(kept)
                kept, held = [], 0
        if kept:
            yield flush(kept)

    return run


FRAGMENT = "batch int, ids array<long>, folds array<int>, sizes array<long>, blob binary"


class _Batch:
    """A batch's documents as n-gram keys. cur: words and ends; one, two: distinct keys, at1, at2: where each position's is."""

    def __init__(self, table: pa.Table, shift: int):
        flat = lambda name: [x for row in table.column(name).to_pylist() for x in row]
        self.ids, self.folds, sizes = flat("ids"), np.array(flat("folds"), dtype=np.int64), flat("sizes")
        body = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in table.column("blob").to_pylist())
        offsets = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64)))).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        words, bounds = word_hashes(column)
        self.shift = np.uint64(shift)
        self.cur = np.insert(words, bounds[1:], END)
        self.pair = mix(np.insert(words, bounds[:-1], START) * np.uint64(0xD6E8FEB86659FD93) + self.cur)
        self.bounds = bounds + np.arange(len(bounds))
        self.starts, self.tokens = self.bounds[:-1], np.diff(self.bounds)
        self.learns = np.repeat((self.folds >= 0) & (self.folds != HELD_OUT), self.tokens)
        self.one, self.at1 = np.unique(self.cur >> self.shift, return_inverse=True)
        self.two, self.at2 = np.unique(self.pair >> self.shift, return_inverse=True)

    def before(self, x: np.ndarray, first: object) -> np.ndarray:
        """Each position's value at the position before it; `first` where a text starts."""
        out = np.roll(x, 1)
        out[self.starts] = first
        return out

    def ends(self, one: np.ndarray) -> object:
        """The count of ends, which is that of starts, by unigram counts."""
        return one[np.searchsorted(self.one, END >> self.shift)]

    def open(self, two: np.ndarray, outside: np.ndarray) -> None:
        """Find the trigrams whose counts the bigram totals leave open: asked (positions), three (distinct keys), at3."""
        mine, out = two[self.at2], outside[self.at2]
        self.low = np.minimum(mine, self.before(mine, 0))
        self.asked = np.flatnonzero((self.low >= 2) | (self.low == 1) & out & self.before(out, False))
        keys = mix(self.pair[self.asked - 1] * np.uint64(0xA24BAED4963EE407) + self.cur[self.asked]) >> self.shift
        self.three, self.at3 = np.unique(keys, return_inverse=True)

    def trigrams(self, two: np.ndarray, three: np.ndarray, once: int) -> np.ndarray:
        """Each position's trigram count by bigram counts and those of the asked keys; once: that of a training text's own trigram that was not asked for."""
        out = np.where(self.learns & (self.low == 1), once, 0).astype(np.float64)
        out[self.asked] = three[self.at3]
        out[self.starts] = two[self.at2[self.starts]]  # after two starts a word is as frequent as after one
        return out


def _asking(batch: int, order: int, keys: np.ndarray, counts: np.ndarray, outside: np.ndarray, bits: int, log2_buckets: int) -> list[tuple]:
    """Rows (ord, bucket, batch, keys, counts) of distinct sorted keys; counts carry in their lowest bit whether texts outside training hold the key."""
    which = (keys >> np.uint64(bits - log2_buckets)).astype(np.int64)
    cut = np.searchsorted(which, np.arange((1 << log2_buckets) + 1))
    sent = counts.astype(np.uint32) << np.uint32(1) | outside.astype(np.uint32)
    out = []
    for k in np.flatnonzero(cut[1:] > cut[:-1]):
        part = slice(cut[k], cut[k + 1])
        out.append((order, int(k), batch, _squeeze(np.diff(keys[part], prepend=np.uint64(0))), _squeeze(sent[part])))
    return out


ASK = "ord int, bucket int, batch int, keys binary, counts binary"


def _ask_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in ASK.split(", ")])


def _ask(bits: int, log2_buckets: int):
    """A batch's unigrams and bigrams with their training counts, one row an order and key bucket."""

    def run(table: pa.Table) -> pa.Table:
        b, batch, rows = _Batch(table, 64 - bits), table.column("batch")[0].as_py(), []
        for order, keys, at in ((1, b.one, b.at1), (2, b.two, b.at2)):
            count, outside = np.bincount(at, weights=b.learns, minlength=len(keys)), np.bincount(at, weights=~b.learns, minlength=len(keys)) > 0
            rows += _asking(batch, order, keys, count, outside, bits, log2_buckets)
        return _ask_table(rows)

    return run


def _ask_trigrams(bits: int, log2_buckets: int):
    """A batch's open trigrams, in the same form."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _ask_table([])
        b = _Batch(table, 64 - bits)
        two, outside = _totals(answers, 2)
        b.open(two, outside)
        count = np.bincount(b.at3, weights=b.learns[b.asked], minlength=len(b.three))
        return _ask_table(_asking(table.column("batch")[0].as_py(), 3, b.three, count, np.zeros(len(count), dtype=bool), bits, log2_buckets))

    return run


def _answer(n_batches: int):
    """All batches' rows of one key bucket: to each batch the totals of its keys, over all and over the deleted fold; and the bucket's sums as batch -1."""

    def run(table: pa.Table) -> pa.Table:
        order, bucket = table.column("ord")[0].as_py(), table.column("bucket")[0].as_py()
        asked = table.column("batch").to_pylist()
        keys = [np.cumsum(_unsqueeze(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        sent = np.concatenate([_unsqueeze(x, np.uint32) for x in table.column("counts").to_pylist()])
        names, at = np.unique(np.concatenate(keys), return_inverse=True)
        weight = (sent >> np.uint32(1)).astype(np.float64)
        deleted = np.repeat(np.array(asked) >= n_batches, [len(k) for k in keys])
        all_of = np.bincount(at, weights=weight, minlength=len(names)).astype(np.uint64)
        del_of = np.bincount(at, weights=weight * deleted, minlength=len(names)).astype(np.uint64)
        outside = np.bincount(at, weights=sent & np.uint32(1), minlength=len(names)) > 0
        told = all_of << np.uint64(1) | outside.astype(np.uint64)
        rows, p = [], 0
        for batch, k in zip(asked, keys, strict=True):
            mine = at[p : p + len(k)]
            rows.append((batch, order, bucket, _squeeze(told[mine]), _squeeze(del_of[mine]) if batch >= n_batches else None, None, None, None))
            p += len(k)
        rows.append((-1, order, bucket, None, None, int((all_of > 0).sum()), int(all_of.sum()), int(del_of.sum())))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in ANSWER.split(", ")])

    return run


ANSWER = "batch int, ord int, bucket int, totals binary, deleted binary, n_distinct long, n_all long, n_deleted long"


def _parts(answers: pa.Table, order: int, name: str) -> np.ndarray:
    rows = zip(answers.column("ord").to_pylist(), answers.column("bucket").to_pylist(), answers.column(name).to_pylist(), strict=True)
    found = [_unsqueeze(x, np.uint64) for _, x in sorted((k, x) for o, k, x in rows if o == order)]
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


def _totals(answers: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """A batch's totals by its distinct keys of an order, and which of them texts outside training hold."""
    told = _parts(answers, order, "totals")
    return (told >> np.uint64(1)).astype(np.float64), (told & np.uint64(1)).astype(bool)


def _level(count: np.ndarray) -> np.ndarray:
    """The context bucket of a count (at least 1)."""
    return np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), CONTEXTS - 1)


# ---------------------------------------------------------------- the model


class Weights(NamedTuple):
    """The training tokens and words that are counted, L1, and L2 and L3 by context bucket (all zero until learnt)."""

    n: float
    v: int
    one: float = 0.0
    two: np.ndarray = np.zeros(CONTEXTS)
    three: np.ndarray = np.zeros(CONTEXTS)

    def probability(self, order: int, c1: np.ndarray, c2: np.ndarray, x1: np.ndarray, c3: np.ndarray, x2: np.ndarray) -> np.ndarray:
        """P of an order (0: uniform) by the counts of the word, bigram and trigram and of the contexts, x1 (one word) and x2 (two)."""
        p = np.full(len(c1), 1 / (self.v + 1))
        if order >= 1:
            p = (1 - self.one) * p + self.one * c1 / max(self.n, 1)
        for at, weights, c, x in ((2, self.two, c2, x1), (3, self.three, c3, x2)):
            if order >= at:
                w = np.where(x > 0, weights[_level(x)], 0.0)
                p = (1 - w) * p + w * c / np.maximum(x, 1)
        return p


EVIDENCE = "c1 binary, c2 binary, x1 binary, c3 binary, x2 binary"


def _evidence(bits: int):
    """A deleted-fold batch's counts and context counts, position by position, without that fold."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in EVIDENCE.split(", ")]
        if not table.num_rows:
            return pa.table([pa.array([], pa.binary())] * 5, names=names)
        b = _Batch(table, 64 - bits)
        (a1, _), (a2, outside), (a3, _) = (_totals(answers, k) for k in (1, 2, 3))
        one, two, three = (x - _parts(answers, k, "deleted").astype(np.float64) for k, x in ((1, a1), (2, a2), (3, a3)))
        b.open(a2, outside)
        c2 = two[b.at2]
        counts = (one[b.at1], c2, b.before(one[b.at1], b.ends(one)), b.trigrams(two, three, 0), b.before(c2, b.ends(one)))
        return pa.table([pa.array([_squeeze(x.astype(np.uint64))], pa.binary()) for x in counts], names=names)

    return run


def ratio_bins(weights: Weights, order: int, counts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of each position whose context was seen: the context bucket, and the bin of the order's estimate over the lower order's probability."""
    c, x = {1: (counts[0], np.full(len(counts[0]), weights.n)), 2: (counts[1], counts[2]), 3: (counts[3], counts[4])}[order]
    seen = x > 0
    ratio = c[seen] / x[seen] / weights.probability(order - 1, *(k[seen] for k in counts))
    with np.errstate(divide="ignore"):
        bins = np.where(ratio > 0, np.clip(np.round(np.log2(ratio) * BINS), -REACH * BINS, REACH * BINS), -REACH * BINS - 1).astype(np.int64)
    return _level(x[seen]) if order > 1 else np.zeros(len(bins), dtype=np.int64), bins


def _histogram(weights: Weights, order: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                level, bins = ratio_bins(weights, order, tuple(_unsqueeze(x, np.uint64).astype(np.float64) for x in row))
                code, count = np.unique(level * 4096 + bins + 2048, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code // 4096), pa.array(code % 4096 - 2048), pa.array(count)], names=["level", "bin", "n"])

    return run


def mixture_weights(rows: list[tuple[int, int, int]], first: float = 0.0, steps: int = STEPS) -> np.ndarray:
    """The higher order's weight of each context bucket by expectation-maximisation over rows (bucket, bin, how often); buckets without data take the next lower one's (`first` below them)."""
    out = np.zeros(CONTEXTS)
    for level in range(CONTEXTS):
        mine = np.array([(b, n) for at, b, n in rows if at == level], dtype=np.float64).reshape(-1, 2)
        if not len(mine):
            out[level] = out[level - 1] if level else first
            continue
        x = np.where(mine[:, 0] < -REACH * BINS, 0.0, np.exp2(mine[:, 0] / BINS))
        w = 0.5
        for _ in range(steps):
            w = float((mine[:, 1] * (w * x / (w * x + 1 - w))).sum() / mine[:, 1].sum())
            w = min(w, 0.999999)
        out[level] = w
    return out


def learn(n: float, v: int, histogram) -> Weights:
    """All weights, lower orders first; histogram(weights so far, order) gives rows (bucket, bin, how often)."""
    w = Weights(n, v)
    w = w._replace(one=float(mixture_weights(histogram(w, 1), n / (n + ADD * (v + 1)))[0]))
    w = w._replace(two=mixture_weights(histogram(w, 2)))
    return w._replace(three=mixture_weights(histogram(w, 3)))


def _scored(bits: int, weights: Weights):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in _SCORE_KINDS], names=_SCORE_NAMES)
        b = _Batch(table, 64 - bits)
        (one, _), (two, outside), (three, _) = (_totals(answers, k) for k in (1, 2, 3))
        b.open(two, outside)
        c1, c2, n = one[b.at1], two[b.at2], weights.n
        p = weights.probability(3, c1, c2, b.before(c1, b.ends(one)), b.trigrams(two, three, 1), b.before(c2, b.ends(one)))
        p1 = (c1 + ADD) / (n + ADD * (weights.v + 1))
        add = lambda x: np.add.reduceat(x, b.starts)
        columns = (b.ids, b.folds == HELD_OUT, b.tokens, add((c1 > 0).astype(np.int64)), np.full(len(b.ids), int(n)), add(np.log10(p1)), add(np.log10(p)))
        return pa.table([pa.array(x, t) for x, t in zip(columns, _SCORE_KINDS, strict=True)], names=_SCORE_NAMES)

    return run


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORE_NAMES = [x.split()[0] for x in SCORE.split(", ")]
_SCORE_KINDS = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())


def score(docs: DataFrame, batch_text: int = BATCH_TEXT) -> DataFrame:
    """One row per row of docs: SCORE, all logarithms to base 10."""
    spark = docs.sparkSession
    rows = texts(docs)
    size = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    size = (size[0] or 0) + 16 * size[1]
    n_batches = max(1, math.ceil(size / (batch_text * max(1.0, size / GROW) ** 0.5)))
    log2_buckets = max(MIN_BUCKETS, 2 * n_batches).bit_length() - 1
    bits = min(64, max(log2_buckets, size.bit_length()) + SPARE_BITS)
    keyed = rows.selectExpr(f"CAST(pmod(xxhash64(doc_id, text), {n_batches}) AS INT) AS batch", f"{fold()} AS fold", "doc_id", "text")
    packed = keyed.mapInArrow(_fragments(n_batches), FRAGMENT)
    n = max(width(spark), 2 * n_batches)  # tasks follow the text's size, so that each holds a batch or two

    def answered(asked: DataFrame, tag: str) -> DataFrame:
        return materialise(asked.repartition(n, "ord", "bucket").groupBy("ord", "bucket").applyInArrow(_answer(n_batches), ANSWER), tag)

    def beside(parts: DataFrame, answers: DataFrame):
        return parts.repartition(n, "batch").groupBy("batch").cogroup(answers.repartition(n, "batch").groupBy("batch"))

    first = answered(packed.repartition(n, "batch").groupBy("batch").applyInArrow(_ask(bits, log2_buckets), ASK), "lm-answers")
    sums = first.where("batch = -1 AND ord = 1").agg(F.sum("n_distinct"), F.sum("n_all"), F.sum("n_deleted")).first()
    v, total, gone = (int(x or 0) for x in sums)
    known = first.where("batch >= 0").select("batch", "ord", "bucket", "totals")
    asked = beside(packed, known.where("ord = 2")).applyInArrow(_ask_trigrams(bits, log2_buckets), ASK)
    second = answered(asked, "lm-trigrams")

    told = first.unionByName(second).where("batch >= 0").select("batch", "ord", "bucket", "totals", "deleted")
    aside = beside(packed.where(f"batch >= {n_batches}"), told.where(f"batch >= {n_batches}"))
    evidence = materialise(aside.applyInArrow(_evidence(bits), EVIDENCE), "lm-evidence")

    def histogram(weights: Weights, order: int) -> list[tuple[int, int, int]]:
        return [tuple(r) for r in evidence.mapInArrow(_histogram(weights, order), "level long, bin long, n long").groupBy("level", "bin").agg(F.sum("n")).collect()]

    weights = learn(float(total - gone), v, histogram)._replace(n=float(total))
    return beside(packed, told.drop("deleted")).applyInArrow(_scored(bits, weights), SCORE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
