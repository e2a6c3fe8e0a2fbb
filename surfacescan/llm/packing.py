"""Best-fit packing of tokenised documents by a configuration linear program over the length histogram.

Documents become token ids and, where they are longer than a sequence, pieces. Only the histogram of
piece lengths (one row a length) reaches the driver. There a fractional cover of the histogram by
configurations (multisets of lengths that fit one sequence) is found by multiplicative weights: each
round prices lengths by how little they are covered so far and a knapsack dynamic program over the
capacity finds, for every length, the best configuration that holds it; the near-best ones are added.
The cover is rounded, what is left over is solved again and at last packed greedily, at every size; a
plain greedy packing is made beside it and taken only where it needs fewer sequences. The rounded plan
names, for each length, runs of ranks and where they go; pieces are ranked inside their length in two
levels (a length may hold a third of all rows) and look up their place.

Tokenising is cached by stretch (white space and the word after it): pieces of the split pattern never
cross from a word into white space, so stretches tokenise alone as they do in the text. Texts with
white space beyond ASCII are tokenised whole.

Cases: a null or empty text is one piece holding the end id alone; a null doc_id is packed as any
other; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import IS_SPACE, batches, hash_spans, joined, materialise, portions, release, texts

#: Tokens in a sequence; the id that ends a document; buckets of the ranking inside a length.
LENGTH, END, BUCKETS = 2048, 0, 256
#: Rounds of weights a solve, cover added in a round, cover per e-fold of a weight, share of the best value that a configuration needs, and solves.
ROUNDS, STEP, PULL, NEAR, SOLVES = 100, 0.1, 10.0, 0.97, 4
#: Stretches that a worker keeps tokenised, before it starts anew.
CACHED = 250_000
#: Bytes of text tokenised at a time: its words' places and hashes take some twenty times as much.
TEXT_BYTES = 2 << 20

_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: A stretch that ends in white space: it would merge with the white space of a stretch set after it.
_OPEN_END = re.compile(rb"(?:[ \t\n\r\f\v]|" + _WIDE_SPACE.pattern + rb")\Z")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _compiled(path: str):
    """The tokenizer file's byte-pair merges as a tiktoken encoding, which gives the same ids several times faster; None unless the file is a
    byte-level BPE whose ids follow its merge order and whose text is split by the usual pattern."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or spec.get("normalizer"):
        return None
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    signs, special = _byte_signs(), {t["content"] for t in spec.get("added_tokens", [])}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(ids) or len(set(ids)) != len(ids):
        return None
    ranks = {bytes(signs[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    if len(ranks) != 256 + len(ids) or max(ranks[bytes([b])] for b in range(256)) > ids[0]:
        return None
    return tiktoken.Encoding("compiled", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of many texts at a time."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.compiled = _compiled(path)
        if self.compiled:
            self.bytes = np.array([len(x) for x in sorted(self.compiled._mergeable_ranks, key=self.compiled._mergeable_ranks.get)])
            if sorted(self.compiled._mergeable_ranks.values()) != list(range(len(self.bytes))):
                self.compiled = None
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.first, self.count = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.flat, self.used = np.zeros(4096, dtype=np.uint32), 0

    def encode(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(strings, add_special_tokens=False)]

    def _learn(self, hashes: list[int], spans: list[bytes]) -> None:
        """Tokenise stretches that end in words end to end: each begins where a word before it ends, so the split is that of the stretch alone, and a token's bytes tell whose it is."""
        if not hashes:
            return
        if self.compiled:
            ids = np.array(self.compiled.encode_ordinary(b"".join(spans).decode("utf-8", "replace")), dtype=np.uint32)
            to, ends = np.cumsum(self.bytes[ids]), np.cumsum([len(s) for s in spans])
            count = np.diff(np.searchsorted(to, ends, side="left") + 1, prepend=0)
            if to[-1] != ends[-1] or not np.isin(ends, to).all():  # text that is not UTF-8, or a token across a border
                ids, count = self._one_by_one(spans)
        else:
            ids, count = self._one_by_one(spans)
        at, n = len(self.slots), len(hashes)
        self.slots.update(zip(hashes, range(at, at + n), strict=True))
        while at + n > len(self.first):
            self.first, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[at : at + n], self.count[at : at + n] = self.used + np.cumsum(count) - count, count
        self.used += len(ids)

    def _one_by_one(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode([s.decode("utf-8", "replace") for s in spans])
        return np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64)

    def documents(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, END last."""
        buf, starts = joined(column, lower=False)
        raw = buf.tobytes()
        n = len(starts) - 1
        ends = starts[1:] - 1
        whole = {k for k in range(n) if _WIDE_SPACE.search(raw, starts[k], ends[k])} if _WIDE_SPACE.search(raw) else set()
        space = IS_SPACE[buf]
        opens = np.zeros(len(buf) + 1, dtype=bool)
        opens[1 : len(buf)] = space[1:] & ~space[:-1]
        opens[ends] = False
        opens[starts[:-1][starts[:-1] < ends]] = True
        at = np.flatnonzero(opens)
        owner = np.repeat(np.arange(n), np.diff(np.searchsorted(at, starts)))
        to = np.minimum(np.append(at[1:], len(buf)), ends[owner])
        hashes = hash_spans(buf, at, to)
        names, pick, where = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slots) + len(names) > CACHED:
            self._clear()
        known = names.tolist()
        new = [i for i, x in enumerate(map(self.slots.get, known)) if x is None]
        first, last = at[pick[new]], to[pick[new]]
        spans = [raw[x:y] for x, y in zip(first.tolist(), last.tolist(), strict=True)]
        # A text's first stretch may lack the white space that keeps it apart from the one before, and its last may be
        # white space that runs into the one after: those go alone.
        apart = space[first] & np.array([not _OPEN_END.search(s, max(0, len(s) - 3)) for s in spans], dtype=bool)
        self._learn([known[i] for i, x in zip(new, apart, strict=True) if x], [t for t, x in zip(spans, apart, strict=True) if x])
        for i in np.flatnonzero(~apart):
            self._learn([known[new[i]]], [spans[i]])
        slot = np.fromiter(map(self.slots.__getitem__, known), dtype=np.int64, count=len(known))[where]
        size = self.count[slot]
        done = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.first[slot] - done[:-1], size) + np.arange(done[-1])] if len(slot) else self.flat[:0]
        bounds = done[np.searchsorted(at, starts)]
        for k in range(n):
            one = np.array(self.encode([raw[starts[k] : ends[k]].decode("utf-8", "replace")])[0], dtype=np.uint32) if k in whole else ids[bounds[k] : bounds[k + 1]]
            yield np.append(one, np.uint32(END)).astype("<u4")


_encoders: dict[str, Encoder] = {}


def cuts(n: int, length: int) -> list[int]:
    """Starts of the pieces of n tokens: full ones at the end, the first takes the rest."""
    return [0] if n <= length else [0, *range(n % length or length, n, length)]


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row. tokenizer: a path on the executors."""
    path = tokenizer or default_tokenizer()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        encoder = _encoders.setdefault(path, None) or Encoder(path)
        _encoders[path] = encoder
        for b in batches(it):
            out = []
            for x, y in portions(b.column(1), TEXT_BYTES):
                for i, ids in zip(b.column(0)[x:y].to_pylist(), encoder.documents(b.column(1)[x:y]), strict=True):
                    at = [*cuts(len(ids), length), len(ids)]
                    out += [(i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return texts(docs).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- the plan

Config = tuple[tuple[int, int], ...]  # (length, how many), longest first


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each capacity, and the length taken last (0: one unit left empty). value[l]: of an item of length l (-inf: none)."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        tried = value[1 : c + 1] + best[c - 1 :: -1] if c > 1 else value[1:2] + best[0]
        i = int(tried.argmax())
        if tried[i] > best[c - 1]:
            best[c], took[c] = tried[i], i + 1
        else:
            best[c] = best[c - 1]
    return best, took


def _filled(first: int, took: np.ndarray, capacity: int) -> Config:
    found, c = {first: 1}, capacity - first
    while c > 0:
        if took[c]:
            found[int(took[c])] = found.get(int(took[c]), 0) + 1
            c -= int(took[c])
        else:
            c -= 1
    return tuple(sorted(found.items(), reverse=True))


def solve(need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[Config, float]:
    """A fractional cover of need[l] items of each length by configurations, covered once on average.

    A length's weight starts as its tokens and falls exponentially with how far it is covered, against
    the mean; its price is the weight over its count. A round adds the near-best configurations in turn, each up to STEP of its scarcest length,
    passing over those that hold a length already added to in the round, so no price is used twice.
    """
    lengths = np.flatnonzero(need)
    covered = np.zeros(capacity + 1)
    size = need * np.arange(capacity + 1)
    use: dict[Config, float] = {}
    for _ in range(rounds):
        price = np.full(capacity + 1, -np.inf)
        mean = (covered * size).sum() / size.sum()
        price[lengths] = lengths / capacity * np.exp(np.clip(mean - covered[lengths], -2, 2) / PULL)
        best, took = knapsack(price, capacity)
        worth = price[lengths] + best[capacity - lengths]
        touched = np.zeros(capacity + 1, dtype=bool)
        for at in np.argsort(-worth, kind="stable"):
            if worth[at] < NEAR * worth.max():
                break
            if touched[lengths[at]]:
                continue
            config = _filled(int(lengths[at]), took, capacity)
            if any(touched[x] for x, _ in config):
                continue
            amount = STEP * min(need[x] / k for x, k in config)
            use[config] = use.get(config, 0.0) + amount
            for x, k in config:
                touched[x] = True
                covered[x] += k * amount / need[x]
    level = max((covered * size).sum() / size.sum(), 1e-9)
    return {c: x / level for c, x in use.items()}


def greedy(left: np.ndarray, capacity: int) -> list[tuple[Config, int]]:
    """Longest first, each filled with the longest that still fit; equal sequences are made together."""
    left, out = left.copy(), []
    present = [int(x) for x in np.flatnonzero(left)[::-1]]
    while present:
        room, config = capacity, []
        for x in present:
            if x <= room:
                k = min(room // x, int(left[x]))
                config.append((x, k))
                room -= k * x
                if not room:
                    break
        times = min(int(left[x]) // k for x, k in config)
        for x, k in config:
            left[x] -= times * k
        out.append((tuple(config), times))
        present = [x for x in present if left[x]]
    return out


def program(need: np.ndarray, capacity: int) -> list[tuple[Config, int]]:
    """The rounded linear program: whole parts of the cover, then its configurations once more each, by their fractions, where they still fit; what is left is solved again and at last packed greedily."""
    left, out = need.astype(np.int64).copy(), []
    for _ in range(SOLVES):
        if not left.any():
            break
        before = left.sum()
        cover = solve(left.astype(float), capacity)
        for fraction in (False, True):
            for config, x in sorted(cover.items(), key=lambda kv: (-(kv[1] % 1 if fraction else kv[1]), kv[0])):
                most = min(int(left[a]) // k for a, k in config)
                times = min(most, 1 if fraction else int(x))
                if times > 0 and (not fraction or sum(a * k for a, k in config) == capacity):
                    out.append((config, times))
                    for a, k in config:
                        left[a] -= times * k
        if left.sum() > 0.9 * before:
            break
    return out + greedy(left, capacity)


def packings(need: np.ndarray, capacity: int) -> dict[str, list[tuple[Config, int]]]:
    """Both packings, of which plan() takes the one with fewer sequences (the program's if they are equal)."""
    return {"program": program(need, capacity), "greedy": greedy(need.astype(np.int64), capacity)}


def plan(need: np.ndarray, capacity: int) -> list[tuple[Config, int]]:
    """(configuration, times) that pack exactly need[l] items of each length."""
    return min(packings(need, capacity).values(), key=lambda p: sum(t for _, t in p))


def places(chosen: list[tuple[Config, int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, per sequence, offset), by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for config, times in chosen:
        offset = 0
        for x, k in config:
            rows.append((x, rank.get(x, 0), sequence, k, offset))
            rank[x] = rank.get(x, 0) + k * times
            offset += k * x
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, buckets: int = BUCKETS) -> DataFrame:
    """Every piece with its sequence and offset: PIECES, sequence_id, offset."""
    rows = materialise(pieces(docs, tokenizer, length), "pieces")
    rows = rows.selectExpr("*", f"CAST(pmod(xxhash64(doc_id, piece, ids_crc32), {buckets}) AS INT) AS bucket")
    counts = rows.groupBy("length", "bucket").count()
    need = np.zeros(length + 1, dtype=np.int64)
    for x, n in counts.groupBy("length").agg({"count": "sum"}).collect():  # one row a length: `length` rows at most
        need[x] = n
    table = docs.sparkSession.sparkContext.broadcast(places(plan(need, length)))
    ahead = counts.selectExpr(
        "length AS a_length", "bucket AS a_bucket",
        "sum(count) OVER (PARTITION BY length ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count AS ahead",
    )
    ranked = rows.selectExpr("*", "row_number() OVER (PARTITION BY length, bucket ORDER BY doc_id, piece, ids_crc32) - 1 AS inside")
    ranked = ranked.join(ahead, (ranked.length == ahead.a_length) & (ranked.bucket == ahead.a_bucket)).selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "ahead + inside AS rank")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = t[:, 0] << 44 | t[:, 1]
        for b in batches(it):
            x, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            row = t[np.searchsorted(key, x << 44 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * x)],
                names=[*b.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
