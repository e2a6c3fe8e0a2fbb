"""Phrase collocation mining: n-grams as rows, counted per language, scored, and thinned by their extensions.

A-Z is lowered; texts fall into pieces at PIECE_ENDS and these into words at spaces and tabs. Every n-gram
of 1 to MAX_N words of a piece becomes a DataFrame row (lang, phrase, n) and is counted by a hash
aggregation per language. Phrases of two words and more with LEAST occurrences are candidates: each cut of
a candidate joins the counts of its two parts and is scored in decimal arithmetic; the lowest-scoring cut
counts. Candidates with a one-word extension of SHARE percent of their occurrences go by an anti-join: a
longer phrase never occurs more often than what it holds, so a candidate within any longer one that is
frequent enough lies within such an extension too. A window ranks the rest of each language.

A phrase is never more frequent than its parts, so rows are only made of n-grams whose words (for two
words) and word pairs (for more) are frequent: whatever is left out has fewer than LEAST occurrences, and
no count changes. Tasks look up frequent parts in a bitmap of hashes, which follows their number up to
MOST_BITS (16 MB). Hashes that meet there, and beyond about 30 million frequent parts the bitmap's fullness,
let further n-grams through, up to all of them: that costs shuffled rows, never a result. Rows are
counted within a batch of texts, exactly, before Spark counts them in each task and then by key.

Cases: a null text is empty, a null language `und`; null doc_ids and repeated rows count as any other;
texts and tables without words give no rows; other columns are ignored. A batch of rows bounds the memory,
a single text its own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, configure, hash_spans, joined, materialise, mix, runs

#: Words of the longest phrase, occurrences of a candidate, percent of them at which an extension takes its place, phrases reported of a language.
MAX_N, LEAST, SHARE, TOP = 4, 30, 80, 2000
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Bits for each frequent part, and bits at most (a power of two).
BITS_EACH, MOST_BITS = 32, 1 << 27
#: Rows of one outgoing batch; parts of a language that are ranked on their own before its best are.
OUT_ROWS, SHARES = 50_000, 16

_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(PIECE_ENDS)] = True
_GAPS = _ENDS.copy()
_GAPS[[9, 32]] = True

ROWS = "lang string, phrase string, n long"


def _hashes(words: pa.StringArray) -> np.ndarray:
    """A hash of each string of an array without offset."""
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[: len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8) if words.buffers()[2] else np.empty(0, dtype=np.uint8)
    return hash_spans(data, ends[:-1], ends[1:])


def _chained(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and a word after it."""
    return mix(head * np.uint64(0xD6E8FEB86659FD93) + word)


def _lang_hashes(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs], dtype=np.uint64)


class Marks:
    """Which phrases are frequent, by the hash of language and phrase; all without bits."""

    def __init__(self, bits: np.ndarray | None) -> None:
        self.bits = bits

    def __call__(self, phrase: np.ndarray, lang: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(phrase), dtype=bool)
        at = place(phrase, lang, len(self.bits) * 8)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def place(phrase: np.ndarray, lang: np.ndarray, bits: int) -> np.ndarray:
    return (mix(phrase ^ lang) & np.uint64(bits - 1)).astype(np.int64)


class Words:
    """The words of a batch of texts: code (into `names`), language (into `langs`) and piece of each, and their hashes."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        buf, starts = joined(texts)
        gap = _GAPS[buf]
        first, last = runs(~gap)
        lens = last - first
        ends = np.zeros(len(first) + 1, dtype=np.int32)
        np.cumsum(lens, out=ends[1:])
        spelt = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(buf[~gap])).dictionary_encode()
        self.code, self.names = spelt.indices.to_numpy(zero_copy_only=False).astype(np.int64), spelt.dictionary
        self.piece = np.cumsum(_ENDS[buf], dtype=np.int32)[first]
        known = langs.dictionary_encode()
        self.langs = known.dictionary
        self.lang = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)[np.searchsorted(starts, first, side="right") - 1]
        self.hash = _hashes(self.names)[self.code]
        self.lang_hash = _lang_hashes(self.langs.to_pylist())[self.lang] if len(self.lang) else np.empty(0, dtype=np.uint64)

    def starts(self, n: int) -> np.ndarray:
        """Where n words of one piece begin."""
        m = len(self.code) - n + 1
        return np.flatnonzero(self.piece[:m] == self.piece[n - 1 :]) if m > 0 else np.empty(0, dtype=np.int64)

    def counted(self, at: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        """The distinct n-grams at the positions, with their counts."""
        key = self.lang[at]
        for k in range(n):
            if k > 1:  # so that the next word fits in
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(self.names) + self.code[at + k]
        _, one, count = np.unique(key, return_index=True, return_counts=True)
        for k in range(0, len(one), OUT_ROWS):
            p = at[one[k : k + OUT_ROWS]]
            spelt = [self.names.take(pa.array(self.code[p + j])) for j in range(n)]
            phrase = spelt[0] if n == 1 else pc.binary_join_element_wise(*spelt, " ")
            yield pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[p])), phrase, pa.array(count[k : k + OUT_ROWS])], names=["lang", "phrase", "n"])


def _exploded(sizes: tuple[int, ...], marks) -> object:
    """Rows (lang, phrase, n) of the n-grams of the sizes in each batch. marks: broadcast Marks of the words (for pairs), of pairs (for more), else None. With single words goes their number, as the phrase ''."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            w = Words(b.column(0), b.column(1))
            if sizes == (1,):
                n = np.bincount(w.lang, minlength=len(w.langs))
                yield pa.RecordBatch.from_arrays([w.langs, pa.array([""] * len(n)), pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"])
                yield from w.counted(np.arange(len(w.code)), 1)
                continue
            part = max(1, min(sizes) - 1)  # words of a marked part
            at = w.starts(part)
            h = w.hash[at] if part == 1 else _chained(w.hash[at], w.hash[at + 1])
            held = np.zeros(len(w.code) + max(sizes), dtype=bool)
            held[at] = marks.value(h, w.lang_hash[at])
            for n in sizes:
                at = w.starts(n)
                for k in range(n - part + 1):
                    at = at[held[at + k]]
                yield from w.counted(at, n)

    return run


def _marks(frequent: DataFrame):
    """The broadcast bitmap of a table of frequent phrases (lang, phrase) of one or two words each."""
    spark = frequent.sparkSession
    bits = 1 << 15
    count = frequent.count()
    while bits < min(MOST_BITS, count * BITS_EACH):
        bits *= 2

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            spelt = pc.split_pattern(b.column(1), " ")
            words = pa.concat_arrays([spelt.flatten()])
            ends = np.cumsum(pc.list_value_length(spelt).to_numpy())
            h = _hashes(words)
            first = np.concatenate(([0], ends[:-1]))
            h = np.where(ends - first == 1, h[first], _chained(h[first], h[ends - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(place(h, _lang_hashes(b.column(0).to_pylist()), bits))], names=["at"])

    found = frequent.select("lang", "phrase").mapInArrow(run, "at long").selectExpr("at DIV 32768 AS block", "at % 32768 AS bit").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in found.collect():  # MOST_BITS at most
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return spark.sparkContext.broadcast(Marks(out))


def counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, n of all phrases of 1 to MAX_N words that occur `least` times; and of the phrase '', n being all words of the language."""
    configure(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    out, marks = None, None
    for sizes in ((1,), (2,), (3, 4)):
        found = rows.mapInArrow(_exploded(sizes, marks), ROWS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        found = materialise(found.where(f"n >= {least} OR phrase = ''"), "phrases")
        out = found if out is None else out.unionByName(found)
        if sizes != (3, 4):
            marks = _marks(found.where("phrase <> ''"))
    return out


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases; top: None for all."""
    found = counts(docs, least)
    candidates = found.where("contains(phrase, ' ')").selectExpr("lang", "phrase", "n AS a", "split(phrase, ' ') AS w")

    # Cuts, with the counts of both parts.
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.selectExpr("lang", "phrase", "a", "k", "array_join(slice(w, 1, k), ' ') AS head", "array_join(slice(w, k + 1, size(w)), ' ') AS tail")
    for part, count in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(found.selectExpr("lang", f"phrase AS {part}", f"n AS {count}"), ["lang", part])
    score = "(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))"
    cuts = cuts.selectExpr("lang", "phrase", "a", "k", "l", "r", f"{score} AS score")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # Extensions by one word on either side; the most frequent of each phrase.
    longer = candidates.where("size(w) > 2").selectExpr("lang", "a", "explode(array(array_join(slice(w, 1, size(w) - 1), ' '), array_join(slice(w, 2, size(w)), ' '))) AS phrase")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("f")).withColumnsRenamed({"lang": "e_lang", "phrase": "e_phrase"})
    taken = f"CAST(100 AS DECIMAL(3,0)) * CAST(f AS DECIMAL(19,0)) >= CAST({share} AS DECIMAL(3,0)) * CAST(a AS DECIMAL(19,0))"
    kept = scored.join(longer, (F.col("lang") == F.col("e_lang")) & (F.col("phrase") == F.col("e_phrase")) & F.expr(taken), "left_anti")

    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    if top is not None:  # first within shares of a language, so that its last window has SHARES * top rows at most
        kept = kept.withColumn("part", F.expr(f"pmod(xxhash64(phrase), {SHARES})")).withColumn("first", rank("lang", "part")).where(f"first <= {top}")
    ranked = kept.withColumn("rank", rank("lang"))
    ranked = ranked if top is None else ranked.where(f"rank <= {top}")
    total = found.where("phrase = ''").select("lang", F.col("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^ \\t]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, {MAX_N + 1}) AS t(k)),
found AS MATERIALIZED (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= {LEAST}),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM found WHERE k > 1),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS at FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, arg_min({{'l': x.f, 'r': y.f, 'score': CAST((2000000::HUGEINT * c.a) // (x.f + y.f) AS BIGINT)}}, {{'score': (2000000::HUGEINT * c.a) // (x.f + y.f), 'at': c.at}}) AS best
  FROM cuts c JOIN found x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.at], ' ') JOIN found y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.at + 1 :], ' ')
  GROUP BY c.lang, c.phrase, c.a),
inside AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda n: list_transform(range(1, k - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))))) AS phrase FROM candidates),
dropped AS (SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase AND 100::HUGEINT * i.a >= {SHARE}::HUGEINT * c.a),
ranked AS (SELECT s.lang, s.phrase, s.a, s.best.l AS l, s.best.r AS r, s.best.score AS score, row_number() OVER (PARTITION BY s.lang ORDER BY s.best.score DESC, s.a DESC, s.phrase) AS rank
  FROM scored s ANTI JOIN dropped d ON s.lang = d.lang AND s.phrase = d.phrase)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
