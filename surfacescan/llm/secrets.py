"""Secret scan: fixed patterns, and novelty measured with a dictionary-primed zstandard compressor.

Every whole text is read. The fixed patterns ("assign", "access", "hex") always report. Beside them,
runs of LEAST characters and more that a secret may have, at most REACH characters from a sensitive word,
before or after it, are candidates. A candidate's novelty is its marginal compressed size, that of
(surroundings + candidate) less that of the surroundings alone, by character, under a compressor primed
with a dictionary: the words of a public tokenizer's vocabulary, the identifiers that occur most often in
all of the documents, and common code words. Candidate and surroundings (CONTEXT characters on each side)
are first written as names are spoken: split where case, digits or signs change, in small letters. The
words of a name are then matches of a few bytes each, whatever its style, while every letter of a random
string costs a byte, and what falls between its short parts another. The measure is thus held against that
of names put together from the dictionary, not against an alphabet: of these, with 3 to 6 words, 98 in 100
and more cost less than NEAR bytes a character, and random strings with letters cost more. A stretch without letters is no name: there the entropy of its signs decides. A candidate
reaches from end to end of its character run, however long, less what fixed patterns report; it is measured
window by window, until one is novel. A candidate's own copies are taken out of its surroundings first.
Names of unknown words, in no dictionary and not near by, are reported.

The identifiers are counted over all documents, pre-aggregated; DICTIONARY_WORDS of them reach the
driver. The scan is map only: a batch of rows bounds the memory. Cases: a null or empty text gives zero
counts and no spans; a null doc_id is kept; repeated rows each give their row; an empty table gives no
rows; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, mapped, texts

#: Fixed patterns: kind, expression, group whose length counts, least length.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: A sensitive word; the characters between it and a candidate, at most; a candidate.
SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api.?key|credential|private.?key|auth|bearer|signature", re.IGNORECASE | re.ASCII)
REACH = 48
LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST, re.ASCII)
#: Characters of a candidate measured at a time: too few for the compressor to code letters by their frequency.
WINDOW = 48
#: Surrounding characters given to the compressor on each side, and its level.
CONTEXT, LEVEL = 192, 12
#: Marginal compressed bytes a character from which a stretch with letters counts as no name; the share of their entropy from which one without does.
NEAR, NEAR_SIGNS = 0.7, 0.95
#: A part of a name: small letters with or without a capital, capitals, or digits.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]|[0-9]+", re.ASCII)
#: Least letters of a word of the vocabulary that is used.
SHORTEST_WORD = 4
#: Signs of each class of characters without letters.
CLASSES = ((re.compile("[0-9]"), 10), (re.compile("[+/_=-]"), 5))
LETTER = re.compile("[A-Za-z]")
#: Identifiers of the documents in the dictionary, and their least length.
DICTIONARY_WORDS, SHORTEST = 3000, 6
#: Words that a task counts before it passes the counts on.
HELD = 100_000

#: Identifier dictionary (fixed values): names and words that code, configuration and logs are full of.
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key private_key public_key client_id client_secret "
    "credential credentials authorization authentication bearer signature session cookie username user_name account "
    "example sample placeholder changeme default production development staging localhost configuration environment "
    "variable function return import package class method string integer boolean object array value parameter "
    "argument request response header content-type application/json https://www.example.com http://localhost:8080 "
    "/usr/local/share /home/user/.config /etc/ssl/certs database connection hostname address timeout version "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxxxxxxxxxx 00000000000000000000 "
    "getProvider setFactory createManager updateHandler deleteService newClient isServer hasBuilder toController onListener asAdapter "
    "Config Context UserAccount Authentication Authorization Credential Token Secret Password Session Signature Request Response "
    "BEGIN CERTIFICATE END CERTIFICATE license copyright information description documentation implementation"
)

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


_IDENTIFIER = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z_]{%d,%d}(?![A-Za-z0-9+/_=-])" % (SHORTEST, LEAST - 1))


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts, added up over many texts; never more than HELD words at a time."""
    n: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    for b in batches(it):
        for text in b.column(0).cast(pa.binary()).to_pylist():
            n.update(_IDENTIFIER.findall(text or b""))
            if len(n) > HELD:
                yield flush()
                n.clear()
    yield flush()


def identifiers(docs: DataFrame, most: int = DICTIONARY_WORDS) -> str:
    """The identifiers that occur most often in all texts, the most frequent last (where a compressor reaches them cheapest). Only whole runs that are too short for a candidate: copies of a secret never get in."""
    counts = texts(docs).select("text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return " ".join(r["word"] for r in reversed(counts.orderBy(F.desc("n"), "word").limit(most).collect()))


def default_vocabulary() -> str:
    """A public tokenizer's file, for the words in its vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Vocabularies read so far, by path; a task is given its own by the driver, so that no worker parses the file.
_READ: dict[str, str] = {}


def vocabulary(path: str) -> str:
    """The vocabulary's words in small letters, the most frequent (lowest ids) last."""
    if path in _READ:
        return _READ[path]
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    spelt = (t[1:] if t[:1] == "\u0120" else t for t in sorted(ids, key=ids.get))
    _READ[path] = " ".join(reversed(dict.fromkeys(t.lower() for t in spelt if len(t) >= SHORTEST_WORD and t.isascii() and t.isalpha())))
    return _READ[path]


def spoken(s: str) -> str:
    """The parts of names, in small letters."""
    return " ".join(PART.findall(s)).lower()


@lru_cache(4)
def _compressor(words: str, path: str) -> zstandard.ZstdCompressor:
    body = f"{vocabulary(path)} {spoken(words)} {spoken(IDENTIFIERS)}".encode()
    # Tables for inputs as small as these: those of the level itself would take 50 MB of a worker.
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=1024, dict_size=len(body), write_content_size=False, write_checksum=False)
    primed = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=primed)


def novelty(before: str, candidate: str, after: str, words: str = "", path: str | None = None) -> float:
    """Marginal compressed bytes of the candidate, by character. words: identifiers for the dictionary; path: a tokenizer file other than the default one."""
    c, context = _compressor(words, path or default_vocabulary()), f"{spoken(after)} {spoken(before)} ".encode()
    body = (spoken(candidate) if LETTER.search(candidate) else candidate).encode()
    return (len(c.compress(context + body)) - len(c.compress(context))) / len(candidate)


def entropy(s: str) -> float:
    """Bytes that a character can carry, of those that s has classes of."""
    return math.log2(max(2, sum(n for rx, n in CLASSES if rx.search(s)))) / 8


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What the spans (by start) cover, as disjoint stretches."""
    out: list[tuple[int, int]] = []
    for a, b, _ in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _uncovered(s: int, e: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of s to e outside the covered stretches that are long enough for a candidate."""
    out, at = [], s
    for a, b in covered[max(0, bisect.bisect_right(covered, (s, s)) - 1) : bisect.bisect_left(covered, (e, e))]:
        if a < e and b > at:
            out.append((at, a))
            at = b
    return [(a, b) for a, b in [*out, (at, e)] if b - a >= LEAST]


def _context(text: str, s: int, e: int, part: str) -> tuple[str, str]:
    """The CONTEXT characters on each side of a candidate s to e, without copies of the part that is measured: copies would hide one another. What else the candidate holds is left out too: many random letters would teach the compressor their frequencies."""
    n = len(part)
    before, after = text[max(0, s - CONTEXT - n) : s], text[e : e + CONTEXT + n]
    return before.replace(part, "\0" * n)[-CONTEXT:].replace("\0", ""), after.replace(part, "\0" * n)[:CONTEXT].replace("\0", "")


def _novel(text: str, s: int, e: int, words: str, path: str | None) -> bool:
    """Whether a window of the candidate is novel."""
    for b in range(s + WINDOW, e + WINDOW, WINDOW):
        b = min(b, e)
        a = max(s, b - WINDOW)
        part = text[a:b]
        before, after = _context(text, s, e, part)
        least = NEAR if LETTER.search(part) else NEAR_SIGNS * entropy(part)
        if novelty(before, part, after, words, path) >= least:
            return True
    return False


def novel_spans(text: str, known: list[tuple[int, int, str]], words: str = "", path: str | None = None) -> list[tuple[int, int, str]]:
    """Spans that the method adds: incompressible candidates near a sensitive word, as far as not already covered."""
    begins, ends = [], []
    for m in SENSITIVE.finditer(text):
        begins.append(m.start())
        ends.append(m.end())
    if not begins:
        return []
    covered, out = _merged(known), []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        i = bisect.bisect_left(ends, s - REACH)
        if i < len(begins) and begins[i] <= e + REACH:
            out += [(a, b, "novel") for a, b in _uncovered(s, e, covered) if _novel(text, a, b, words, path)]
    return out


def find(text: str | None, words: str = "", path: str | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and those that novelty adds."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, novel_spans(text, base, words, path)


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def _scan(words: str, path: str):
    known = vocabulary(path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _READ[path] = known
        for b in batches(it):
            rows = []
            for text in b.column(1).to_pylist():
                base, novel = find(text, words, path)
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + novel), len(novel)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs: counts by kind, the digest of the base spans and all spans. path: a tokenizer file that all executors see, instead of the default one."""
    return texts(docs).mapInArrow(_scan(identifiers(docs), path or default_vocabulary()), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# ---------------------------------------------------------------- masking, for filters and pipelines


def mask(text: str, words: str = "", path: str | None = None) -> str:
    """The text with each reported span replaced by a marker of its kind; overlapping spans merge."""
    base, novel = find(text, words, path)
    out, at = [], 0
    for s, e, k in sorted(base + novel):
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with every secret in `text` masked and, where there is one, `n_chars` brought up to date. All rows and columns stay."""
    names = docs.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None
    words, path = identifiers(docs), path or default_vocabulary()
    known = vocabulary(path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _READ[path] = known
        for b in batches(it):
            columns = list(b.columns)
            before = columns[at].to_pylist()
            after = [x if not x else mask(x, words, path) for x in before]
            columns[at] = pa.array(after, b.schema.field(at).type)
            if count is not None:
                was = columns[count].to_pylist()
                columns[count] = pa.array([n if x == y else len(y) for n, x, y in zip(was, before, after)], b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return mapped(docs, run, docs.schema)
