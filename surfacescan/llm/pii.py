"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

Every whole text is read. The fixed patterns ("email", "ip", "card", "phone") always report. Beside them a
conditional random field labels the tokens (runs of letters, runs of digits, single other characters) of
each sentence that holds a digit or an @ with the beginning or inside of one of the four kinds, or as
outside. A token's features are the shapes (case and length of letters, length of digits, the sign) of the
tokens from two before to two after it, and whether space stands before it and the next one. What the model
labels is reported where it passes the exact check of its kind (`plausible`) and touches no span of the
fixed patterns: telephone numbers written without a plus, cards side by side or with other separators, IPv6
addresses, mail addresses at hosts without a dot or with letters beyond ASCII.

The model is trained from a small labelled table, `labelled(text, spans)`: by default one written by rule
(`examples`), with ordinary numbers, dates, versions, prices and hashes as counterexamples. Training
maximises the penalised log-likelihood by gradient ascent in one executor task, which reads at most
MOST_EXAMPLES rows; weights of fixed size reach the driver. A span without a digit or an @ is never
reported, so that sentences without either need no decoding. Viterbi runs over all sentences of a batch
at once, a token position at a time.

The scan is map only: a batch of rows bounds the memory, and CHUNK characters the decoding; a single sentence
is decoded whole, in time linear in its length. Cases: a null or empty text gives zero counts and no spans;
a null doc_id is kept; repeated rows each give their row; an empty table gives no rows; an empty labelled
table gives the fixed patterns alone; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches, mapped, texts

KINDS = ("email", "ip", "card", "phone")
#: Labels: outside; then beginning and inside of each kind.
OUTSIDE, LABELS = 0, 1 + 2 * len(KINDS)
#: Rows of the labelled table that training reads, at most; steps and step size of the ascent, and the penalty.
MOST_EXAMPLES, STEPS, RATE, PENALTY = 4000, 200, 0.3, 0.001
#: Characters of sentences decoded at a time.
CHUNK = 1 << 20

# ---------------------------------------------------------------- fixed patterns

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.ASCII)
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
HOT = re.compile("[0-9@]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @, so that long runs without one cost no retries."""
    free, at = 0, text.find("@")
    while at >= 0:
        if domain := DOMAIN.match(text, at + 1):
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                free = domain.end()
        at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by kind, then start."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# ---------------------------------------------------------------- tokens and features

#: Classes of a character: space, digit, small letter, capital, other sign (its own token).
SPACE, NUMBER, SMALL, CAPITAL, SIGN = range(5)
_WIDE_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CLASS = np.full(0x3040, SMALL, dtype=np.uint8)
_CLASS[:128] = SIGN
_CLASS[[*range(9, 14), *range(28, 33), *_WIDE_SPACES]] = SPACE
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91] = NUMBER, SMALL, CAPITAL
_CLASS[0x2010:0x2028] = _CLASS[0x2030:0x205F] = _CLASS[0x3001:0x3040] = SIGN

#: Shapes: 0 none; 1 to 20 digits by length; 21 to 40 letters by case and length; 41 a sign beyond ASCII; 42 on the ASCII signs.
LONGEST, _LETTERS, _OTHER = 20, 21, 41
SHAPES = 42 + 128
#: Features of a token: five shapes and three flags (always, space before it, space before the next).
OFFSETS = (-2, -1, 0, 1, 2)
FEATURES = len(OFFSETS) * SHAPES + 3


class Tokens:
    """The tokens of sentences set end to end: start, end (code points), shape, space before, and the sentences' bounds in them."""

    def __init__(self, sentences: list[str]) -> None:
        points = np.frombuffer("\n".join(sentences).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = _CLASS[np.minimum(points, 0x303F)]
        kind[points >= 0x3040] = SMALL
        group = np.where(kind == CAPITAL, SMALL, kind)
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (group[1:] == SIGN)))[: len(points)]
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(points))
        token = group[at] != SPACE
        self.start, self.end = at[token], stop[token]
        lens, what = self.end - self.start, group[self.start]
        before = np.concatenate(([SPACE], kind))[self.start]
        self.spaced = before == SPACE
        capitals = np.concatenate(([0], np.cumsum(kind == CAPITAL)))
        n = capitals[self.end] - capitals[self.start]
        case = np.select([n == 0, n == lens, (n == 1) & (kind[self.start] == CAPITAL)], [0, 1, 2], 3)
        size = np.searchsorted([1, 2, 3, 6], lens)
        signs = np.where(points[self.start] < 128, 42 + np.minimum(points[self.start], 127), _OTHER)
        self.shape = np.select([what == NUMBER, what == SMALL], [np.minimum(lens, LONGEST), _LETTERS + 5 * case + size], signs).astype(np.int64)
        ends = np.cumsum([len(s) + 1 for s in sentences])
        self.bounds = np.concatenate(([0], np.searchsorted(self.start, ends)))

    def features(self) -> np.ndarray:
        """Indexes of each token's features: one for each offset, then always, and FEATURES (none) or a flag's."""
        n = len(self.shape)
        sentence = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        out = np.zeros((n, len(OFFSETS) + 3), dtype=np.int64)
        spaced_next = np.zeros(n, dtype=bool)
        for c, k in enumerate(OFFSETS):
            i = np.arange(n) + k
            j = np.clip(i, 0, max(0, n - 1))
            inside = (i == j) & (sentence[j] == sentence)
            out[:, c] = c * SHAPES + np.where(inside, self.shape[j], 0)
            if k == 1:
                spaced_next = ~inside | self.spaced[j]
        base = len(OFFSETS) * SHAPES
        out[:, -3] = base
        out[:, -2] = np.where(self.spaced, base + 1, FEATURES)
        out[:, -1] = np.where(spaced_next, base + 2, FEATURES)
        return out


def _steps(bounds: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The sentences, longest first; and how many of them have a token at each position."""
    lens = np.diff(bounds)
    order = np.argsort(-lens, kind="stable")
    longest = int(lens.max(initial=0))
    return order, (len(lens) - np.searchsorted(np.sort(lens), np.arange(longest), side="right")).tolist()


def viterbi(scores: np.ndarray, moves: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The best labels of all sentences. scores: (tokens, labels); moves: (from, to) of neighbours; bounds: the sentences'. Ties go to the lower label."""
    order, active = _steps(bounds)
    begin = bounds[:-1][order]
    back = np.zeros(scores.shape, dtype=np.uint8)
    best, last = None, np.zeros(len(order), dtype=np.int64)
    for t, m in enumerate(active):
        at = begin[:m] + t
        if t == 0:
            best = scores[at]
        else:
            whole = best[:m, :, None] + moves
            back[at] = whole.argmax(axis=1)
            best[:m] = np.take_along_axis(whole, back[at][:, None, :].astype(np.int64), 1)[:, 0] + scores[at]
        done = active[t + 1] if t + 1 < len(active) else 0
        last[done:m] = best[done:m].argmax(axis=1)
    out = np.zeros(len(scores), dtype=np.int64)
    now = np.zeros(len(order), dtype=np.int64)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        done = active[t + 1] if t + 1 < len(active) else 0
        now[done:m] = last[done:m]
        at = begin[:m] + t
        out[at] = now[:m]
        now[:m] = back[at, now[:m]]
    return out


class Model:
    """weights: (FEATURES + 1, LABELS), the last row zero; moves: (LABELS, LABELS)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), LABELS))
        for c in range(features.shape[1]):
            out += self.weights[features[:, c]]
        return out

    def spans(self, sentences: list[str]) -> list[tuple[int, int, int, str]]:
        """(sentence, start, end, kind) of what the labels mark."""
        t = Tokens(sentences)
        label = viterbi(self.scores(t.features()), self.moves, t.bounds)
        offset = np.concatenate(([0], np.cumsum([len(s) + 1 for s in sentences])))
        sentence = np.repeat(np.arange(len(sentences)), np.diff(t.bounds))
        out: list[tuple[int, int, int, str]] = []
        open_ = None
        for i in np.flatnonzero(label != OUTSIDE).tolist():
            kind, inside = (int(label[i]) - 1) // 2, label[i] % 2 == 0
            if inside and open_ and open_[0] == i - 1 and open_[1] == kind and sentence[i] == sentence[i - 1]:
                n, s, _, k = out[-1]
                out[-1] = (n, s, int(t.end[i] - offset[n]), k)
            else:
                n = int(sentence[i])
                out.append((n, int(t.start[i] - offset[n]), int(t.end[i] - offset[n]), KINDS[kind]))
            open_ = (i, kind)
        return out


# ---------------------------------------------------------------- training


def _allowed() -> np.ndarray:
    """Moves between labels: into the inside of a kind only from its beginning or inside."""
    out = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = -1e4
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


def likelihood(model: Model, features: np.ndarray, labels: np.ndarray, bounds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The log-likelihood of the labels, and its gradients by weights and moves: forward and backward, scaled, over all sentences at once."""
    scores = model.scores(features)
    order, active = _steps(bounds)
    begin = bounds[:-1][order]
    moves, top = np.exp(model.moves), scores.max(axis=1, initial=0)
    local = np.exp(scores - top[:, None])
    ahead, behind, scale = np.zeros_like(scores), np.ones_like(scores), np.ones(len(scores))
    for t, m in enumerate(active):
        at = begin[:m] + t
        f = local[at] * (ahead[at - 1] @ moves) if t else local[at]
        scale[at] = f.sum(axis=1)
        ahead[at] = f / scale[at][:, None]
    for t in range(len(active) - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        behind[at] = (local[at + 1] * behind[at + 1] / scale[at + 1][:, None]) @ moves.T
    first = np.zeros(len(scores), dtype=bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    pair = np.flatnonzero(~first)
    off = -ahead * behind  # the truth less the marginals
    off[np.arange(len(scores)), labels] += 1
    by_weight = np.zeros(model.weights.size)
    for c in range(features.shape[1]):
        at = features[:, c, None] * LABELS + np.arange(LABELS)
        by_weight += np.bincount(at.ravel(), weights=off.ravel(), minlength=by_weight.size)
    by_weight = by_weight.reshape(-1, LABELS)
    by_weight[FEATURES] = 0
    by_move = -moves * (ahead[pair - 1].T @ (local * behind / scale[:, None])[pair])
    np.add.at(by_move, (labels[pair - 1], labels[pair]), 1)
    value = scores[np.arange(len(scores)), labels].sum() + model.moves[labels[pair - 1], labels[pair]].sum() - np.log(scale).sum() - top.sum()
    return float(value), by_weight, by_move


def token_labels(t: Tokens, sentences: list[str], spans: list[list[tuple[str, int, int]]]) -> np.ndarray:
    """Labels of the tokens within spans (kind, start, end) of each sentence."""
    out = np.zeros(len(t.start), dtype=np.int64)
    offset = 0
    for s, marked in zip(sentences, spans, strict=True):
        for kind, a, b in marked:
            i, j = np.searchsorted(t.start, offset + a), np.searchsorted(t.start, offset + b)
            out[i:j] = 2 + 2 * KINDS.index(kind)
            if j > i:
                out[i] -= 1
        offset += len(s) + 1
    return out


def train(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> Model | None:
    """The model fitted to labelled sentences; None without any."""
    rows = [(s, [m for m in marked or [] if m[0] in KINDS]) for s, marked in rows if s]
    if not rows:
        return None
    sentences = [re.sub(r"\n", " ", s) for s, _ in rows]
    t = Tokens(sentences)
    features, labels = t.features(), token_labels(t, sentences, [m for _, m in rows])
    model = Model(np.zeros((FEATURES + 1, LABELS)), _allowed())
    fitted = [(model.weights, np.ones(model.weights.shape, dtype=bool)), (model.moves, model.moves == 0)]  # forbidden moves stay
    sizes = [np.full(x.shape, 1e-8) for x, _ in fitted]
    for _ in range(STEPS):
        _, *by = likelihood(model, features, labels, t.bounds)
        for (x, free), g, size in zip(fitted, by, sizes, strict=True):
            g = np.where(free, g / len(rows) - PENALTY * x, 0)
            size += g * g
            x += RATE * g / np.sqrt(size)
    return model


def examples(n: int = 900, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A labelled table written by rule: n sentences of invented words with one to three things in them, personal data or not."""
    rng = np.random.default_rng(seed)

    def pick(x):
        return x[rng.integers(len(x))]

    def number(k: int, first: str = "123456789") -> str:
        return pick(first) + "".join(pick("0123456789") for _ in range(k - 1))

    def word(low: int = 2, high: int = 9) -> str:
        return "".join(pick("aeioubcdlmnprstvwéäñ" if rng.random() < 0.1 else "aeioubcdlmnprst") for _ in range(rng.integers(low, high)))

    def valid(d: str) -> str:
        return next(d[:-1] + c for c in "0123456789" if luhn(d[:-1] + c))

    def card() -> str:
        d = valid(number(16, "3456"))
        sep = pick(["", "", "", " ", "-", ".", "/", "  "])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return pick([f"+{number(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{number(2)} {a} {b} {c}", f"+{number(2)}/{a}/{b}/{c}", f"{a}.{b}.{c}", f"00{number(2)} {a} {b}{c}", f"(0{a}) {b} {c}", f"0{a}/{b}{c}"])

    def ip() -> str:
        if rng.random() < 0.7:
            return ".".join(str(rng.integers(0, 256)) for _ in range(4))
        parts = [f"{rng.integers(1, 65536):x}" for _ in range(8)]
        return ":".join(parts) if rng.random() < 0.5 else f"{parts[0]}:{parts[1]}::{parts[2]}:{parts[3]}"

    def email() -> str:
        user = pick([word(), f"{word()}.{word()}", f"{word()}{number(2)}", f"{word()}.{number(2)}", f"{word()}_{word()}", f"{word()}+{word()}"])
        return f"{user}@{pick([f'{word()}.{pick(["com", "org", "de"])}', f'{word()}{number(1)}.{word()}.com', f'{word()}-{word()}.net', word(), 'localhost'])}"

    def other() -> str:
        hexes = "".join(pick("0123456789abcdef") for _ in range(40))
        return pick([
            number(1) + ".0", number(1) + ".", number(4), number(2), f"{number(1)}.{number(1)}.{number(1)}", f"20{number(2)}-0{number(1)}-{number(2)}", f"{number(2)}/{number(2)}/20{number(2)}",
            f"{number(2)}:{number(2)}:{number(2)}", f"{number(1)},{number(3)}.{number(2)}", f"${number(3)}", f"{number(2)}%", f'"{hexes}"', hexes[:32], f"{number(8)}", f"{number(10)}", f"{number(12)}", f"{number(22)}", f"{number(30)}",
            f"{word()}{number(2)}", f"x{number(3)}y", f"({number(4)})", f"[{number(1)}, {number(2)}]", f"{number(3)}-{number(3)}", f"{word()}-{number(4)}", "@" + word(), f"{word()} @ {number(2)}", f"{word()}@", f"#{number(3)}",
            f"{number(1)}-{number(2)}-{number(1)}", f"{number(2)}.{number(2)}", f"{number(5)} {number(5)} {number(3)}", f"{number(1)} + {number(1)} = {number(2)}", "".join(pick("0123456789ABCDEF") for _ in range(40)),
        ])

    out = []
    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    for _ in range(n):
        s, spans = "", []
        for _ in range(rng.integers(1, 4)):
            s += " ".join(word().capitalize() if rng.random() < 0.1 else word() for _ in range(rng.integers(0, 6)))
            s += pick([" ", " ", " ", " ", ", ", ": ", " (", ' "', " = ", ".", " is ", " no "]) if s else ""
            kind = pick([*KINDS, "other", "other"])
            thing = make.get(kind, other)()
            for _ in range(2 if kind in ("card", "ip") and rng.random() < 0.15 else 1):
                if kind in KINDS:
                    spans.append((kind, len(s), len(s) + len(thing)))
                s += thing + " "
            s = s[:-1] + pick([" ", " ", " ", ", ", ". ", ") ", '" ', "; ", "!! ", "%%% ", "### "])
        out.append((s, spans))
    return out


SPANS = "array<struct<kind:string,start:int,end:int>>"


def _fit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(s, [(m["kind"], m["start"], m["end"]) for m in marked or []]) for b in batches(it) for s, marked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    model = train(rows)
    if model is not None:
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.moves.tobytes()])], names=["weights", "moves"])


def fit(spark: SparkSession, labelled: DataFrame | None = None) -> Model | None:
    """The model of a labelled table (text, spans), by default that of `examples`."""
    if labelled is None:
        labelled = spark.createDataFrame(examples(), f"text string, spans {SPANS}")
    rows = labelled.selectExpr("CAST(text AS STRING) AS text", f"CAST(spans AS {SPANS}) AS spans").orderBy("text", "spans").limit(MOST_EXAMPLES)
    got = rows.coalesce(1).mapInArrow(_fit, "weights binary, moves binary").first()
    return got and Model(*(np.frombuffer(x).reshape(-1, LABELS) for x in got))


# ---------------------------------------------------------------- the scan

_END = re.compile(r"\n|[.!?]\s")


def _sentences(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the sentences (to a line feed, or a full stop, ! or ? before space) that hold a digit or an @."""
    at = 0
    while m := HOT.search(text, at):
        start = max(at, *(text.rfind(x, at, m.start()) + 1 for x in "\n"))
        for x in ".!?":
            k = text.rfind(x, start, m.start())
            while k >= start and not text[k + 1].isspace():
                k = text.rfind(x, start, k)
            start = max(start, k + 1)
        end = _END.search(text, m.end())
        stop = end.start() + (text[end.start()] != "\n") if end else len(text)
        yield start, stop
        at = stop


#: What may be in a number of a card or telephone.
_WRITTEN = re.compile(r"[0-9 ()./+-]+")


def plausible(kind: str, text: str, a: int, b: int) -> bool:
    """The exact check of what the model labels: it stands free of letters and digits, and is as its kind must be."""
    if text[a - 1 : a].isalnum() or text[b : b + 1].isalnum():
        return False
    s = text[a:b]
    d = _digits(s)
    if kind == "card":
        return 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn(d) and bool(_WRITTEN.fullmatch(s))
    if kind == "phone":  # digits alone may be any number
        return 9 <= len(d) <= 15 and len(d) < len(s) and bool(_WRITTEN.fullmatch(s))
    if kind == "ip":
        try:
            return bool(ipaddress.ip_address(s))
        except ValueError:
            return False
    user, _, host = s.partition("@")
    return bool(user) and any(c.isalnum() for c in host) and "@" not in host


def find_all(rows: list[str | None], model: Model | None) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """Of each text the spans of the fixed patterns and those that the model adds, by kind, then start."""
    out = [(base_spans(t) if t else [], []) for t in rows]
    if model is None:
        return out
    held: list[tuple[int, int]] = []
    waiting: list[str] = []
    size = 0

    def decode() -> None:
        for n, a, b, kind in model.spans(waiting):
            i, at = held[n]
            if plausible(kind, waiting[n], a, b):
                out[i][1].append((at + a, at + b, kind))

    for i, text in enumerate(rows):
        for a, b in _sentences(text) if text else ():
            held.append((i, a))
            waiting.append(text[a:b])
            size += b - a
            if size >= CHUNK:
                decode()
                held, waiting, size = [], [], 0
    if waiting:
        decode()
    for k, (base, more) in enumerate(out):
        known = sorted(base)
        ends = np.maximum.accumulate([e for _, e, _ in known]) if known else []
        starts = [s for s, _, _ in known]
        fresh = []
        for s, e, kind in sorted(more, key=lambda x: (KINDS.index(x[2]), x[0])):
            j = np.searchsorted(starts, e)  # spans that begin before this one ends
            if j == 0 or ends[j - 1] <= s:
                fresh.append((s, e, kind))
        out[k] = (base, fresh)
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (KINDS.index(x[2]), x[0])))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: counts and digest of the fixed patterns' spans, all spans, and how many of these the model added."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.sparkSession, labelled))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            rows = []
            for base, more in find_all(b.column(1).to_pylist(), model.value):
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
            types = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows), types))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return texts(docs).mapInArrow(run, SCHEMA)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by a marker of its kind; overlapping spans merge."""
    out, at = [], 0
    for s, e, k in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs with all personal data in `text` masked; all rows and columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.sparkSession, labelled))
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            columns = list(b.columns)
            rows = columns[at].to_pylist()
            columns[at] = pa.array([t and mask(t, base + more) for t, (base, more) in zip(rows, find_all(rows, model.value), strict=True)], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return mapped(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
