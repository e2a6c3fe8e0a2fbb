"""Files to code segments, line for line; and R segments to syntax nodes.

Both are map-only Python stages over files: each row is one file, and packages spread over tasks.
A file type or a language may be added by registering an extractor or an analyzer; what is not
registered gives no segments, or a coverage span.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import SCAN_LIMIT
from ..schemas import NODES, SEGMENTS, batch, names
from . import rdsyntax, rsyntax

Segment = tuple[str, str | None, list[str], list[int]]  # language, label, lines, guarded lines
Extractor = Callable[[list[str], dict], list[Segment]]

# Forms of chunks, inline code and their options.
OPEN, CLOSE = re.compile(r"^[\s>]*```+\s*\{"), re.compile(r"^[\s>]*```+\s*$")
NO_EVAL = re.compile(r"(^|,)\s*eval\s*=\s*F(ALSE)?\s*(,|$)")
PIPE, PIPE_NO_EVAL = re.compile(r"^\s*#\|"), re.compile(r"eval:\s*(false|FALSE|F)")
INLINE = re.compile(r"`(?:\{r\}|r)[ \t#][^`]*`")
SWEAVE_OPEN, SWEAVE_CLOSE = re.compile(r"^\s*<<.*>>="), re.compile(r"^\s*@(\s.*)?$")
SWEAVE_NO_EVAL, SWEAVE_INLINE = re.compile(r"eval\s*=\s*F(ALSE)?([,>\s]|$)"), re.compile(r"\\Sexpr\{([^{}]*)\}")
ENGINES = {"r": "R", "bash": "shell", "sh": "shell", "zsh": "shell"}
#: Rows of nodes that go on together.
BATCH = 10_000
INHERITS = {"make": "shell", "qmd": "Rmd"}


def blank_except(lines: list[str], keep: set[int]) -> list[str]:
    """The lines with the given numbers, others empty."""
    return [x if i in keep else "" for i, x in enumerate(lines, 1)]


def placed(found: list[tuple[int, str]]) -> str:
    """Code pieces of one line at their columns (0-based), a semicolon before each but the first."""
    out = ""
    for col, code in found:
        out = (out + ";").ljust(col) + code if out else " " * col + code
    return out


def _plain(language: str) -> Extractor:
    return lambda lines, meta: [(language, None, lines, [])]


def _rd(lines: list[str], meta: dict) -> list[Segment]:
    code, problem = rdsyntax.read_page(lines, meta.get("macros"))
    if problem:
        meta["errors"].append(("read_Rd_code", problem))
    return [("R", label, body, guarded) for label, body, guarded in code]


def _chunks(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """(first fence, last fence or one past the end, header) of each chunk, 1-based."""
    i = 1
    while i <= len(lines):
        if OPEN.match(lines[i - 1]):
            j = i + 1
            while j <= len(lines) and not CLOSE.match(lines[j - 1]):
                j += 1
            yield i, j, lines[i - 1].split("{", 1)[1].split("}", 1)[0]
            i = j
        i += 1


def _rmd(lines: list[str], meta: dict) -> list[Segment]:
    out, taken = [], set()
    for a, b, header in _chunks(lines):
        taken |= set(range(a, min(b, len(lines)) + 1))
        body = [re.sub(r"^[\s>]*", lambda m: m[0].replace(">", " "), x) if lines[a - 1].lstrip().startswith(">") else x for x in lines[a : b - 1]]
        word = re.match(r"\s*([^\s,}]*)", header)[1]
        if not word or word[0] in ".#" or not any(x.strip() for x in body):
            continue
        options = re.sub(r"^\s*[^\s,}]+\s*,?", "", header)
        pipes = []
        for x in body:
            if not PIPE.match(x):
                break
            pipes.append(x)
        off = bool(NO_EVAL.search(options)) or any(PIPE_NO_EVAL.search(x) for x in pipes)
        full = [""] * a + body + [""] * (len(lines) - b + 1)
        out.append((ENGINES.get(word.lower(), word.lower()), None, full[: len(lines)], list(range(a + 1, b)) if off else []))
    inline = []
    for i, x in enumerate(lines, 1):
        if i in taken:
            inline.append("")
            continue
        masked = re.sub(r"``+.*?``+", lambda m: " " * len(m[0]), x)
        inline.append(placed([(m.start() + len(p), re.sub(r"`$", "", m[0][len(p) :])) for m in INLINE.finditer(masked) for p in [re.match(r"`(\{r\}|r)[ \t#]", m[0])[0]]]))
    if any(inline):
        out.append(("R", None, inline, []))
    return out


def _rnw(lines: list[str], meta: dict) -> list[Segment]:
    code, guarded, inside, off = [], [], False, False
    for i, x in enumerate(lines, 1):
        if not inside and SWEAVE_OPEN.match(x):
            inside, off = True, bool(SWEAVE_NO_EVAL.search(x))
            code.append("")
        elif inside and SWEAVE_CLOSE.match(x):
            inside = False
            code.append("")
        elif inside:
            code.append(x)
            guarded += [i] if off else []
        else:
            code.append(placed([(m.start(1), m[1]) for m in SWEAVE_INLINE.finditer(x)]))
    return [("R", None, code, guarded)] if any(x.strip() for x in code) else []


def _rsp(lines: list[str], meta: dict) -> list[Segment]:
    text, at, pieces = "\n".join(lines), 0, []
    while (a := text.find("<%", at)) >= 0:
        start = a + 2
        comment = text.startswith("--", start)
        b = text.find("--%>" if comment else "%>", start)
        end, at = (b, b + (4 if comment else 2)) if b >= 0 else (len(text), len(text))
        if comment or text[start : start + 1] in ("@", "%"):
            continue
        if text[start : start + 1] in ("=", ":"):
            start += 1
        if end > start and text[end - 1] == "-":
            end -= 1
        line, col = text.count("\n", 0, start) + 1, start - (text.rfind("\n", 0, start) + 1) + 1
        pieces += [(line + i, col if i == 0 else 1, part) for i, part in enumerate(text[start:end].split("\n")) if part]
    code = rdsyntax.assemble(pieces, len(lines), ";")
    return [("R", None, code, [])] if any(x.strip() for x in code) else []


EXTRACTORS: dict[str, Extractor] = {"R": _plain("R"), "shell": _plain("shell"), "Rd": _rd, "Rmd": _rmd, "Rnw": _rnw, "rsp": _rsp}


def read_lines(content: bytes) -> tuple[list[str], str | None]:
    """Lines by LF, CRLF or CR, those that are not UTF-8 left empty; and what was wrong."""
    if b"\0" in content:
        raise ValueError("line with embedded nul")
    parts = re.split(rb"\r\n|\n|\r", content)
    out, bad = [], 0
    for x in parts[:-1] if not parts[-1] else parts:
        try:
            out.append(x.decode())
        except UnicodeDecodeError:
            out.append("")
            bad += 1
    return out, f"{bad} lines are not valid UTF-8 and were skipped." if bad else None


def _limit_note(size: int) -> str:
    return f"File is {size / 1024**2:.0f} MB, above the {SCAN_LIMIT / 1024**2:.0f} MB scanning limit; it was not read."


def extract_segments(readings: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """SEGMENTS rows of each reading (a file with content, bytes, type, rule, code_contexts and macros); failures are rows with step and message."""
    use = {**EXTRACTORS, **(extractors or {})}
    cols = names(SEGMENTS)

    def one(r) -> Iterator[tuple]:
        key = (r.package, r.version, r.file_context, r.rule)
        failed = lambda step, why: (*key, None, None, None, None, None, None, step, why)
        if r.bytes > SCAN_LIMIT:
            yield failed("extract_segments", _limit_note(r.bytes))
            return
        extractor = use.get(INHERITS.get(r.type, r.type))
        if extractor is None:
            return
        try:
            lines, note = read_lines(r.content)
        except ValueError as e:
            yield failed("read_code", str(e))
            return
        if note:
            yield failed("read_code", note)
        contexts = list(r.code_contexts) if r.code_contexts is not None else []
        try:
            meta = {"macros": rdsyntax.read_macros(r.macros) if isinstance(r.macros, str) else {}, "errors": []}
            found = list(extractor(lines, meta))
        except Exception as e:  # an extractor's failure costs its file alone
            yield failed("extract_segments", f"{type(e).__name__}: {e}")
            return
        for i, (language, label, body, guarded) in enumerate(found):
            yield (*key, i, language, label, contexts, body, guarded, None, None)
        for step, why in meta["errors"]:
            yield failed(step, why)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = pd.DataFrame([x for r in pdf.itertuples(index=False) for x in one(r)], columns=cols)
            out["seg_ord"] = out["seg_ord"].astype("Int32")
            yield out

    return readings.mapInPandas(run, SEGMENTS)


def parse_segments(segments: DataFrame) -> DataFrame:
    """NODES rows of each R segment; one that does not parse is a single row with a message and no node.

    Nodes of many segments go on in one batch: most segments are small, and a batch costs far more than a row.
    """
    cols = names(NODES)
    keys = ["package", "version", "file_context", "rule", "seg_ord"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in it:
            for *key, lines in zip(*(b.column(c).to_pylist() for c in keys), b.column("lines"), strict=True):
                try:
                    held += [(*key, *n, None) for n in rsyntax.rows(rsyntax.parse("\n".join(lines.as_py()) or "\n"))]
                except Exception as e:  # not R, or beyond the parser: costs its segment alone
                    held.append((*key, *[None] * (len(cols) - len(keys) - 1), str(e) or type(e).__name__))
                if len(held) >= BATCH:
                    yield batch(held, NODES)
                    held = []
        if held:
            yield batch(held, NODES)

    return segments.where(F.col("language") == "R").select(*keys, "lines").mapInArrow(run, NODES)
