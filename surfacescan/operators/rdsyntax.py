"""Code in Rd help pages: the examples, and Sexpr macros by the stage that runs them."""

from __future__ import annotations

import re

#: Blocks inside examples that are only wrappers; the first alone keeps its code from running.
GUARDS, WRAPPERS = ("dontrun",), ("dontrun", "donttest", "dontshow", "testonly", "dontdiff")
_STAGE = re.compile(r"stage\s*=\s*([A-Za-z0-9]+)")
_MACRO = re.compile(r"\\([A-Za-z][A-Za-z0-9]*)")
_PARAMETER = re.compile(r"#([1-9])")
#: Uses of package macros in one page, nested ones included, and how deep they nest; beyond these they have no end.
EXPANSIONS, NESTING = 1000, 50

# The markup of help pages, the macros that R itself defines, and those whose argument is code or verbatim.
MARKUP = set("""
    name alias title description concept keyword docType encoding Rdversion RdOpts synopsis usage arguments value details format note author references section subsection seealso examples source
    acronym bold cite code command deqn describe dfn dontdiff dontrun dontshow donttest dots ldots R cr tab email emph enc enumerate env eqn figure file href if ifelse item itemize kbd l linkS4class link
    method S3method S4method option out pkg preformatted samp Sexpr special sQuote dQuote strong tabular testonly url v var verb newcommand renewcommand
    CRANpkg PR doi sspace I packageTitle packageDescription packageAuthor packageMaintainer packageDESCRIPTION packageIndices
""".split())  # fmt: skip
VERBATIM = {"alias", "code", "command", "deqn", "env", "eqn", "figure", "href", "kbd", "name", "option", "out", "preformatted", "RdOpts", "Rdversion", "samp", "synopsis", "url", "usage", "verb"}


def sexpr_stage(options: str) -> str:
    """build, install or render; install unless the options say otherwise."""
    m = _STAGE.search(options)
    return m[1].lower() if m and m[1].lower() in ("build", "render") else "install"


class RdError(ValueError):
    """The page does not parse; what was read up to there is kept."""


class _Page:
    def __init__(self, lines: list[str], macros: dict[str, str] | None = None, outer: _Page | None = None):
        self.text, self.macros = "\n".join(lines), outer.macros if outer else dict(macros or {})
        self.unknown: dict[str, None] = outer.unknown if outer else {}
        self.uses: list[str] = outer.uses if outer else []
        self.depth: int = outer.depth + 1 if outer else 0
        self.starts = [0]
        for x in lines:
            self.starts.append(self.starts[-1] + len(x) + 1)
        self.pieces: dict[str, list[tuple[int, int, str]]] = {"examples": [], "build": [], "install": [], "render": []}
        self.guarded: set[int] = set()
        self.problem: str | None = None
        self.line = 1

    def where(self, at: int) -> tuple[int, int]:
        lo, hi = 0, len(self.starts) - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.starts[mid] <= at else (lo, mid)
        return lo + 1, at - self.starts[lo] + 1

    def put(self, bucket: str, at: int, code: str, guard: bool) -> None:
        line, col = self.where(at)
        for i, part in enumerate(code.split("\n")):
            if part:
                self.pieces[bucket].append((line + i, col if i == 0 else 1, part))
            if guard:
                self.guarded.add(line + i)

    def closing(self, at: int, code: bool) -> int:
        """Index of the brace that closes the one before `at`; quotes hide braces in code."""
        depth, quote = 1, ""
        while at < len(self.text):
            c = self.text[at]
            if c == "\\":
                at += 2
                continue
            if c == "%":
                end = self.text.find("\n", at)
                at = len(self.text) if end < 0 else end
                continue
            if code and quote:
                quote = "" if c == quote else quote
            elif code and c in "\"'`":
                quote = c
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    return at
            at += 1
        self.problem = self.problem or "unexpected end of input: a brace is not closed"
        return len(self.text)

    def options(self, at: int) -> tuple[str, int]:
        if self.text[at : at + 1] == "[":
            end = self.text.find("]", at)
            if end > 0:
                return self.text[at + 1 : end], end + 1
        return "", at

    def use(self, name: str, at: int, end: int, bucket: str | None = None, guard: bool = False) -> int:
        """Put the code of a package's macro, used at `at` with arguments from `end`, at the place of its use; return where the use ends."""
        body = self.macros[name]
        given: list[str] = []
        for _ in range(max((int(x) for x in _PARAMETER.findall(body)), default=0)):
            if self.text[end : end + 1] != "{":
                break
            close = self.closing(end + 1, False)
            given.append(self.text[end + 1 : close])
            end = close + 1
        self.uses.append(name)
        if len(self.uses) > EXPANSIONS or self.depth >= NESTING:
            self.problem = self.problem or "macros are used without an end"
            return end
        inner = _Page(_PARAMETER.sub(lambda m: given[int(m[1]) - 1] if int(m[1]) <= len(given) else "", body).split("\n"), outer=self)
        inner.code(0, len(inner.text), bucket, guard) if bucket else inner.read()
        self.problem = self.problem or inner.problem
        line, col = self.where(at)
        for to, pieces in inner.pieces.items():
            if pieces:
                self.pieces[to].append((line, col, "; ".join(x for _, _, x in sorted(pieces, key=lambda x: x[:2]))))
        if guard:
            self.guarded.add(line)
        return end

    def define(self, at: int) -> int:
        """Read the name and body that follow a definition at `at`; return where it ends."""
        m = _DEFINED.match(self.text, at)
        if not m:
            return at
        close = self.closing(m.end(), False)
        self.macros[m[1]] = self.text[m.end() : close]
        return close + 1

    def code(self, at: int, end: int, bucket: str, guard: bool) -> None:
        """R-like text: comments go, escapes are undone, wrappers open, Sexpr goes to its stage."""
        run, start = [], at

        def flush() -> None:
            nonlocal run
            if run:
                self.put(bucket, start, "".join(run), guard)
            run = []

        while at < end:
            c = self.text[at]
            if c == "%":
                flush()
                stop = self.text.find("\n", at, end)
                at = start = end if stop < 0 else stop
                continue
            m = _MACRO.match(self.text, at, end) if c == "\\" else None
            if m and m[1] in ("dots", "ldots"):
                run.append("...")
                at = m.end()
                continue
            if m and (m[1] in WRAPPERS or m[1] == "Sexpr"):
                flush()
                options, brace = self.options(m.end())
                if self.text[brace : brace + 1] == "{":
                    close = min(self.closing(brace + 1, True), end)
                    if m[1] == "Sexpr":
                        self.code(brace + 1, close, sexpr_stage(options), False)
                    else:
                        self.code(brace + 1, close, bucket, guard or m[1] in GUARDS)
                    at = start = close + 1
                    continue
            if m and m[1] in self.macros:
                flush()
                at = start = self.use(m[1], at, m.end(), bucket, guard)
                continue
            if c == "\\" and self.text[at + 1 : at + 2] in ("%", "\\", "{", "}"):
                flush()
                start = at + 1
                run.append(self.text[at + 1])
                at += 2
                continue
            if not run:
                start = at
            run.append(c)
            at += 1
        flush()

    def read(self) -> None:
        at = verbatim = 0
        while at < len(self.text):
            c = self.text[at]
            if c == "%":
                end = self.text.find("\n", at)
                at = len(self.text) if end < 0 else end
                continue
            m = _MACRO.match(self.text, at) if c == "\\" else None
            if not m:
                at += 2 if c == "\\" else 1
                continue
            name, (options, brace) = m[1], self.options(m.end())
            if name in ("examples", "Sexpr") and self.text[brace : brace + 1] == "{":
                close = self.closing(brace + 1, True)
                self.code(brace + 1, close, "examples" if name == "examples" else sexpr_stage(options), False)
                at = close + 1
            elif name in ("newcommand", "renewcommand"):
                at = self.define(m.end())
            elif name in self.macros:
                at = self.use(name, at, m.end())
            else:
                if name in VERBATIM and self.text[brace : brace + 1] == "{" and at >= verbatim:
                    before = self.problem
                    verbatim = self.closing(brace + 1, False)
                    self.problem = before
                elif name not in MARKUP and at >= verbatim:
                    self.unknown[name] = None
                at = m.end()


_DEFINED = re.compile(r"\s*\{?\\([A-Za-z][A-Za-z0-9]*)\}?\s*\{")


def read_macros(text: str) -> dict[str, str]:
    """Names and bodies of the macros that a page of definitions makes; nothing is run."""
    page = _Page(text.split("\n"))
    for m in re.finditer(r"\\(?:re)?newcommand\b", text):
        page.define(m.end())
    return page.macros


def assemble(pieces: list[tuple[int, int, str]], n: int, separator: str) -> list[str]:
    """Pieces at their lines and columns, blanks between; the separator parts two pieces of one line."""
    out = [""] * n
    for line, col, text in sorted(pieces, key=lambda p: p[:2]):
        if not 1 <= line <= n:
            continue
        have = out[line - 1]
        pad = col - 1 - len(have)
        if have and separator:
            have, pad = have + separator, pad - len(separator)
        out[line - 1] = have + " " * max(0, pad) + text
    return out


def read_page(lines: list[str], macros: dict[str, str] | None = None) -> tuple[list[tuple[str, list[str], list[int]]], str | None]:
    """(label, lines, guarded lines) of each kind of code that the page has, and what is wrong with it, if anything.

    Macros of the package and the page are expanded, arguments and nested uses included; others that are no
    markup are named as unknown, since the code that they stand for is not seen.
    """
    page = _Page(lines, macros)
    page.read()
    out = []
    for bucket, label in (("examples", "Rd_examples"), ("build", "Rd_Sexpr_build"), ("install", "Rd_Sexpr_install"), ("render", "Rd_Sexpr_render")):
        code = assemble(page.pieces[bucket], len(lines), "" if bucket == "examples" else ";")
        if any(x.strip() for x in code):
            out.append((label, code, sorted(page.guarded) if bucket == "examples" else []))
    problems = [page.problem] * bool(page.problem) + [f"unknown macro '\\{x}'" for x in page.unknown]
    return out, "; ".join(problems) or None
