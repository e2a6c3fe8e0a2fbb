"""Regular expressions of the POSIX and PCRE dialects, as rule files write them, in Java's."""

from __future__ import annotations

import re

#: POSIX classes and Java's names for them.
CLASSES = {
    "alnum": "Alnum", "alpha": "Alpha", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit",
}
#: Forms without a counterpart that means the same, by how they begin, and their names.
REFUSED = [
    (r"\(\?R\)|\(\?[0-9]+\)|\(\?[+-][0-9]+\)|\(\?&|\(\?P>", "recursion"), (r"\(\?\(", "a condition"), (r"\(\*", "a verb"), (r"\(\?\|", "a branch reset"), (r"\(\?C", "a callout"),
    (r"\\K", r"\K"), (r"\\C", r"\C"), (r"\\g", r"\g"), (r"\\N", r"\N"), (r"\\[lLuU]", "a change of case"),
]
_REFUSED = [(re.compile(rx), what) for rx, what in REFUSED]
_REPEAT = re.compile(r"[*+?]|\{[0-9]+(?:,[0-9]*)?\}")
_GROUP = re.compile(r"\(\?P?<([A-Za-z][A-Za-z0-9]*)>|\(\?P=([A-Za-z][A-Za-z0-9]*)\)|\(\?#[^)]*\)")
_POSIX = re.compile(r"\[:(\^?)([a-z]+):\]")


class RegexError(ValueError):
    """A form that has no counterpart."""


def _bracket(rx: str, at: int) -> tuple[str, int]:
    """A bracket expression from its [: in Java's form, and where it ends."""
    out, i = ["["], at + 1
    if rx[i : i + 1] == "^":
        out.append("^")
        i += 1
    first = True
    while i < len(rx) and (rx[i] != "]" or first):
        if m := _POSIX.match(rx, i):
            negated, name = m.groups()
            if name == "word":
                out.append(r"\W" if negated else r"\w")
            elif name in CLASSES:
                out.append(rf"\{'P' if negated else 'p'}{{{CLASSES[name]}}}")
            else:
                raise RegexError(f"class [:{name}:]")
            i = m.end()
        elif rx.startswith(("[.", "[="), i) and rx.find(rx[i + 1] + "]", i + 2) >= 0:
            raise RegexError("a collating element")
        elif rx[i] == "\\" and i + 1 < len(rx):
            out.append(rx[i : i + 2])
            i += 2
        else:  # a bracket or & of its own is a sign like others there, but not in Java
            out.append("\\" + rx[i] if rx[i] in "[]&" else rx[i])
            i += 1
        first = False
    if i >= len(rx):
        raise RegexError("a bracket that is not closed")
    return "".join([*out, "]"]), i + 1


def to_java(rx: str) -> str:
    """The expression in Java's dialect; RegexError names a form that cannot be said there, or not with the same meaning."""
    out, i, quoted, literal = [], 0, False, False
    while i < len(rx):
        if literal:
            end = rx.find(r"\E", i)
            end = len(rx) if end < 0 else end
            out.append(re.sub(r"([^A-Za-z0-9\s])", r"\\\1", rx[i:end]))
            i, literal, quoted = end + 2, False, True
            continue
        for form, what in _REFUSED:
            if form.match(rx, i):
                raise RegexError(what)
        c = rx[i]
        if rx.startswith(r"\Q", i):
            i, literal = i + 2, True
        elif c == "\\":
            out.append(rx[i : i + 2])
            i, quoted = i + 2, True
        elif c == "[":
            part, i = _bracket(rx, i)
            out.append(part)
            quoted = True
        elif m := _GROUP.match(rx, i):
            name, again = m.groups()
            out.append(f"(?<{name}>" if name else rf"\k<{again}>" if again else "")
            i, quoted = m.end(), not name
        elif quoted and (m := _REPEAT.match(rx, i)):
            out.append(m.group())
            i = m.end()
            if rx[i : i + 1] == "+":
                raise RegexError("a possessive quantifier")
            if rx[i : i + 1] == "?":
                out.append("?")
                i += 1
            quoted = False
        elif c == ".":
            out.append("[^\\n]")  # Java's dot stops at other line ends too
            i, quoted = i + 1, True
        else:
            out.append(c)
            i, quoted = i + 1, c not in "(|^"
    return "".join(out)
