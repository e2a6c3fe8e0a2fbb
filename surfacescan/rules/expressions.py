"""The built-in syntax rules and code contexts said in XPath, written from their lists of names."""

from __future__ import annotations

from dataclasses import replace

from . import data
from .base import RuleBase

#: Called as itself, not as a member of something.
BARE = "not(preceding-sibling::OP-DOLLAR) and not(preceding-sibling::OP-AT)"


def _any(names: list[str]) -> str:
    return "(" + " or ".join(f"text() = '{n}'" for n in names) + ")"


def call(names: list[str], more: str = BARE) -> str:
    """A call of one of the functions."""
    return f"SYMBOL_FUNCTION_CALL[{_any(names)} and {more}]"


def _holds(words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(text(), '{w}')" for w in words) + ")"


def literal(words: tuple[str, ...]) -> str:
    """A string that holds one of the words and reads as code rather than prose."""
    return f"//STR_CONST[{_holds(words)} and not(contains(text(), '`')) and (not(contains(text(), ' ')) or string-length(text()) < 32)]"


def pattern(name: str, functions: list[str], sources: list[str]) -> str:
    """The expression of a built-in syntax rule."""
    out = [f"//{call(functions)}"] if functions else []
    out += [f"//{call([f], f"preceding-sibling::SYMBOL_PACKAGE[text() = '{p}']")}" for r, f, p in data.PACKAGE_CALLS if r == name]
    if classes := [s for r, s in data.CLASS_NEWS if r == name]:
        out.append(f"//expr[{call(['new'], 'preceding-sibling::OP-DOLLAR')} and .//SYMBOL[{_any(classes)}]]")
    if name == "decoding":
        out.append(f"//expr[expr/{call(['rawToChar'])} and .//{call(['as.raw'])}]")
    if name == "eval_parse":
        out.append(f"//expr[expr/{call(['eval', 'evalq'])} and .//{call(list(data.PARSERS))} and .//{call(sources)}]")
    if name == "options_repos":
        out.append(f"//expr[expr/{call(['options'])} and SYMBOL_SUB[text() = 'repos']]")
    if name == "persistence":
        out.append(literal(data.PERSISTENCE))
    if name == "credentials":
        out.append(literal(data.SECRET_PATHS))
        out.append(f"//{call(['Sys.getenv'])}[../../expr[2][not(preceding-sibling::EQ_SUB)]/STR_CONST[{_holds(data.SECRET_NAMES)}]]")
    return " | ".join(out)


def context(how: str, target: str) -> str:
    """The expression of a built-in code context: a function assigned to a name, or a call."""
    if how == "call":
        return f"//expr[expr/{call([target])}]"
    named = f"SYMBOL[text() = '{target}']"
    return f"//*[expr[1]/{named} and (LEFT_ASSIGN or EQ_ASSIGN) and expr[FUNCTION] or expr[2]/{named} and RIGHT_ASSIGN and expr[1]//FUNCTION]"


def in_xpath(base: RuleBase) -> RuleBase:
    """The rules with every built-in syntax rule and code context as an expression."""
    sources = [f for r in base.patterns if r["name"] in data.CAPABILITIES for f in r["functions"]] + list(data.READERS)
    patterns = [r | {"xpath": pattern(r["name"], r["functions"], sources)} for r in base.patterns]
    contexts = [r if r["kind"] == "segment" else r | {"how": "xpath", "target": "", "xpath": context(r["how"], r["target"])} for r in base.code_contexts]
    return replace(base, patterns=patterns, code_contexts=contexts)
