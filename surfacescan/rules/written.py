"""Rules that users write as YAML, one a file, added to a rule base."""

from __future__ import annotations

import re
from dataclasses import replace
from pathlib import Path

import regex

from ..functions.regex import RegexError, to_java
from ..schemas import PHASES
from .base import RuleBase, validate_rules, xpath_problem

_EXAMPLES = ("positive_examples", "negative_examples")
#: The fields of each kind of file, told by the field that only it has.
_KINDS = {
    "filename": ("file_contexts", {"name", "version", "type", "message", "path", "recursive", "report", "filename", "code_context", "assume_called", *PHASES, *_EXAMPLES}),
    "functions": ("patterns", {"name", "version", "language", "message", "attck", "functions", *_EXAMPLES}),
    "kind": ("code_contexts", {"name", "version", "language", "message", "kind", "xpath", *PHASES, *_EXAMPLES}),
    "regex": ("matches", {"name", "version", "language", "message", "attck", "regex", *_EXAMPLES}),
}


def _parse(text: str) -> object:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("rules in YAML need the package yaml; rules in JSON (load) do not") from e
    return yaml.safe_load(text)


def _claims(rule: dict, path: str) -> bool:
    folder, _, name = path.rpartition("/")
    below = rule["path"] == "." or path.startswith(rule["path"] + "/")
    return (below if rule["recursive"] else (folder or ".") == rule["path"]) and re.search(rule["filename"], name) is not None


def read_rule(path: str | Path) -> tuple[str, dict, dict | None]:
    """The table, the rule and, of a file rule or code context, its phases. Raises ValueError that names the file and what is wrong.

    Line rules are written in the POSIX and PCRE dialects and said in the engine's; a form that has no
    counterpart is refused by name. Syntax rules name functions, or say in XPath what they seek (`functions`
    then names what a call by string may stand for, and may be empty); code contexts are XPath. Examples
    are tried where that takes no parser of R: of file rules (paths) and line rules (lines); `examples` of
    the audit plan tries those of the others.
    """

    def stop(why: str) -> None:
        raise ValueError(f"{path}: {why}")

    r = _parse(Path(path).read_text(encoding="utf-8"))
    if not isinstance(r, dict):
        stop("not a rule: no fields")
    kinds = [k for k in _KINDS if k in r]
    if len(kinds) != 1:
        stop("one of filename, functions, regex and kind must be there")
    table, fields = _KINDS[kinds[0]]
    if kinds == ["functions"] and "xpath" in r:
        fields = fields | {"xpath"}
    if wrong := fields ^ r.keys():
        stop(f"{'missing' if wrong & fields else 'unexpected'} {', '.join(sorted(wrong & fields or wrong))}")
    texts = {"name", "version", "type", "message", "path", "filename", "regex", "language", "kind", "xpath"} & fields
    if wrong := sorted(f for f in texts if not isinstance(r[f], str) or not r[f].strip()):
        stop(f"{', '.join(wrong)} must be text")
    lists = {"functions", "attck", *_EXAMPLES} & fields
    if wrong := sorted(f for f in lists if not isinstance(r[f], list) or not r[f] and not (f == "functions" and "xpath" in r) or not all(isinstance(x, str) and x.strip() for x in r[f])):
        stop(f"{', '.join(wrong)} must be a list of texts")
    if wrong := sorted(f for f in {"recursive", "report", *PHASES} & fields if not isinstance(r[f], bool)):
        stop(f"{', '.join(wrong)} must be true or false")
    rule = {k: v for k, v in r.items() if k not in PHASES}
    if "attck" in rule:
        rule["attck"] = " ".join(rule["attck"])
    try:
        if table == "file_contexts":
            code = r["code_context"]
            rule |= {"computed": code == "computed", "code_context": None if code in (None, "computed") else [code] if isinstance(code, str) else code}
            wrong = [x for kind in _EXAMPLES for x in r[kind] if _claims(rule, x) != (kind == "positive_examples")]
            return (table, rule, {"context": r["name"]} | {p: r[p] for p in PHASES}) if not wrong else stop(f"does not hold for its example {wrong[0]}")
        if table == "code_contexts":
            if rule["kind"] != "xpath":
                stop("code contexts of segments are built in; kind must be xpath")
            if rule.pop("language") != "R":
                stop("code contexts are sought in R alone")
            if why := xpath_problem(rule["xpath"]):
                stop(f"XPath {why}")
            return table, rule | {"how": "xpath", "target": ""}, {"context": r["name"]} | {p: r[p] for p in PHASES}
        if table == "matches":
            rule["needs"] = []
            rule["regex"] = to_java(rule["regex"])
            plain = regex.compile(rule["regex"])
            if wrong := [x for kind in _EXAMPLES for x in r[kind] if any(map(plain.search, x.split("\n"))) != (kind == "positive_examples")]:
                stop(f"does not hold for its example {wrong[0]}")
        else:
            if rule.pop("language") != "R":
                stop("functions are sought in R alone")
            if "xpath" in rule and (why := xpath_problem(rule["xpath"])):
                stop(f"XPath {why}")
    except RegexError as e:
        stop(f"{e} cannot be said in the engine's dialect")
    except (re.error, regex.error) as e:
        stop(f"does not compile: {e}")
    return table, rule, None


def with_rules(base: RuleBase, *paths: str | Path) -> RuleBase:
    """A base with the rules of the files (of folders: all *.yaml below, by name) added, validated as a whole."""
    tables = {t: list(getattr(base, t)) for t in ("file_contexts", "code_contexts", "patterns", "matches", "phases")}
    files = [f for p in map(Path, paths) for f in (sorted(p.rglob("*.yaml")) if p.is_dir() else [p])]
    for f in files:
        table, rule, phases = read_rule(f)
        tables[table].append(rule)
        if phases:
            tables["phases"].append(phases)
    out = replace(base, **tables, provenance={})
    validate_rules(out)
    return out
