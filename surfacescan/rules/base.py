"""Validated rule base: building, storing with a checksum, loading, and tables for joins."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from pathlib import Path

import regex
from pyspark.sql import DataFrame, SparkSession

from ..schemas import CONTEXT_KINDS, FILE_TYPES, PHASES, SEGMENT_LABELS
from . import data

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9_]{0,63}")


@dataclass
class RuleBase:
    """Five tables as lists of dicts, the versions, and where they come from."""

    file_contexts: list[dict]
    code_contexts: list[dict]
    patterns: list[dict]
    matches: list[dict]
    phases: list[dict]
    versions: list[dict]
    provenance: dict = field(default_factory=dict)

    TABLES = ("file_contexts", "code_contexts", "patterns", "matches", "phases", "versions")

    @property
    def version(self) -> str:
        """The newest version by release order, later entries first among equals."""
        return max(enumerate(self.versions), key=lambda x: (x[1]["released"], x[0]))[1]["version"]

    def frame(self, spark: SparkSession, table: str) -> DataFrame:
        """One table as a DataFrame; at most a few dozen rows, so broadcasting it is safe."""
        kinds = {
            "file_contexts": "name string, version string, type string, message string, path string, recursive boolean, report boolean, filename string, code_context array<string>, computed boolean, assume_called boolean",
            "code_contexts": "name string, version string, message string, kind string, how string, target string",
            "patterns": "name string, version string, message string, attck string, functions array<string>",
            "matches": "name string, version string, message string, attck string, regex string, language string",
            "phases": "context string, " + ", ".join(f"{p} boolean" for p in PHASES),
            "versions": "version string, released int",
        }[table]
        cols = [x.split()[0] for x in kinds.split(", ")]
        return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in getattr(self, table)], kinds)

    def owners(self) -> dict[str, str]:
        """Function to the first rule, by name, that declares it."""
        out: dict[str, str] = {}
        for r in sorted(self.patterns, key=lambda r: r["name"]):
            for f in r["functions"]:
                out.setdefault(f, r["name"])
        return out

    def text(self) -> str:
        return json.dumps({t: getattr(self, t) for t in self.TABLES}, indent=1, sort_keys=True)


def _phases(context: str, on: str) -> dict:
    return {"context": context} | {p: p.removeprefix("at_") in on.split() for p in PHASES}


def default_rules() -> RuleBase:
    """The built-in rules, validated."""
    files = [
        {"name": n, "version": "0.4.0", "type": t, "message": f"{n.replace('_', ' ')}: a file that the toolchain {'runs' if p else 'can run'}", "path": at, "recursive": rec, "report": rep,
         "filename": fn, "code_context": cc if isinstance(cc, list) else None, "computed": cc == "computed", "assume_called": called}
        for n, t, rep, at, rec, fn, cc, called, p in data.FILE_RULES
    ]
    codes = [{"name": n, "version": "0.4.0", "message": f"code that runs in {n}", "kind": k, "how": how, "target": what} for n, k, (how, what), _ in data.CODE_RULES]
    patterns = [{"name": n, "version": v, "message": data.SAYS[n], "attck": a, "functions": f.split()} for n, v, a, f in data.PATTERN_RULES]
    matches = [{"name": n, "version": "0.4.0", "message": data.SAYS[n], "attck": a, "regex": rx, "needs": data.NEEDS[n].split(), "language": "shell"} for n, a, rx in data.MATCH_RULES]
    phases = sorted([_phases(r[0], r[-1]) for r in data.FILE_RULES] + [_phases(r[0], r[-1]) for r in data.CODE_RULES], key=lambda r: r["context"])
    base = RuleBase(files, codes, patterns, matches, phases, [{"version": v, "released": at} for v, at in data.VERSIONS])
    validate_rules(base)
    base.provenance = {"rules_version": base.version, "rules_sha256": hashlib.sha256(base.text().encode()).hexdigest()}
    return base


# What each kind of rule must have; further fields are reported, not refused.
FIELDS = {
    "file_contexts": {"name", "version", "type", "message", "path", "recursive", "report", "filename", "code_context", "computed", "assume_called"},
    "code_contexts": {"name", "version", "message", "kind", "how", "target"},
    "patterns": {"name", "version", "message", "attck", "functions"},
    "matches": {"name", "version", "message", "attck", "regex", "needs", "language"},
}
#: Fields that a rule may have: a syntax rule, and a code context whose `how` is xpath, say in XPath what they match.
OPTIONAL = {"patterns": {"xpath"}, "code_contexts": {"xpath"}}


def xpath_problem(xpath: str) -> str | None:
    """Why an expression is no good as a rule, if it is not."""
    from ..operators import xpath as read  # the operators import the rules

    try:
        read.parse(xpath)
    except read.XPathError as e:
        return f"is not read: {e}"
    return None


def java_regex_problem(rx: str) -> str | None:
    """Why an expression is no good as a rule: it does not compile, or it matches the empty string. The engine has the last word (engine_regex_problem); this is its dialect as far as the package regex reads it."""
    try:
        plain = regex.compile(rx)
    except regex.error as e:
        return f"does not compile: {e}"
    return "matches the empty string" if plain.match("") else None


def engine_regex_problem(spark: SparkSession, rx: str) -> str | None:
    """Why the engine itself refuses an expression, if it does."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(rx)
    except Exception as e:
        return f"does not compile: {str(getattr(e, 'java_exception', e)).splitlines()[0]}"
    return None


def validate_rules(base: RuleBase) -> list[str]:
    """Raise ValueError on the first broken rule; return warnings about unexpected fields."""
    warned, contexts = [], {r["name"] for r in base.code_contexts}
    versions = {r["version"] for r in base.versions}

    def stop(rule: dict, why: str) -> None:
        raise ValueError(f"rule {rule.get('name', '?')}: {why}")

    for table, wanted in FIELDS.items():
        seen = set()
        for r in getattr(base, table):
            if lacking := wanted - r.keys():
                stop(r, f"missing {', '.join(sorted(lacking))}")
            warned += [f"{table} {r['name']}: unexpected field {x}" for x in sorted(r.keys() - wanted - OPTIONAL.get(table, set()) - {"positive_examples", "negative_examples"})]
            if not isinstance(r["name"], str) or not NAME.fullmatch(r["name"]):
                stop(r, "bad name")
            if r["name"] in seen:
                stop(r, "name used twice")
            seen.add(r["name"])
            if not str(r["message"]).strip():
                stop(r, "empty message")
            if r["version"] not in versions:
                stop(r, f"unknown version {r['version']}")
            for kind in ("positive_examples", "negative_examples"):
                if kind in r and not (1 <= len(r[kind]) <= 50 and all(str(x).strip() for x in r[kind])):
                    stop(r, f"{kind}: 1 to 50, none empty")
            if "attck" in wanted and not str(r["attck"]).strip():
                stop(r, "no technique")
    for r in base.file_contexts:
        if r["type"] not in FILE_TYPES:
            stop(r, "unknown type")
        if ".." in r["path"].split("/"):
            stop(r, "path leaves the package")
        if why := java_regex_problem(r["filename"]):
            stop(r, f"filename {why}")
        if r["computed"] and r["code_context"]:
            stop(r, "computed and named code contexts mixed")
        if (r["assume_called"] is None) != (not r["computed"] and not r["code_context"]):
            stop(r, "assume_called is for rules with code contexts, and for all of them")
        if unknown := set(r["code_context"] or ()) - contexts:
            stop(r, f"unknown code contexts {sorted(unknown)}")
    for r in base.code_contexts:
        if r["kind"] not in CONTEXT_KINDS or (r["kind"] == "segment") != (r["how"] == "label"):
            stop(r, "kind and matcher disagree")
        if r["how"] == "label" and r["target"] not in SEGMENT_LABELS:
            stop(r, "unknown segment label")
    for r in [*base.patterns, *base.code_contexts]:
        if "xpath" in r and (why := xpath_problem(r["xpath"])):
            stop(r, f"XPath {why}")
    for r in base.matches:
        if r["language"] is not None and (not isinstance(r["language"], str) or not NAME.fullmatch(r["language"])):
            stop(r, "bad language")
        if why := java_regex_problem(r["regex"]):
            stop(r, f"regex {why}")
    for r in base.phases:
        if any(not isinstance(r.get(p), bool) for p in PHASES):
            stop({"name": r.get("context")}, "phases must be true or false")
    if lacking := ({r["name"] for r in base.file_contexts} | contexts) - {r["context"] for r in base.phases}:
        raise ValueError(f"no phases for {sorted(lacking)}")
    for table in ("file_contexts", "code_contexts", "patterns", "matches", "phases"):
        if not getattr(base, table):
            raise ValueError(f"no {table}")
    return warned


def save(base: RuleBase, path: str | Path) -> str:
    """Write the rules and, beside them, their SHA-256; nothing is written if they do not validate."""
    validate_rules(base)
    body = base.text().encode()
    digest = hashlib.sha256(body).hexdigest()
    Path(path).write_bytes(body)
    Path(f"{path}.sha256").write_text(digest + "\n")
    return digest


def load(path: str | Path) -> RuleBase:
    """Read rules whose SHA-256 is the one stored beside them; anything else is refused."""
    beside = Path(f"{path}.sha256")
    if not Path(path).is_file() or not beside.is_file():
        raise FileNotFoundError(f"{path} or its .sha256 is missing")
    want, body = (beside.read_text().split() or [""])[0].lower(), Path(path).read_bytes()
    have = hashlib.sha256(body).hexdigest()
    if not want or have != want:
        raise ValueError(f"{path}: checksum {have} is not {want or 'given'}")
    base = RuleBase(**json.loads(body))
    validate_rules(base)
    base.provenance = {"rules_version": base.version, "rules_sha256": have}
    return base
