"""Summaries of an audit, their text, and notes on what went wrong."""

from __future__ import annotations

import os
import re
import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.findings import check_phases, in_phase, runs_automatically
from ..functions.paths import coverage_type, top_level
from ..schemas import PHASES, STATUSES, STEPS


def summarize_findings(findings: DataFrame, phases: list[str] | None = None) -> DataFrame:
    """phase, rule, n, attck (and phase_rank): a finding counts once in each of its phases, and under "none" without any.

    Order by phase_rank and rule: lifecycle order, or the caller's where phases are given.
    """
    order = check_phases(phases) or [*PHASES, "none"]
    pairs = ", ".join([*(f"'{p}', {p}" for p in PHASES), "'none', NOT (" + " OR ".join(PHASES) + ")"])
    rows = findings.selectExpr("rule", "attck", *PHASES).selectExpr("rule", "attck", f"stack({len(PHASES) + 1}, {pairs}) AS (phase, holds)").where("holds").where(F.col("phase").isin(order))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("phase")).cast("int")
    return rows.groupBy("phase", "rule").agg(F.count("*").alias("n"), F.min("attck").alias("attck")).select("phase", "rule", "n", "attck", rank.alias("phase_rank"))


def summarize_coverage(cover: DataFrame, phases: list[str] | None = None) -> DataFrame:
    """status, top_level, type, files, lines (null if none is known), and the status' rank to order by."""
    rows = in_phase(cover, phases) if phases else cover
    path = F.col("file_context")
    keyed = rows.select("status", top_level(path).alias("top_level"), coverage_type(F.col("language"), path).alias("type"), "lines")
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")).cast("int")
    return keyed.groupBy("status", "top_level", "type").agg(F.count("*").alias("files"), F.sum("lines").alias("lines")).withColumn("status_rank", rank)


def summarize_contexts(contexts: DataFrame) -> DataFrame:
    """Distinct files and rules reported of each package and version, in order of path and rule."""
    return contexts.select("package", "version", "file_context", "rule").distinct().orderBy("package", "version", "file_context", "rule")


def summarize_errors(errors: DataFrame) -> DataFrame:
    return errors.select("step", "file_context", "rule", F.col("message").alias("error"))


def error_counts(errors: DataFrame) -> DataFrame:
    """Per step: rows, distinct files and rules (the row count where none is known)."""
    n = F.count("*")
    of = lambda c: F.when(F.countDistinct(c) == 0, n).otherwise(F.countDistinct(c))
    return errors.groupBy("step").agg(n.alias("n"), of("file_context").alias("n_files"), of("rule").alias("n_rules"))


#: What a failed step means; {n} is a count of files or rules.
NOTES = {
    "find_file_contexts": ("rules", "{n} could not be applied to the file names; files they would claim may be missing."),
    "extract_segments": ("files", "{n} could not be taken apart; nothing in them was scanned."),
    "read_code": ("files", "{n} could not be read in full; what could not be read was not scanned."),
    "read_Rd_code": ("files", "{n} did not parse as help pages; only what was recovered was scanned."),
    "parse_code": ("files", "{n} did not parse as R; no syntax rule saw that code."),
    "find_code_contexts": ("rules", "{n} of the code contexts failed; code inside them may count as top level."),
    "find_patterns": ("rules", "{n} failed on some code; findings may be missing."),
    "find_indirect": ("files", "{n} could not be searched for functions named by strings."),
    "find_matches": ("rules", "{n} of the line rules failed; findings may be missing."),
}


# Packages that define well-known help-page macros, by package. The macro's name alone decides, never what the scanned package says of itself.
MACROS_OF = {
    "Rdpack": "insertAllCited insertCite insertCited insertCiteOnly insertFig insertNoCite insertRef makeFig printExample runExamples".split(),
    "mathjaxr": "loadmathjax mjdeqn mjeqn mjsdeqn mjseqn mjtdeqn mjteqn".split(),
    "lifecycle": ["lifecycle"],
    "details": ["foldstart", "foldend"],
}
_UNKNOWN_MACRO = r"unknown macro '\\([A-Za-z][A-Za-z0-9]*)'"


def _count(n: int, what: str) -> str:
    return f"{n} {what if n != 1 else what[:-1]}"


def unknown_macros(errors: DataFrame) -> DataFrame:
    """file_context and macro of each use of a help-page macro that could not be expanded."""
    return errors.where("step = 'read_Rd_code'").select("file_context", F.explode(F.expr(f"regexp_extract_all(message, r\"{_UNKNOWN_MACRO}\", 1)")).alias("macro"))


def _macro_note(errors: DataFrame) -> str:
    known = {m: p for p, names in MACROS_OF.items() for m in names}
    used = unknown_macros(errors)
    n = used.select("file_context").distinct().count()
    named = {known[r[0]] for r in used.where(F.col("macro").isin(*known)).select("macro").distinct().collect()}
    helps = [p for p in MACROS_OF if p in named]
    hint = f" With {', '.join(helps[:-1]) + ' and ' if helps[1:] else ''}{helps[-1]} installed it would be." if helps else ""
    return f"{_count(n, 'help pages')} used macros that are not known here; code that these stand for was not scanned.{hint}"


def error_notes(errors: DataFrame) -> list[str]:
    """One sentence a failed step, in the order of the pipeline; steps that are not of it come last, by name. Reads a row a step and the macros of MACROS_OF."""
    macro = F.coalesce((F.col("step") == "read_Rd_code") & F.contains("message", F.lit("unknown macro '")), F.lit(False))
    counted = {r["step"]: r for r in error_counts(errors.where(~macro)).collect()}
    lost = not errors.where(macro).isEmpty()
    out = []
    for step in STEPS:
        if step == "read_Rd_code" and lost:
            out.append(_macro_note(errors))
        if r := counted.pop(step, None):
            what, note = NOTES[step]
            out.append(note.format(n=_count(r["n_rules" if what == "rules" else "n_files"], what)))
    return out + [f"{_count(r['n'], 'errors')} in the step {step}; the scan may not be complete." for step, r in sorted(counted.items(), key=lambda x: x[0] or "")]


WIDTH = 77


def header(label: str) -> str:
    return f"--- {label} ".ljust(WIDTH, "-")


def field(label: str, value: object, width: int = 11) -> str:
    return f"{label + ':':<{width}} {value}".rstrip()


def table(rows: list[tuple], columns: list[str], widths: list[int] | None = None) -> list[str]:
    """Fixed-width lines: text to the left, numbers to the right, null blank."""
    cells = [["" if x is None else str(x) for x in r] for r in rows]
    widths = widths or column_widths(rows, columns)
    right = [any(isinstance(r[i], (int, float)) for r in rows) for i in range(len(columns))]
    line = lambda r: "   ".join(x.rjust(w) if a else x.ljust(w) for x, w, a in zip(r, widths, right, strict=True)).rstrip()
    return [line(columns), *map(line, cells)]


def column_widths(*parts: list) -> list[int]:
    """Widths that fit all given (rows, columns) pairs."""
    out: list[int] = []
    for rows, columns in zip(parts[0::2], parts[1::2], strict=True):
        here = [max([len(c), *(len("" if r[i] is None else str(r[i])) for r in rows)]) for i, c in enumerate(columns)]
        out = [max(a, b) for a, b in zip(out, here, strict=True)] if out else here
    return out


def shown_time(scanned: str | None) -> str:
    """YYYY-MM-DD HH:MM UTC of ISO text; other text as it is."""
    if not scanned:
        return "<unknown>"
    head = scanned[:16]
    return f"{head.replace('T', ' ')} UTC" if len(head) == 16 and head[4] == "-" and head[10] == "T" else scanned


def under_home(path: str, home: str | None = None) -> str:
    """The path with the home folder as ~, if it is that folder or lies below it."""
    home = re.sub("/+$", "", (os.path.expanduser("~") if home is None else home).replace("\\", "/"))
    rest = path.replace("\\", "/").removeprefix(home)
    return f"~{rest}" if home and len(rest) + len(home) == len(path) and (not rest or rest[0] == "/") else path


def _one(audit, package: str, version: str | None):
    """A filter for one package's rows: of the version, or of the only one there is."""
    _check(audit, package)
    have = sorted((r["version"] for r in audit.scans.where(F.col("package") == package).select("version").distinct().collect()), key=lambda v: (v is not None, v))
    if not have or version is not None and version not in have:
        raise ValueError(f"no package {package}{'' if version is None else f' {version}'} in this audit")
    if version is None and len(have) > 1:
        raise ValueError(f"{package} is there in versions {', '.join(map(str, have))}: name one")
    wanted = have[0] if version is None else version
    return lambda df: df.where((F.col("package") == package) & F.col("version").eqNullSafe(F.lit(wanted)))


def _check(audit, package: str) -> None:
    if lacking := [x for x in ("patterns", "matches", "coverage", "errors", "scans") if not isinstance(getattr(audit, x, None), DataFrame)]:
        raise ValueError(f"not an audit: without {', '.join(lacking)}")
    if not isinstance(package, str) or not package:
        raise ValueError("package must be a name")


def text_report(audit, package: str, phases: list[str] | None = None, path: bool = True, version: str | None = None) -> str:
    """The report on one package and version, without the line of its path if asked. Collects its summaries: rows by phase and rule, status and folder. Of several versions one must be named."""
    one = _one(audit, package, version)
    meta = one(audit.scans).first()
    columns = ["phase", "rule", "n", "attck"]
    found = {
        title: [tuple(r)[:4] for r in summarize_findings(one(df), phases).orderBy("phase_rank", "rule").collect()]
        for title, df in (("R Patterns", audit.patterns), ("Shell / Make Matches", audit.matches))
    }
    cover = [tuple(r)[:5] for r in summarize_coverage(one(audit.coverage)).orderBy("status_rank", "top_level", "type").collect()]
    notes = error_notes(one(audit.errors))
    out = [header("Package"), field("Name", meta["pkg_name"] or "<unknown>"), field("Version", meta["pkg_version"] or "<unknown>"), field("SHA-256", meta["pkg_sha256"]),
           field("Rules", meta["rules_version"] or "<unknown>"), field("Scanned", shown_time(meta["scanned"]))]
    if path:
        out.insert(3, field("Path", under_home(meta["pkg_path"]) if meta["pkg_path"] else "<unknown>"))
    if phases:
        out.append(field("Phases", ", ".join(check_phases(phases))))
    widths = column_widths(*(x for rows in found.values() for x in (rows, columns)))
    for title, rows in found.items():
        out += ["", header(title), *(table(rows, columns, widths) if rows else ["none"])]
        if any(r[0] == "none" for r in rows):
            out += textwrap.wrap("Findings under none run in no phase by themselves: something must call the code they are in.", WIDTH)
    out += ["", header("Coverage"), *(table(cover, ["status", "top_level", "type", "files", "lines"]) if cover else ["none"])]
    out += ["", header("Errors"), *(notes or ["none"])]
    return "\n".join(x.rstrip() for x in out)


def short_text(audit, package: str, version: str | None = None) -> str:
    """Counts of one package's findings, one a line."""
    one = _one(audit, package, version)
    n = {name: one(getattr(audit, name)).count() for name in ("file_contexts", "patterns", "matches", "errors")}
    labels = {"file_contexts": "File contexts", "patterns": "Patterns", "matches": "Matches", "errors": "Errors"}
    return "\n".join(field(labels[k], f"{v}{'   (coverage incomplete)' if k == 'errors' and v else ''}", 16) for k, v in n.items())


def automatic(findings: DataFrame) -> DataFrame:
    return findings.where(runs_automatically())
