"""Schemas of the result frames, and the closed vocabularies they use."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lifecycle phases in order, and the vocabularies of the result columns.
PHASES = ("at_autoconf", "at_build", "at_check", "at_install_src", "at_install_bin", "at_load", "at_attach", "at_unload", "at_detach")
FILE_TYPES = ("R", "Rd", "Rmd", "qmd", "Rnw", "rsp", "shell", "make", "other")
STATUSES = ("parsed", "matched", "exportable", "unexamined", "error")
REASONS = ("no_analyzer", "no_extractor", "serialized", "binary", "no_rule", "symlink", "too_large", "unreadable", "unparseable")
COMPUTED = ("top_level", "in_function")
SEGMENT_LABELS = ("Rd_examples", "Rd_Sexpr_build", "Rd_Sexpr_install", "Rd_Sexpr_render")
CONTEXT_KINDS = ("xpath", "segment")
STEPS = ("find_file_contexts", "extract_segments", "read_code", "read_Rd_code", "parse_code", "find_code_contexts", "find_patterns", "find_indirect", "find_matches")

_P = ", ".join(f"{p} boolean" for p in PHASES)
FILES = "package string, version string, file_context string, bytes long, content binary, is_symlink boolean"
LINE_FINDINGS = "rule string, file_context string, line_number int, column_number int, preview string, message string, attck string"
FRAMES = {
    "file_contexts": f"rule string, file_context string, message string, {_P}",
    "patterns": f"rule string, file_context string, line_number int, column_number int, code_context string, guarded boolean, indirect boolean, preview string, message string, attck string, {_P}",
    "matches": f"{LINE_FINDINGS}, {_P}",
    "coverage": f"file_context string, language string, status string, reason string, first_line int, last_line int, lines int, bytes long, rule string, {_P}",
    "errors": "step string, file_context string, rule string, message string",
}
SCANS = "pkg_name string, pkg_version string, pkg_path string, pkg_is_tarball boolean, pkg_sha256 string, engine_version string, rules_version string, rules_sha256 string, scanned string"
SEGMENTS = "package string, version string, file_context string, rule string, seg_ord int, language string, context string, code_contexts array<string>, lines array<string>, guarded_lines array<int>, step string, message string"
NODES = (
    "package string, version string, file_context string, rule string, seg_ord int, pre int, size int, parent int, gparent int, ord int, depth int, tag string, text string, "
    "line1 int, col1 int, line2 int, col2 int, after_dollar boolean, after_at boolean, prev_pkg string, first_arg boolean, named_arg string, in_function boolean, assigned string, message string"
)
ENTRIES = "package string, name string, type string, linkname string, size long"


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def arrow(schema: str) -> pa.Schema:
    """The Arrow form of a schema of plain columns."""
    return pa.schema([(n, _ARROW[t]) for n, t in (x.split(" ", 1) for x in schema.split(", "))])


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as one Arrow batch."""
    to = arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), to.types)], schema=to)


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def conform(df: DataFrame, schema: str, keys: tuple[str, ...] = ("package", "version")) -> DataFrame:
    """df with keys and exactly the schema's columns, cast; further columns go, a missing one is an error."""
    lacking = [c for c in names(schema) if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df.select(*(k for k in keys if k in df.columns), *(F.col(n).cast(t).alias(n) for n, t in (x.split(" ", 1) for x in schema.split(", "))))


def validate(df: DataFrame, schema: str, keys: tuple[str, ...] = ("package", "version")) -> DataFrame:
    """df, if its columns and types are exactly the schema's (after keys)."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema if f.name not in keys]
    want = [(n, {"long": "bigint"}.get(t, t)) for n, t in (x.split(" ", 1) for x in schema.split(", "))]
    if have != want:
        raise ValueError(f"columns {have} are not {want}")
    return df
