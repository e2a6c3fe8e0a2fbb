"""Which rules claim which files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import any_of, basename, dirname
from ..rules import RuleBase


def _claims(rule: dict, path: Column) -> Column:
    """Whether a rule claims a path: by its folder (or any below it) and the file's name."""
    if not rule["recursive"]:
        place = dirname(path) == rule["path"]
    else:
        place = F.lit(True) if rule["path"] == "." else F.startswith(path, F.lit(rule["path"] + "/"))
    return place & basename(path).rlike(rule["filename"])


def find_file_contexts(files: DataFrame, rules: RuleBase) -> DataFrame:
    """One row a file and claiming rule: package, version, file_context, rule, type, report, message, computed, code_contexts.

    The rules are one array of structs, filtered by their conditions in a single pass over the paths:
    no join, no content read.
    """
    path = F.col("file_context")
    rows = [
        F.when(
            _claims(r, path),
            F.struct(
                F.lit(r["name"]).alias("rule"), F.lit(r["type"]).alias("type"), F.lit(r["report"]).alias("report"), F.lit(r["message"]).alias("message"),
                F.lit(r["computed"]).alias("computed"), F.array(*map(F.lit, r["code_context"] or ())).cast("array<string>").alias("code_contexts"),
            ),
        )
        for r in sorted(rules.file_contexts, key=lambda r: r["name"])
    ]
    found = files.where("file_context IS NOT NULL AND NOT is_symlink").select("package", "version", "file_context", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("c"))
    return found.select("package", "version", "file_context", "c.*")


def reported(found: DataFrame) -> DataFrame:
    return found.where("report").select("package", "version", "rule", "file_context", "message")


def scan_set(found: DataFrame) -> DataFrame:
    """Distinct readings: a file once for each rule that wants it read."""
    return found.where("type <> 'other'").select("package", "version", "file_context", "type", "rule", "code_contexts").distinct()


def claiming_rule(found: DataFrame) -> DataFrame:
    """The rule named for each file: one that reads it before others, then by name."""
    first = F.min(F.struct((F.col("type") == "other").alias("o"), F.col("rule").alias("rule")))
    return found.groupBy("package", "version", "file_context").agg(first.alias("f")).select("package", "version", "file_context", "f.rule")


def in_scope(path: Column, rules: RuleBase) -> Column:
    """Whether a file not claimed by any rule still counts: its name matches an anchored name of a rule, wherever it lies."""
    return any_of([basename(path).rlike(p) for p in sorted({r["filename"] for r in rules.file_contexts if r["filename"].endswith("$")})])
