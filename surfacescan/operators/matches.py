"""Regular-expression rules over the lines of shell and make segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.findings import match_columns, may_match, preview, regex_literal
from ..rules import RuleBase


def lines_of(segments: DataFrame) -> DataFrame:
    """One row a line: the segment's keys, language, line_number, line."""
    return segments.select("package", "version", "file_context", "language", F.posexplode("lines").alias("p", "line")).select(
        "package", "version", "file_context", "language", (F.col("p") + 1).cast("int").alias("line_number"), "line"
    )


def rules_for(rules: RuleBase, language: str) -> list[dict]:
    """The match rules of a language, and those of none."""
    return [r for r in rules.matches if r["language"] in (None, language)]


def find_matches(segments: DataFrame, rules: RuleBase, language: str = "shell") -> DataFrame:
    """All matches of all rules: rule, file_context, line_number, column_number, preview, message, attck (without phases).

    One pass over the lines: each rule's positions are an expression, lines without any of the strings
    that a rule needs skip its regex, and lines no rule matches go before anything is exploded.
    """
    lines = lines_of(segments.where(F.col("language") == language))
    use = sorted(rules_for(rules, language), key=lambda r: r["name"])
    # As a lambda the condition is evaluated rule by rule: generated code of all rules in one method is too long for the JVM to compile.
    some = " OR ".join(f"({may_match('x', r['needs'])} AND x RLIKE {regex_literal(r['regex'])})" for r in use) or "false"
    hits = lines.where(f"exists(array(line), x -> {some})")
    text = lambda x: "'" + x.replace(chr(92), chr(92) * 2).replace("'", chr(92) + "'") + "'"
    structs = [
        f"transform({match_columns('line', r['regex'], r['needs'])}, c -> named_struct('rule', '{r['name']}', 'message', {text(r['message'])}, 'attck', {text(r['attck'])}, 'c', c))"
        for r in use
    ]
    rows = hits.selectExpr("*", f"explode(concat({', '.join(structs)})) AS m")
    return rows.select(
        "package", "version", F.col("m.rule").alias("rule"), "file_context", "line_number", F.col("m.c").cast("int").alias("column_number"),
        preview(F.col("line"), F.col("m.c")).alias("preview"), F.col("m.message").alias("message"), F.col("m.attck").alias("attck"),
    )
