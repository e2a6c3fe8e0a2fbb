"""Expressions over findings: match positions, previews and phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PHASES
from .paths import any_of

#: Characters of a preview, and how far before a far match it begins.
PREVIEW, BEFORE = 72, 16
_MARK = "\u0001"


def may_match(line: str, needs: list[str]) -> str:
    """Spark SQL: whether a line holds one of the strings that a regex cannot match without (none given: it may). Far cheaper than the regex."""
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "(" + (" OR ".join(f"contains({line}, {quote(x)})" for x in needs) or "true") + ")"


def regex_literal(regex: str) -> str:
    """Spark SQL: a rule's regex, with line ends as they are on Unix."""
    return "'" + ("(?d)" + regex).replace("\\", "\\\\").replace("'", "\\'") + "'"


def match_columns(line: str, regex: str, needs: list[str] = ()) -> str:
    """Spark SQL: the 1-based columns, in characters, of all matches of a regex in a line expression.

    The matches are marked by replacement and the line cut at the marks, once; a fold over the parts
    adds up their lengths, and a match begins where the parts before it end.
    """
    literal = regex_literal(regex)
    parts = f"split(regexp_replace(replace({line}, '{_MARK}', ' '), {literal}, '{_MARK}$0'), '{_MARK}', -1)"
    fold = (
        f"aggregate({parts}, named_struct('n', 0, 'at', CAST(array() AS ARRAY<INT>)), "
        "(s, x) -> named_struct('n', s.n + length(x), 'at', array_append(s.at, s.n + length(x) + 1)), s -> slice(s.at, 1, size(s.at) - 1))"
    )
    return f"IF({may_match(line, needs)} AND {line} RLIKE {literal}, {fold}, CAST(array() AS ARRAY<INT>))"


def preview(line: Column, column: Column, continues: Column | None = None) -> Column:
    """The PREVIEW characters around a column: from the indent, or from BEFORE ahead of a far match; dots where it was cut."""
    lead = F.length(F.regexp_extract(line, r"^(\s*)", 1))
    at = F.coalesce(column, lead + 1)
    start = F.when(at > lead + 1 + PREVIEW - BEFORE, at - BEFORE).otherwise(lead + 1)
    text = F.regexp_replace(F.trim(F.regexp_replace(F.substr(line, start, F.lit(PREVIEW)), r"\s+", " ")), r"^ | $", "")
    more = (start + PREVIEW - 1 < F.length(line)) | (F.lit(False) if continues is None else F.coalesce(continues, F.lit(False)))
    return F.concat(F.when(start > lead + 1, F.lit("...")).otherwise(F.lit("")), text, F.when(more, F.lit("...")).otherwise(F.lit("")))


def runs_automatically() -> Column:
    return any_of([F.col(p) for p in PHASES])


def check_phases(phases: list[str] | None) -> list[str] | None:
    """None, or the distinct phases in the caller's order; "none" stands for findings without a phase."""
    if phases is None:
        return None
    if unknown := [p for p in phases if p not in (*PHASES, "none")]:
        raise ValueError(f"unknown phase: {', '.join(unknown)}")
    return list(dict.fromkeys(phases))


def in_phase(df: DataFrame, phases: list[str] | None) -> DataFrame:
    """Rows that run in any of the phases."""
    phases = check_phases(phases)
    if phases is None:
        return df
    return df.where(any_of([~runs_automatically() if p == "none" else F.col(p) for p in phases]))


def with_phases(df: DataFrame, key: str, lookup: DataFrame) -> DataFrame:
    """df with the phases of its key; all false where the key is unknown. lookup: the rules' phases, a few dozen rows."""
    table = F.broadcast(lookup.select(F.col("context").alias("__context"), *(F.col(p).alias(f"__{p}") for p in PHASES)))
    joined = df.join(table, F.col(key) == F.col("__context"), "left")
    return joined.select(*df.columns, *(F.coalesce(f"__{p}", F.lit(False)).alias(p) for p in PHASES))
