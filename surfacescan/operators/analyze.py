"""Analyzers of further languages, each failure contained.

An analyzer takes a language's segments and gives findings. A plain function of one segment, wrapped in
PerSegment, has an error channel beside its rows: what it raises costs that segment and gives an error row.
Any other analyzer is a function from the DataFrame of segments to one of findings; what it raises, while
its plan is made or while Spark runs it, costs the analyzer and gives an error row a package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..schemas import LINE_FINDINGS, conform, names

KEYS = ["package", "version", "file_context"]
FINDING = names(LINE_FINDINGS)
FOUND = f"package string, version string, {LINE_FINDINGS}, failed string"
#: Characters of an error's text that are kept.
KEPT = 500


def told(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e)[:KEPT]}"


@dataclass(frozen=True)
class PerSegment:
    """find: from the lines of a segment and its facts (package, version, file_context, rule, context) to dicts of a finding's columns but file_context; a preview, unless given, is the line."""

    find: Callable[[list[str], dict], Iterable[dict]]

    def __call__(self, segments: DataFrame) -> DataFrame:
        """Findings, and for a segment that failed one row with `failed` and no rule."""
        find = self.find

        def one(r) -> Iterator[tuple]:
            key = (r.package, r.version)
            lines = list(r.lines)
            try:
                rows = []
                for x in find(lines, {k: getattr(r, k) for k in (*KEYS, "rule", "context")}):
                    at = int(x["line_number"])
                    x = {"column_number": 1, "message": None, "attck": None, "preview": lines[at - 1].strip()} | x | {"file_context": r.file_context}
                    rows.append((*key, *(x[c] for c in FINDING), None))
            except Exception as e:  # the segment's own failure
                rows = [(*key, None, r.file_context, *[None] * (len(FINDING) - 2), told(e))]
            yield from rows

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                out = pd.DataFrame([x for r in pdf.itertuples(index=False) for x in one(r)], columns=names(FOUND))
                yield out.astype({"line_number": "Int32", "column_number": "Int32"})

        return segments.select(*KEYS, "rule", "context", "lines").mapInPandas(run, FOUND)


def analyze(segments: DataFrame, language: str, analyzer: PerSegment | Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """Findings of a language's segments (None where the analyzer failed as a whole) and errors (package, version, file_context, rule, message)."""
    rows = segments.where(F.col("language") == language)
    named = F.lit(language).alias("rule")
    try:
        if isinstance(analyzer, PerSegment):
            found = cut(analyzer(rows))  # read twice
            errors = found.where("failed IS NOT NULL").select(*KEYS, named, F.col("failed").alias("message"))
            return conform(found.where("failed IS NULL"), LINE_FINDINGS), errors
        return cut(conform(analyzer(rows), LINE_FINDINGS)), rows.limit(0).select(*KEYS, named, F.lit("").alias("message"))
    except Exception as e:
        return None, segments.select("package", "version").distinct().select("package", "version", F.lit(None).cast("string").alias("file_context"), named, F.lit(told(e)).alias("message"))
