"""How well each file was read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ANALYZED, BINARY, SERIALIZED, excluded, extension, language_of
from ..rules import RuleBase
from .claims import claiming_rule, in_scope

KEYS = ["package", "version", "file_context"]
#: Steps whose errors mean that a file was not read.
READING = ("read_code", "extract_segments", "parse_code")


def _beside(df: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """df left-joined to other on the file, taking columns."""
    right = other.select(*(F.col(k).alias(f"__{k}") for k in KEYS), *columns)
    return df.join(right, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS], "left").drop(*(f"__{k}" for k in KEYS))


def error_reasons(errors: DataFrame) -> DataFrame:
    """Per file the reason of its first reading error, in the order of the reading steps' appearance (`ord`, if any, else by text)."""
    why = F.when(F.contains("message", F.lit("scanning limit")), "too_large").when(F.col("step") == "parse_code", "unparseable").otherwise("unreadable")
    rank = F.when(F.col("step") == "extract_segments", 0).when(F.col("step") == "read_code", 1).otherwise(2)
    first = errors.where(F.col("step").isin(*READING)).groupBy(*KEYS).agg(F.min(F.struct(rank.alias("o"), why.alias("why"))).alias("f"))
    return first.select(*KEYS, F.col("f.why").alias("failed"))


def build_coverage(files: DataFrame, found: DataFrame, rules: RuleBase, scanned: DataFrame, errors: DataFrame, lines: DataFrame) -> DataFrame:
    """One row a file in scope: language, status, reason, extent, bytes and the rule named for it.

    scanned: (file, read_as), the type each file was read as; lines: (file, n_lines) of readable text.
    """
    rows = files.where("file_context IS NOT NULL").where(~excluded(F.col("file_context"))).select(*KEYS, "bytes", "is_symlink")
    rows = _beside(rows, claiming_rule(found), ["rule"]).where(F.col("rule").isNotNull() | in_scope(F.col("file_context"), rules))
    rows = _beside(_beside(_beside(rows, error_reasons(errors), ["failed"]), scanned, ["read_as"]), lines, ["n_lines"])
    read_as = F.when(F.col("read_as") == "make", "shell").otherwise(F.col("read_as"))
    ext = extension(F.col("file_context"))
    lang = language_of(ext)
    ladder = (
        F.when(F.col("is_symlink"), F.struct(F.lit("unexamined").alias("status"), F.lit("symlink").alias("reason"), lang.alias("language")))
        .when(F.col("failed").isNotNull(), F.struct(F.lit("error").alias("status"), F.col("failed").alias("reason"), lang.alias("language")))
        .when(read_as.isNotNull(), F.struct(F.when(read_as == "shell", "matched").otherwise("parsed").alias("status"), F.lit(None).cast("string").alias("reason"), read_as.alias("language")))
        .when(ext.isin(*SERIALIZED), F.struct(F.lit("unexamined").alias("status"), F.lit("serialized").alias("reason"), lang.alias("language")))
        .when(ext.isin(*BINARY), F.struct(F.lit("unexamined").alias("status"), F.lit("binary").alias("reason"), lang.alias("language")))
        .when(lang.isNotNull() & ~lang.isin(*ANALYZED), F.struct(F.lit("exportable").alias("status"), F.lit("no_analyzer").alias("reason"), lang.alias("language")))
        .otherwise(F.struct(F.lit("unexamined").alias("status"), F.when(F.col("rule").isNull(), "no_rule").otherwise("no_extractor").alias("reason"), lang.alias("language")))
    )
    rows = rows.withColumn("__v", ladder)
    n = F.when(F.col("__v.status").isin("parsed", "matched", "exportable"), F.col("n_lines")).cast("int")
    return rows.select(
        *KEYS, F.col("__v.language").alias("language"), F.col("__v.status").alias("status"), F.col("__v.reason").alias("reason"),
        F.when(n.isNotNull(), 1).cast("int").alias("first_line"), n.alias("last_line"), n.alias("lines"), F.col("bytes").cast("long").alias("bytes"), "rule",
    )


def segment_spans(segments: DataFrame, analyzed: tuple[str, ...] = ("R", "shell")) -> DataFrame:
    """Segments that no analyzer reads, as spans of their non-blank lines."""
    # One fold over the lines, below an explode of one row: a condition on its result would be pushed down and have the lines made again.
    none = F.lit(None).cast("int")
    at = F.aggregate(
        "lines", F.struct(F.lit(0).alias("i"), none.alias("first"), none.alias("last"), F.lit(0).alias("n")),
        lambda s, x: F.when(F.trim(x) != "", F.struct((s["i"] + 1).alias("i"), F.coalesce(s["first"], s["i"] + 1).alias("first"), (s["i"] + 1).alias("last"), (s["n"] + 1).alias("n")))
        .otherwise(F.struct((s["i"] + 1).alias("i"), s["first"].alias("first"), s["last"].alias("last"), s["n"].alias("n"))),
    )
    rows = segments.where(~F.col("language").isin(*analyzed)).select(*KEYS, "language", F.explode(F.array(at)).alias("__at")).where("__at.n > 0")
    return rows.select(
        *KEYS, "language", F.lit("exportable").alias("status"), F.lit("no_analyzer").alias("reason"), F.col("__at.first").alias("first_line"),
        F.col("__at.last").alias("last_line"), F.col("__at.n").alias("lines"), F.lit(None).cast("long").alias("bytes"),
    )


def merge_coverage(coverage: DataFrame, spans: DataFrame, found: DataFrame) -> DataFrame:
    """Files and spans, the latter under their file's rule. Order by file and first_line, null first, to see them as they lie."""
    return coverage.unionByName(_beside(spans, claiming_rule(found), ["rule"]).select(coverage.columns))
