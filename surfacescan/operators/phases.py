"""In which lifecycle phases a finding runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.findings import with_phases
from ..schemas import COMPUTED, PHASES


def attach_phases(df: DataFrame, lookup: DataFrame, key: str = "rule") -> DataFrame:
    """Phases of the rule itself."""
    return with_phases(df, key, lookup)


def resolve_pattern_phases(patterns: DataFrame, lookup: DataFrame, called: DataFrame) -> DataFrame:
    """Phases of the code context; of a computed one, those of the Rd segment or of the rule that had the file read.

    Code in a function that its file rule does not assume to be called runs in none. patterns carries
    file_rule and rd_context; called: (name, assume_called), one row a file rule.
    """
    computed = F.col("code_context").isin(*COMPUTED)
    keyed = patterns.withColumn("__key", F.when(computed, F.coalesce("rd_context", "file_rule")).otherwise(F.col("code_context")))
    flags = F.broadcast(called.select(F.col("name").alias("__rule"), F.col("assume_called").alias("__called")))
    rows = with_phases(keyed, "__key", lookup).join(flags, F.col("file_rule") == F.col("__rule"), "left")
    idle = (F.col("code_context") == "in_function") & F.col("__called").eqNullSafe(False)
    return rows.select(*patterns.columns, *((F.col(p) & ~idle).alias(p) for p in PHASES))


def file_phases(found: DataFrame, lookup: DataFrame) -> DataFrame:
    """Of each claimed file, the union of the phases of all rules that claim it."""
    return with_phases(found.select("package", "version", "file_context", "rule"), "rule", lookup).groupBy("package", "version", "file_context").agg(*(F.bool_or(p).alias(p) for p in PHASES))


def resolve_match_phases(matches: DataFrame, of_files: DataFrame) -> DataFrame:
    """Phases of the file a match lies in."""
    keys = ["package", "version", "file_context"]
    right = of_files.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(p).alias(f"__{p}") for p in PHASES))
    rows = matches.join(right, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    return rows.select(*matches.columns, *(F.coalesce(f"__{p}", F.lit(False)).alias(p) for p in PHASES))
