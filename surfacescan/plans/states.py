"""Corpus summaries as states: kept a batch, merged later, finished when asked for.

Coverage at corpus scale is tens of millions of rows, and findings millions; a state has a row a rule or a
group, so that adding a batch never reads what is summarised already. Counts and sums add up. Distinct
packages do not, where batches share some: they are kept as exact bitmaps over the packages' numbers, which
`numbered` hands out once and for all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators.report import summarize_coverage, summarize_findings


def numbered(packages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """package, number, written down: those of `known` as they are, further ones from the highest on."""
    names = packages.select("package").distinct()
    if known is None:
        return cut(names.select("package", F.monotonically_increasing_id().alias("number")))
    top = known.agg(F.max("number")).first()[0]
    new = names.join(known, "package", "left_anti").select("package", (F.lit(-1 if top is None else top) + 1 + F.monotonically_increasing_id()).alias("number"))
    return cut(known.unionByName(new))


def findings(found: DataFrame) -> DataFrame:
    """State of summarize_findings: phase, rule, n, attck, phase_rank."""
    return summarize_findings(found)


def merged_findings(*states: DataFrame) -> DataFrame:
    """One state, and the summary itself, of several."""
    return _union(states).groupBy("phase", "rule", "phase_rank").agg(F.sum("n").alias("n"), F.min("attck").alias("attck")).select("phase", "rule", "n", "attck", "phase_rank")


def coverage(cover: DataFrame) -> DataFrame:
    """State of summarize_coverage: status, top_level, type, files, lines, status_rank."""
    return summarize_coverage(cover)


def merged_coverage(*states: DataFrame) -> DataFrame:
    return _union(states).groupBy("status", "top_level", "type", "status_rank").agg(F.sum("files").alias("files"), F.sum("lines").alias("lines")).select("status", "top_level", "type", "files", "lines", "status_rank")


def rules(found: DataFrame, numbers: DataFrame) -> DataFrame:
    """State of both proportions: rule, bucket, n, packages (a bitmap of the packages whose numbers fall into the bucket)."""
    per = found.groupBy("rule", "package").agg(F.count("*").alias("n")).join(numbers, "package")
    per = per.selectExpr("rule", "n", "bitmap_bucket_number(number) AS bucket", "bitmap_bit_position(number) AS bit")
    return per.groupBy("rule", "bucket").agg(F.sum("n").alias("n"), F.bitmap_construct_agg("bit").alias("packages"))


def merged_rules(*states: DataFrame) -> DataFrame:
    return _union(states).groupBy("rule", "bucket").agg(F.sum("n").alias("n"), F.bitmap_or_agg("packages").alias("packages"))


def proportions(state: DataFrame, total: int) -> DataFrame:
    """rule, n, percent (of all findings), n_packages, percent_packages (of `total`)."""
    per = state.groupBy("rule").agg(F.sum("n").alias("n"), F.sum(F.bitmap_count("packages")).alias("n_packages"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy()) * 100  # a row a rule
    return per.select("rule", "n", share.alias("percent"), "n_packages", (F.col("n_packages") / F.lit(total) * 100).alias("percent_packages"))


def _union(states: tuple[DataFrame, ...]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), states)
