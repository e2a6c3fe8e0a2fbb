"""Surveys over many archives: structure, expansion, proportions, provenance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..rules import RuleBase
from ..sources.archive import archive_sizes, archive_verdicts, read_archives
from .audit import Audit, audit, description

QUANTILES = (0.5, 0.9, 0.99, 0.999, 1.0)
#: Ranges that quantiles() cuts a column into.
BINS = 256


def survey(spark: SparkSession, path: str, rules: RuleBase | None = None, on_error: str = "keep", **caps) -> tuple[Audit, DataFrame, DataFrame]:
    """Audit every archive at a path as one job: the audit, refused archives as error rows, and identity mismatches."""
    rows = read_archives(spark, path, **caps)
    refused = archive_verdicts(spark, path, **caps).where("verdict IS NOT NULL").select("package", "version", F.lit("validate_tar").alias("step"), F.lit(None).cast("string").alias("file_context"), F.lit(None).cast("string").alias("rule"), F.col("verdict").alias("message"))
    if on_error == "stop" and (first := refused.first()):
        raise ValueError(f"{first['package']}: {first['message']}")
    files = rows.where("verdict IS NULL").drop("verdict", "archive_sha256")
    return audit(files, rules), refused, provenance(files)


def provenance(files: DataFrame) -> DataFrame:
    """Packages whose DESCRIPTION states another name or version than the archive's file name. What is not stated does not differ."""
    d = description(files)
    other = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.col(b).isNotNull() & F.col(a).isNull())
    what = F.concat_ws("; ", F.when(other("package", "desc_name"), F.concat(F.lit("name is "), "desc_name")), F.when(other("version", "desc_version"), F.concat(F.lit("version is "), "desc_version")))
    return d.select(F.coalesce("desc_name", "package").alias("package"), F.coalesce("desc_version", "version").alias("version"), F.col("package").alias("filename_name"), F.col("version").alias("filename_version"),
                    "desc_name", "desc_version", what.alias("message")).where("message <> ''")


def survey_structure(entries: DataFrame) -> DataFrame:
    """Maxima and counts of each archive's headers."""
    name, count = F.col("name"), lambda c: F.sum(F.when(c, 1).otherwise(0))
    return entries.groupBy("package").agg(
        F.count("name").alias("n_entries"), F.max("size").alias("max_entry_size"), F.sum("size").alias("bytes_read"), F.max(F.length(name)).alias("max_path_nchar"),
        F.max(F.size(F.split(name, "/"))).alias("max_path_depth"), count(F.col("type") == "symlink").alias("n_symlink"), count(F.col("type") == "hardlink").alias("n_hardlink"),
        count(F.col("type") == "other").alias("n_other_type"), count(name.rlike(r"(^|/)\.\.(/|$)")).alias("n_traversal"), count(name.startswith("/")).alias("n_absolute"),
        count(name.contains("\\")).alias("n_backslash"), count(name.rlike(r"[\x00-\x1f]")).alias("n_control"), count(name == "").alias("n_empty"),
        F.countDistinct(F.substring_index(name, "/", 1)).alias("n_toplevel"), F.max(F.when(F.col("type") == "refused", F.col("linkname"))).alias("error"),
    )


def survey_expansion(spark: SparkSession, path: str, cap: int = 8 * 1024**3) -> DataFrame:
    """Compressed and uncompressed size of each archive, the ratio, and whether the cap was hit."""
    return archive_sizes(spark, path, max_entries=10**9, max_bytes=cap, max_ratio=None)


def quantiles(df: DataFrame, column: str, at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Exact quantiles, linear between neighbours: p, value; no rows where the column has no value.

    By rank: values are counted first, so that frequent ones cost one row, and fall into BINS ranges of
    like size; only the ranges that hold a wanted rank are sorted, each on its own. The bounds and sizes
    of the ranges reach the driver, and a row for each quantile.
    """
    spark = df.sparkSession
    counted = cut(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n")))
    edges = counted.agg(F.percentile_approx("v", [i / BINS for i in range(1, BINS)], BINS * 10).alias("e")).first()["e"]
    if edges is None:
        return spark.createDataFrame([], "p double, value double")
    edges = sorted(set(edges))
    binned = counted.withColumn("bin", _searched(edges))
    sizes = dict(binned.groupBy("bin").agg(F.sum("n").alias("n")).collect())
    before, total = {}, 0
    for b in sorted(sizes):
        before[b] = total
        total += sizes[b]
    ranks = {p: (total - 1) * p for p in at}
    wanted = sorted({r for x in ranks.values() for r in (math.floor(x), math.ceil(x))})
    of = {r: max(b for b in before if before[b] <= r) for r in wanted}
    asked = spark.createDataFrame([(of[r], r, r - before[of[r]]) for r in wanted], "b int, rank long, within long")
    upto = Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = binned.where(F.col("bin").isin(sorted(set(of.values())))).withColumn("upto", F.sum("n").over(upto))
    hits = held.join(F.broadcast(asked), (F.col("bin") == F.col("b")) & (F.col("within") < F.col("upto")) & (F.col("within") >= F.col("upto") - F.col("n"))).select("rank", "v")
    value = dict(hits.collect())  # two rows a quantile
    out = [(p, value[math.floor(x)] + (value[math.ceil(x)] - value[math.floor(x)]) * (x - math.floor(x))) for p, x in ranks.items()]
    return spark.createDataFrame(out, "p double, value double")


def _searched(edges: list[float]) -> Column:
    """How many edges lie below v, by halving."""

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("v") > edges[mid], among(mid + 1, hi)).otherwise(among(lo, mid))

    return among(0, len(edges))


def proportion_hits(found: DataFrame) -> DataFrame:
    """Findings by rule, and their percentage of all."""
    n = found.groupBy("rule").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)


def proportion_packages(found: DataFrame, total: int) -> DataFrame:
    """Packages with a finding by rule, and their percentage of `total`."""
    return found.groupBy("rule").agg(F.countDistinct("package").alias("n")).withColumn("percent", F.col("n") / F.lit(total) * 100)


def verify_downloads(local: DataFrame, listed: DataFrame) -> DataFrame:
    """local (package, content) with its hashes against listed (package, md5): equal, not, or null where not listed."""
    want = listed.select(F.col("package").alias("l_package"), F.lower("md5").alias("md5_listed"))
    rows = local.select("package", F.md5("content").alias("md5_local"), F.sha2("content", 256).alias("sha256_local"))
    return rows.join(want, rows.package == want.l_package, "left").select("package", "md5_listed", "md5_local", (F.col("md5_listed") == F.col("md5_local")).alias("md5_matches"), "sha256_local")


def dependency_closure(edges: DataFrame, roots: DataFrame, steps: int = 64) -> DataFrame:
    """All packages that the roots need, themselves included, by joining only the newest ones in each step. edges: package, needs."""
    known = frontier = roots.select("package").distinct()
    for _ in range(steps):
        needed = frontier.join(edges, "package").select(F.col("needs").alias("package")).distinct()
        frontier = cut(needed.join(known, "package", "left_anti"))
        if frontier.isEmpty():
            return known
        known = cut(known.union(frontier))
    raise RuntimeError(f"a chain of more than {steps} dependencies")
