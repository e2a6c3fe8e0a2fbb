"""The audit of any number of packages as one plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.findings import preview
from ..functions.paths import over_limit
from ..operators import claims, coverage, extract, matches, patterns, phases
from ..operators.analyze import analyze
from ..rules import RuleBase, default_rules
from ..rules.base import engine_regex_problem, xpath_problem

ENGINE_VERSION = "0.1.0"
KEYS = ["package", "version", "file_context"]


@dataclass
class Audit:
    """The five result frames, and one row of metadata a package; all lazy."""

    file_contexts: DataFrame
    patterns: DataFrame
    matches: DataFrame
    coverage: DataFrame
    errors: DataFrame
    scans: DataFrame
    held: list[DataFrame] = field(default_factory=list, repr=False)

    def release(self) -> None:
        """Let go of the tables that the audit keeps; its frames stay usable and are computed anew."""
        for df in self.held:
            df.unpersist()

    def validate(self) -> Audit:
        for name, schema in schemas.FRAMES.items():
            schemas.validate(getattr(self, name), schema)
        return self


def _errors(df: DataFrame, step: str | None = None) -> DataFrame:
    return df.select("package", "version", (F.lit(step) if step else F.col("step")).alias("step"), "file_context", "rule", "message")


def manifest(files: DataFrame, excluded: tuple[str, ...] = (r"^\.git/", r"^\.Rproj\.user/")) -> DataFrame:
    """Per package the hash over its files' sorted hashes and paths, their number, and the links and unreadable files left out.

    Grouping is by package: the list of one package's files, a line each, is gathered in one row.
    """
    use = files.where("file_context IS NOT NULL")
    for p in excluded:
        use = use.where(~F.col("file_context").rlike(p))
    ok = ~F.col("is_symlink") & F.col("content").isNotNull()
    line = F.when(ok, F.struct(F.col("file_context").alias("f"), F.sha2("content", 256).alias("h")))
    rows = use.groupBy("package", "version").agg(
        F.array_sort(F.collect_list(line)).alias("l"), F.array_sort(F.collect_list(F.when(F.col("is_symlink"), F.col("file_context")))).alias("symlinks"),
        F.array_sort(F.collect_list(F.when(~F.col("is_symlink") & F.col("content").isNull(), F.col("file_context")))).alias("unreadable"),
    )
    text = F.array_join(F.transform("l", lambda x: F.concat(x["h"], F.lit("  "), x["f"])), "\n")
    return rows.select("package", "version", F.sha2(text, 256).alias("hash"), text.alias("manifest"), F.size("l").alias("n_files"), "symlinks", "unreadable")


def description(files: DataFrame) -> DataFrame:
    """Package and Version that each DESCRIPTION states in its first record; null where it does not."""
    text = F.split(F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n"), r"\n\s*\n").getItem(0)
    text = F.regexp_replace(text, r"\n[ \t]+", " ")  # continuation lines
    of = lambda name: F.trim(F.nullif(F.regexp_extract(text, rf"(?m)^{name}:[ \t]*(.*)$", 1), F.lit("")))
    return files.where("file_context = 'DESCRIPTION'").select("package", "version", of("Package").alias("desc_name"), of("Version").alias("desc_version"))


def scans(files: DataFrame, rules: RuleBase, scanned: str, path: str | None = None, tarball: bool = False) -> DataFrame:
    """Nine facts on each package's scan; scanned: the time, as ISO text."""
    m, d = manifest(files).select("package", "version", "hash"), description(files).withColumnsRenamed({"package": "d_package", "version": "d_version"})
    rows = m.join(d, m.package.eqNullSafe(d.d_package) & m.version.eqNullSafe(d.d_version), "left")
    p = rules.provenance
    return rows.select(
        "package", "version", F.col("desc_name").alias("pkg_name"), F.col("desc_version").alias("pkg_version"), F.lit(path).cast("string").alias("pkg_path"), F.lit(tarball).alias("pkg_is_tarball"),
        F.col("hash").alias("pkg_sha256"), F.lit(ENGINE_VERSION).alias("engine_version"), F.lit(p.get("rules_version")).cast("string").alias("rules_version"),
        F.lit(p.get("rules_sha256")).cast("string").alias("rules_sha256"), F.lit(scanned).alias("scanned"),
    )


def rule_errors(files: DataFrame, rules: RuleBase) -> tuple[RuleBase, DataFrame]:
    """The rules without those whose expressions the engine refuses, and an error row for each of these and each package."""
    broken = []
    for table, column, step in (("file_contexts", "filename", "find_file_contexts"), ("matches", "regex", "find_matches")):
        broken += [(table, step, r["name"], why) for r in getattr(rules, table) if (why := engine_regex_problem(files.sparkSession, r[column]))]
    for table, step in (("patterns", "find_patterns"), ("code_contexts", "find_code_contexts")):
        broken += [(table, step, r["name"], f"XPath {why}") for r in getattr(rules, table) if "xpath" in r and (why := xpath_problem(r["xpath"]))]
    keep = replace(rules, **{t: [r for r in getattr(rules, t) if (t, r["name"]) not in {(b[0], b[2]) for b in broken}] for t in ("file_contexts", "matches", "patterns", "code_contexts")})
    rows = [F.struct(F.lit(step).alias("step"), F.lit(None).cast("string").alias("file_context"), F.lit(name).alias("rule"), F.lit(why).alias("message")) for _, step, name, why in broken]
    none = "array<struct<step:string,file_context:string,rule:string,message:string>>"
    packages = files.select("package", "version").distinct()
    return keep, packages.select("package", "version", F.inline(F.array(*rows).cast(none)))


def check_arguments(files: DataFrame, rules: RuleBase | None, scanned: str, persist: bool, path: str | None, tarball: bool) -> None:
    """Raise ValueError naming the first argument of audit() that is not what it must be."""
    if not isinstance(files, DataFrame):
        raise ValueError("files must be a DataFrame, as the sources return")
    if lacking := [c for c in schemas.names(schemas.FILES) if c not in files.columns]:
        raise ValueError(f"files has no {', '.join(lacking)}")
    if rules is not None and not isinstance(rules, RuleBase):
        raise ValueError("rules must be a RuleBase, as load() returns")
    if not isinstance(scanned, str) or not scanned:
        raise ValueError("scanned must be a time as ISO text")
    if path is not None and (not isinstance(path, str) or not path):
        raise ValueError("path must be a path or None")
    for name, flag in (("persist", persist), ("tarball", tarball)):
        if not isinstance(flag, bool):
            raise ValueError(f"{name} must be True or False")
    if tarball and path is None:
        raise ValueError("tarball needs the archive's path")


def audit(files: DataFrame, rules: RuleBase | None = None, scanned: str = "1970-01-01T00:00:00Z", extractors: dict | None = None, analyzers: dict | None = None, persist: bool = True, path: str | None = None, tarball: bool = False) -> Audit:
    """Audit all packages in `files`.

    path, tarball: where the files came from, for the scan's metadata.

    extractors: file type to extractor, beside the built-in ones. analyzers: language to PerSegment, a
    function of one segment, or to a function from the frame of segments to findings with the columns of
    matches but the phases; further columns go. Analyzers run at once, so that their failures can be held.

    What fails costs itself alone: a rule, a file, a segment in PerSegment, or an analyzer that fails as a
    whole, gives an error row.

    Content is read by one map-only stage; segments and nodes, which several branches read, are kept
    in memory or on disk (persist) until release(), and computed again where an executor is lost.
    """
    check_arguments(files, rules, scanned, persist, path, tarball)
    rules, failed = rule_errors(files, rules or default_rules())
    spark = files.sparkSession
    lookup = rules.frame(spark, "phases")
    found = claims.find_file_contexts(files, rules)
    scan = claims.scan_set(found)
    macros = files.where("file_context LIKE 'man/macros/%.Rd'").groupBy("package", "version").agg(F.array_join(F.sort_array(F.collect_list(F.decode("content", "UTF-8"))), "\n").alias("macros")).withColumnsRenamed({"package": "m_package", "version": "m_version"})
    body = files.select(*(F.col(k).alias(f"b_{k}") for k in KEYS), "content", "bytes")
    claimed = scan.join(body, [scan[k].eqNullSafe(body[f"b_{k}"]) for k in KEYS])
    absent = F.col("content").isNull() & ~F.coalesce(over_limit(F.col("bytes")), F.lit(False))
    unread = claimed.where(absent).select(*KEYS, "rule", F.lit("The file could not be read; nothing in it was scanned.").alias("message"))
    readings = claimed.where(~absent)
    readings = readings.join(macros, F.col("package").eqNullSafe(F.col("m_package")) & F.col("version").eqNullSafe(F.col("m_version")), "left").select(*KEYS, "type", "rule", "code_contexts", "content", "bytes", "macros")
    all_segments = extract.extract_segments(readings, extractors)
    all_segments = all_segments.persist() if persist else all_segments
    segments = all_segments.where("step IS NULL")
    all_nodes = extract.parse_segments(segments)
    all_nodes = all_nodes.persist() if persist else all_nodes
    nodes = all_nodes.where("pre IS NOT NULL")

    # Patterns.
    applicable = spark.createDataFrame(
        [(r["name"], c) for r in rules.file_contexts for c in r["code_context"] or () if any(x["name"] == c and x["kind"] == "xpath" for x in rules.code_contexts)], "file_rule string, name string")
    hits = patterns.find_in_contexts(nodes, rules, applicable)
    seg = segments.select(*(F.col(k).alias(f"g_{k}") for k in patterns.SEG), "context", "lines", "guarded_lines")
    hits = hits.join(seg, [hits[k].eqNullSafe(seg[f"g_{k}"]) for k in patterns.SEG])
    said = F.broadcast(rules.frame(spark, "patterns").select(F.col("name").alias("r_name"), "message", "attck"))
    hits = hits.join(said, hits.found == F.col("r_name")).select(
        "package", "version", hits.found.alias("rule"), "file_context", F.col("line1").alias("line_number"), F.col("col1").alias("column_number"),
        F.when((F.col("code_context") == "top_level") & F.col("context").isNotNull(), F.col("context")).otherwise(F.col("code_context")).alias("code_context"),
        F.array_contains("guarded_lines", F.col("line1")).alias("guarded"), "indirect",
        preview(F.element_at("lines", F.col("line1")), F.col("col1"), F.col("line2") != F.col("line1")).alias("preview"), "message", "attck",
        F.col("rule").alias("file_rule"), F.col("context").alias("rd_context"),
    )
    called = spark.createDataFrame([(r["name"], r["assume_called"]) for r in rules.file_contexts], "name string, assume_called boolean")
    pattern_rows = phases.resolve_pattern_phases(hits, lookup, called)

    # Matches.
    lined = matches.find_matches(segments, rules)
    for language, analyzer in (analyzers or {}).items():
        more, wrong = analyze(segments, language, analyzer)
        lined = lined if more is None else lined.unionByName(more)
        failed = failed.unionByName(wrong.withColumn("step", F.lit("find_matches")), allowMissingColumns=True)
    match_rows = phases.resolve_match_phases(lined, phases.file_phases(found, lookup))

    # Errors and coverage.
    syntax = all_nodes.where("message IS NOT NULL").select("package", "version", F.lit("parse_code").alias("step"), "file_context", "rule", "message")
    errors = _errors(all_segments.where("step IS NOT NULL")).unionByName(_errors(unread, "read_code")).unionByName(syntax).unionByName(_errors(failed))
    scanned_as = scan.groupBy(*KEYS).agg(F.min("type").alias("read_as"))
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n?", "\n")
    n_lines = files.where("content IS NOT NULL").select(*KEYS, text.alias("t")).selectExpr(*KEYS, r"length(t) - length(replace(t, '\n', '')) + IF(t = '' OR endswith(t, '\n'), 0, 1) AS n_lines")
    cover = coverage.merge_coverage(coverage.build_coverage(files, found, rules, scanned_as, errors, n_lines), coverage.segment_spans(segments, ("R", "shell", *(analyzers or ()))), found)
    cover = phases.attach_phases(cover, lookup)

    shape = lambda name, df: schemas.conform(df, schemas.FRAMES[name])
    return Audit(
        shape("file_contexts", phases.attach_phases(claims.reported(found), lookup)), shape("patterns", pattern_rows), shape("matches", match_rows),
        shape("coverage", cover), shape("errors", errors), scans(files, rules, scanned, path, tarball),
        [all_segments, all_nodes] if persist else [],
    )


def broken_examples(spark: SparkSession, rules: RuleBase) -> list[tuple[str, str, str]]:
    """(rule, kind, code) of what syntax rules and code contexts say of themselves and do not hold to.

    Each positive example must be found and each negative one not; a declared function, called bare, must be
    found by its rule ("functions"), so that a call that names it by a string is rightly laid to that rule.
    """
    cases = [(r["name"], kind, x) for r in [*rules.patterns, *rules.code_contexts] for kind in ("positive_examples", "negative_examples") for x in r.get(kind, ())]
    cases += [(r["name"], "functions", f"{f}()") for r in rules.patterns for f in r["functions"]]
    rows = [(name, None, str(i), kind, 0, "R", x.split("\n")) for i, (name, kind, x) in enumerate(cases)]
    nodes = extract.parse_segments(spark.createDataFrame(rows, "package string, version string, file_context string, rule string, seg_ord int, language string, lines array<string>")).where("pre IS NOT NULL")
    nodes = nodes.persist()
    hits = patterns.find_patterns(nodes, rules).where("found = package").select("file_context").union(patterns.find_code_contexts(nodes, rules).where("context = package").select("file_context"))
    found = {int(r["file_context"]) for r in hits.distinct().collect()}  # a few hundred at most
    nodes.unpersist()
    return [case for i, case in enumerate(cases) if (i in found) != (case[1] != "negative_examples")]
