"""Queries of the package's own operators, and their DuckDB equivalents, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .functions.findings import in_phase
from .functions.regex import to_java
from .operators import claims, coverage, export, extract, matches, patterns, phases, report, sarif
from .operators.analyze import PerSegment
from .plans import corpus, states
from .plans.audit import audit, manifest, rule_errors
from .rules import RuleBase, default_rules
from .rules.expressions import in_xpath
from .schemas import PHASES, STATUSES
from .sources import read_tree
from .sources.archive import validate_entries
from .virtual import CODE, N, SNIPPETS, VFILES, VFINDINGS, VLINES, VNODES, VTREE, table, vcode, vfiles, vfindings, vnodes, vsegments, vtree

RULES = default_rules()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _text(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of constant rows."""
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)})"


FILE_RULES = _values("file_rules", "rule, type, report, path, recursive, filename", [(r["name"], r["type"], r["report"], r["path"], r["recursive"], r["filename"]) for r in RULES.file_contexts])
RULE_PHASES = _values("rule_phases", "context, " + ", ".join(PHASES), [(r["context"], *(r[p] for p in PHASES)) for r in RULES.phases])
FOUND = r"""found AS (
  SELECT v.package, v.file_context, r.rule, r.type, r.report FROM (SELECT *, regexp_replace(file_context, '^.*/', '') AS base, CASE WHEN contains(file_context, '/') THEN regexp_replace(file_context, '/[^/]*$', '') ELSE '.' END AS dir FROM vfiles WHERE NOT is_symlink) v
  JOIN file_rules r ON regexp_matches(v.base, r.filename) AND (CASE WHEN r.recursive THEN r.path = '.' OR starts_with(v.file_context, r.path || '/') ELSE v.dir = r.path END))"""
CLAIMING = "claiming AS (SELECT package, file_context, arg_min(rule, (CASE WHEN type = 'other' THEN '1' ELSE '0' END) || rule) AS rule FROM found GROUP BY ALL)"
_P = ", ".join(PHASES)
_COALESCED = ", ".join(f"coalesce({p}, false) AS {p}" for p in PHASES)
_BASE = f"WITH {VFILES}, {FILE_RULES}, {FOUND}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _lookup(spark: SparkSession) -> DataFrame:
    return RULES.frame(spark, "phases")


def _found(spark: SparkSession, d: str) -> DataFrame:
    return claims.find_file_contexts(vfiles(spark, d), RULES)


@query("claim_files", f"{_BASE} SELECT package, file_context, rule, type, report FROM found")
def _(s, d):
    return _found(s, d).select("package", "file_context", "rule", "type", "report")


@query("reported_contexts", f"{_BASE} SELECT package, file_context, rule FROM found WHERE report")
def _(s, d):
    return claims.reported(_found(s, d)).select("package", "file_context", "rule")


@query("scan_set", f"{_BASE} SELECT DISTINCT package, file_context, type, rule FROM found WHERE type <> 'other'")
def _(s, d):
    return claims.scan_set(_found(s, d)).select("package", "file_context", "type", "rule")


@query("claiming_rule", f"{_BASE}, {CLAIMING} SELECT * FROM claiming")
def _(s, d):
    return claims.claiming_rule(_found(s, d)).select("package", "file_context", "rule")


_SCOPE = "EXISTS (SELECT 1 FROM file_rules r WHERE r.filename LIKE '%$' AND regexp_matches(regexp_replace(v.file_context, '^.*/', ''), r.filename))"


@query("in_scope", f"{_BASE} SELECT package, file_context, {_SCOPE} AS in_scope FROM vfiles v")
def _(s, d):
    return vfiles(s, d).select("package", "file_context", claims.in_scope(F.col("file_context"), RULES).alias("in_scope"))


def _wgets(lines: list[str], facts: dict):
    """A segment's analyzer that fails on long segments."""
    if len(lines) > 12:
        raise ValueError(f"{facts['file_context']} is long")
    yield from ({"rule": "wget", "line_number": i} for i, x in enumerate(lines, 1) if "wget" in x)


@query("segment_failures", f"""WITH {VFILES}, {VLINES}, counted AS (SELECT package, file_context, count(*) > 12 AS failed, count(*) FILTER (contains(line, 'wget')) AS hits FROM vlines GROUP BY ALL)
SELECT package, file_context, failed, CASE WHEN failed THEN 0 ELSE hits END AS n_found FROM counted WHERE failed OR hits > 0""")
def _(s, d):
    found = PerSegment(_wgets)(vsegments(s, d).selectExpr("*", "'x' AS rule", "CAST(NULL AS STRING) AS context"))
    return found.groupBy("package", "file_context").agg(F.bool_or(F.col("failed").isNotNull()).alias("failed"), F.count("rule").alias("n_found"))


_TREE = f"WITH {VFILES}, {VTREE}"


@query("folder_listing", f"{_TREE} SELECT package, file_context, bytes, false AS is_symlink, CASE WHEN bytes <= 20000 THEN sha256(text) END AS sha, CASE WHEN bytes > 20000 THEN 'above the limit' END AS problem FROM vtree")
def _(s, d):
    return read_tree(s, vtree(s, d), limit=20_000).select("package", "file_context", "bytes", "is_symlink", F.sha2("content", 256).alias("sha"), "problem")


@query("folder_pruned", f"{_TREE} SELECT package, file_context, bytes FROM vtree WHERE (starts_with(file_context, 'src/') OR file_context LIKE '.%') AND bytes < 3000 AND package <> 'web-3'")
def _(s, d):
    rows = read_tree(s, vtree(s, d), match=r"^src/|^\.", largest=2999)
    return rows.where("package <> 'web-3' AND content IS NOT NULL").select("package", "file_context", "bytes")


_EXT = r"regexp_extract(regexp_replace(file_context, '^.*/', ''), '^.+\.([^.]*)$', 1)"
_LANGUAGE = "CASE " + " ".join(f"WHEN {_EXT} IN ({', '.join(map(_text, e.split()))}) THEN '{n}'" for n, e in paths.LANGUAGES.items()) + " END"
_TYPE = f"coalesce(language, nullif({_EXT}, ''), regexp_replace(file_context, '^.*/', ''))"
_TOP = "CASE WHEN contains(file_context, '/') THEN split_part(file_context, '/', 1) || '/' ELSE '.' END"


@query("path_parts", f"WITH {VFILES} SELECT package, file_context, ext, language, {_TYPE} AS type, {_TOP} AS top_level FROM (SELECT *, {_EXT} AS ext, {_LANGUAGE} AS language FROM vfiles)")
def _(s, d):
    p = F.col("file_context")
    rows = vfiles(s, d).select("package", "file_context", paths.extension(p).alias("ext"), paths.language_of(paths.extension(p)).alias("language"))
    return rows.withColumn("type", paths.coverage_type(F.col("language"), p)).withColumn("top_level", paths.top_level(p))


@query("page_paths", r"SELECT page_id, regexp_extract(url, '^[^:]+://([^/]+)', 1) AS host, CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) || '/' ELSE '.' END AS top_level FROM (SELECT page_id, url, regexp_replace(url, '^[^:]+://[^/]+/?', '') AS p FROM pages)")
def _(s, d):
    p = F.regexp_replace("url", "^[^:]+://[^/]+/?", "")
    return table(s, d, "pages").select("page_id", F.regexp_extract("url", "^[^:]+://([^/]+)", 1).alias("host"), paths.top_level(p).alias("top_level"))


def _coverage(s, d):
    files, found = vfiles(s, d), _found(s, d)
    scanned = claims.scan_set(found).groupBy("package", "version", "file_context").agg(F.min("type").alias("read_as"))
    errors = files.where("bytes > 8000").select("package", "version", F.lit("extract_segments").alias("step"), "file_context", F.lit(None).cast("string").alias("rule"), paths.limit_message(F.col("bytes"), 8000).alias("message"))
    lines = files.select("package", "version", "file_context", F.size(paths.split_lines(F.col("text"))).alias("n_lines"))
    return coverage.build_coverage(files, found, RULES, scanned, errors, lines)


_IN = lambda xs: ", ".join(map(_text, xs))
COVERAGE = f"""
scanned AS (SELECT package, file_context, min(type) AS read_as FROM found WHERE type <> 'other' GROUP BY ALL),
scoped AS (
  SELECT v.*, c.rule, s.read_as, CASE WHEN text = '' THEN 0 ELSE len(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) - CASE WHEN text LIKE '%' || chr(10) OR text LIKE '%' || chr(13) THEN 1 ELSE 0 END END AS n_lines, {_EXT.replace("file_context", "v.file_context")} AS ext
  FROM vfiles v LEFT JOIN claiming c USING (package, file_context) LEFT JOIN scanned s USING (package, file_context)
  WHERE NOT regexp_matches(v.file_context, '^\\.git/|^\\.Rproj\\.user/|^renv/library/') AND (c.rule IS NOT NULL OR {_SCOPE})),
spoken AS (SELECT *, {_LANGUAGE} AS lang, CASE WHEN read_as = 'make' THEN 'shell' ELSE read_as END AS reading FROM scoped),
judged AS (
  SELECT *, CASE WHEN is_symlink THEN 'unexamined/symlink' WHEN bytes > 8000 THEN 'error/too_large' WHEN reading = 'shell' THEN 'matched/' WHEN reading IS NOT NULL THEN 'parsed/'
    WHEN ext IN ({_IN(paths.SERIALIZED)}) THEN 'unexamined/serialized' WHEN ext IN ({_IN(paths.BINARY)}) THEN 'unexamined/binary'
    WHEN lang NOT IN ({_IN(paths.ANALYZED)}) THEN 'exportable/no_analyzer' WHEN rule IS NULL THEN 'unexamined/no_rule' ELSE 'unexamined/no_extractor' END AS verdict FROM spoken),
covered AS (
  SELECT package, file_context, CASE WHEN NOT is_symlink AND bytes <= 8000 AND reading IS NOT NULL THEN reading ELSE lang END AS language, split_part(verdict, '/', 1) AS status, nullif(split_part(verdict, '/', 2), '') AS reason,
    CAST(CASE WHEN split_part(verdict, '/', 1) IN ('parsed', 'matched', 'exportable') THEN n_lines END AS INTEGER) AS lines, bytes, rule FROM judged)"""
_COVER = f"{_BASE}, {CLAIMING}, {COVERAGE}"


@query("coverage_frame", f"{_COVER} SELECT *, lines AS last_line, CASE WHEN lines IS NOT NULL THEN 1 END AS first_line FROM covered")
def _(s, d):
    return _coverage(s, d).drop("version")


@query("coverage_merge_spans", f"""{_COVER} SELECT package, file_context, language, status, reason, lines, rule FROM covered UNION ALL
SELECT v.package, v.file_context, 'python', 'exportable', 'no_analyzer', 1, c.rule FROM vfiles v LEFT JOIN claiming c USING (package, file_context) WHERE v.doc_id % {N} = 2""")  # fmt: skip
def _(s, d):
    spans = vfiles(s, d).where(f"doc_id % {N} = 2").selectExpr("package", "version", "file_context", "'python' AS language", "array('', 'x', '') AS lines")
    return coverage.merge_coverage(_coverage(s, d), coverage.segment_spans(spans), _found(s, d)).select("package", "file_context", "language", "status", "reason", "lines", "rule")


@query("summarize_coverage", f"""{_COVER} SELECT status, top_level, type, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, {" ".join(["CASE status", *(f"WHEN '{x}' THEN {i + 1}" for i, x in enumerate(STATUSES)), "END"])} AS status_rank
FROM (SELECT *, {_TOP} AS top_level, {_TYPE} AS type FROM covered) GROUP BY ALL""")  # fmt: skip
def _(s, d):
    return report.summarize_coverage(_coverage(s, d))


@query("export_jobs", f"{_COVER} SELECT package, file_context, language, min(1) AS first_line, max(lines) AS last_line, true AS whole, package || '/' || file_context AS target, false AS collides FROM covered WHERE status = 'exportable' GROUP BY ALL")
def _(s, d):
    return export.export_jobs(_coverage(s, d)).drop("version")


@query("export_manifest", f"""{_COVER} SELECT c.package || '/' || file_context AS path, file_context, CASE WHEN bytes > 2000 THEN 'over max_bytes' END AS note FROM covered c WHERE status = 'exportable'""")
def _(s, d):
    return export.export_manifest(export.export_jobs(_coverage(s, d)), vfiles(s, d), 2000).select("path", "file_context", "note")


@query("sarif_artifacts", f"{_COVER} SELECT package, file_context, status, reason, language, lines, bytes FROM covered")
def _(s, d):
    return sarif.artifacts(_coverage(s, d)).drop("version")


@query("read_lines", f"WITH {VFILES}, {VLINES} SELECT package, file_context, line_number, line FROM vlines")
def _(s, d):
    return matches.lines_of(vsegments(s, d)).select("package", "file_context", "line_number", "line")


@query("line_counts", r"SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS INTEGER) AS n_lines, true AS valid FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(paths.split_lines(F.col("text"))).alias("n_lines"), F.is_valid_utf8("text").alias("valid"))


@query("size_guard", "SELECT doc_id, octet_length(encode(text)) > 5000 AS over, format('File is {:.0f} MB, above the 0 MB scanning limit; it was not read.', octet_length(encode(text)) / 1048576.0) AS message FROM documents")
def _(s, d):
    n = F.octet_length("text")
    return table(s, d, "documents").select("doc_id", paths.over_limit(n, 5000).alias("over"), paths.limit_message(n, 5000).alias("message"))


_RULED = "CASE k " + " ".join(f"WHEN {i} THEN '{r}'" for i, (r, _) in enumerate(SNIPPETS) if r) + " END"


@query("match_positions", f"WITH {VFILES}, {VLINES} SELECT package, file_context, {_RULED} AS rule, line_number, CAST(length(plain) + 5 AS INTEGER) AS column_number FROM vlines WHERE k < {len(SNIPPETS) - 1}")
def _(s, d):
    return matches.find_matches(vsegments(s, d), RULES).select("package", "file_context", "rule", "line_number", "column_number")


@query("match_posix", ORACLES["match_positions"])
def _(s, d):
    posix = [r | {"regex": to_java(r["regex"].replace(r"\p{Alnum}", "[:alnum:]").replace(r"\s", "[[:space:]]"))} for r in RULES.matches]
    return matches.find_matches(vsegments(s, d), replace(RULES, matches=posix)).select("package", "file_context", "rule", "line_number", "column_number")


_LEAD, _AT = r"length(regexp_extract(line, '^(\s*)', 1))", "length(plain) + 5"
PREVIEWED = rf"""previewed AS (
  SELECT package, file_context, {_RULED} AS rule, line_number, CAST({_AT} AS INTEGER) AS column_number, line, {_LEAD} AS lead, CASE WHEN {_AT} > {_LEAD} + 57 THEN {_AT} - 16 ELSE {_LEAD} + 1 END AS start FROM vlines WHERE k < {len(SNIPPETS) - 1}),
shown AS (SELECT package, file_context, rule, line_number, column_number, concat(CASE WHEN start > lead + 1 THEN '...' ELSE '' END, trim(regexp_replace(substr(line, start, 72), '\s+', ' ', 'g')), CASE WHEN start + 71 < length(line) THEN '...' ELSE '' END) AS preview FROM previewed)"""


@query("match_preview", f"WITH {VFILES}, {VLINES}, {PREVIEWED} SELECT * FROM shown")
def _(s, d):
    return matches.find_matches(vsegments(s, d), RULES).select("package", "file_context", "rule", "line_number", "column_number", "preview")


@query("match_lines", f"WITH {VFILES}, {VLINES} SELECT package, file_context, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN k = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_curl FROM vlines GROUP BY ALL")
def _(s, d):
    rx = "(?d)" + next(r["regex"] for r in RULES.matches if r["name"] == "curl")
    return matches.lines_of(vsegments(s, d)).groupBy("package", "file_context").agg(F.count("*").alias("n_lines"), F.sum(F.col("line").rlike(rx).cast("long")).alias("n_curl"))


FILE_PHASES = f"file_phases AS (SELECT package, file_context, {', '.join(f'bool_or({p}) AS {p}' for p in PHASES)} FROM found f JOIN rule_phases r ON f.rule = r.context GROUP BY ALL)"


@query("match_phases", f"WITH {VFILES}, {FILE_RULES}, {RULE_PHASES}, {FOUND}, {VLINES}, {FILE_PHASES} SELECT l.package, l.file_context, {_RULED} AS rule, line_number, {_COALESCED} FROM vlines l LEFT JOIN file_phases p USING (package, file_context) WHERE k < {len(SNIPPETS) - 1}")
def _(s, d):
    rows = phases.resolve_match_phases(matches.find_matches(vsegments(s, d), RULES), phases.file_phases(_found(s, d), _lookup(s)))
    return rows.select("package", "file_context", "rule", "line_number", *PHASES)


@query("file_phase_union", f"WITH {VFILES}, {FILE_RULES}, {RULE_PHASES}, {FOUND}, {FILE_PHASES} SELECT * FROM file_phases")
def _(s, d):
    return phases.file_phases(_found(s, d), _lookup(s)).drop("version")


@query("phase_lookup", f"WITH {VFILES}, {FILE_RULES}, {RULE_PHASES}, {FOUND} SELECT f.package, f.file_context, f.rule, {_COALESCED} FROM found f LEFT JOIN rule_phases r ON f.rule = r.context WHERE f.report")
def _(s, d):
    return phases.attach_phases(claims.reported(_found(s, d)), _lookup(s)).select("package", "file_context", "rule", *PHASES)


@query("phase_lookup_missing", f"WITH {RULE_PHASES} SELECT event_id, {_COALESCED} FROM events e LEFT JOIN rule_phases r ON e.event_type = r.context")
def _(s, d):
    return phases.attach_phases(table(s, d, "events"), _lookup(s), "event_type").select("event_id", *PHASES)


_FILE_RULE = "CASE event_id % 3 WHEN 0 THEN 'R_scripts' WHEN 1 THEN 'tests_testthat' ELSE 'man_pages' END"
_RD = "CASE WHEN event_id % 3 = 2 THEN 'Rd_examples' END"


@query("pattern_phases", f"""WITH {VFINDINGS}, {RULE_PHASES}, {_values("called", "name, assume_called", [(r["name"], r["assume_called"]) for r in RULES.file_contexts])},
keyed AS (SELECT *, {_FILE_RULE} AS file_rule, CASE WHEN code_context IN ('top_level', 'in_function') THEN coalesce({_RD}, {_FILE_RULE}) ELSE code_context END AS key FROM vfindings)
SELECT event_id, code_context, file_rule, {", ".join(f"coalesce(r.{p}, false) AND NOT (code_context = 'in_function' AND coalesce(assume_called, true) = false) AS {p}" for p in PHASES)}
FROM keyed k LEFT JOIN rule_phases r ON k.key = r.context LEFT JOIN called c ON k.file_rule = c.name""")  # fmt: skip
def _(s, d):
    rows = vfindings(s, d).drop(*PHASES).selectExpr("*", f"{_FILE_RULE} AS file_rule", f"{_RD} AS rd_context")
    called = s.createDataFrame([(r["name"], r["assume_called"]) for r in RULES.file_contexts], "name string, assume_called boolean")
    return phases.resolve_pattern_phases(rows, _lookup(s), called).select("event_id", "code_context", "file_rule", *PHASES)


_CONTEXT = "CASE flag WHEN 'A' THEN 'onLoad_base' WHEN 'N' THEN 'onAttach_base' ELSE 'not_named' END"


@query("innermost_context", f"""WITH {VNODES}, ctx AS (SELECT *, {_CONTEXT} AS context FROM vnodes WHERE ord = 1)
SELECT f.file_context, f.pre, coalesce(arg_max(c.context, c.pre), CASE WHEN any_value(f.in_function) THEN 'in_function' ELSE 'top_level' END) AS code_context
FROM vnodes f LEFT JOIN ctx c ON f.file_context = c.file_context AND c.pre < f.pre AND f.pre <= c.pre + c.size AND c.context <> 'not_named' WHERE f.ord = 3 GROUP BY f.file_context, f.pre""")  # fmt: skip
def _(s, d):
    n = vnodes(s, d)
    found = n.where("ord = 3").selectExpr("*", "'x' AS found", "false AS indirect", "pre AS lpre", "1 AS line1", "1 AS col1", "1 AS line2")
    ctx = n.where("ord = 1").selectExpr("*", f"{_CONTEXT} AS context")
    use = s.createDataFrame([("R_scripts", "onLoad_base"), ("R_scripts", "onAttach_base")], "file_rule string, name string")
    return patterns.determine_code_contexts(found, ctx, use).select("file_context", "pre", "code_context")


@query("calls_bare", f"WITH {VNODES} SELECT file_context, pre, text FROM vnodes WHERE NOT after_dollar AND NOT after_at")
def _(s, d):
    return patterns.calls(vnodes(s, d).withColumn("tag", F.lit("SYMBOL_FUNCTION_CALL"))).select("file_context", "pre", "text")


@query("calls_below", f"""WITH {VNODES} SELECT file_context, pre FROM vnodes o WHERE text = 'eval'
AND EXISTS (SELECT 1 FROM vnodes i WHERE i.file_context = o.file_context AND i.text = 'parse' AND i.pre > o.pre AND i.pre <= o.pre + o.size)
AND EXISTS (SELECT 1 FROM vnodes i WHERE i.file_context = o.file_context AND i.text IN ('readRDS', 'system') AND i.pre > o.pre AND i.pre <= o.pre + o.size)""")  # fmt: skip
def _(s, d):
    n = vnodes(s, d)
    return patterns._holding(patterns._holding(n.where("text = 'eval'"), n.where("text = 'parse'")), n.where("text IN ('readRDS', 'system')")).select("file_context", "pre")


@query("function_owner", f"WITH {VNODES}, {_values('owners', 'fn, owner', list(RULES.owners().items()))} SELECT file_context, pre, owner FROM vnodes JOIN owners ON text = fn")
def _(s, d):
    owners = s.createDataFrame(list(RULES.owners().items()), "fn string, owner string")
    n = vnodes(s, d)
    return n.join(F.broadcast(owners), n.text == owners.fn).select("file_context", "pre", "owner")


@query("guarded_flag", "WITH g AS (SELECT conv_id, list(CAST(turn AS INTEGER)) AS guarded FROM conversations WHERE turn % 3 = 1 GROUP BY conv_id) SELECT c.conv_id, c.turn, coalesce(list_contains(guarded, CAST(c.turn AS INTEGER)), false) AS guarded FROM conversations c LEFT JOIN g USING (conv_id)")
def _(s, d):
    c = table(s, d, "conversations")
    g = c.where("turn % 3 = 1").groupBy("conv_id").agg(F.collect_list(F.col("turn").cast("int")).alias("lines"))
    return c.join(g, "conv_id", "left").select("conv_id", "turn", F.coalesce(F.array_contains("lines", F.col("turn").cast("int")), F.lit(False)).alias("guarded"))


@query("segment_spans", f"""WITH {VFILES}, {VLINES}, filled AS (SELECT package, file_context, line_number FROM vlines WHERE trim(line) <> '')
SELECT package, file_context, 'python' AS language, min(line_number) AS first_line, max(line_number) AS last_line, CAST(count(*) AS INTEGER) AS lines FROM filled GROUP BY ALL""")  # fmt: skip
def _(s, d):
    return coverage.segment_spans(vsegments(s, d).withColumn("language", F.lit("python"))).select("package", "file_context", "language", "first_line", "last_line", "lines")


@query("blank_except", f"WITH {VFILES}, {VLINES} SELECT package, file_context, line_number, CASE WHEN line_number % 3 = 0 THEN line ELSE '' END AS line FROM vlines")
def _(s, d):
    kept = vsegments(s, d).withColumn("lines", F.transform("lines", lambda x, i: F.when((i + 1) % 3 == 0, x).otherwise("")))
    return matches.lines_of(kept).select("package", "file_context", "line_number", "line")


_NONE = "NOT (" + " OR ".join(PHASES) + ")"
_UNPIVOT = " UNION ALL ".join([*(f"SELECT '{p}' AS phase, {i + 1} AS phase_rank, rule, attck FROM vfindings WHERE {p}" for i, p in enumerate(PHASES)), f"SELECT 'none', 10, rule, attck FROM vfindings WHERE {_NONE}"])
_SUMMARY = "SELECT phase, rule, count(*) AS n, min(attck) AS attck, phase_rank FROM u"


@query("summarize_findings", f"WITH {VFINDINGS}, u AS ({_UNPIVOT}) {_SUMMARY} GROUP BY ALL")
def _(s, d):
    return report.summarize_findings(vfindings(s, d))


@query("summarize_filtered", f"WITH {VFINDINGS}, u AS (SELECT phase, CASE phase WHEN 'none' THEN 1 WHEN 'at_load' THEN 2 ELSE 3 END AS phase_rank, rule, attck FROM ({_UNPIVOT}) WHERE phase IN ('none', 'at_load', 'at_build')) {_SUMMARY} GROUP BY ALL")
def _(s, d):
    return report.summarize_findings(vfindings(s, d), ["none", "at_load", "at_build"])


@query("in_phase", f"WITH {VFINDINGS} SELECT event_id FROM vfindings WHERE at_check OR at_load OR {_NONE}")
def _(s, d):
    return in_phase(vfindings(s, d), ["at_check", "at_load", "none"]).select("event_id")


@query("runs_automatically", f"WITH {VFINDINGS} SELECT event_id FROM vfindings WHERE NOT {_NONE}")
def _(s, d):
    return report.automatic(vfindings(s, d)).select("event_id")


@query("distinct_contexts", f"{_BASE} SELECT DISTINCT f.package, CAST(v.doc_id % 3 AS VARCHAR) AS version, f.file_context, f.rule FROM found f JOIN vfiles v ON f.package = v.package AND f.file_context = v.file_context WHERE f.report")
def _(s, d):
    found = claims.find_file_contexts(vfiles(s, d).withColumn("version", F.expr("CAST(doc_id % 3 AS STRING)")), RULES)
    return report.summarize_contexts(claims.reported(found))


@query("hash_manifest", f"""WITH {VFILES}, l AS (SELECT package, file_context, is_symlink, sha256(text) || '  ' || file_context AS line FROM vfiles WHERE NOT starts_with(file_context, '.git/'))
SELECT package, sha256(coalesce(string_agg(line, chr(10) ORDER BY file_context) FILTER (WHERE NOT is_symlink), '')) AS hash, CAST(count(*) FILTER (WHERE NOT is_symlink) AS INTEGER) AS n_files, CAST(count(*) FILTER (WHERE is_symlink) AS INTEGER) AS n_links FROM l GROUP BY package""")  # fmt: skip
def _(s, d):
    return manifest(vfiles(s, d)).select("package", "hash", "n_files", F.size("symlinks").alias("n_links"))


@query("sarif_fingerprints", f"""WITH {VFINDINGS}, o AS (SELECT *, row_number() OVER (PARTITION BY package, rule, file_context, code_context, preview ORDER BY line_number, column_number) AS nth FROM vfindings)
SELECT package, rule, file_context, line_number, column_number, sha256(concat('pattern/', rule, chr(13), file_context, chr(13), code_context, chr(13), preview, chr(13), nth)) AS fingerprint FROM o""")  # fmt: skip
def _(s, d):
    f = vfindings(s, d)
    rows = sarif.fingerprints(sarif.sarif_findings(f.limit(0), f, f.limit(0)))
    return rows.select("package", "rule", "file_context", F.col("line").alias("line_number"), F.col("column").alias("column_number"), "fingerprint")


@query("sarif_descriptors", f"WITH {VFINDINGS} SELECT package, 'pattern/' || rule AS id, rule AS name, any_value(message) AS message, any_value(attck) AS tag FROM vfindings GROUP BY package, rule")
def _(s, d):
    f = vfindings(s, d)
    return sarif.descriptors(sarif.sarif_findings(f.limit(0), f, f.limit(0))).select("package", "id", "name", "message", F.col("tags").getItem(0).alias("tag"))


_ENTRY = "CASE doc_id % 11 WHEN 0 THEN concat('../', source) WHEN 1 THEN concat('/', source) ELSE concat(source, '/', doc_id) END"
_KIND = "CASE WHEN doc_id % 31 = 7 THEN 'symlink' WHEN doc_id % 37 = 5 THEN 'other' ELSE 'file' END"


def _entries(s, d):
    return table(s, d, "documents").selectExpr("concat('a', doc_id DIV 50) AS package", f"{_ENTRY} AS name", f"{_KIND} AS type", "'' AS linkname", "n_chars AS size")


ENTRIES = f"entries AS (SELECT concat('a', doc_id // 50) AS package, {_ENTRY} AS name, {_KIND} AS type, n_chars AS size FROM documents)"
_SUM = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"


@query("tar_problem_counts", f"WITH {ENTRIES} SELECT package, count(*) AS n_entries, {_SUM('type = ' + chr(39) + 'symlink' + chr(39))} AS n_links, {_SUM('type = ' + chr(39) + 'other' + chr(39))} AS n_other, {_SUM('starts_with(name, ' + chr(39) + '../' + chr(39) + ')')} AS n_traversal, {_SUM('starts_with(name, ' + chr(39) + '/' + chr(39) + ')')} AS n_absolute, count(DISTINCT split_part(name, '/', 1)) AS n_toplevel FROM entries GROUP BY package")
def _(s, d):
    return validate_entries(_entries(s, d)).select("package", "n_entries", "n_links", "n_other", "n_traversal", "n_absolute", "n_toplevel")


@query("tar_structure", f"WITH {ENTRIES} SELECT package, count(*) AS n_entries, max(size) AS max_entry_size, CAST(sum(size) AS BIGINT) AS bytes_read, CAST(max(length(name)) AS INTEGER) AS max_path_nchar, CAST(max(len(string_split(name, '/'))) AS INTEGER) AS max_path_depth FROM entries GROUP BY package")
def _(s, d):
    return corpus.survey_structure(_entries(s, d)).select("package", "n_entries", "max_entry_size", "bytes_read", "max_path_nchar", "max_path_depth")


@query("quantiles", "WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_orderkey) SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE, 0.999::DOUBLE, 1.0::DOUBLE]) AS p, unnest((SELECT quantile_cont(n, [0.5, 0.9, 0.99, 0.999, 1.0]) FROM n)) AS value")
def _(s, d):
    return corpus.quantiles(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("n")), "n")


@query("merged_proportions", f"""WITH {VFINDINGS}, n AS (SELECT rule, count(*) AS n, count(DISTINCT package) AS n_packages FROM vfindings GROUP BY rule)
SELECT rule, CAST(n AS BIGINT) AS n, n / (SELECT sum(n) FROM n) * 100 AS percent, CAST(n_packages AS BIGINT) AS n_packages, n_packages / 40 * 100 AS percent_packages FROM n""")
def _(s, d):
    """Two parts of the findings, whose packages overlap, as states."""
    found = vfindings(s, d)
    parts = [found.where("event_id % 3 = 0"), found.where("event_id % 3 <> 0")]
    first = states.numbered(parts[0])
    numbers = [first, states.numbered(parts[1], first)]
    return states.proportions(states.merged_rules(*(states.rules(f, n) for f, n in zip(parts, numbers))), 40)


@query("merged_coverage", ORACLES["summarize_coverage"])
def _(s, d):
    cover = _coverage(s, d)
    parts = [cover.where("pmod(hash(file_context), 3) = 0"), cover.where("pmod(hash(file_context), 3) <> 0")]
    return states.merged_coverage(*map(states.coverage, parts))


@query("merged_findings", ORACLES["summarize_findings"])
def _(s, d):
    found = vfindings(s, d)
    parts = [found.where("event_id % 3 = 0"), found.where("event_id % 3 <> 0")]
    return states.merged_findings(*map(states.findings, parts))


@query("sarif_notifications", """SELECT concat('p', user_id % 40) AS package, 'error' AS level, concat('m', event_id) AS text, CASE event_id % 3 WHEN 0 THEN 'parse_code' ELSE 'find_matches' END AS descriptor_id,
CASE event_id % 3 WHEN 0 THEN concat('R/', user_id, '.R') END AS uri, CASE event_id % 3 WHEN 2 THEN event_type END AS associated_rule FROM events""")
def _(s, d):
    errors = table(s, d, "events").selectExpr("concat('p', user_id % 40) AS package", "CAST(NULL AS STRING) AS version", "IF(event_id % 3 = 0, 'parse_code', 'find_matches') AS step", "IF(event_id % 3 = 0, concat('R/', user_id, '.R'), NULL) AS file_context",
                                              "IF(event_id % 3 = 2, event_type, NULL) AS rule", "concat('m', event_id) AS message")
    return sarif.notifications(errors).drop("version")


@query("export_collisions", """WITH c AS (SELECT source AS package, concat('vignettes/', doc_id // 2, '.Rmd', CASE WHEN doc_id % 2 = 1 THEN '.python' ELSE '' END) AS file_context, doc_id % 2 = 1 AS whole, doc_id % 5 = 0 AS dots FROM documents),
t AS (SELECT package, CASE WHEN dots THEN concat('../', file_context) ELSE file_context END AS file_context, whole FROM c), j AS (SELECT *, concat(package, '/', CASE WHEN whole THEN file_context ELSE concat(file_context, '.python') END) AS path FROM t),
n AS (SELECT *, count(*) OVER (PARTITION BY path) AS k FROM j)
SELECT path, file_context, CASE WHEN contains(file_context, '../') THEN 'unsafe path' WHEN k > 1 THEN 'name collides with another export' END AS note FROM n""")
def _(s, d):
    rows = table(s, d, "documents").selectExpr("source AS package", "CAST(NULL AS STRING) AS version", "concat('vignettes/', doc_id DIV 2, '.Rmd', IF(doc_id % 2 = 1, '.python', '')) AS f", "doc_id % 2 = 1 AS whole", "doc_id % 5 = 0 AS dots", "CAST(text AS BINARY) AS content")
    rows = rows.withColumn("file_context", F.expr("IF(dots, concat('../', f), f)"))
    cover = rows.selectExpr("package", "version", "file_context", "'python' AS language", "'exportable' AS status", "1 AS first_line", "2 AS last_line", "IF(whole, 9L, NULL) AS bytes")
    files = rows.selectExpr("package", "version", "file_context", "9L AS bytes", "content", "false AS is_symlink")
    return export.export_manifest(export.export_jobs(cover), files).select("path", "file_context", "note")


@query("proportion_hits", f"WITH {VFINDINGS}, n AS (SELECT rule, count(*) AS n FROM vfindings GROUP BY rule) SELECT rule, n, n / (SELECT sum(n) FROM n) * 100 AS percent FROM n")
def _(s, d):
    return corpus.proportion_hits(vfindings(s, d))


@query("proportion_packages", f"WITH {VFINDINGS}, f AS (SELECT rule, event_id % (3 * length(rule)) AS package FROM vfindings) SELECT rule, count(DISTINCT package) AS n, count(DISTINCT package) / 40 * 100 AS percent FROM f GROUP BY rule")
def _(s, d):
    return corpus.proportion_packages(vfindings(s, d).withColumn("package", F.expr("event_id % (3 * length(rule))")), 40)


@query("provenance_mismatch", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN concat('name is ', c_name, 'x') ELSE concat('version is ', c_nationkey + 1) END AS message FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0 AND c_custkey % 5 <> 0")
def _(s, d):
    body = "concat('Package: ', c_name, IF(c_custkey % 5 = 0, 'x', ''), '\\nVersion: ', IF(c_custkey % 7 = 0 AND c_custkey % 5 <> 0, c_nationkey + 1, c_nationkey), '\\nTitle: t\\n')"
    files = table(s, d, "customer").selectExpr("c_name AS package", "CAST(c_nationkey AS STRING) AS version", "'DESCRIPTION' AS file_context", f"CAST({body} AS BINARY) AS content")
    return corpus.provenance(files).select(F.expr("CAST(regexp_extract(filename_name, '([0-9]+)$', 1) AS BIGINT)").alias("c_custkey"), "message")


_STEP = "CASE event_id % 4 WHEN 0 THEN 'parse_code' WHEN 1 THEN 'read_code' WHEN 2 THEN 'find_matches' ELSE 'find_patterns' END"


@query("error_counts", f"WITH e AS (SELECT {_STEP} AS step, CASE WHEN event_id % 4 < 2 THEN concat('f', user_id) END AS file_context, CASE WHEN event_id % 4 >= 2 THEN event_type END AS rule FROM events) SELECT step, count(*) AS n, CASE WHEN count(DISTINCT file_context) = 0 THEN count(*) ELSE count(DISTINCT file_context) END AS n_files, CASE WHEN count(DISTINCT rule) = 0 THEN count(*) ELSE count(DISTINCT rule) END AS n_rules FROM e GROUP BY step")
def _(s, d):
    e = table(s, d, "events").selectExpr(f"{_STEP} AS step", "IF(event_id % 4 < 2, concat('f', user_id), NULL) AS file_context", "IF(event_id % 4 >= 2, event_type, NULL) AS rule", "'m' AS message")
    return report.error_counts(e)


@query("rule_antijoins", f"WITH {_values('named', 'context', [(c,) for r in RULES.file_contexts for c in r['code_context'] or ()])}, {RULE_PHASES}, t AS (SELECT p_type AS context FROM part UNION SELECT context FROM named) SELECT context FROM t WHERE context NOT IN (SELECT context FROM rule_phases)")
def _(s, d):
    named = RULES.frame(s, "file_contexts").select(F.explode("code_context").alias("context"))
    return table(s, d, "part").select(F.col("p_type").alias("context")).union(named).distinct().join(F.broadcast(_lookup(s)), "context", "left_anti").select("context")


@query("rule_versions", f"WITH {_values('v', 'version, released', [(x['version'], x['released']) for x in RULES.versions])} SELECT version FROM v ORDER BY released DESC LIMIT 1")
def _(s, d):
    return RULES.frame(s, "versions").orderBy(F.desc("released")).limit(1).select("version")


_SECRET = r"(?i)(token|secret|password|api_key)\s*[:=]"


@query("secret_lines", rf"WITH {VFILES}, {VLINES} SELECT package, file_context, line_number FROM vlines WHERE regexp_matches(plain, '{_SECRET}')")
def _(s, d):
    rows = vfiles(s, d).select("package", "file_context", F.posexplode(paths.split_lines(F.col("text"))).alias("p", "line"))
    return rows.where(F.col("line").rlike(_SECRET)).select("package", "file_context", (F.col("p") + 1).cast("int").alias("line_number"))


@query("verify_downloads", "SELECT concat('d', doc_id) AS package, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN md5(text) ELSE md5('x') END AS md5_listed, md5(text) AS md5_local, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 3 = 1 END AS md5_matches, sha256(text) AS sha256_local FROM documents")
def _(s, d):
    t = table(s, d, "documents")
    local = t.selectExpr("concat('d', doc_id) AS package", "CAST(text AS BINARY) AS content")
    return corpus.verify_downloads(local, t.where("doc_id % 3 <> 0").selectExpr("concat('d', doc_id) AS package", "upper(IF(doc_id % 3 = 1, md5(text), md5('x'))) AS md5"))


@query("dependency_closure", "WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1), r AS (SELECT p_partkey AS a FROM part WHERE p_partkey % 97 = 0 UNION SELECT e.b FROM r JOIN e ON r.a = e.a) SELECT concat('p', a) AS package FROM r")
def _(s, d):
    t = table(s, d, "part")
    edges = t.where("p_partkey > 1").selectExpr("concat('p', p_partkey) AS package", "concat('p', p_partkey DIV 2) AS needs")
    return corpus.dependency_closure(edges, t.where("p_partkey % 97 = 0").selectExpr("concat('p', p_partkey) AS package"))


_EXPECTED = _values("expected", "k, a, b, rule, line_number, column_number, code_context, indirect", [(k, a, b, *f) for k, (a, b, _, found) in enumerate(CODE) for f in found])


@query("pattern_findings", f"""WITH {_EXPECTED} SELECT concat('p', doc_id // 100) AS package, concat(a, doc_id, b) AS file_context, rule, line_number, column_number, code_context, indirect
FROM documents JOIN expected ON doc_id % {len(CODE)} = k""")  # fmt: skip
def _(s, d):
    return audit(vcode(s, d), RULES, persist=False).patterns.select("package", "file_context", "rule", "line_number", "column_number", "code_context", "indirect")


@query("xpath_findings", ORACLES["pattern_findings"])
def _(s, d):
    return audit(vcode(s, d), in_xpath(RULES)).patterns.select("package", "file_context", "rule", "line_number", "column_number", "code_context", "indirect")


def _broken() -> RuleBase:
    """The rules with a file rule, a line rule and nothing else broken."""
    rules = default_rules()
    rules.file_contexts.append(rules.file_contexts[0] | {"name": "bad_file", "filename": "(?<x"})
    rules.matches.append(rules.matches[0] | {"name": "bad_line", "regex": "a{2,1}"})
    return rules


@query("broken_rules", f"WITH {VFILES} SELECT package, step, rule, CAST(NULL AS VARCHAR) AS file_context FROM (SELECT DISTINCT package FROM vfiles), (VALUES ('find_file_contexts', 'bad_file'), ('find_matches', 'bad_line')) AS b(step, rule)")
def _(s, d):
    return rule_errors(vfiles(s, d), _broken())[1].select("package", "step", "rule", "file_context")


@query("matches_beside_broken_rules", f"WITH {VFILES}, {VLINES} SELECT {_RULED} AS rule, CAST(count(*) AS BIGINT) AS n FROM vlines WHERE k < {len(SNIPPETS) - 1} GROUP BY ALL")
def _(s, d):
    rules, _ = rule_errors(vfiles(s, d), _broken())
    return matches.find_matches(vsegments(s, d), rules).groupBy("rule").agg(F.count("*").alias("n"))


# What SQL cannot express: extraction, parsing and the whole audit; tests hold these against known results.


@query("extract_segments")
def _(s, d):
    found = _found(s, d)
    body = vfiles(s, d).select(F.col("package").alias("b_package"), F.col("file_context").alias("b_file"), "content", "bytes")
    scan = claims.scan_set(found)
    readings = scan.join(body, (scan.package == body.b_package) & (scan.file_context == body.b_file)).withColumn("macros", F.lit(None).cast("string"))
    return extract.extract_segments(readings).select("package", "file_context", "rule", "language", F.size("lines").alias("n_lines"), "step")


@query("audit_errors")
def _(s, d):
    return audit(vfiles(s, d).drop("doc_id", "text"), RULES).errors


@query("audit_coverage")
def _(s, d):
    return audit(vfiles(s, d).drop("doc_id", "text"), RULES).coverage


@query("sarif_documents")
def _(s, d):
    return sarif.emit_sarif(audit(vfiles(s, d).drop("doc_id", "text"), RULES))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
