"""SARIF 2.1.0 documents, one a package and version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import PHASES

KEYS = ["package", "version"]
SCHEMA_URI = "https://json.schemastore.org/sarif-2.1.0.json"
#: Where the engine is described, and the page of a technique.
INFORMATION_URI = "urn:surfacescan:engine"
TECHNIQUE_URI = "https://attack.mitre.org/techniques/"


def sarif_findings(file_contexts: DataFrame, patterns: DataFrame, matches: DataFrame) -> DataFrame:
    """The three frames as one: id, rule, place, preview, message, attck, phases (array), code_context, guarded, indirect."""
    none = lambda t: F.lit(None).cast(t)

    def part(df: DataFrame, prefix: str, line: bool, code: bool) -> DataFrame:
        phases = F.filter(F.array(*(F.when(F.col(p), F.lit(p)) for p in PHASES)), lambda x: x.isNotNull())
        return df.select(
            "package", "version", F.concat(F.lit(prefix), F.col("rule")).alias("id"), "rule", "file_context", (F.col("line_number") if line else none("int")).alias("line"),
            (F.col("column_number") if line else none("int")).alias("column"), (F.col("preview") if line else none("string")).alias("preview"), "message",
            (F.col("attck") if line else none("string")).alias("attck"), phases.alias("phases"), (F.col("code_context") if code else none("string")).alias("code_context"),
            (F.col("guarded") if code else none("boolean")).alias("guarded"), (F.col("indirect") if code else none("boolean")).alias("indirect"),
        )

    return part(file_contexts, "file/", False, False).unionByName(part(patterns, "pattern/", True, True)).unionByName(part(matches, "match/", True, False))


def fingerprints(found: DataFrame) -> DataFrame:
    """found with fingerprint: a hash of what and where without line numbers, and which occurrence of it this is."""
    key = [*KEYS, "id", "file_context", "code_context", "preview"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("line", "column"))
    text = F.concat_ws("\r", "id", "file_context", F.coalesce("code_context", F.lit("")), F.coalesce("preview", F.lit("")), nth.cast("string"))
    return found.withColumn("fingerprint", F.sha2(text, 256))


def descriptors(found: DataFrame) -> DataFrame:
    """One row a rule that has findings: id, name, message and its technique tags."""
    first = F.min(F.struct("file_context", F.coalesce("line", F.lit(0)).alias("l"), F.coalesce("column", F.lit(0)).alias("c"), "rule", "message", "attck")).alias("f")
    tags = F.filter(F.split(F.coalesce("f.attck", F.lit("")), r"\s+"), lambda x: x != "")
    return found.groupBy(*KEYS, "id").agg(first).select(*KEYS, "id", F.col("f.rule").alias("name"), F.col("f.message").alias("message"), tags.alias("tags"))


def artifacts(coverage: DataFrame) -> DataFrame:
    """One row a file: its first coverage row."""
    first = F.min(F.struct(F.coalesce("first_line", F.lit(0)).alias("l"), F.col("bytes").isNull().alias("span"), "status", "reason", "language", "lines", "bytes")).alias("f")
    return coverage.groupBy(*KEYS, "file_context").agg(first).select(*KEYS, "file_context", *(F.col(f"f.{c}").alias(c) for c in ("status", "reason", "language", "lines", "bytes")))


def help_uri(tags: Column) -> Column:
    """The page of a rule's first technique; the engine's own where it has none."""
    return F.when(F.size(tags) > 0, F.concat(F.lit(TECHNIQUE_URI), F.replace(tags[0], F.lit("."), F.lit("/")), F.lit("/"))).otherwise(F.lit(INFORMATION_URI))


def notifications(errors: DataFrame) -> DataFrame:
    """Errors as notifications: the step is the descriptor, and file and rule are where a consumer looks for them."""
    return errors.select(*KEYS, F.lit("error").alias("level"), F.col("message").alias("text"), F.col("step").alias("descriptor_id"), F.col("file_context").alias("uri"), F.col("rule").alias("associated_rule"))


def emit_sarif(audit) -> DataFrame:
    """package, version, sarif (JSON text). One package's findings meet in one row: the document."""
    found = sarif_findings(audit.file_contexts, audit.patterns, audit.matches)
    if audit.held:  # results and rules both read the findings; they are let go of with what the audit keeps
        found = found.persist()
        audit.held.append(found)
    found = fingerprints(found)
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn")))
    place = F.struct(F.struct(F.struct(F.col("file_context").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("id").alias("ruleId"), F.lit("note").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"),
        F.struct(F.col("fingerprint").alias("findingV1")).alias("partialFingerprints"),
        F.struct("phases", F.col("code_context").alias("codeContext"), "guarded", "indirect").alias("properties"),
    )
    ordered = F.struct("id", "file_context", F.coalesce("line", F.lit(0)).alias("l"), F.coalesce("column", F.lit(0)).alias("c"), F.to_json(result).alias("j"))
    listed = lambda c, name: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["j"]), ","), F.lit("]")).alias(name)
    results = found.groupBy(*KEYS).agg(listed(ordered, "results"))
    rule = F.struct("id", "name", F.struct(F.col("message").alias("text")).alias("shortDescription"), help_uri(F.col("tags")).alias("helpUri"), F.struct("tags").alias("properties"))
    rules = descriptors(found).groupBy(*KEYS).agg(listed(F.struct("id", F.to_json(rule).alias("j")), "rules"))
    keep = {"ignoreNullFields": "false"}
    art = F.struct(F.struct(F.col("file_context").alias("uri")).alias("location"), F.struct("status", "reason", "language", "lines", "bytes").alias("properties"))
    arts = artifacts(audit.coverage).groupBy(*KEYS).agg(listed(F.struct("file_context", F.to_json(art, keep).alias("j")), "artifacts"))
    where = F.when(F.col("uri").isNotNull(), F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation")).alias("physicalLocation"))))
    by = F.when(F.col("associated_rule").isNotNull(), F.struct(F.col("associated_rule").alias("id")))
    note = F.struct("level", F.struct("text").alias("message"), F.struct(F.col("descriptor_id").alias("id")).alias("descriptor"), where.alias("locations"), by.alias("associatedRule"))
    notes = notifications(audit.errors).groupBy(*KEYS).agg(listed(F.struct("descriptor_id", "uri", F.to_json(note).alias("j")), "notes"))
    rows = audit.scans.select(*KEYS, "engine_version", "rules_version", "rules_sha256", "scanned", "pkg_name", "pkg_version", "pkg_sha256")
    for df in (results, rules, arts, notes):
        right = df.withColumnsRenamed({k: f"r_{k}" for k in KEYS})
        rows = rows.join(right, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in KEYS], "left").drop(*(f"r_{k}" for k in KEYS))
    part = lambda c: F.coalesce(c, F.lit("[]"))
    driver = F.to_json(F.struct(F.lit("surfacescan").alias("name"), F.col("engine_version").alias("version"), F.lit(INFORMATION_URI).alias("informationUri")))
    properties = F.to_json(F.struct("pkg_name", "pkg_version", "pkg_sha256", "rules_version", "rules_sha256", "scanned"))
    body = F.concat(
        F.lit('{"$schema":"' + SCHEMA_URI + '","version":"2.1.0","runs":[{"tool":{"driver":'), F.expr("substring({0}, 1, length({0}) - 1)".format("d")), F.lit(',"rules":'), part("rules"),
        F.lit('}},"invocations":[{"executionSuccessful":true,"toolExecutionNotifications":'), part("notes"), F.lit('}],"artifacts":'), part("artifacts"), F.lit(',"results":'), part("results"),
        F.lit(',"properties":'), F.col("p"), F.lit("}]}"),
    )
    return rows.withColumn("d", driver).withColumn("p", properties).select(*KEYS, body.alias("sarif"))
