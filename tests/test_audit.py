import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from surfacescan.operators import export, report, sarif
from surfacescan.plans import audit
from surfacescan.plans.audit import manifest
from surfacescan.rules import default_rules
from surfacescan.schemas import PHASES
from surfacescan.sources import from_memory

FETCH = "wget -q https://lamps.example.org/oil.tgz && wget b"
DEMO = {
    "DESCRIPTION": ["Package: lantern", "Version: 2.3.1", "Title: Lamps", "    and light"],
    "configure": ["#!/bin/sh", "set -e", FETCH],
    "R/hooks.R": [".onAttach <- function(lib, pkg) {", "  packageStartupMessage('lit')", "  shell(\"ver\")", "}"],
    "R/glow.R": ["glow <- function(path) {", "  readRDS(path)", "}"],
    "man/glow.Rd": ["\\name{glow}", "\\description{", "\\Sexpr[results=hide]{httr2::req_perform(r)}", "}", "\\examples{", "unserialize(x)", "}"],
    "vignettes/v.Rmd": ["```{python}", "", "x = 1", "```", "```{r}", "system('a')", "```"],
    "R/broken.R": ["f <- function( {"],
    "src/Makevars": ["all: ; umask 0"],
    "misc/configure": ["x"],
    "data/a.rda": b"RDX\0",
    "inst/a.png": b"\x89PNG",
    "src/a.c": ["int x;"],
}


@pytest.fixture(scope="module")
def done(spark):
    return audit(from_memory(spark, {"lantern": DEMO, "other": {"configure": ["wget z"]}})).validate()


def found(df, *columns):
    return sorted(tuple(r) for r in df.where("package = 'lantern'").select(*columns).collect())


def on(df):
    return df.select("*", F.array_join(F.filter(F.array(*(F.when(F.col(p), F.lit(p)) for p in PHASES)), lambda x: x.isNotNull()), " ").alias("on"))


def test_patterns(done):
    assert found(on(done.patterns), "rule", "file_context", "line_number", "column_number", "code_context", "on") == [
        ("deserialization", "R/glow.R", 2, 3, "in_function", ""),
        ("deserialization", "man/glow.Rd", 6, 1, "Rd_examples", "at_check"),
        ("httr2", "man/glow.Rd", 3, 29, "Rd_Sexpr_install", "at_build at_check at_install_src"),
        ("system", "R/hooks.R", 3, 3, "onAttach_base", "at_build at_check at_install_src at_attach"),
        ("system", "vignettes/v.Rmd", 6, 1, "top_level", "at_build at_check"),
    ]


def test_matches_take_the_union_of_phases(done):
    assert found(on(done.matches), "rule", "file_context", "line_number", "column_number", "on") == [
        ("chmod", "src/Makevars", 1, 8, "at_build at_check at_install_src at_load"),
        ("wget", "configure", 3, 1, "at_build at_check at_install_src"),
        ("wget", "configure", 3, FETCH.rindex("wget") + 1, "at_build at_check at_install_src"),
    ]


def test_coverage(done):
    rows = {(r[0], r[3]): tuple(r)[1:] for r in found(done.coverage, "file_context", "status", "reason", "language", "lines")}
    assert rows["R/broken.R", "R"][:2] == ("error", "unparseable") and rows["data/a.rda", None][:2] == ("unexamined", "serialized") and rows["inst/a.png", None] if ("inst/a.png", None) in rows else True
    assert rows["src/a.c", "c"][:2] == ("exportable", "no_analyzer") and rows["misc/configure", None][:2] == ("unexamined", "no_rule")
    assert rows["vignettes/v.Rmd", "python"][:2] == ("exportable", "no_analyzer") and rows["configure", "shell"][0] == "matched" and rows["DESCRIPTION", None][:2] == ("unexamined", "no_extractor")


def test_errors_and_notes(done):
    assert found(done.errors, "step", "file_context") == [("parse_code", "R/broken.R")]
    assert report.error_notes(done.errors)[0].startswith("1 file did not parse")


def test_report(done):
    text = report.text_report(done, "lantern")
    lines = [" ".join(x.split()) for x in text.split("\n")]
    assert "at_attach system 1 T1059.003 T1059.004" in lines and "at_check deserialization 1 T1059" in lines and "Name: lantern" in lines and "Version: 2.3.1" in lines
    assert all(len(x) <= 77 for x in text.split("\n") if x.startswith("---")) and "none" in text and "(coverage incomplete)" in report.short_text(done, "lantern")
    assert "Phases:" in report.text_report(done, "lantern", ["at_load"])
    with pytest.raises(ValueError):
        report.summarize_findings(done.patterns, ["at_lunch"])


def test_notes_on_macros_and_other_steps(spark):
    said = lambda rows: report.error_notes(spark.createDataFrame(rows, "package string, version string, step string, file_context string, rule string, message string"))
    macro = lambda f, *names: ("p", None, "read_Rd_code", f, None, "; ".join(f"unknown macro '\\{x}'" for x in names))
    assert said([macro("a.Rd", "mjseqn", "insertRef"), macro("b.Rd", "lifecycle")])[0].startswith("2 help pages used macros") and "With Rdpack, mathjaxr and lifecycle installed" in said([macro("a.Rd", "mjseqn", "insertRef"), macro("b.Rd", "lifecycle")])[0]
    assert "installed" not in said([macro("a.Rd", "strange")])[0] and said([macro("a.Rd", "strange")])[0].startswith("1 help page used")
    both = said([macro("a.Rd", "foldend"), ("p", None, "read_Rd_code", "b.Rd", None, "a brace is not closed"), ("p", None, "dance", None, None, "x"), ("p", None, "dance", None, None, None), ("p", None, "parse_code", "c.R", None, "x")])
    assert len(both) == 4 and "With details installed" in both[0] and both[1].startswith("1 file did not parse as help pages") and "as R" in both[2] and both[3].startswith("2 errors in the step dance")
    assert said([]) == []


def test_unknown_macros_are_errors(spark):
    got = audit(from_memory(spark, {"lantern": {"man/a.Rd": ["\\name{a}", "\\description{\\lifecycle{old}}"], "man/b.Rd": ["\\name{b}", "\\code{f}"]}}))
    assert found(got.errors, "step", "file_context", "message") == [("read_Rd_code", "man/a.Rd", "unknown macro '\\lifecycle'")]
    got.release()


def test_paths_under_home():
    assert report.under_home("/home/ann/p.tar.gz", "/home/ann/") == "~/p.tar.gz" and report.under_home("/home/ann", "/home/ann") == "~"
    assert report.under_home("/home/anna/p", "/home/ann") == "/home/anna/p" and report.under_home("/srv/p", "/home/ann") == "/srv/p" and report.under_home("/x", "/") == "/x"
    assert report.under_home("C:\\Users\\ann\\p", "C:\\Users\\ann") == "~/p"


def test_arguments_are_checked(spark, done):
    files = from_memory(spark, {"p": {"R/a.R": ["1"]}})
    for wrong, word in (({"rules": {}}, "rules"), ({"scanned": ""}, "scanned"), ({"persist": 1}, "persist"), ({"path": ""}, "path"), ({"tarball": None}, "tarball"), ({"tarball": True}, "tarball needs")):
        with pytest.raises(ValueError, match=word):
            audit(files, **wrong)
    with pytest.raises(ValueError, match="files"):
        audit("folder")
    with pytest.raises(ValueError, match="content"):
        audit(files.drop("content"))
    with pytest.raises(ValueError, match="not an audit"):
        report.text_report(files, "p")
    with pytest.raises(ValueError, match="no package"):
        report.text_report(done, "absent")
    scan = audit(files, path="/data/p.tar.gz", tarball=True).scans.first()
    assert scan["pkg_path"] == "/data/p.tar.gz" and scan["pkg_is_tarball"]
    text = report.text_report(done, "lantern")
    assert "Path:" in text and "Path:" not in report.text_report(done, "lantern", path=False)


def test_sarif(done):
    docs = {r["package"]: json.loads(r["sarif"]) for r in sarif.emit_sarif(done).collect()}
    run = docs["lantern"]["runs"][0]
    assert len(run["results"]) == 5 + 3 + 2 and {r["level"] for r in run["results"]} == {"note"}
    assert len({r["partialFingerprints"]["findingV1"] for r in run["results"]}) == 10
    assert "region" not in next(r for r in run["results"] if r["ruleId"].startswith("file/"))["locations"][0]["physicalLocation"]
    paths = set()

    def walk(x, at):
        paths.add(at)
        for k, v in x.items() if isinstance(x, dict) else [("[]", y) for y in x] if isinstance(x, list) else ():
            walk(v, f"{at}.{k}".lstrip("."))

    for d in docs.values():
        walk(d, "")
    driver, notes, at = "runs.[].tool.driver", "runs.[].invocations.[].toolExecutionNotifications.[]", "physicalLocation.artifactLocation.uri"
    assert paths >= {
        "$schema", "version", *(f"{driver}.{k}" for k in ("name", "version", "informationUri")), *(f"{driver}.rules.[].{k}" for k in ("id", "name", "shortDescription.text", "helpUri", "properties.tags.[]")),
        "runs.[].invocations.[].executionSuccessful", *(f"{notes}.{k}" for k in ("level", "message.text", "descriptor.id", f"locations.[].{at}", "associatedRule.id")),
        *(f"runs.[].results.[].{k}" for k in ("ruleId", "level", "message.text", f"locations.[].{at}", "locations.[].physicalLocation.region.startLine", "locations.[].physicalLocation.region.startColumn", "partialFingerprints.findingV1", "properties.phases.[]", "properties.codeContext", "properties.guarded", "properties.indirect")),
        *(f"runs.[].artifacts.[].{k}" for k in ("location.uri", "properties.status", "properties.reason", "properties.language", "properties.lines", "properties.bytes")),
    }
    pages = {r["name"]: r["helpUri"] for r in run["tool"]["driver"]["rules"]}
    assert pages["chmod"].startswith("https://") and pages["configure"].startswith("urn:")
    assert run["tool"]["driver"]["rules"] and run["invocations"][0]["toolExecutionNotifications"] and all("language" in a["properties"] for a in run["artifacts"])


def test_scanning_together_is_scanning_apart(spark, done):
    alone = audit(from_memory(spark, {"other": {"configure": ["wget z"]}}))
    assert [tuple(r) for r in alone.matches.collect()] == [tuple(r) for r in done.matches.where("package = 'other'").collect()]


def test_export(spark, done, tmp_path):
    files = from_memory(spark, {"lantern": DEMO})
    rows = export.export_manifest(export.export_jobs(done.coverage.where("package = 'lantern'")), files)
    out = {r["file_context"]: r for r in export.export_unscanned(rows, str(tmp_path)).collect()}
    assert out["src/a.c"]["written"] and (tmp_path / "lantern/src/a.c").read_text() == "int x;\n"
    assert (tmp_path / "lantern/vignettes/v.Rmd.python").read_text().split("\n")[2] == "x = 1"
    with pytest.raises(ValueError, match="not empty"):
        export.export_unscanned(rows, str(tmp_path))
    (tmp_path / "lantern/src/a.c").write_text("old")
    again = export.export_unscanned(rows, str(tmp_path), overwrite=True).collect()
    assert all(r["written"] for r in again if r["file_context"] == "src/a.c") and (tmp_path / "lantern/src/a.c").read_text() == "int x;\n"
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file() and p.name.startswith(".")) == []  # nothing unfinished
    bad = spark.createDataFrame([("../x",), ("/x",), ("a/b",), ("a//b",)], "p string").select(export.unsafe(F.col("p"))).collect()
    assert [r[0] for r in bad] == [True, True, False, True]


def test_export_is_not_led_astray(tmp_path):
    """A link planted as a parent, or as the file itself, leaves nothing outside the target; what a lost task has written counts."""
    import os

    outside, top = tmp_path / "outside", tmp_path / "top"
    outside.mkdir()
    top.mkdir()
    at = os.open(top, os.O_RDONLY | os.O_DIRECTORY)
    (top / "p").symlink_to(outside)
    assert export._write(at, "p/src/a.c", b"x", False) == "escapes target" and export._write(at, "p/a.c", b"x", True) == "escapes target" and list(outside.iterdir()) == []
    (top / "q").mkdir()
    (top / "q/a.c").symlink_to(outside / "b.c")
    assert export._write(at, "q/a.c", b"x", False) == "could not write" and list(outside.iterdir()) == []
    assert export._write(at, "q/a.c", b"x", True) is None and not (top / "q/a.c").is_symlink() and list(outside.iterdir()) == []
    (top / "f").write_text("x")
    assert export._write(at, "f/a.c", b"x", False) == "escapes target"
    assert export._write(at, "r/s/a.c", b"body", False) is None and export._write(at, "r/s/a.c", b"body", False) is None and export._write(at, "r/s/a.c", b"other", False) == "could not write"
    assert (top / "r/s/a.c").read_bytes() == b"body" and sorted(os.listdir(top / "r/s")) == ["a.c"]
    os.close(at)


def test_manifest_ignores_order(spark):
    a, b = ({"p": dict(items)} for items in (list(DEMO.items()), list(DEMO.items())[::-1]))
    one, two = (manifest(from_memory(spark, x)).first() for x in (a, b))
    assert one["hash"] == two["hash"] and one["n_files"] == len(DEMO) and not one["manifest"].endswith("\n")


def test_nothing_and_conforming(spark):
    empty = audit(from_memory(spark, {"p": {"a.txt": ["x"]}}).limit(0))
    assert all(getattr(empty, n).count() == 0 for n in ("file_contexts", "patterns", "matches", "coverage", "errors"))
    with pytest.raises(ValueError):
        replace(empty, errors=empty.matches).validate()


BARE = {r["name"]: r["functions"] for r in default_rules().patterns}
MORE = {
    "decoding": ["rawToChar(as.raw(c(1, 2)))"],
    "eval_parse": ["eval(parse(text = rawToChar(x)))", "evalq(str2lang(readLines(u)))"],
    "install": ["BiocManager::install('x')", "renv::install('x')"],
    "options_repos": ["options(repos = c(a = 'b'))"],
    "persistence": ["x <- '~/.bashrc'", "cat(y, file = \".Rprofile\")"],
    "credentials": ["readLines('~/.ssh/id_rsa')", "Sys.getenv('GITHUB_TOKEN')", "list.files('~/.gnupg/')"],
    "system_callr": ["callr::r(f)", "callr::r_session$new()"],
    "system_processx": ["processx::run('a')", "process$new('a')"],
}
NOTHING = [
    "x$system('a')", "x@system('a')", "install('x')", "eval(x)", "eval(parse(text = 'a'))", "options(digits = 3)", "Sys.getenv('HOME')", "run('a')", "'read about `.bashrc` here'",
    "'a long sentence that talks about .bashrc at length'", "system", "f$new()", "match.fun(what = 'system')", "do.call(fn, 'system')", "r('x')",
]
INDIRECT = ["do.call('system', list('a'))", "do.call(args = list('id'), what = 'system')", "match.fun('system')('a')", "getFunction(name = 'system')", "do.call(args = x, 'system')"]


def test_rule_examples(spark):
    files, want = {}, {}
    for rule in BARE:
        for i, code in enumerate([f"{f}(x)" for f in BARE[rule]] + [f"p::{f}(x)" for f in BARE[rule]] + MORE.get(rule, [])):
            files[f"tests/{rule}-{i}.R"], want[f"tests/{rule}-{i}.R"] = [code], rule
    for i, code in enumerate(NOTHING):
        files[f"tests/nothing-{i}.R"] = [code]
    for i, code in enumerate(INDIRECT):
        files[f"tests/indirect-{i}.R"], want[f"tests/indirect-{i}.R"] = [code], "system"
    done = audit(from_memory(spark, {"p": files}))
    got = {}
    for r in done.patterns.collect():
        got.setdefault(r["file_context"], set()).add((r["rule"], r["indirect"]))
    assert done.errors.count() == 0
    assert {f: r for f, r in want.items() if r not in {x for x, _ in got.get(f, ())}} == {}
    assert {f: files[f] for f in got if "nothing" in f} == {}
    assert all(any(i for _, i in got[f"tests/indirect-{k}.R"]) for k in range(len(INDIRECT)))


def test_hooks_and_innermost(spark):
    files = {
        "R/a.R": [".onLoad <- function(l, p) {", "  on_load(system('x'))", "  do.call('system', list())", "}", "(function(l) system('y')) -> .onAttach", ".Last.lib = function(x) shell('z')", ".onUnload <- \\(x) system('q')"],
        "tests/b.R": [".onLoad <- function(l, p) system('x')"],
    }
    done = audit(from_memory(spark, {"p": files}))
    got = sorted((r["file_context"], r["line_number"], r["code_context"], r["indirect"]) for r in done.patterns.collect())
    assert got == [("R/a.R", 2, "on_load_rlang", False), ("R/a.R", 3, "onLoad_base", True), ("R/a.R", 5, "onAttach_base", False), ("R/a.R", 6, "LastLib_base", False), ("R/a.R", 7, "in_function", False), ("tests/b.R", 1, "in_function", False)]


def test_line_examples(spark):
    hits = ["curl a && curl b", "éé && curl x", "umask 0", "chmod +x f", "pip install x", "base64 -d f", "Rscript a", "nc h 1", "exec 3<>/dev/tcp/h/1", "git clone u", "cat $HOME/.ssh/id_rsa", "echo $GITHUB_TOKEN"]
    misses = ["libcurl -lcurl", "umask 022", "chmod 644 f", "chmodx 777", "mycurl", "install curl.h", "nc", "PKG_LIBS=-lssh2", "SRC_DIR=src/credential_helpers"]
    done = audit(from_memory(spark, {"p": {"configure": hits, "cleanup": misses}}))
    rows = sorted((r["file_context"], r["line_number"], r["column_number"]) for r in done.matches.collect())
    assert {r[1] for r in rows if r[0] == "configure"} == set(range(1, len(hits) + 1)) and not [r for r in rows if r[0] == "cleanup"]
    assert [r[2] for r in rows if r[1] == 1] == [1, 11] and [r[2] for r in rows if r[1] == 2] == [7]


def test_versions_of_a_package_stay_apart(spark):
    old = from_memory(spark, {"p": {"DESCRIPTION": ["Package: p", "Version: 1"], "R/a.R": ["system('a')"], "src/a.c": ["int x;"], "man/macros/m.Rd": ["\\newcommand{\\go}{\\Sexpr{system('m')}}"], "man/a.Rd": ["\\go"]}}, "1")
    new = from_memory(spark, {"p": {"DESCRIPTION": ["Package: p", "Version: 2"], "R/a.R": ["source('b')"], "src/a.c": ["int y;"], "man/a.Rd": ["\\go"]}}, "2")
    done = audit(old.unionByName(new))
    assert sorted((r["version"], r["pkg_version"]) for r in done.scans.collect()) == [("1", "1"), ("2", "2")]
    assert sorted((r["version"], r["rule"], r["file_context"]) for r in done.patterns.collect()) == [("1", "system", "R/a.R"), ("1", "system", "man/a.Rd"), ("2", "source", "R/a.R")]
    docs = {r["version"]: json.loads(r["sarif"])["runs"][0] for r in sarif.emit_sarif(done).collect()}
    assert {v: sorted(x["ruleId"] for x in d["results"]) for v, d in docs.items()} == {"1": ["pattern/system", "pattern/system"], "2": ["pattern/source"]}
    one, two = (" ".join(report.text_report(done, "p", version=v).split()) for v in ("1", "2"))
    assert "Version: 1" in one and "system" in one and "source" not in one and "Version: 2" in two and "source" in two and "system" not in two
    assert "Patterns: 2" in " ".join(report.short_text(done, "p", "1").split()) and "Patterns: 1" in " ".join(report.short_text(done, "p", "2").split())
    for wrong in (None, "3"):
        with pytest.raises(ValueError, match="versions 1, 2" if wrong is None else "no package p 3"):
            report.text_report(done, "p", version=wrong)
    contexts = [tuple(r) for r in report.summarize_contexts(done.file_contexts.unionByName(done.file_contexts)).collect()]
    assert contexts == sorted(set(contexts))
    jobs = export.export_jobs(done.coverage)
    assert sorted((r["target"], r["collides"]) for r in jobs.collect()) == [("p/1/src/a.c", False), ("p/2/src/a.c", False)]


def test_failures_cost_themselves_alone(spark):
    rules = default_rules()
    whole = from_memory(spark, {"lantern": DEMO})
    plain = audit(whole, rules)
    broken = replace(rules, matches=[*rules.matches, rules.matches[0] | {"name": "bad_line", "regex": "a{2,1}"}], file_contexts=[*rules.file_contexts, rules.file_contexts[0] | {"name": "bad_file", "filename": "(?<x"}])

    def odd(lines, meta):
        if "glow" in lines[0]:
            raise ZeroDivisionError("odd file")
        return [("R", None, lines, [])]

    def bad(segments):
        raise KeyError("no such column")

    done = audit(whole, broken, extractors={"R": odd}, analyzers={"python": bad})
    errors = sorted((r["step"], r["file_context"] or "", r["rule"] or "") for r in done.errors.collect())
    assert errors == [("extract_segments", "R/glow.R", "R_scripts"), ("find_file_contexts", "", "bad_file"), ("find_matches", "", "bad_line"), ("find_matches", "", "python"), ("parse_code", "R/broken.R", "R_scripts")]
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(done.matches) == rows(plain.matches) and rows(done.patterns) == rows(plain.patterns.where("file_context <> 'R/glow.R'"))
    assert any("line rules failed" in x for x in report.error_notes(done.errors)) and any("could not be applied" in x for x in report.error_notes(done.errors))


def test_analyzers_that_fail_at_run_time(spark):
    from surfacescan.operators.analyze import PerSegment

    rules = default_rules()
    next(r for r in rules.file_contexts if r["name"] == "exec_other")["type"] = "py"
    files = from_memory(spark, {"p": {"exec/a.py": ["import os", "os.system('x')"], "exec/b.py": ["boom"], "exec/c.py": ["x"]}, "q": {"exec/d.py": [" os.system('y')"], "configure": ["wget z"]}})
    extractors = {"py": lambda lines, meta: [("python", None, lines, [])]}

    def find(lines, facts):
        if lines[0] == "boom":
            raise RuntimeError(f"no {facts['file_context']}")
        return [{"rule": "os_system", "line_number": i, "column_number": x.index("os.") + 1, "message": "runs a command"} for i, x in enumerate(lines, 1) if "os.system" in x]

    done = audit(files, rules, extractors=extractors, analyzers={"python": PerSegment(find)}).validate()
    hits = lambda a: sorted((r["package"], r["rule"], r["file_context"], r["line_number"], r["column_number"], r["preview"]) for r in a.matches.collect())
    wget = ("q", "wget", "configure", 1, 1, "wget z")
    assert hits(done) == [("p", "os_system", "exec/a.py", 2, 1, "os.system('x')"), ("q", "os_system", "exec/d.py", 1, 2, "os.system('y')"), wget]
    assert [tuple(r) for r in done.errors.select("package", "step", "file_context", "rule", "message").collect()] == [("p", "find_matches", "exec/b.py", "python", "RuntimeError: no exec/b.py")]

    def frame(segments):  # raises in the tasks, beyond the reach of a plan's try
        def run(it):
            for pdf in it:
                raise RuntimeError("at run time")
                yield pdf

        return segments.mapInPandas(run, "package string, version string, rule string, file_context string, line_number int, column_number int, preview string, message string, attck string")

    done = audit(files, rules, extractors=extractors, analyzers={"python": frame}).validate()
    assert hits(done) == [wget]
    errors = done.errors.collect()
    assert sorted((r["package"], r["step"], r["file_context"], r["rule"]) for r in errors) == [(p, "find_matches", None, "python") for p in "pq"] and "at run time" in errors[0]["message"]


def test_links_are_not_read(spark, tmp_path):
    from surfacescan.sources import read_tree

    (tmp_path / "p/R").mkdir(parents=True)
    (tmp_path / "p/real").mkdir()
    (tmp_path / "p/R/a.R").write_text("system('a')\n")
    (tmp_path / "p/real/b.R").write_text("system('b')\n")
    (tmp_path / "p/R/link.R").symlink_to(tmp_path / "p/R/a.R")
    (tmp_path / "p/tests").symlink_to(tmp_path / "p/real")
    rows = {r["file_context"]: (r["is_symlink"], r["content"] is None) for r in read_tree(spark, str(tmp_path / "p"), "p").collect()}
    assert rows["R/a.R"] == (False, False) and rows["R/link.R"] == (True, True) and rows["real/b.R"] == (False, False)
    assert rows.get("tests/b.R", (True, True)) == (True, True)
    done = audit(read_tree(spark, str(tmp_path / "p"), "p"))
    assert [r["file_context"] for r in done.patterns.collect()] == ["R/a.R"]
    assert ("R/link.R", "unexamined", "symlink") in {(r["file_context"], r["status"], r["reason"]) for r in done.coverage.collect()}


def test_further_types_and_languages(spark):
    from pyspark.sql import functions as F

    from surfacescan.rules import default_rules

    rules = default_rules()
    next(r for r in rules.file_contexts if r["name"] == "exec_other")["type"] = "py"
    files = from_memory(spark, {"p": {"exec/a.py": ["import os", "os.system('x')"]}})

    def find(segments):
        lines = segments.select("package", "version", "file_context", F.posexplode("lines").alias("i", "line"), F.lit("more").alias("extra"))
        hit = lines.where("line LIKE '%os.system%'")
        return hit.selectExpr("package", "version", "'os_system' AS rule", "file_context", "i + 1 AS line_number", "1 AS column_number", "line AS preview", "'runs a command' AS message", "'T1059' AS attck", "extra")

    done = audit(files, rules, extractors={"py": lambda lines, meta: [("python", None, lines, [])]}, analyzers={"python": find}).validate()
    assert [(r["rule"], r["line_number"]) for r in done.matches.collect()] == [("os_system", 2)]
    assert [(r["status"], r["language"]) for r in done.coverage.collect()] == [("parsed", "py")]
