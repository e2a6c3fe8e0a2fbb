from dataclasses import replace

import pytest

from surfacescan.functions.regex import RegexError, to_java
from surfacescan.plans import audit
from surfacescan.rules import default_rules, load, read_rule, save, validate_rules, with_rules
from surfacescan.rules.base import java_regex_problem
from surfacescan.schemas import PHASES
from surfacescan.sources import from_memory


def test_counts_and_version():
    base = default_rules()
    assert [len(getattr(base, t)) for t in ("file_contexts", "code_contexts", "patterns", "matches", "phases")] == [45, 10, 23, 11, 55]
    assert base.version == "0.4.0"
    assert base.owners()["system"] == "system" and base.owners()["curl"] == "curl"


def test_round_trip_and_tampering(tmp_path):
    at = tmp_path / "rules.json"
    digest = save(default_rules(), at)
    assert load(at).provenance["rules_sha256"] == digest == default_rules().provenance["rules_sha256"]
    at.write_text(at.read_text() + " ")
    with pytest.raises(ValueError):
        load(at)
    (tmp_path / "rules.json.sha256").write_text("")
    with pytest.raises(ValueError):
        load(at)
    (tmp_path / "rules.json.sha256").unlink()
    with pytest.raises(FileNotFoundError):
        load(at)


@pytest.mark.parametrize(
    "table,change",
    [
        ("patterns", {"name": "1bad"}),
        ("patterns", {"message": " "}),
        ("patterns", {"attck": ""}),
        ("patterns", {"version": "9.9"}),
        ("patterns", {"positive_examples": []}),
        ("file_contexts", {"path": "../x"}),
        ("file_contexts", {"type": "perl"}),
        ("file_contexts", {"filename": "("}),
        ("file_contexts", {"filename": ".*"}),
        ("file_contexts", {"code_context": ["nobody"], "assume_called": True}),
        ("file_contexts", {"assume_called": None}),
        ("code_contexts", {"kind": "segment"}),
        ("matches", {"regex": "a*"}),
        ("phases", {"at_load": None}),
    ],
)
def test_broken_rules_are_refused(table, change):
    base = default_rules()
    getattr(base, table)[0].update(change)
    with pytest.raises(ValueError):
        validate_rules(base)


def test_unexpected_fields_only_warn():
    base = default_rules()
    base.patterns[0]["colour"] = "red"
    assert validate_rules(base) == [f"patterns {base.patterns[0]['name']}: unexpected field colour"]


def test_missing_phases():
    base = default_rules()
    base.phases = base.phases[1:]
    with pytest.raises(ValueError, match="no phases"):
        validate_rules(base)


def test_regex_problems():
    assert java_regex_problem("x|") and java_regex_problem("[") and java_regex_problem("abc") is None


FILE = """name: cellar
version: "0.4.0"
type: shell
message: >-
  A script in the
  cellar.
path: inst/cellar
recursive: FALSE
report: TRUE
code_context: ~
assume_called: ~
filename: '^run$'
positive_examples:
  - inst/cellar/run
negative_examples:
  - inst/cellar/run.R
""" + "".join(f"{p}: {'TRUE' if p == 'at_load' else 'FALSE'}\n" for p in PHASES)
LINE = """name: kettle
version: "0.4.0"
language: shell
message: it's a \\kettle
attck: [T1059, T1105]
regex: 'boil\\s+\\d+'
positive_examples: ["x; boil 3"]
negative_examples: ["boil x"]
"""
CALL = """name: stew
version: "0.4.0"
language: R
message: stews
attck: [T1059]
functions: [simmer]
positive_examples: ["simmer(1)"]
negative_examples: ["x$simmer(1)"]
"""

HOOK = """name: hooked
version: "0.4.0"
language: R
message: runs when hooked
kind: xpath
xpath: "//expr[LEFT_ASSIGN and expr[1]/SYMBOL[text() = 'hook'] and expr[FUNCTION]]"
positive_examples: ["hook <- function() 1"]
negative_examples: ["hook <- 1"]
""" + "".join(f"{p}: {'TRUE' if p == 'at_load' else 'FALSE'}\n" for p in PHASES)
SOUGHT = CALL.replace("stew", "broth").replace("functions: [simmer]", "functions: []\nxpath: \"//expr[expr/SYMBOL_FUNCTION_CALL[text() = 'simmer'] and .//STR_CONST[contains(text(), 'bone')]]\"").replace("simmer(1)", "simmer('bone')")
POSIX = LINE.replace("kettle", "samovar").replace("'boil\\s+\\d+'", "'(?<=^|[^[:alnum:]_-])steep[[:space:]]+[]0-9&&[]+(?=[^[:alnum:]./-]|$)'").replace("boil 3", "steep 3").replace("boil x", "steep x")


def test_written_xpath_and_posix_rules(spark, tmp_path):
    pytest.importorskip("yaml")
    for name, text in (("a", HOOK), ("b", SOUGHT), ("c", POSIX), ("d", FILE.replace("type: shell", "type: R").replace("code_context: ~", "code_context: [hooked]").replace("assume_called: ~", "assume_called: FALSE"))):
        (tmp_path / f"{name}.yaml").write_text(text)
    base = with_rules(default_rules(), tmp_path)
    files = {"inst/cellar/run": ["hook <- function() {", "  simmer(f('a bone'))", "  simmer('x')", "}"], "configure": ["steep 12", "xsteep 1", "steep ]&[ steep 1.x"]}
    got = audit(from_memory(spark, {"p": files}), base, persist=False)
    assert [(r["rule"], r["line_number"], r["code_context"], r["at_load"]) for r in got.patterns.collect()] == [("broth", 2, "hooked", True)]
    assert sorted((r["rule"], r["line_number"], r["column_number"]) for r in got.matches.collect()) == [("samovar", 1, 1), ("samovar", 3, 1)]
    save(base, tmp_path / "all.json")
    assert load(tmp_path / "all.json").code_contexts[-1]["how"] == "xpath"
    broken = replace(base, patterns=[*base.patterns, base.patterns[-1] | {"name": "torn", "xpath": "//a["}])
    errors = audit(from_memory(spark, {"p": files}), broken, persist=False).errors.collect()
    assert [(r["step"], r["rule"]) for r in errors] == [("find_patterns", "torn")] and "XPath" in errors[0]["message"]


def test_dialects(spark):
    """What the translator writes is taken by the engine, and finds what the expression says."""
    cases = [
        ("[[:alpha:]_-]+", "é1 a_b-", "a_b-"), ("[^[:space:][:digit:]]+", " 1ab2", "ab"), ("[][]+", "a[]b", "[]"), ("[a&&b]+", "x&&y", "&&"), ("[[:^alnum:]]", "a.", "."), (r"\Qa.b\E+", "xa.bbb", "a.bbb"), ("a.c", "a\u0085c", "a\u0085c"),
        ("(?P<q>['\"])x(?P=q)", "'x\" \"x\"", '"x"'), ("a(?#note)b", "ab", "ab"), ("(?i)AB", "xab", "ab"), ("a{2,}?", "aaa", "aa"), ("[[:word:]]+$", "a b_1", "b_1"), (r"[\]x]+", "a]x", "]x"), ("(?<=a|bc)d", "bcd", "d"), ("x+?y", "xxy", "xxy"),
    ]
    rows = spark.createDataFrame([(t, to_java(rx), w) for rx, t, w in cases], "t string, rx string, w string")
    assert [(r["rx"], r["got"]) for r in rows.selectExpr("rx", "w", "regexp_extract(t, rx, 0) AS got").collect() if r["got"] != r["w"]] == []
    for rx, what in (("a++", "possessive"), ("(a)(?1)", "recursion"), ("(?(1)a|b)", "condition"), ("a(*SKIP)b", "verb"), (r"a\Kb", "K"), ("[[.a.]]", "collating"), ("[[:wrong:]]", "wrong"), ("[ab", "not closed"), (r"(a)\g1", "g")):
        with pytest.raises(RegexError, match=what):
            to_java(rx)


def test_written_rules(spark, tmp_path):
    pytest.importorskip("yaml")
    for name, text in (("a", FILE), ("b", LINE), ("c", CALL)):
        (tmp_path / f"{name}.yaml").write_text(text)
    base = with_rules(default_rules(), tmp_path)
    assert [len(getattr(base, t)) for t in ("file_contexts", "patterns", "matches", "phases")] == [46, 24, 12, 56] and len(default_rules().matches) == 11
    got = audit(from_memory(spark, {"p": {"inst/cellar/run": ["boil 12", "boil over"], "R/a.R": ["simmer(x)"]}}), base, persist=False)
    assert [(r["rule"], r["file_context"], r["message"], r["at_load"], r["at_build"]) for r in got.file_contexts.collect()] == [("cellar", "inst/cellar/run", "A script in the cellar.", True, False)]
    assert [(r["rule"], r["line_number"], r["message"], r["attck"], r["at_load"]) for r in got.matches.collect()] == [("kettle", 1, "it's a \\kettle", "T1059 T1105", True)]
    assert [(r["rule"], r["file_context"]) for r in got.patterns.collect()] == [("stew", "R/a.R")]
    save(base, tmp_path / "all.json")
    assert load(tmp_path / "all.json").matches[-1]["name"] == "kettle"


@pytest.mark.parametrize(
    "text, why",
    [
        ("[]", "no fields"), ("name: a", "one of filename"), (CALL + "xpath: //x[", "XPath"), (HOOK.replace("kind: xpath", "kind: segment"), "must be xpath"), (HOOK.replace("//expr", "expr"), "begins with"), (LINE.replace("boil\\s+", "boil\\s++"), "possessive"), (LINE.replace("boil\\s+", "boil(?R)?"), "recursion"), (LINE.replace("boil\\s+", "boil[[:odd:]]"), "class"), (CALL + "note: x", "unexpected note"), (CALL.replace("message: stews\n", ""), "missing message"),
        (CALL.replace("language: R", "language: C"), "R alone"), (CALL.replace("[simmer]", "simmer"), "functions must be a list"), (LINE.replace("boil x", "boil 4"), "example boil 4"),
        (LINE.replace("boil\\s", "(boil"), "compile"), (FILE.replace("report: TRUE", "report: 1"), "report must be"), (FILE.replace("inst/cellar/run\nneg", "cellar/run\nneg"), "example cellar/run"), (FILE.replace("type: shell", "type: [x]"), "type must be text"),
    ],
)
def test_written_rules_that_are_wrong(tmp_path, text, why):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text(text)
    with pytest.raises(ValueError, match=why):
        read_rule(tmp_path / "r.yaml")
    (tmp_path / "ok.yaml").write_text(CALL.replace("stew", "system"))
    with pytest.raises(ValueError, match="twice"):
        with_rules(default_rules(), tmp_path / "ok.yaml")
