"""Syntax rules: one exchange and no join for all rules together, over segments of any number a batch."""

import numpy as np
import pyarrow as pa
import pytest

from surfacescan.operators import patterns, xpath
from surfacescan.operators.extract import parse_segments
from surfacescan.rules import default_rules
from surfacescan.rules.expressions import in_xpath

SEGMENTS = "package string, version string, file_context string, rule string, seg_ord int, language string, lines array<string>"


@pytest.mark.parametrize("rules", [default_rules(), in_xpath(default_rules())], ids=["built in", "in xpath"])
def test_all_rules_share_one_exchange(spark, rules):
    segments = spark.createDataFrame([("p", None, str(i), "R_scripts", 0, "R", ["system('a')"]) for i in range(3)], SEGMENTS)
    nodes = parse_segments(segments).where("pre IS NOT NULL")
    for df in (patterns.find_patterns(nodes, rules), patterns.find_code_contexts(nodes, rules)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 1
        assert plan.count("Scan ExistingRDD") == 1  # the nodes are read once


def test_segments_across_batches():
    """A sweep over batches that cut segments anywhere marks what one over all rows marks."""
    size = [2, 0, 0, 1, 0] * 50
    rows = {"__first": [i % 5 in (0, 3) for i in range(250)], "pre": [0, 1, 2, 0, 1] * 50, "parent": [-1, 0, 0, -1, 0] * 50, "size": size, "ord": [0, 0, 1, 0, 0] * 50}
    fits = np.random.default_rng(1).random(250) < 0.4
    axes = {f"on_{a}": a for a in ("child", "parent", "ancestor", "descendant", "preceding-sibling", "following-sibling")}
    whole = pa.table({**rows, **{a: fits for a in axes}})
    want = xpath._along(whole, axes)
    for n in (1, 2, 7, 64):
        assert pa.Table.from_batches(xpath._sweep(axes)(whole.to_batches(n))).combine_chunks() == want.combine_chunks()
    assert want.column("on_child").to_pylist()[:1] == [bool(fits[1] or fits[2])] and any(want.column("on_child").to_pylist())


@pytest.mark.parametrize("rules", [default_rules(), in_xpath(default_rules())], ids=["built in", "in xpath"])
def test_rules_and_hooks_share_their_passes(spark, rules):
    """Findings and hooks were sought apart, and each pass carried every column of a node."""
    code = [".onLoad <- function(l, p) {", "  system('a')", "  do.call('system', list('b'))", "}", "eval(parse(text = readLines(u)))"]
    segments = spark.createDataFrame([("p", None, str(i), "R_scripts", 0, "R", code[i:]) for i in (0, 4)], SEGMENTS)
    nodes = parse_segments(segments).where("pre IS NOT NULL")
    use = spark.createDataFrame([("R_scripts", "onLoad_base")], "file_rule string, name string")
    together = patterns.find_in_contexts(nodes, rules, use)
    apart = patterns.determine_code_contexts(patterns.find_patterns(nodes, rules).unionByName(patterns.find_indirect(nodes, rules)), patterns.find_code_contexts(nodes, rules), use)
    assert sorted(map(str, together.collect())) == sorted(map(str, apart.collect()))
    assert {(r["found"], r["code_context"], r["indirect"]) for r in together.collect()} >= {("system", "onLoad_base", False), ("system", "onLoad_base", True)}
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    passes = [x for x in plan.splitlines() if "MapInArrow run(" in x and "__first" in x]
    assert 1 <= len(passes) <= 4 and not any("col2" in x or "depth" in x for x in passes)
