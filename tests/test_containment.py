"""Descendants and innermost hooks by sweeps, against every pair."""

import time

import numpy as np
from pyspark.sql import functions as F

from surfacescan.operators import patterns

NODES = "package string, version string, file_context string, rule string, seg_ord int, pre int, size int, kind string"


def nodes(spark, n=400, segments=5, nested=True, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(segments):
        for pre in range(n // segments):
            size = int(rng.integers(0, 12)) if not nested else 0
            rows.append(["p", None if s % 2 else "1", f"f{s % 3}", "R_scripts", s, pre, size, rng.choice(["outer", "inner", "both", "none"])])
        if nested:  # sizes of a random tree in pre-order
            mine, stack = rows[-(n // segments) :], []
            for r in mine:
                while stack and rng.random() < 0.4:
                    stack.pop()
                for up in stack:
                    up[6] += 1
                stack.append(r)
    return rows, spark.createDataFrame([tuple(r) for r in rows], NODES)


def test_holding(spark):
    for nested in (True, False):
        rows, df = nodes(spark, nested=nested)
        want = sorted((r[4], r[5]) for r in rows if r[7] in ("outer", "both") and any(i[4] == r[4] and i[7] in ("inner", "both") and r[5] < i[5] <= r[5] + r[6] for i in rows))
        got = patterns._holding(df.where("kind IN ('outer', 'both')"), df.where("kind IN ('inner', 'both')"))
        assert got.columns == df.columns and sorted((r["seg_ord"], r["pre"]) for r in got.collect()) == want and want


def test_innermost_context(spark):
    for nested in (True, False):
        rows, df = nodes(spark, nested=nested, seed=4)
        found = df.where("kind <> 'none'").selectExpr("*", "'x' AS found", "false AS indirect", "pre AS lpre", "1 AS line1", "1 AS col1", "1 AS line2", "pre % 2 = 0 AS in_function")
        hooks = df.where("pre % 7 < 3").withColumn("context", F.explode(F.when(F.col("pre") % 7 == 1, F.array(F.lit("b"), F.lit("a"), F.lit("unused"))).otherwise(F.array(F.lit("c")))))
        use = spark.createDataFrame([("R_scripts", x) for x in "abc"], "file_rule string, name string")
        want = []
        for r in rows:
            if r[7] != "none":
                over = [(-h[5], x) for h in rows if h[4] == r[4] and h[5] % 7 < 3 and h[5] < r[5] <= h[5] + h[6] for x in ("ab" if h[5] % 7 == 1 else "c")]
                want.append((r[4], r[5], min(over)[1] if over else "in_function" if r[5] % 2 == 0 else "top_level"))
        got = patterns.determine_code_contexts(found, hooks, use)
        assert sorted((r["seg_ord"], r["pre"], r["code_context"]) for r in got.collect()) == sorted(want)
        assert {"a", "c"} <= {x[2] for x in want}


def test_a_file_of_many_like_lines_takes_linear_time(spark):
    """A segment of 250,000 lines, as in 10 MB of eval(parse(text = rawToChar(x))): pairs of its lines would be 3e10."""
    lines = spark.range(250_000).selectExpr("'p' AS package", "CAST(NULL AS STRING) AS version", "'R/a.R' AS file_context", "'R_scripts' AS rule", "0 AS seg_ord", "CAST(id AS INT) AS line")
    outer = lines.selectExpr("package", "version", "file_context", "rule", "seg_ord", "line * 16 AS pre", "15 AS size")
    inner = lines.selectExpr("package", "version", "file_context", "rule", "seg_ord", "line * 16 + 9 AS pre", "0 AS size", "line")
    took = time.time()
    assert patterns._holding(patterns._holding(outer, inner), inner.where("line % 2 = 0")).count() == 125_000
    found = inner.selectExpr("*", "'x' AS found", "false AS indirect", "pre AS lpre", "1 AS line1", "1 AS col1", "1 AS line2", "true AS in_function")
    hooks = outer.where("pre % 64 = 0").withColumn("context", F.lit("h"))
    use = spark.createDataFrame([("R_scripts", "h")], "file_rule string, name string")
    assert patterns.determine_code_contexts(found, hooks, use).where("code_context = 'h'").count() == 62_500
    assert time.time() - took < 60
