"""Spans of segments: the lines are made and read once."""

from oracle import DATA

from surfacescan.operators.coverage import segment_spans
from surfacescan.queries import queries


def test_lines_are_split_once(spark):
    plan = queries()["segment_spans"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_spans(spark):
    rows = [("a", ["", " x", "", "y", " "]), ("b", ["", " "]), ("c", []), ("d", None), ("e", ["z"])]
    df = spark.createDataFrame([("p", None, f, "python", x) for f, x in rows], "package string, version string, file_context string, language string, lines array<string>")
    got = sorted(tuple(r) for r in segment_spans(df).select("file_context", "first_line", "last_line", "lines").collect())
    assert got == [("a", 2, 4, 2), ("e", 1, 1, 1)]
