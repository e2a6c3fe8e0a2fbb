"""Small segments go through the parser many a batch."""

import time

from surfacescan.operators.extract import parse_segments


def test_many_small_segments(spark):
    """A batch a segment took several milliseconds each."""
    ids = spark.range(8_000).coalesce(1)
    segments = ids.selectExpr("'p' AS package", "CAST(NULL AS STRING) AS version", "concat('R/', id, '.R') AS file_context", "'R_scripts' AS rule", "0 AS seg_ord", "'R' AS language", "array(IF(id % 2 = 0, 'f(x)', 'not R at all')) AS lines")
    parse_segments(segments.limit(1)).count()  # workers are up
    took = time.time()
    rows = {r["bad"]: r["n"] for r in parse_segments(segments).selectExpr("message IS NOT NULL AS bad", "file_context").distinct().groupBy("bad").count().withColumnRenamed("count", "n").collect()}
    assert rows == {True: 4_000, False: 4_000} and time.time() - took < 30
