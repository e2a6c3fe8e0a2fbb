"""Sharding by a Feistel permutation of global row numbers, in DataFrame and SQL functions only.

Each row has a global number: rows go to hashed buckets of a fixed count, are ordered inside each by
their hash, and each bucket starts where the buckets before it end. A Feistel network over the domain
0..n-1 (two digits of near-equal bases, walking on while a value lies outside) permutes that number;
the permuted number modulo the shard count is the shard, the quotient the slot. So the shuffle is
reproducible from the key alone, and any row's shard and slot can be computed without a table.

Law: "rows" (shard sizes differ by one at most). Cases: a null or empty text has size 16 and CRC 0; a
null doc_id is a key like any other; repeated rows are told apart by nothing and so take neighbouring
numbers in any order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .permute import digest, digest_duck, permuted, permuted_duck, sides

#: Shards of the query, the permutation's name, and buckets for the numbering (a fixed number, so the
#: table of their sizes, which is broadcast, has that many rows whatever the input).
SHARDS, KEY, BUCKETS = 40, "shuffle-1", 4096


def numbered(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, row_number (gapless from 0), total."""
    rows = docs.selectExpr(
        "CAST(doc_id AS BIGINT) AS doc_id",
        "CAST(octet_length(coalesce(CAST(text AS STRING), '')) + 16 AS BIGINT) AS size",
        "crc32(CAST(coalesce(CAST(text AS STRING), '') AS BINARY)) AS text_crc32",
    ).selectExpr("*", f"{digest('coalesce(CAST(doc_id AS STRING), "-")', 'size', 'text_crc32')} AS rk")
    rows = rows.selectExpr("*", f"rk % {buckets} AS bucket")
    counts = rows.groupBy("bucket").count()
    starts = counts.selectExpr(
        "bucket AS b_bucket",
        "sum(count) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count AS b_start",
        "sum(count) OVER () AS total",
    ).hint("broadcast")
    placed = rows.selectExpr("doc_id", "size", "text_crc32", "bucket", "row_number() OVER (PARTITION BY bucket ORDER BY rk, doc_id, size, text_crc32) AS place")
    return placed.join(starts, placed.bucket == starts.b_bucket).selectExpr("doc_id", "size", "text_crc32", "b_start + place - 1 AS row_number", "total")


def shard_rows(docs: DataFrame, shards: int = SHARDS, key: str = KEY, buckets: int = BUCKETS) -> DataFrame:
    """Every row of docs with its shard and slot: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), row_number."""
    a, b = sides("total")
    rows = numbered(docs, buckets).selectExpr("*", f"{a} AS fa").selectExpr("*", "(total + fa - 1) DIV fa AS fb")
    return rows.selectExpr("*", f"{permuted('row_number', 'total', repr(key), 'fa', 'fb')} AS permuted").selectExpr(
        "doc_id", "size", "text_crc32", "'rows' AS law", f"CAST(permuted % {shards} AS INT) AS shard",
        f"permuted DIV {shards} AS slot", "CAST(NULL AS INT) AS grown_shard", "row_number",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_number")


_CRC_TABLE = "list_transform(range(256), lambda t: list_reduce(list_prepend(CAST(t AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"

ORACLE = f"""
WITH crc_table AS (SELECT {_CRC_TABLE} AS tab),
base AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
        lambda c, h: xor(tab[xor(c % 256, h) + 1], c // 256)), 4294967295) AS text_crc32
  FROM documents, crc_table),
keyed AS (SELECT *, {digest_duck("coalesce(CAST(doc_id AS VARCHAR), '-')", "size", "text_crc32")} AS rk FROM base),
numbered AS (
  SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY rk % {BUCKETS}, rk, doc_id, size, text_crc32) - 1 AS rn, count(*) OVER () AS n FROM keyed)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place % {SHARDS} AS INTEGER) AS shard, CAST(place // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM {permuted_duck("numbered", "doc_id, size, text_crc32, rn, n", "rn", "n", f"'{KEY}'")}
"""
