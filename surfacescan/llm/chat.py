"""Chat formatting after collapsing cumulative snapshots, in DataFrame functions only.

A logged conversation is often a prefix of a longer one logged later. Each conversation's turns get a
rolling prefix hash: turn k's digest covers k, the role and the text, and the prefix hash is the running
sum of two 59-bit halves of the digests (as decimals, so nothing overflows), which with k names the
prefix. The distinct prefixes of longer conversations are aggregated before they are shuffled, and an
anti-join drops every conversation whose whole hash is among them; of equal conversations the one with
the smallest id stays. What is left is maximal and is rendered.

Cases: turns are ordered by turn (null first), then role and text, so that ties have one order; a null
role renders as "user" and a null text as empty, but each counts as a value of its own in the hashes; a
null conv_id is a conversation like any other; repeated rows are repeated turns; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Template of one turn; {role} and {text} are filled in.
TURN = "<|{role}|>\n{text}<|end|>\n"


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, k (from 1), n (turns of the conversation), role, text, h1, h2 (of the first k turns); one shuffle and one sort."""
    rows = turns.selectExpr("CAST(conv_id AS BIGINT) AS conv_id", "CAST(turn AS BIGINT) AS turn", "CAST(role AS STRING) AS role", "CAST(text AS STRING) AS text")
    order = "PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, role ASC NULLS FIRST, text ASC NULLS FIRST"
    rows = rows.selectExpr("conv_id", "role", "text", f"row_number() OVER ({order}) AS k", "CAST(count(*) OVER (PARTITION BY conv_id) AS INT) AS n")
    body = "coalesce(concat('+', role), '-'), coalesce(concat('+', text), '-')"
    rows = rows.selectExpr("*", f"sha2(concat_ws('|', CAST(k AS STRING), {body}), 256) AS d")
    half = lambda at: f"CAST(conv(substring(d, {at}, 15), 16, 10) AS DECIMAL(28, 0))"
    running = "OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return rows.selectExpr("conv_id", "k", "n", "role", "text", f"sum({half(1)}) {running} AS h1", f"sum({half(16)}) {running} AS h2")


def maximal(rows: DataFrame) -> DataFrame:
    """Of the rows of prefixes(): conv_id and n_turns of the conversations that are no proper prefix of another and no later copy."""
    wholes = rows.where("k = n").groupBy("k", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNotNull(), "conv_id"))["conv_id"].alias("conv_id"))
    inner = rows.where("k < n").select("k", "h1", "h2").distinct()
    return wholes.join(inner, ["k", "h1", "h2"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"))


def render(turns: DataFrame, template: str = TURN) -> DataFrame:
    """Each conversation of `turns` (conv_id, k, role, text) in the template: conv_id, n_turns, rendered."""
    before, _, rest = template.partition("{role}")
    between, _, after = rest.partition("{text}")
    rows = turns.select("conv_id", "k", F.concat(F.lit(before), F.coalesce("role", F.lit("user")), F.lit(between), F.coalesce("text", F.lit("")), F.lit(after)).alias("piece"))
    listed = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("k", "piece"))).alias("pieces"))
    return listed.select("conv_id", "n_turns", F.array_join(F.col("pieces.piece"), "").alias("rendered"))


def collapsed(turns: DataFrame, template: str = TURN) -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, rendered. The prefixes are written once: the anti-join and the rendering read them."""
    rows = materialise(prefixes(turns), "prefixes")
    kept = maximal(rows).select(F.col("conv_id").alias("m_conv"))
    return render(rows.join(kept, rows.conv_id.eqNullSafe(kept.m_conv), "left_semi").select("conv_id", "k", "role", "text"), template)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collapsed(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return rows.select("conv_id", "n_turns", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


ORACLE = """
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, role ASC NULLS FIRST, text ASC NULLS FIRST) AS k FROM conversations),
bodies AS (SELECT *, sha256(concat_ws('|', k, coalesce('+' || role, '-'), coalesce('+' || text, '-'))) AS d FROM turns),
prefixes AS (SELECT conv_id, k, string_agg(d, ' ') OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, max(k) OVER (PARTITION BY conv_id) AS n FROM bodies),
kept AS (SELECT min(conv_id) AS conv_id, n FROM prefixes WHERE k = n AND p NOT IN (SELECT p FROM prefixes WHERE k < n) GROUP BY p, n),
shown AS (
  SELECT t.conv_id, any_value(m.n) AS n_turns, string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY k) AS rendered
  FROM turns t JOIN kept m USING (conv_id) GROUP BY t.conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, CAST(length(rendered) AS BIGINT) AS n_chars, sha256(rendered) AS rendered_sha256 FROM shown
"""
