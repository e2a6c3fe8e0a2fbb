"""Mixing sources to target weights, block by block.

Words of a source stand end to end in the order of its documents' hashes and are cut into blocks of a
fixed length. Sources' targets come from weights, shared over a budget and capped at a number of
epochs, the excess reshared; target over the mean block gives a source's demand in blocks. The mix has
as many slots as all demands ask for, dealt to output shards of SHARD_BLOCKS slots. Each shard draws its
source counts: the whole part of slots times share is given, and the slots left, fewer than there are
sources, are a seeded multinomial draw over the fractional parts (residual multinomial sampling). So a
count's mean is exactly slots times share and its variance is that of the residual draw, which keeps
small sources near their target. The slots of a source are numbered through its shards; a per-source
pseudorandom permutation maps them to block indices, going once through all blocks before any repeats
(slots past the epochs' last block stay empty), and slots and blocks join by index.

The numbering is two-level: hashed ranges inside a source, as many as its rows ask for, are summed
first, so a source with a third of all rows is still numbered in parallel. Sources are aggregated
before any global order; only their list (one row a source) meets in one task.

Cases: a null or empty text, or one of white space, has size 0 and gives nothing; a null source is a
source of its own, last in order; a null doc_id is a document like any other; repeated rows are
separate documents in any order; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, fresh, mapped, materialise, width
from .permute import digest, digest_duck, permuted, permuted_duck, sides

#: Weights dealt to the sources in order, repeating; the mix's size against all words; most uses of a
#: word; words in a block; slots in an output shard; rows of a hashed range inside a source; units that a
#: demand is rounded to a slot; slots permuted in a task.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
BLOCK, SHARD_BLOCKS, RANGE_ROWS, UNITS, TASK_SLOTS = 64, 16384, 500, 64, 200_000
KEY = "mix-1"

#: Words of a text, as Spark SQL: runs of anything but ASCII white space.
WORDS = "CAST(regexp_count(coalesce(CAST(text AS STRING), ''), '[^ \\\\t-\\\\r]+') AS BIGINT)"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash that orders documents, written once so that later passes read no text."""
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(source AS STRING) AS source", f"{WORDS} AS size")
    return materialise(rows.selectExpr("*", f"{digest(repr(KEY), "coalesce(CAST(doc_id AS STRING), '-')", 'size')} AS rk"), "mix-sizes")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Of each source: source_size and target, by weighted filling up to the caps.

    Ordered by cap over weight, a source is capped if it fills up before the level that it and those
    after it reach by sharing what the ones before leave; these levels rise until the first source that
    is not capped and fall from there, so the largest level among such sources is the level of all.
    """
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    dealt = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    ranked = ranked.selectExpr("source", "source_size", "n_docs", f"CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} {dealt} END AS weight")
    for step in _filling(share, epochs):
        ranked = ranked.selectExpr(*step, "n_docs")
    return ranked


def _filling(share: float, epochs: int) -> tuple[list[str], list[str], list[str]]:
    """Three projections that hold in Spark and DuckDB alike: sums of whole numbers, so that both round alike."""
    order = "ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST"
    before = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    one = ["source", "source_size", "weight", f"sum(source_size) {before} - source_size AS capped", f"sum(weight) OVER () - sum(weight) {before} + weight AS weights_left", "sum(source_size) OVER () AS total"]
    level = f"(CAST(total AS DOUBLE) * {share:.17g} - CAST(capped AS DOUBLE) * {epochs}) / weights_left"
    two = ["source", "source_size", "weight", f"CASE WHEN CAST(source_size AS DOUBLE) * {epochs} <= weight * ({level}) THEN NULL ELSE {level} END AS level"]
    three = ["source", "CAST(source_size AS BIGINT) AS source_size", f"CASE WHEN level IS NULL THEN CAST(source_size AS DOUBLE) * {epochs} ELSE weight * max(level) OVER () END AS target"]
    return one, two, three


def _demand(epochs: int) -> str:
    """A source's slots in UNITS, in Spark and DuckDB alike."""
    return f"CAST(round((CASE WHEN target >= CAST(source_size AS DOUBLE) * {epochs} THEN CAST(blocks * {epochs} AS DOUBLE) ELSE target * blocks / source_size END) * {UNITS}) AS BIGINT)"


class Plan(NamedTuple):
    """table: a row a source (sid, source, source_size, target, blocks, q, fa, fb); units: all demands; slots of the mix; rows of the largest source."""

    table: DataFrame
    units: int
    slots: int
    rows: int
    epochs: int
    block: int


def plan(sizes: DataFrame, block: int = BLOCK, epochs: int = EPOCHS, **mix) -> Plan:
    """Targets and demands, written once."""
    rows = (
        targets(sizes, epochs=epochs, **mix)
        .selectExpr("*", "CAST(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS INT) AS sid", f"(source_size + {block - 1}) DIV {block} AS blocks")
        .selectExpr("*", f"{_demand(epochs)} AS q", f"{sides('greatest(blocks, 1)')[0]} AS fa")
        .selectExpr("*", "(greatest(blocks, 1) + fa - 1) DIV fa AS fb")
    )
    table = materialise(rows, "mix-plan")
    units, most = table.agg(F.sum("q"), F.max("n_docs")).first()
    return Plan(table, units or 0, ((units or 0) + UNITS // 2) // UNITS, most or 0, epochs, block)


def placed(sizes: DataFrame, known: Plan) -> DataFrame:
    """sizes with sid and `start`, the words of the source before the document."""
    bits = max(4, (known.rows // RANGE_ROWS).bit_length())
    named = known.table.select("sid", F.col("source").alias("p_source"))
    rows = sizes.join(named, sizes.source.eqNullSafe(named.p_source)).selectExpr("doc_id", "source", "sid", "size", "rk", f"CAST(shiftright(rk, {60 - bits}) AS INT) AS bucket")
    ahead = rows.groupBy("sid", "bucket").agg({"size": "sum"}).selectExpr(
        "sid AS a_sid", "bucket AS a_bucket",
        "sum(`sum(size)`) OVER (PARTITION BY sid ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - `sum(size)` AS ahead",
    )
    inside = rows.selectExpr("*", "sum(size) OVER (PARTITION BY sid, bucket ORDER BY rk, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS within")
    return inside.join(ahead, (inside.sid == ahead.a_sid) & (inside.bucket == ahead.a_bucket)).selectExpr("doc_id", "source", "sid", "size", "ahead + within AS start")


def blocks(numbered: DataFrame, block: int = BLOCK) -> DataFrame:
    """Where documents lie in their source's blocks: sid, start, idx, first (word of the document), words; and doc_id and source."""
    rows = numbered.where("size > 0").selectExpr("*", f"explode(sequence(start DIV {block}, (start + size - 1) DIV {block})) AS idx")
    return rows.selectExpr(
        "doc_id", "source", "sid", "start", "idx", f"greatest(idx * {block} - start, 0) AS first",
        f"least((idx + 1) * {block}, start + size) - greatest(idx * {block}, start) AS words",
    )


def draws(known: Plan, shard_blocks: int = SHARD_BLOCKS, key: str = KEY) -> DataFrame:
    """shard, sid, n: how many slots of each source each output shard drew. No row for none.

    Whole numbers throughout: of `slots` slots a source with q of `units` gets slots * q DIV units, and its
    remainder is its width on the line that the shard's draws fall on.
    """
    w = max(1, known.units)
    shards = -(-known.slots // shard_blocks)
    kinds = [(shard_blocks, 0, shards - 2), (known.slots - (shards - 1) * shard_blocks, shards - 1, shards - 1)]  # all shards but the last, and the last
    structs = ", ".join(f"named_struct('slots', {n}L, 'a', {a}L, 'b', {b}L)" for n, a, b in kinds if 0 <= a <= b) or "named_struct('slots', 0L, 'a', 0L, 'b', 0L)"
    line = known.table.selectExpr("sid", "q", f"explode(array({structs})) AS v").selectExpr("sid", "v.a AS a", "v.b AS b", f"v.slots * q DIV {w} AS given", f"v.slots * q % {w} AS rest")
    line = line.selectExpr("*", "sum(rest) OVER (PARTITION BY a ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - rest AS at", f"sum(rest) OVER (PARTITION BY a) DIV {w} AS left")
    line = line.selectExpr("*", "explode(sequence(a, b)) AS shard")
    drawn = line.where("sid = 0 AND left > 0").selectExpr("shard", "left", "explode(sequence(1L, left)) AS nth")
    drawn = drawn.selectExpr("shard", f"{digest(repr(key + '-draw'), 'shard', 'nth')} % (left * {w}) AS at", "1 AS draw", "0L AS rest", "CAST(NULL AS INT) AS sid", "0L AS given")
    both = line.selectExpr("shard", "at", "0 AS draw", "rest", "sid", "given").unionByName(drawn)
    hit = both.selectExpr("shard", "draw", "given", "last_value(sid, true) OVER (PARTITION BY shard ORDER BY at, draw, rest, sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid")
    return hit.groupBy("shard", "sid").agg(F.sum(F.expr("given + draw")).alias("n")).where("n > 0")


def slots(known: Plan, shard_blocks: int = SHARD_BLOCKS, key: str = KEY) -> DataFrame:
    """The mix: sid, slot (gapless from 0 in each source), its shard, epoch and block index."""
    of = known.table.selectExpr("sid AS k_sid", "source", "blocks", "fa", "fb")
    rows = draws(known, shard_blocks, key)
    rows = rows.selectExpr("*", "sum(n) OVER (PARTITION BY sid ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS first")
    rows = rows.join(of, rows.sid == of.k_sid).selectExpr("*", f"least(first + n, blocks * {known.epochs}) - 1 AS last").where("last >= first")
    rows = rows.repartition(max(width(known.table.sparkSession), -(-known.slots // TASK_SLOTS)), "sid", "shard")
    rows = rows.selectExpr("sid", "shard", "source", "blocks", "fa", "fb", "explode(sequence(first, last)) AS slot").selectExpr("*", "slot % blocks AS at", "slot DIV blocks AS epoch")
    return rows.selectExpr("sid", "shard", "slot", "epoch", f"{permuted('at', 'blocks', f"concat('{key}-', coalesce(source, '-'))", 'fa', 'fb')} AS block_idx")


def _used(laid: DataFrame, drawn: DataFrame) -> DataFrame:
    """Slots and blocks joined by index."""
    s = drawn.withColumnRenamed("sid", "s_sid").hint("merge")  # its rows come of an explode, which size estimates miss: never to be broadcast
    return laid.join(s, (laid.sid == s.s_sid) & (laid.idx == s.block_idx)).drop("s_sid")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixture, piece by piece: source, slot, shard, doc_id, first (word of the document), words."""
    sizes = sized(docs)
    known = plan(sizes, **how)
    return _used(blocks(placed(sizes, known), known.block), slots(known)).select("source", "slot", "shard", "doc_id", "first", "words")


def taken(docs: DataFrame, **how) -> DataFrame:
    """One row a document: doc_id, size, source_size, target (of its source), taken (words the mix takes of it), first_shard (the first output shard that takes any; null: none)."""
    sizes = sized(docs)
    known = plan(sizes, **how)
    numbered = placed(sizes, known)
    used = _used(blocks(numbered, known.block), slots(known)).groupBy("sid", "start").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"))
    used = used.withColumnsRenamed({"sid": "u_sid", "start": "u_start"}).hint("merge")
    tagged = known.table.selectExpr("sid AS t_sid", "source_size", "target")
    rows = numbered.join(tagged, numbered.sid == tagged.t_sid)
    rows = rows.join(used, (rows.sid == used.u_sid) & (rows.start == used.u_start) & (rows.size > 0), "left")
    return rows.selectExpr("doc_id", "size", "source_size", "target", "coalesce(taken, 0) AS taken", "first_shard")


# ---------------------------------------------------------------- the mixture as documents

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, size: int, parts: list[tuple[int, int]]) -> str:
    """The words of `parts` (first, count; ascending), each run of neighbouring words as it stands in the text, runs by line; all words: the text itself."""
    spans: list[list[int]] = []
    for first, count in parts:
        if spans and spans[-1][1] == first:
            spans[-1][1] = first + count
        else:
            spans.append([first, first + count])
    if spans == [[0, size]]:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in spans)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mixture as rows of docs, columns as they are: for each document and epoch that takes words of it, a row whose text is those words (and n_chars its length)."""
    sizes = sized(docs)
    known = plan(sizes, **how)
    numbered = placed(sizes, known)
    used = _used(blocks(numbered, known.block), slots(known))
    used = used.groupBy("sid", "start", "epoch").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts")).selectExpr("sid AS u_sid", "start AS u_start", "parts")
    tagged = numbered.where("size > 0").selectExpr("doc_id AS m_doc", "source AS m_source", "size AS m_size", "sid", "start", "row_number() OVER (PARTITION BY doc_id, source, size ORDER BY start) AS m_nth")
    tagged = tagged.join(used.hint("merge"), (tagged.sid == used.u_sid) & (tagged.start == used.u_start)).select("m_doc", "m_source", "m_size", "m_nth", "parts")
    names = docs.columns
    doc, source, size, nth, firsts, counts = fresh(names, "doc", "source", "size", "nth", "firsts", "counts")
    rows = docs.select("*", F.expr("CAST(doc_id AS BIGINT)").alias(doc), F.expr("CAST(source AS STRING)").alias(source), F.expr(WORDS).alias(size))
    rows = rows.withColumn(nth, F.expr(f"row_number() OVER (PARTITION BY {doc}, {source}, {size} ORDER BY xxhash64(text))"))
    rows = rows.join(tagged.hint("merge"), rows[doc].eqNullSafe(tagged.m_doc) & rows[source].eqNullSafe(tagged.m_source) & (rows[size] == tagged.m_size) & (rows[nth] == tagged.m_nth))
    rows = rows.select(*(rows[f"`{c}`"] for c in names), rows[size], F.col("parts.first").alias(firsts), F.col("parts.words").alias(counts))
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            columns = list(b.columns[: len(names)])
            parts = zip(*(c.to_pylist() for c in (b.column(at), *b.columns[len(names) :])), strict=True)
            after = [cut(x, n, list(zip(first, words, strict=True))) for x, n, first, words in parts]
            columns[at] = pa.array(after, b.schema.field(at).type)
            if count is not None:
                columns[count] = pa.array([len(x) for x in after], b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped(rows, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _words_duck() -> str:
    return "CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT)"


def _oracle() -> str:
    one, two, three = _filling(SHARE, EPOCHS)
    dealt = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    doc = "coalesce(CAST(doc_id AS VARCHAR), '-')"
    return f"""
WITH sizes AS (SELECT doc_id, source, size, {digest_duck(f"'{KEY}'", doc, 'size')} AS rk FROM (SELECT doc_id, source, {_words_duck()} AS size FROM documents)),
summed AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)} {dealt} END AS weight FROM summed),
f1 AS (SELECT {', '.join(one)} FROM ranked), f2 AS (SELECT {', '.join(two)} FROM f1), f3 AS (SELECT {', '.join(three)} FROM f2),
known AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid, {_demand(EPOCHS)} AS q FROM (SELECT *, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM f3)),
whole AS (SELECT w, m, (m + {SHARD_BLOCKS - 1}) // {SHARD_BLOCKS} AS shards FROM (SELECT CAST(sum(q) AS BIGINT) AS w, (CAST(sum(q) AS BIGINT) + {UNITS // 2}) // {UNITS} AS m FROM known)),
kinds AS (SELECT {SHARD_BLOCKS} AS n, 0 AS a, shards - 2 AS b, w FROM whole WHERE shards > 1 UNION ALL SELECT m - (shards - 1) * {SHARD_BLOCKS}, shards - 1, shards - 1, w FROM whole WHERE shards > 0),
line AS (SELECT sid, a, b, w, n * q // w AS given, n * q % w AS rest FROM known, kinds),
ends AS (SELECT *, CAST(sum(rest) OVER (PARTITION BY a ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - rest AS pos, CAST(sum(rest) OVER (PARTITION BY a) AS BIGINT) // w AS spare FROM line),
bounds AS (SELECT *, unnest(range(a, b + 1)) AS shard FROM ends),
falls AS (SELECT shard, {digest_duck(f"'{KEY}-draw'", 'shard', 'nth')} % (spare * w) AS pos FROM (SELECT shard, spare, w, unnest(range(1, spare + 1)) AS nth FROM bounds WHERE sid = 0)),
both_ AS (SELECT shard, pos, 0 AS draw, rest, sid, given FROM bounds UNION ALL SELECT shard, pos, 1, 0, NULL, 0 FROM falls),
hit AS (SELECT shard, given + draw AS n, last_value(sid IGNORE NULLS) OVER (PARTITION BY shard ORDER BY pos, draw, rest, sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM both_),
counts AS (SELECT shard, sid, CAST(sum(n) AS BIGINT) AS n FROM hit GROUP BY ALL HAVING sum(n) > 0),
spans AS (SELECT *, CAST(sum(n) OVER (PARTITION BY sid ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - n AS first FROM counts),
heads AS (SELECT source, shard, slot, slot % blocks AS idx, blocks, concat('{KEY}-', coalesce(source, '-')) AS name
  FROM (SELECT k.source, k.blocks, s.shard, unnest(range(first, least(first + n, k.blocks * {EPOCHS}))) AS slot FROM spans s JOIN known k USING (sid))),
placed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY rk, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start FROM sizes),
laid AS (
  SELECT source, start, idx, least((idx + 1) * {BLOCK}, start + size) - greatest(idx * {BLOCK}, start) AS words
  FROM (SELECT *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS idx FROM placed WHERE size > 0)),
drawn AS (SELECT source, shard, place FROM {permuted_duck("heads", "source, shard, slot, idx, blocks, name", "idx", "blocks", "name")}),
used AS (SELECT l.source, l.start, CAST(sum(words) AS BIGINT) AS taken, min(shard) AS first_shard FROM laid l JOIN drawn d ON l.source IS NOT DISTINCT FROM d.source AND l.idx = d.place GROUP BY ALL)
SELECT s.doc_id, s.size, k.source_size, k.target, coalesce(u.taken, 0) AS taken, u.first_shard
FROM placed s JOIN known k ON s.source IS NOT DISTINCT FROM k.source
LEFT JOIN used u ON s.source IS NOT DISTINCT FROM u.source AND s.start = u.start AND s.size > 0
"""


ORACLE = _oracle()
