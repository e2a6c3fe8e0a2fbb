"""Exact Jaccard join of n-gram sets with a prefix tree.

A document's set is its distinct word 4-grams as 64-bit hashes, globally ordered by hash value. Two
sets link when 100 * |x and y| >= THRESHOLD * |x or y|.

1. Equal sets are folded first: their documents share one representative, the smallest doc_id.
2. Of each representative the first elements in the global order are kept, enough that any two
   linked sets share at least a set number of them (`need`): with t the threshold, linked sets overlap
   in t * size elements of either at least, so prefixes of (1 - t) * size + need elements share need.
3. Elements that occur in one prefix only cannot be shared. Of the rest, a document with fewer than
   need is done with; the others are ordered rarest first, and all but need - 1 of them route: linked
   documents share a routed element. Rare ones first keeps the passages that many documents share out.
4. Documents that share a routed element are candidates of one another; components of these make
   groups. A large group falls into bands of set size, of which linked sets are at most one apart, and
   a band into small blocks, of which one is the hub: each task joins the hub and
   one further block, so tasks and shuffled rows grow in proportion to the group. Near copies of one
   text nearly all hang together then. Sets outside their band's largest class so far are lastly joined
   with all of the band, again in blocks; sets that already hang together are not compared again.
5. In a task, a prefix tree over its sets (frequent elements first, so that branches are shared) is
   walked once for all of them: each node adds its element's indicator to the running overlaps; subtrees
   in which no set can still reach its threshold, given the elements left on both sides, are cut, and so
   are sets that already hang together. What links is kept as a spanning forest; components of all
   forests give each document's class.

Nothing is capped: large groups take more tasks. A group of unlike documents of
like size that share a passage which makes up much of each is still compared in all pairs of blocks, which
grows with the square of such a group. Copies of one set are never expanded. Elements of one
document are exploded once, in a prefix's length. Cases: a null or empty text, or one of white space,
has an empty set and links with nothing; with fewer words than N the whole sequence is one element;
a null doc_id is in no component (null) but counts as a document; rows that repeat a doc_id are one
document per row with one component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, fresh, mapped, materialise, mix, texts, width, word_hashes
from .graph import components

#: Words of an element; percent of the union that must be shared.
N, THRESHOLD = 4, 85
#: Percent of a set's size by which prefixes are longer than they must be for one shared element.
SLACK = 10
#: Elements of a candidate group that one task takes whole; in a block of a larger one: of the hub and those joined with it, and of the sets left over then (this bounds a task's memory).
TASK_ELEMENTS, HUB_ELEMENTS, BLOCK_ELEMENTS = 30_000, 10_000, 100_000
#: Bitmaps (32,768 bits, 4 KB each) that mark the candidates' hashed ids: 4 MB are broadcast at most, however many candidates there are.
MARKS = 1024


def ngram_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's sorted distinct n-gram hashes."""
    words, bounds = word_hashes(column)
    grams = np.empty(0, dtype=np.uint64)
    if len(words) >= n:
        rolled = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            rolled *= np.uint64(0xD6E8FEB86659FD93)
            rolled += words[k : len(words) - n + 1 + k]
        grams = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:  # the whole sequence, apart from any n-gram
            whole = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                whole = mix(whole * np.uint64(0xA24BAED4963EE407) + words[k : k + 1])
            out.append(whole)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _need(size: int, threshold: int, slack: int) -> tuple[int, int]:
    """(prefix length, elements that a linked pair must share in its prefixes, as far as this set can tell).

    A pair's own need is that of its smaller set; a partner has threshold percent of this size at least.
    """
    share = lambda s: s * slack // 100 + 1
    least = -(-size * threshold // 100)
    return min(size, size - least + share(size)), share(least)


# ---------------------------------------------------------------- the tree join of one block pair


def _common(x: np.ndarray, y: np.ndarray) -> int:
    m = min(len(x), len(y))
    differ = np.flatnonzero(x[:m] != y[:m])
    return int(differ[0]) if len(differ) else m


def tree_join(sets: list[np.ndarray], left: int, threshold: int = THRESHOLD, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets (sorted, distinct) before `left` and those from it on; with left = 0, among all. known: a label each; sets of one label already hang together.

    The tree's inner nodes are the branchings of the sorted sets. Equal in its components to checking
    every such pair: only pairs whose ends already hang together are passed over.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not sizes.sum():
        return []
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    count = np.bincount(flat)
    shared = int((count > 1).sum())  # the others never overlap: they count in the sizes only
    rank = np.empty(len(names), dtype=np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(names))
    ordered = [np.sort(r[r < shared]) for r in np.split(rank[flat], np.cumsum(sizes)[:-1])]
    lens = np.array([len(x) for x in ordered], dtype=np.int64)
    probes = np.arange(left, n)
    psize, plen = sizes[probes], lens[probes]
    held = np.concatenate([ordered[p] for p in probes])
    by = np.argsort(held, kind="stable")
    holder, bounds = np.repeat(np.arange(len(probes)), plen)[by], np.searchsorted(held[by], np.arange(shared + 1))

    def overlaps(items: np.ndarray) -> np.ndarray:
        """How many of the items each probe holds."""
        if not len(items):
            return np.zeros(len(probes), dtype=np.int64)
        return np.bincount(np.concatenate([holder[bounds[e] : bounds[e + 1]] for e in items]), minlength=len(probes))

    def wanted(size: int) -> np.ndarray:
        """The least overlap with each probe: threshold * union <= 100 * overlap, solved for the overlap."""
        return -(-threshold * (size + psize) // (100 + threshold))

    built = sorted(range(left or n), key=lambda i: ordered[i].astype(">u4").tobytes())
    line = np.array(built)
    class_of, links = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1], []
    todo = [(0, len(line), 0, np.zeros(len(probes), dtype=np.int64))]
    while todo:
        lo, hi, depth, over = todo.pop()
        first = ordered[line[lo]]
        to = _common(first, ordered[line[hi - 1]]) if hi - lo > 1 else len(first)
        over, depth = over + overlaps(first[depth:to]), to
        inside = line[lo:hi]
        # Remaining-length bound: the most elements that a set below and the probe can still share.
        alive = np.minimum(plen, over + lens[inside].max() - depth) >= wanted(sizes[inside].min())
        if (class_of[inside] == class_of[inside[0]]).all():
            alive &= class_of[probes] != class_of[inside[0]]
        if not alive.any():
            continue
        ended = inside[lens[inside] == depth]
        for i in ended:
            hit = np.flatnonzero((over >= wanted(sizes[i])) & (class_of[probes] != class_of[i]))
            if len(hit):
                classes, at = np.unique(class_of[probes[hit]], return_index=True)
                links += [(int(i), int(probes[hit[k]])) for k in at]
                merged = np.zeros(n, dtype=bool)
                merged[classes] = merged[class_of[i]] = True
                class_of[merged[class_of]] = min(int(classes[0]), int(class_of[i]))
        if len(ended) < hi - lo:
            start = lo + len(ended)  # a set that ends here sorts before those that go on
            step = np.array([ordered[i][depth] for i in line[start:hi]])
            cuts = [start, *(start + 1 + np.flatnonzero(step[1:] != step[:-1])), hi]
            todo += [(a, b, depth, over) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return links


def _signature(s: np.ndarray) -> tuple[int, int]:
    """Two sums over a set that tell it apart from others, as signed longs."""
    two = (s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return tuple(int(np.uint64(x).astype(np.int64)) for x in two) if len(s) else (0, 0)


def _join_groups(n: int, threshold: int):
    """Rows (root, band, task, side, label, rep, sig1, sig2, text), sorted by the first four: links (a, b) between the sets of each task."""

    def links(rows: list) -> list[tuple[int, int]]:
        known: dict = {}
        for label, rep, s in rows:
            known.setdefault((rep, s.tobytes()), (label, s))
        sets = list(known.items())
        found = tree_join([s for _, (_, s) in sets], 0, threshold, np.array([x for _, (x, _) in sets]))
        return [(sets[i][0][0], sets[j][0][0]) for i, j in found]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches(it):
            out = []
            columns = [c.to_pylist() for c in b.columns[:8]]
            for *at, label, rep, s1, s2, s in zip(*columns, ngram_sets(b.column(8), n), strict=True):
                if at != key:
                    if len(rows) > 1:
                        out += links(rows)
                    key, rows = at, []
                if (s1, s2) == _signature(s):
                    rows.append((label, rep, s))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        out = links(rows) if len(rows) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


# ---------------------------------------------------------------- the join


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among ids (one column, long), and others whose hash meets one of theirs: of the rest one in 3,000 for 10,000 ids, nearly all from 100 million on. What is broadcast is bounded by MARKS."""
    place = lambda c: (F.expr(f"pmod(xxhash64({c}), {MARKS})"), F.expr(f"CAST(pmod(xxhash64({c}, 1), 32768) AS INT)"))
    mark, bit = place(ids.columns[0])
    marks = ids.select(mark.alias("mark"), bit.cast("long").alias("bit")).groupBy("mark").agg(F.bitmap_construct_agg("bit").alias("bits"))
    # As 512 numbers, whose bits can be asked for: the first of eight bytes is a number's highest.
    marks = marks.selectExpr("mark", "transform(sequence(0, 511), i -> CAST(conv(hex(substring(bits, 8 * i + 1, 8)), 16, -10) AS BIGINT)) AS words")
    mark, bit = place("doc_id")
    found = rows.where("doc_id IS NOT NULL").withColumns({"at": mark, "bit": bit}).join(F.broadcast(marks), F.col("at") == F.col("mark"))
    return found.where("getbit(words[bit DIV 64], (7 - (bit DIV 8) % 8) * 8 + bit % 8) = 1").select(*rows.columns)


def _digests(n: int, threshold: int, slack: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            sets = ngram_sets(b.column(1), n)
            needs = [_need(len(s), threshold, slack) for s in sets]
            sigs = [_signature(s) for s in sets]
            prefix = [s[:p].view(np.int64) for s, (p, _) in zip(sets, needs, strict=True)]
            ends = np.zeros(len(sets) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in prefix], out=ends[1:])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[k] for x in sigs], pa.int64()) for k in (0, 1)),
                 pa.array([k for _, k in needs], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix)))],
                names=["doc_id", "size", "sig1", "sig2", "need", "prefix"],
            )

    return run


SIG = ["size", "sig1", "sig2"]


def classes(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, slack: int = SLACK) -> tuple[DataFrame, DataFrame]:
    """Two tables: every row's doc_id with its set's size and signature; and each set's signature with rep (smallest doc_id) and root (its component)."""
    rows = texts(docs)
    sets = materialise(rows.mapInArrow(_digests(n, threshold, slack), "doc_id long, size long, sig1 long, sig2 long, need int, prefix array<long>"), "sets")
    reps = sets.where("size > 0 AND doc_id IS NOT NULL").groupBy(*SIG).agg(F.min("doc_id").alias("rep"), F.any_value("need").alias("need"), F.any_value("prefix").alias("prefix"))
    reps = materialise(reps, "reps")

    elements = reps.select("rep", "need", F.explode("prefix").alias("e"))
    # Written first, as are the heads below: a hot element then meets a plain table, and Spark can split its side of the join.
    often = materialise(elements.groupBy("e").count().where("count > 1"), "often")
    common = elements.join(often, "e").groupBy("rep", "need").agg(F.sort_array(F.collect_list(F.struct("count", "e"))).alias("found"))
    routes = materialise(common.where("size(found) >= need").select("rep", F.explode(F.expr("slice(found.e, 1, size(found) - need + 1)")).alias("e")), "routes")
    heads = materialise(routes.groupBy("e").agg(F.min("rep").alias("head")), "heads")
    grouped = components(routes.join(heads, "e").select(F.col("rep").alias("a"), F.col("head").alias("b")))

    def links(tasks: DataFrame) -> DataFrame:
        work = tasks.join(bodies, "rep").select("root", "band", "task", "side", "label", "rep", "sig1", "sig2", "text")
        key = ("root", "band", "task", "side")
        work = work.repartition(width(docs.sparkSession, 2), *key).sortWithinPartitions(*key)
        return work.mapInArrow(_join_groups(n, threshold), "a long, b long")

    # The candidates' texts, written once without a shuffle. Ids whose hash meets a candidate's come along; links() joins by id and passes them over.
    bodies = materialise(_marked(rows, grouped.select("node")).select(F.col("doc_id").alias("rep"), "text"), "bodies")

    # Large groups fall into bands of size, of which linked sets are at most one apart: a set goes to its own band and the next.
    members = grouped.join(reps.select("rep", *SIG), grouped.node == F.col("rep")).select("root", "rep", *SIG)
    members = materialise(members.withColumn("band", F.floor(F.log("size") / (1.001 * math.log(100 / threshold))).cast("int")), "members")
    split = materialise(members.groupBy("root").agg((F.sum("size") > TASK_ELEMENTS).alias("split")), "split")
    placed = members.join(split, "root").selectExpr("root", "rep", *SIG, "explode(IF(split, array(band, band + 1), array(-1))) AS band")
    cut = materialise(placed.groupBy("root", "band").agg(F.sum("size").alias("n")).selectExpr("root", "band", f"IF(n <= {TASK_ELEMENTS}, 1, CAST(ceil(n / {HUB_ELEMENTS}) AS INT)) AS cut"), "cut")
    placed = materialise(placed.join(cut, ["root", "band"]), "placed")

    # Each block with its group's hub.
    tasks = placed.selectExpr("*", "CAST(pmod(xxhash64(rep), cut) AS INT) AS block")
    tasks = tasks.selectExpr("root", "band", "rep", "sig1", "sig2", "0 AS side", "rep AS label", "explode(IF(block > 0 OR cut = 1, array(block), sequence(1, cut - 1))) AS task")
    linked = components(links(tasks))

    # Of groups that were cut, elements that route sets of several classes so far form the groups that are left; in
    # these, sets outside the largest class are joined with all of the group.
    label = linked.withColumnsRenamed({"node": "l_node", "root": "l_root"})
    large = placed.where("cut > 1").select("rep").distinct().join(label, F.col("rep") == F.col("l_node"), "left").select("rep", F.coalesce("l_root", "rep").alias("label"))
    open_ = materialise(routes.join(large, "rep"), "open")
    heads = open_.groupBy("e").agg(F.min("rep").alias("head"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("e", "head")
    regrouped = components(open_.join(heads, "e").select(F.col("rep").alias("a"), F.col("head").alias("b"))).withColumnRenamed("root", "n_root")
    large = regrouped.join(open_.select("rep", "label").distinct(), F.col("node") == F.col("rep")).select("n_root", "rep", "label")
    large = large.join(members.drop("root"), "rep").selectExpr("n_root AS root", "rep", "label", *SIG, "explode(array(band, band + 1)) AS band")
    large = materialise(large, "large")
    most = large.groupBy("root", "band", "label").agg(F.sum("size").alias("n")).groupBy("root", "band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("whole"), F.max("n").alias("most"))
    most = materialise(most.where("whole > most").selectExpr("root", "band", "main", f"CAST(ceil(whole / {BLOCK_ELEMENTS}) AS INT) AS sides", f"CAST(ceil((whole - most) / {BLOCK_ELEMENTS}) AS INT) AS outs"), "most")
    if not most.isEmpty():
        rest = large.join(most, ["root", "band"]).selectExpr("*", "CAST(pmod(xxhash64(rep), sides) AS INT) AS block", "CAST(pmod(xxhash64(rep), outs) AS INT) AS out")
        pairs = "array_union(transform(sequence(0, outs - 1), t -> named_struct('task', t, 'side', block)), IF(label <> main, transform(sequence(0, sides - 1), t -> named_struct('task', out, 'side', t)), array()))"
        more = links(rest.selectExpr("root", "band", "rep", "sig1", "sig2", "label", f"inline({pairs})"))
        for side in ("a", "b"):  # links between classes so far
            more = more.join(label, F.col(side) == F.col("l_node"), "left").withColumn(side, F.coalesce("l_root", side)).select("a", "b")
        merged = components(more).withColumnsRenamed({"node": "m_node", "root": "m_root"})
        linked = reps.select("rep").join(label, F.col("rep") == F.col("l_node"), "left").select(F.col("rep").alias("node"), F.coalesce("l_root", "rep").alias("root"))
        linked = linked.join(merged, F.col("root") == F.col("m_node"), "left").select("node", F.coalesce("m_root", "root").alias("root"))
    named = reps.select("rep", *SIG).join(linked, F.col("rep") == F.col("node"), "left").select(*SIG, "rep", F.coalesce("root", "rep").alias("root"))
    return sets.select("doc_id", *SIG), named


def join(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    rows, named = classes(docs, **how)
    return rows.join(named, SIG, "left").select("doc_id", F.col("size").alias("n_shingles"), F.expr("CASE WHEN size > 0 AND doc_id IS NOT NULL THEN root ELSE doc_id END").alias("component_id"))


def deduplicated(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """One row of docs of each component (that of its smallest doc_id), columns as they are. Rows without words or doc_id stay."""
    _, named = classes(docs, n, threshold)
    at, names = docs.columns.index("text"), docs.columns
    *mark, own, rep, nth = fresh(names, "size", "sig1", "sig2", "own", "rep", "nth")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            sets = ngram_sets(b.column(at), n)
            sigs = [(len(s), *_signature(s)) for s in sets]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[k] for x in sigs], pa.int64()) for k in range(3))], names=[*b.schema.names, *mark])

    marked = mapped(docs, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{m} long" for m in mark)]))
    marked = marked.withColumn(own, F.expr("CAST(doc_id AS BIGINT)"))
    kept = named.where("rep = root").select(*(F.col(c).alias(m) for c, m in zip(SIG, mark, strict=True)), F.col("rep").alias(rep))
    size = mark[0]
    rows = marked.join(kept, mark, "left").where(f"{size} = 0 OR {own} IS NULL OR {own} = {rep}")
    rows = rows.withColumn(nth, F.expr(f"CASE WHEN {size} = 0 OR {own} IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY {', '.join(mark)}, {own} ORDER BY {own}) END"))
    return rows.where(f"{nth} = 1").select(*(f"`{c}`" for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]))) END AS s FROM words),
sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
grams AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
often AS (SELECT g FROM grams GROUP BY g HAVING count(*) > 1),
usual AS (SELECT doc_id, n, g FROM grams SEMI JOIN often USING (g)),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM usual x JOIN usual y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * x.n >= 85 * y.n AND 100 * y.n >= 85 * x.n
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM r JOIN edges e ON r.b = e.a) SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id FROM sized d LEFT JOIN reach r ON d.doc_id = r.a
"""
