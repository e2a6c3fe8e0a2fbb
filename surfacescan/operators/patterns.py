"""Syntax rules as conditions over the node table.

A node's subtree is the range pre .. pre + size inside its segment. What rules ask of a node is SQL, and what
they ask of nodes around it are columns that passes over a segment in pre-order fill: no range joins, which a
file of many like lines would make quadratic. Rule tables are a few hundred constant rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import RuleBase, data
from . import xpath
from .xpath import AT, SEG

_PLACE = [*AT, "size", "line1", "col1", "line2", "in_function"]
_FOUND = ["found", "indirect", "lpre", *_PLACE]
#: Before a hook's name, where hooks and findings are sought together.
_HOOK = "hook "


def calls(nodes: DataFrame) -> DataFrame:
    """Names called bare or with a package, not as members."""
    return nodes.where("tag = 'SYMBOL_FUNCTION_CALL' AND NOT after_dollar AND NOT after_at")


def _holding(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Outer nodes with an inner one in their subtree."""
    return xpath.having(outer, "descendant", inner)


def _direct(df: DataFrame) -> DataFrame:
    return df.withColumn("indirect", F.lit(False)).withColumn("lpre", F.col("pre")).select(_FOUND)


def _called(names: list[str]) -> str:
    """SQL: a call of one of the functions, bare or with a package."""
    return f"(tag = 'SYMBOL_FUNCTION_CALL' AND NOT after_dollar AND NOT after_at AND {_in(names)})"


def _in(words: list[str]) -> str:
    return f"text IN ({', '.join(map(xpath.quoted, words))})" if words else "false"


def _with(words: tuple[str, ...]) -> str:
    return xpath.one_of([f"contains(text, {xpath.quoted(w)})" for w in words])


def _asked_patterns(rules: RuleBase, marks: xpath.Marks) -> dict[str, list[str]]:
    """Conditions of each syntax rule."""
    # A rule's expression stands for all that it seeks.
    asked = {r["name"]: [xpath.condition(r["xpath"], marks)] if "xpath" in r else [_called(r["functions"])] for r in rules.patterns}
    builtin = {r["name"] for r in rules.patterns if "xpath" not in r}

    def add(rule: str, *conditions: str) -> None:
        if rule in builtin:
            asked[rule].append(xpath.all_of(list(conditions)))

    below = lambda inner: marks.on("child", marks.on("child", inner))
    for rule, name, package in data.PACKAGE_CALLS:
        add(rule, "tag = 'SYMBOL_FUNCTION_CALL'", _in([name]), f"prev_pkg = {xpath.quoted(package)}")
    # Call expressions that hold further calls.
    sources = [f for r in rules.patterns if r["name"] in data.CAPABILITIES for f in r["functions"]] + list(data.READERS)
    for rule, outer, inner in (("decoding", ["rawToChar"], [["as.raw"]]), ("eval_parse", ["eval", "evalq"], [list(data.PARSERS), sources])):
        add(rule, "tag = 'expr'", below(_called(outer)), *(marks.on("descendant", _called(names)) for names in inner))
    add("options_repos", "tag = 'expr'", below(_called(["options"])), marks.on("child", "(tag = 'SYMBOL_SUB' AND text = 'repos')"))
    # X$new() with a process class in X.
    for rule in sorted({r for r, _ in data.CLASS_NEWS}):
        classes = [s for r, s in data.CLASS_NEWS if r == rule]
        add(rule, "tag = 'expr'", marks.on("child", "(tag = 'SYMBOL_FUNCTION_CALL' AND text = 'new' AND after_dollar)"), marks.on("descendant", f"(tag = 'SYMBOL' AND {_in(classes)})"))
    # Telling literals: code rather than prose.
    for rule, words in (("persistence", data.PERSISTENCE), ("credentials", data.SECRET_PATHS)):
        add(rule, "tag = 'STR_CONST' AND NOT contains(text, '`') AND (NOT contains(text, ' ') OR length(text) < 32)", _with(words))
    named = below(f"(tag = 'STR_CONST' AND first_arg AND {_with(data.SECRET_NAMES)})")
    add("credentials", _called(["Sys.getenv"]), marks.on("parent", marks.on("parent", named)))
    return asked


def _asked_contexts(rules: RuleBase, marks: xpath.Marks) -> dict[str, list[str]]:
    """Conditions of each hook."""
    asked = {}
    for r in rules.code_contexts:
        if r["how"] == "assign":
            asked[r["name"]] = [f"assigned = {xpath.quoted(r['target'])}"]
        elif r["how"] == "call":
            asked[r["name"]] = [xpath.all_of(["tag = 'expr'", marks.on("child", marks.on("child", _called([r["target"]])))])]
        elif r["how"] == "xpath":
            asked[r["name"]] = [xpath.condition(r["xpath"], marks)]
    return asked


def find_patterns(nodes: DataFrame, rules: RuleBase) -> DataFrame:
    """Each (rule, node) once: found (the rule), indirect, lpre (document order), the node's keys, extent and in_function."""
    marks = xpath.Marks()
    return _direct(xpath.marked(nodes, _asked_patterns(rules, marks), marks, _PLACE))


def find_indirect(nodes: DataFrame, rules: RuleBase) -> DataFrame:
    """Functions that a call names by a literal: as find_patterns, positioned at the literal but contained as the call."""
    spark = nodes.sparkSession
    by = spark.createDataFrame(list(data.INDIRECT.items()), "name string, parameter string")
    owners = spark.createDataFrame(list(rules.owners().items()), "fn string, found string")
    c = calls(nodes)
    c = c.join(F.broadcast(by), c.text == by.name).select(*[F.col(k).alias(f"c_{k}") for k in SEG], F.col("gparent").alias("c_at"), "parameter")
    lit = nodes.where("tag = 'STR_CONST' AND (first_arg OR named_arg IS NOT NULL)")
    on = [*(lit[k].eqNullSafe(c[f"c_{k}"]) for k in SEG), lit.gparent == c.c_at]
    near = lit.join(c, on)
    # The call must name its own parameter or give it first; the target is then the first literal that names any of the three.
    fits = F.max(F.col("first_arg") | F.col("named_arg").eqNullSafe(F.col("parameter"))).alias("fits")
    target = F.min(F.when(F.col("first_arg") | F.col("named_arg").isin(list(data.INDIRECT.values())), F.struct("pre", "text", "line1", "col1", "line2"))).alias("t")
    named = near.groupBy(*SEG, F.col("gparent").alias("call")).agg(fits, target).where("fits AND t IS NOT NULL")
    plain = named.where(r"NOT contains(t.text, '\\') AND t.text RLIKE '^[\"\'].*[\"\']$'").withColumn("fn", F.expr("substring(t.text, 2, length(t.text) - 2)"))
    owned = plain.join(F.broadcast(owners), "fn").select("found", *[F.col(k).alias(f"o_{k}") for k in SEG], "call", "t")
    e = nodes.where("tag = 'expr'")
    rows = e.join(owned, [*(e[k].eqNullSafe(owned[f"o_{k}"]) for k in SEG), e.pre == owned.call])
    return rows.select(
        "found", F.lit(True).alias("indirect"), F.col("t.pre").alias("lpre"), *AT, "size",
        F.col("t.line1").alias("line1"), F.col("t.col1").alias("col1"), F.col("t.line2").alias("line2"), "in_function",
    )


def find_code_contexts(nodes: DataFrame, rules: RuleBase) -> DataFrame:
    """Extents of hooks: context, the segment's keys, pre, size, line1, col1."""
    marks = xpath.Marks()
    rows = xpath.marked(nodes, _asked_contexts(rules, marks), marks, [*AT, "size", "line1", "col1"])
    return rows.withColumnRenamed("found", "context").select("context", *AT, "size", "line1", "col1")


def _innermost():
    """Rows of findings and hooks, sorted by segment and pre-order: the findings with the hook opened last that is still open."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, open_ = None, []
        for b in it:
            columns = {n: b.column(n).to_pylist() for n in (*SEG, "pre", "x_context", "x_end")}
            keep, names = [], []
            for i, (pre, context, end) in enumerate(zip(columns["pre"], columns["x_context"], columns["x_end"], strict=True)):
                if (at := tuple(columns[k][i] for k in SEG)) != segment:
                    segment, open_ = at, []
                while open_ and open_[-1][0] < pre:
                    open_.pop()
                if end is not None:
                    open_.append((end, context))
                else:
                    keep.append(i)
                    names.append(open_[-1][1] if open_ else None)
            found = b.select(_FOUND).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(names, pa.string())], names=[*_FOUND, "x_context"])

    return run


def determine_code_contexts(found: DataFrame, contexts: DataFrame, applicable: DataFrame) -> DataFrame:
    """found with code_context: the innermost hook around it that its file rule names, else in_function or top_level.

    applicable: (file rule, context), a few dozen rows. Findings and hooks of a segment are sorted together and
    swept once with a stack of the open hooks, so that time is linear in them and memory is the nesting's depth.
    """
    use = contexts.join(F.broadcast(applicable), (contexts.rule == applicable.file_rule) & (contexts.context == applicable.name))
    use = use.select(*(contexts[k] for k in SEG), contexts.pre, F.col("context").alias("x_context"), (contexts.pre + contexts["size"]).alias("x_end"))
    return _placed(found.select(_FOUND).unionByName(use, allowMissingColumns=True))


def find_in_contexts(nodes: DataFrame, rules: RuleBase, applicable: DataFrame) -> DataFrame:
    """What find_patterns and find_indirect find, with code_context: determine_code_contexts of them, but rules and hooks share the exchange of the nodes and its passes."""
    marks = xpath.Marks()
    asked = _asked_patterns(rules, marks) | {_HOOK + name: conditions for name, conditions in _asked_contexts(rules, marks).items()}
    hook = F.startswith("found", F.lit(_HOOK))
    rows = _direct(xpath.marked(nodes, asked, marks, _PLACE)).withColumn("x_context", F.when(hook, F.substr("found", F.lit(len(_HOOK) + 1))))
    use = F.broadcast(applicable.select("file_rule", F.col("name").alias("x_name")))
    rows = rows.join(use, (rows.rule == use.file_rule) & (rows.x_context == use.x_name), "left").where("x_context IS NULL OR x_name IS NOT NULL")
    rows = rows.select(*_FOUND, "x_context", F.expr("IF(x_context IS NULL, NULL, pre + size)").alias("x_end"))
    return _placed(rows.unionByName(find_indirect(nodes, rules), allowMissingColumns=True))


def _placed(rows: DataFrame) -> DataFrame:
    """Findings, and hooks as rows with x_context and x_end: the findings with code_context."""
    # A finding comes before the hooks on its own node; of these the first by name comes last, on top.
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(_FOUND).schema) + ", x_context string"
    rows = rows.repartition(*SEG).sortWithinPartitions(*SEG, "pre", F.desc_nulls_first("x_context"))
    inside = rows.mapInArrow(_innermost(), schema)
    return inside.select(*_FOUND, F.coalesce("x_context", F.when(F.col("in_function"), "in_function").otherwise("top_level")).alias("code_context"))
