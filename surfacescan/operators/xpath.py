"""Syntax rules in XPath, compiled into a relational plan over the node table.

The part of XPath 1.0 that syntax rules use: unions, paths of the axes child, descendant, parent, ancestor,
preceding-sibling, following-sibling and self (long or short), predicates with and, or, not(), paths,
comparisons of text() or of a path's text with a literal, contains(), starts-with(), string-length(), and a
position as a step's first predicate. Anything else is refused by name when the expression is compiled.

A path in a predicate is an existence test and is evaluated from its end: whether a node fits the last step,
then whether one of the step before has such a node on the axis, and so on. Conditions on a node itself are
SQL; each axis is a column that a pass over a segment in pre-order fills. No step makes pairs of nodes, and
all rules share one exchange and sort of the node table and as many passes as their deepest one has steps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEG = ["package", "version", "file_context", "rule", "seg_ord"]
AT = [*SEG, "pre"]
INVERSE = {
    "child": "parent", "parent": "child", "descendant": "ancestor", "ancestor": "descendant", "preceding-sibling": "following-sibling", "following-sibling": "preceding-sibling", "self": "self",
}


class XPathError(ValueError):
    """An expression that is not XPath, or beyond the part that is read here."""


# ---------------------------------------------------------------- reading

_TOKEN = re.compile(r"\s*(?:('[^']*'|\"[^\"]*\")|([0-9]+(?:\.[0-9]+)?)|(//|\.\.|::|!=|<=|>=|[/.|()\[\]@,=<>*+])|([A-Za-z_][A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]+)*))")


@dataclass
class Step:
    axis: str
    test: str
    where: list = field(default_factory=list)
    nth: int | None = None


@dataclass
class Path:
    """steps from the context node, or from the document's root."""

    steps: list[Step]
    absolute: bool = False


class _Reader:
    """Recursive descent; values are Path, ("union", paths), ("filter", value, predicates) and tuples of an operator and operands."""

    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise XPathError(f"unexpected {text[at:].strip()[:20]!r}")
            self.tokens.append(m.group().strip())
            at = m.end()
        self.i = 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.i + k] if self.i + k < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        t = self.peek()
        if not t or wanted and t not in wanted:
            raise XPathError(f"{' or '.join(wanted) or 'more'} expected{f' before {t!r}' if t else ' at the end'}")
        self.i += 1
        return t

    def whole(self):
        out = self.either()
        if self.peek():
            raise XPathError(f"unexpected {self.peek()!r}")
        return out

    def _chain(self, word: str, below):
        out = below()
        while self.peek() == word:
            self.take()
            out = (word, out, below())
        return out

    def either(self):
        return self._chain("or", self.both)

    def both(self):
        return self._chain("and", self.compared)

    def compared(self):
        left = self.union()
        if self.peek() in ("=", "!=", "<", "<=", ">", ">="):
            return ("cmp", self.take(), left, self.union())
        return left

    def union(self):
        out = [self.primary()]
        while self.peek() == "|":
            self.take()
            out.append(self.primary())
        return out[0] if len(out) == 1 else ("union", out)

    def primary(self):
        t = self.peek()
        if t[:1] in "'\"" and t:
            return ("lit", self.take()[1:-1])
        if t[:1].isdigit():
            return ("num", float(self.take()))
        if t == "(":
            self.take()
            inner = self.either()
            self.take(")")
            where = self.predicates()
            if self.peek() in ("/", "//"):
                raise XPathError("a path after a bracket")
            return ("filter", inner, where) if where else inner
        if self.peek(1) == "(" and t not in ("text", "node"):
            return self.function()
        return self.path()

    def function(self):
        name, args = self.take(), []
        self.take("(")
        while self.peek() != ")":
            args.append(self.either())
            if self.peek() != ")":
                self.take(",")
        self.take(")")
        if name not in ARGUMENTS:
            raise XPathError(f"function {name}()")
        if len(args) != ARGUMENTS[name]:
            raise XPathError(f"{name}() takes {ARGUMENTS[name]}")
        return (name, *args)

    def path(self) -> Path:
        steps, absolute = [], self.peek() in ("/", "//")
        axis = {"/": "child", "//": "descendant"}[self.take()] if absolute else "child"
        while True:
            steps.append(self.step(axis))
            if self.peek() not in ("/", "//"):
                break
            axis = {"/": "child", "//": "descendant"}[self.take()]
        # A leading dot says where the path goes on from.
        return Path(steps[1:] if len(steps) > 1 and steps[0] == Step("self", "node()") else steps, absolute)

    def step(self, axis: str) -> Step:
        t = self.peek()
        if t in (".", ".."):
            self.take()
            if axis == "descendant" and t == "..":
                raise XPathError("'..' after '//'")
            return Step("self" if t == "." else "parent", "node()", self.predicates())
        if self.peek(1) == "::":
            if t not in INVERSE:
                raise XPathError(f"axis {t}")
            if axis == "descendant":
                raise XPathError(f"{t}:: after '//'")
            axis = self.take()
            self.take("::")
        test = self.take()
        if test in ("text", "node"):
            self.take("(")
            self.take(")")
            test += "()"
        elif not (test == "*" or re.match("[A-Za-z_]", test)):
            raise XPathError(f"unexpected {test!r}")
        where = self.predicates()
        nth = None
        if where and isinstance(where[0], tuple) and where[0][0] == "num":
            if axis not in ("child", "descendant"):
                raise XPathError(f"a position on the axis {axis}")
            nth, where = int(where[0][1]), where[1:]
        return Step(axis, test, where, nth)

    def predicates(self) -> list:
        out = []
        while self.peek() == "[":
            self.take()
            out.append(self.either())
            self.take("]")
        return out


#: Functions, and the number of their arguments.
ARGUMENTS = {"not": 1, "contains": 2, "starts-with": 2, "string-length": 1, "true": 0, "false": 0}
def _own_text(e) -> bool:
    """Whether an expression is text() of the context node."""
    return isinstance(e, Path) and not e.absolute and len(e.steps) == 1 and e.steps[0].axis == "child" and e.steps[0].test == "text()" and not e.steps[0].where


def quoted(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _value(e) -> str:
    """Text or a number, of the context node alone, as SQL."""
    if _own_text(e) or isinstance(e, Path) and len(e.steps) == 1 and e.steps[0] == Step("self", "node()"):
        return "coalesce(text, '')"
    if isinstance(e, tuple) and e[0] == "lit":
        return quoted(e[1])
    if isinstance(e, tuple) and e[0] == "num":
        return f"{e[1]!r}D"
    if isinstance(e, tuple) and e[0] == "string-length":
        return f"length({_value(e[1])})"
    raise XPathError(f"{e[0] if isinstance(e, tuple) else 'a path'} as a value")


def _named(e) -> Path | None:
    """For a comparison of a path's text with a literal: the path whose last node has that text."""
    _, op, left, right = e
    if isinstance(right, Path) and not _own_text(right):
        left, right = right, left
    if not isinstance(left, Path) or _own_text(left) or left.steps[-1] == Step("self", "node()") or op not in ("=", "!=") or not isinstance(right, tuple) or right[0] != "lit":
        return None
    steps = left.steps[:-1] if left.steps[-1].test == "text()" else left.steps
    last = steps[-1]
    own = Path([Step("child", "text()")])
    return Path([*steps[:-1], Step(last.axis, last.test, [*last.where, ("cmp", op, own, right)], last.nth)], left.absolute)


def _spelt(e) -> list[str] | None:
    """The literals of a chain of text() = ... or text() = ...; None where it is no such chain."""
    if isinstance(e, tuple) and e[0] == "or":
        a, b = _spelt(e[1]), _spelt(e[2])
        return None if a is None or b is None else a + b
    return [e[3][1]] if isinstance(e, tuple) and e[:2] == ("cmp", "=") and _own_text(e[2]) and isinstance(e[3], tuple) and e[3][0] == "lit" else None


def _local(e) -> str | None:
    """A condition on the context node alone, as SQL that is never null; None where it looks further."""
    if _own_text(e):
        return "text IS NOT NULL"
    if isinstance(e, Path):
        return None
    kind = e[0]
    if kind == "or" and (words := _spelt(e)) is not None:
        return f"(text IS NOT NULL AND text IN ({', '.join(_value(('lit', w)) for w in words)}))"
    if kind in ("and", "or"):
        a, b = _local(e[1]), _local(e[2])
        return None if a is None or b is None else f"({a} {kind.upper()} {b})"
    if kind == "not":
        inner = _local(e[1])
        return None if inner is None else f"(NOT {inner})"
    if kind == "union":
        return None
    if kind in ("true", "false"):
        return kind
    if kind == "cmp":
        if _named(e) is not None:
            return None
        has = "text IS NOT NULL AND " if _own_text(e[2]) or _own_text(e[3]) else ""
        return f"({has}{_value(e[2])} {e[1]} {_value(e[3])})"
    if kind == "contains":
        return f"contains({_value(e[1])}, {_value(e[2])})"
    if kind == "starts-with":
        return f"startswith({_value(e[1])}, {_value(e[2])})"
    raise XPathError(f"{kind} as a condition")


def _check(e, top: bool = True) -> None:
    """Refuse what has no plan, without data."""
    if isinstance(e, Path):
        if top != e.absolute:
            raise XPathError("a rule begins with / or //" if top else "a path from the root within a predicate")
        for k, s in enumerate(e.steps):
            if s.test == "text()":
                raise XPathError("text() as a node")
            if top and k == 0 and s.axis not in ("child", "descendant"):
                raise XPathError(f"{s.axis} at the root")
            for w in s.where:
                _check_condition(w)
    elif isinstance(e, tuple) and e[0] == "union":
        for x in e[1]:
            _check(x, top)
    elif isinstance(e, tuple) and e[0] == "filter":
        _check(e[1], top)
        for w in e[2]:
            _check_condition(w)
    else:
        raise XPathError("not a set of nodes")


def _check_condition(e) -> None:
    if isinstance(e, tuple) and e[0] == "num":
        raise XPathError("a position that is not a step's first predicate")
    if isinstance(e, tuple) and e[0] in ("and", "or", "not"):
        for x in e[1:]:
            _check_condition(x)
    elif isinstance(e, tuple) and e[0] == "cmp" and (path := _named(e)) is not None:
        _check(path, False)
    elif isinstance(e, tuple) and e[0] in ("union", "filter") or isinstance(e, Path) and not _own_text(e):
        if isinstance(e, tuple) and e[0] == "filter":
            raise XPathError("a filtered bracket within a predicate")
        _check(e, False)
    else:
        _local(e)


def parse(text: str):
    """The expression, read and checked; raises XPathError."""
    e = _Reader(text).whole()
    try:
        _check(e)
    except RecursionError:
        raise XPathError("nested too deeply") from None
    return e


# ---------------------------------------------------------------- the plan


def _swept(outer: DataFrame, inner: DataFrame, axis: str) -> DataFrame:
    """outer with __on: whether an inner node is among its descendants, or its ancestors. One sort of a segment and one pass."""
    rows = outer.withColumn("__inner", F.lit(None).cast("int")).unionByName(inner.select(*SEG, "pre", F.when(F.lit(axis == "descendant"), F.col("pre")).otherwise(F.col("pre") + F.col("size")).cast("int").alias("__inner")), allowMissingColumns=True)
    # Backwards the last inner node seen is the next one in pre-order; forwards the furthest end seen tells whether any is still open.
    order = [F.desc("pre") if axis == "descendant" else F.asc("pre"), F.col("__inner").asc_nulls_first()]
    window = Window.partitionBy(*SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if axis == "descendant":
        on = F.last("__inner", ignorenulls=True).over(window) <= F.col("pre") + F.col("size")
    else:
        on = F.max("__inner").over(window) >= F.col("pre")
    return rows.withColumn("__on", F.coalesce(on, F.lit(False))).where("__inner IS NULL").drop("__inner")


def having(outer: DataFrame, axis: str, nodes: DataFrame, negate: bool = False) -> DataFrame:
    """outer nodes with one of the nodes among their descendants or ancestors; or, negated, without."""
    return _swept(outer, nodes, axis).where("NOT __on" if negate else "__on").drop("__on")


def _along(t: pa.Table, axes: dict[str, str]) -> pa.Table:
    """Whole segments in pre-order: each column of `axes` says of a node whether it fits; then, whether one on its axis does."""
    whole = lambda c: pc.fill_null(t.column(c).cast(pa.int64()), -1).to_numpy()
    seg, n = np.cumsum(t.column("__first").to_numpy()).astype("int64") << 32, len(t)
    key, over = seg + whole("pre") + 1, seg + whole("parent") + 1
    end, order = key + whole("size"), whole("ord")
    up = np.minimum(np.searchsorted(key, over), n - 1)
    has = key[up] == over
    beside = np.unique(over, return_inverse=True)[1]
    for c, axis in axes.items():
        fits = t.column(c).to_numpy()
        if axis == "child":
            on = np.zeros(n, bool)
            on[up[has & fits]] = True
        elif axis == "parent":
            on = has & fits[up]
        elif axis == "descendant":
            so_far = np.concatenate([[0], np.cumsum(fits)])
            on = so_far[np.searchsorted(key, end, "right")] > so_far[1:]
        elif axis == "ancestor":
            on = np.concatenate([[0], np.maximum.accumulate(np.where(fits, end, 0))[:-1]]) >= key
        else:
            first = axis == "preceding-sibling"
            far = np.full(n, np.iinfo("int64").max if first else -1)
            (np.minimum if first else np.maximum).at(far, beside[fits], order[fits])
            on = order > far[beside] if first else order < far[beside]
        t = t.set_column(t.schema.get_field_index(c), c, pa.array(on))
    return t


def _sweep(axes: dict[str, str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # of the segment that may go on
        for b in it:
            starts = np.flatnonzero(b.column("__first").to_numpy(zero_copy_only=False))
            if len(starts) and (held or starts[-1]):
                yield from _along(pa.Table.from_batches([*held, b.slice(0, starts[-1])]), axes).to_batches(10_000)
                held = []
            held.append(b.slice(starts[-1]) if len(starts) else b)
        if held:
            yield from _along(pa.Table.from_batches(held), axes).to_batches(10_000)

    return run


class Marks:
    """Conditions on nodes as SQL, in which a condition on an axis is a column.

    A column at a time is no plan at a time: the nodes are put together by segment once, and each pass over a
    segment fills all columns whose conditions are known, those of all rules together.
    """

    def __init__(self) -> None:
        self.asked: dict[tuple[str, str], tuple[str, int]] = {}
        self.numbered = False  # whether a position is asked for

    def on(self, axis: str, condition: str) -> str:
        """SQL for whether a node on the axis fulfils a condition."""
        if axis == "self":
            return condition
        if (axis, condition) not in self.asked:
            depth = 1 + max((d for c, d in self.asked.values() if c in condition), default=0)
            self.asked[axis, condition] = f"__m{len(self.asked)}_", depth
        return self.asked[axis, condition][0]

    def fill(self, nodes: DataFrame) -> DataFrame:
        """The nodes with the columns; and with their positions where any condition asks for one."""
        rows = nodes.repartition(*SEG)
        if self.numbered:
            among = lambda *keys: F.row_number().over(Window.partitionBy(*SEG, *keys).orderBy("ord"))
            rows = rows.withColumns({"__nth": among("parent", "tag"), "__nth_any": among("parent")})
        rows = rows.withColumn("__first", F.row_number().over(Window.partitionBy(*SEG).orderBy("pre")) == 1).sortWithinPartitions(*SEG, "pre")  # Spark may put the windows into another order
        for depth in sorted({d for _, d in self.asked.values()}):
            here = {name: (axis, condition) for (axis, condition), (name, d) in self.asked.items() if d == depth}
            rows = rows.withColumns({name: F.expr(f"coalesce({condition}, false)") for name, (_, condition) in here.items()})
            rows = rows.mapInArrow(_sweep({name: axis for name, (axis, _) in here.items()}), rows.schema)
        return rows


def all_of(conditions: list[str]) -> str:
    return "(" + (" AND ".join(conditions) or "true") + ")"


def one_of(conditions: list[str]) -> str:
    return "(" + (" OR ".join(conditions) or "false") + ")"


def _tested(s: Step, marks: Marks) -> list[str]:
    any_tag = s.test in ("*", "node()")
    out = [] if any_tag else [f"tag = {quoted(s.test)}"]
    if s.nth is not None:
        marks.numbered = True
        out.append(f"{'__nth_any' if any_tag else '__nth'} = {s.nth}")
    return out


def _condition(e, marks: Marks) -> str:
    """A predicate as SQL that is never null."""
    if (own := _local(e)) is not None:
        return own
    if isinstance(e, tuple) and e[0] == "not":
        return f"(NOT {_condition(e[1], marks)})"
    if isinstance(e, tuple) and e[0] in ("and", "or"):
        return (all_of if e[0] == "and" else one_of)([_condition(x, marks) for x in e[1:]])
    if isinstance(e, tuple) and e[0] == "union":
        return one_of([_condition(x, marks) for x in e[1]])
    path = _named(e) if isinstance(e, tuple) else e
    found = None
    for s, after in zip(reversed(path.steps), [None, *reversed(path.steps)]):
        further = [] if after is None else [marks.on(after.axis, found)]
        found = all_of([*_tested(s, marks), *further, *(_condition(w, marks) for w in s.where)])
    return marks.on(path.steps[0].axis, found)


def _selected(e, marks: Marks) -> str:
    """Whether an expression selects a node, as SQL."""
    if isinstance(e, tuple) and e[0] == "union":
        return one_of([_selected(x, marks) for x in e[1]])
    if isinstance(e, tuple):
        return all_of([_selected(e[1], marks), *(_condition(w, marks) for w in e[2])])
    found = None
    for k, s in enumerate(e.steps):
        before = [marks.on(INVERSE[s.axis], found)] if k else ["parent < 0"] if s.axis == "child" else []
        found = all_of([*_tested(s, marks), *before, *(_condition(w, marks) for w in s.where)])
    return found


def condition(xpath: str, marks: Marks) -> str:
    """Whether an expression selects a node, as SQL over the node's columns and the marks."""
    return _selected(parse(xpath), marks)


def select(nodes: DataFrame, xpath: str) -> DataFrame:
    """The rows of a node table that an expression selects, each once."""
    return select_all(nodes, {"x": xpath}).select(*nodes.columns)


def select_all(nodes: DataFrame, rules: dict[str, str]) -> DataFrame:
    """The rows that each rule selects, each once a rule, with the rule's name as `found`."""
    marks = Marks()
    return marked(nodes, {name: [condition(x, marks)] for name, x in rules.items()}, marks)


def marked(nodes: DataFrame, rules: dict[str, list[str]], marks: Marks, keep: list[str] | None = None) -> DataFrame:
    """The rows that fulfil any of a rule's conditions, each once a rule, with the rule's name as `found`. All rules share one plan.

    keep: the columns that go on (all, unless given). Others that no condition names stay behind before the
    exchange: each pass carries every column to Python and back.
    """
    keep = keep or nodes.columns
    asked = set(re.findall(r"\w+", " ".join([*(c for _, c in marks.asked), *(c for conditions in rules.values() for c in conditions)])))
    rows = nodes.select(*(c for c in nodes.columns if c in {*keep, *AT, "parent", "size", "ord", "tag"} or c in asked))
    names = ", ".join(f"IF({one_of(conditions)}, {quoted(name)}, NULL)" for name, conditions in rules.items())
    rows = marks.fill(rows) if marks.asked or marks.numbered else rows
    return rows.withColumn("found", F.expr(f"explode(filter(array({names}), x -> x IS NOT NULL))")).select(*keep, "found")
