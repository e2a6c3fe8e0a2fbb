"""XPath rules: the compiled plan against a plain evaluator over trees, and what is refused."""

import numpy as np
import pytest

from surfacescan.operators import patterns, xpath
from surfacescan.operators.extract import parse_segments
from surfacescan.operators.xpath import Path, XPathError, select
from surfacescan.plans.audit import broken_examples
from surfacescan.rules import default_rules
from surfacescan.rules.expressions import in_xpath

NODES = "package string, version string, file_context string, rule string, seg_ord int, pre int, size int, parent int, ord int, tag string, text string"


class Tree:
    """One segment's nodes; evaluates an expression node by node."""

    def __init__(self, rows):
        self.rows = {r[5]: r for r in rows}

    def axis(self, n, axis):
        r = self.rows[n]
        up = []
        at = r[7]
        while at in self.rows:
            up.append(at)
            at = self.rows[at][7]
        kids = [k for k, x in self.rows.items() if x[7] == r[7] and k != n]
        return {
            "self": [n], "child": [k for k, x in self.rows.items() if x[7] == n], "descendant": [k for k in self.rows if r[5] < k <= r[5] + r[6]], "parent": up[:1], "ancestor": up,
            "preceding-sibling": [k for k in kids if self.rows[k][8] < r[8]], "following-sibling": [k for k in kids if self.rows[k][8] > r[8]],
        }[axis]

    def fits(self, s, n):
        if s.test not in ("*", "node()") and self.rows[n][9] != s.test:
            return False
        if s.nth is not None:
            like = sorted((x[8], k) for k, x in self.rows.items() if x[7] == self.rows[n][7] and (s.test in ("*", "node()") or x[9] == s.test))
            if [k for _, k in like].index(n) + 1 != s.nth:
                return False
        return all(self.holds(w, n) for w in s.where)

    def walk(self, steps, at):
        for s in steps:
            if s.test == "text()":
                return {("text", self.rows[n][10]) for n in at if self.rows[n][10] is not None}
            at = {k for n in at for k in self.axis(n, s.axis) if self.fits(s, k)}
        return at

    def value(self, e, n):
        if isinstance(e, Path):
            got = self.walk(e.steps, {n})
            return [x[1] if isinstance(x, tuple) else self.rows[x][10] or "" for x in got]
        if e[0] in ("lit", "num"):
            return [e[1]]
        return [len("".join(self.value(e[1], n)[:1]))]

    def holds(self, e, n):
        if isinstance(e, Path):
            return bool(self.walk(e.steps, {n}))
        kind = e[0]
        if kind == "and":
            return self.holds(e[1], n) and self.holds(e[2], n)
        if kind == "or":
            return self.holds(e[1], n) or self.holds(e[2], n)
        if kind == "union":
            return any(self.holds(x, n) for x in e[1])
        if kind == "not":
            return not self.holds(e[1], n)
        if kind in ("true", "false"):
            return kind == "true"
        if kind == "cmp":
            op = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[e[1]]
            return any(op(a, b) for a in self.value(e[2], n) for b in self.value(e[3], n))
        a, b = ("".join(self.value(x, n)[:1]) for x in e[1:])
        return b in a if kind == "contains" else a.startswith(b)

    def select(self, e):
        if isinstance(e, tuple) and e[0] == "union":
            return set().union(*map(self.select, e[1]))
        if isinstance(e, tuple):
            return {n for n in self.select(e[1]) if all(self.holds(w, n) for w in e[2])}
        first = e.steps[0]
        at = {n for n, r in self.rows.items() if (first.axis == "descendant" or r[7] < 0) and self.fits(first, n)}
        return self.walk(e.steps[1:], at)


def trees(spark, n=5, size=40):
    rng = np.random.default_rng(12)
    out = []
    for s in range(n):
        rows, stack = [], []
        for pre in range(size):
            while len(stack) > 1 and rng.random() < 0.45:
                stack.pop()
            parent = stack[-1] if stack else -1
            order = sum(r[7] == parent for r in rows)
            tag = "root" if parent < 0 else str(rng.choice(["e", "e", "a", "b", "OP-X"]))
            rows.append(["p", None if s % 2 else "1", f"f{s}", "R", s, pre, 0, parent, order, tag, None if tag in ("e", "root") else str(rng.choice(["x", "y", "it's", "a\\b", "long text"]))])
            for up in stack:
                rows[up][6] += 1
            stack.append(pre)
        out.append(rows)
    return out, spark.createDataFrame([tuple(r) for rows in out for r in rows], NODES)


EXPRESSIONS = [
    "//a", "/root/e", "//e[a]", "//e[not(a)]", "//e[a and not(b)]", "//e[a or b[text() = 'x']]", "//a[text() = 'x' and not(preceding-sibling::OP-X)]", "//e[.//a[text() = \"it's\"]]", "//e[not(.//a) and not(.//b)]",
    "//a | //b[text() != 'x']", "(//a | //e)[preceding-sibling::e]", "//e[e/a[contains(text(), 'o')]]", "//e[e[1]/a or e[2]//b]", "//e[2][a]", "//*[3]", "//b[following-sibling::a[text() = 'y']]", "//a[ancestor::e[b]]", "//a[../b]",
    "//e[not(e/a/preceding-sibling::OP-X)]", "//e/a[1]", "//e//b[string-length(text()) < 4]", "//a[starts-with(text(), 'lo') or text() = 'a\\b']", "//e[a = 'x']", "//e[e/a/text() != 'x']", "//e[not(a or (b and not(OP-X)))]",
    "//e[(a | b)[1] or true()]", "//*[self::a or self::b][text()]", "//e[descendant::a and child::b]", "//a[not(text() = 'x') and ../../e[2][not(preceding-sibling::b)]/a]", "//e[. = '' and not(false())]", "//nothing", "//a/..",
]


def test_plans_select_what_a_walk_selects(spark):
    rows, df = trees(spark)
    df = df.persist()
    walked = 0
    parts = None
    wanted = set()
    for i, text in enumerate(EXPRESSIONS):
        try:
            e = xpath.parse(text)
        except XPathError:
            assert "(a | b)[1]" in text
            continue
        got = select(df, text).selectExpr(f"{i} AS i", "seg_ord", "pre")
        parts = got if parts is None else parts.union(got)
        here = {(i, s, n) for s, r in enumerate(rows) for n in Tree(r).select(e)}
        wanted |= here
        walked += bool(here)
    found = [tuple(r) for r in parts.collect()]
    assert len(found) == len(set(found)) and {x for x in wanted ^ set(found)} == set() and walked >= 27


@pytest.mark.parametrize("text, why", [
    ("", "expected"), ("//", "expected"), ("//a[", "expected"), ("a", "begins with"), ("//a[//b]", "from the root"), ("//a[count(b) = 1]", "count"), ("//a[last()]", "last"), ("//a[@x]", "@"), ("//a[b[text()][1]]", "position"),
    ("//a[namespace::x]", "namespace"), ("//a]", "unexpected"), ("'x'", "not a set"), ("//a[contains(text())]", "takes 2"), ("//a[text() = ]", "expected"), ("//a/text()", "text"), ("//a[preceding-sibling::b[1]]", "position"), ("//a[3 + 4]", "unexpected|expected"),
    ("//a[contains(b, 'x')]", "value"), ("//a § b", "unexpected"),
])
def test_refused(text, why):
    with pytest.raises(XPathError, match=why):
        xpath.parse(text)


def test_built_in_rules_said_in_xpath_hold_for_the_same_code(spark):
    from surfacescan.virtual import CODE

    rules = default_rules()
    segments = spark.createDataFrame([("p", None, str(i), "R_scripts", 0, "R", code.split("\n")) for i, (_, path, code, _) in enumerate(CODE) if path == ".R"], "package string, version string, file_context string, rule string, seg_ord int, language string, lines array<string>")
    nodes = parse_segments(segments).where("pre IS NOT NULL").persist()
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    one, two = (rows(patterns.find_patterns(nodes, r), "found", "file_context", "pre") for r in (rules, in_xpath(rules)))
    assert one == two and len(one) > 30
    one, two = (rows(patterns.find_code_contexts(nodes, r), "context", "file_context", "pre") for r in (rules, in_xpath(rules)))
    assert one == two and len(one) >= 6


def test_examples_of_rules(spark):
    rules = default_rules()
    fine = {"name": "stew", "version": "0.4.0", "message": "m", "attck": "T1", "functions": ["stew"], "xpath": "//SYMBOL_FUNCTION_CALL[text() = 'stew' and not(preceding-sibling::OP-DOLLAR)]", "positive_examples": ["stew(1)", "a::stew()"], "negative_examples": ["x$stew()", "stews()"]}
    odd = fine | {"name": "odd", "functions": ["stew", "brew"], "positive_examples": ["brew()"], "negative_examples": ["stew()"]}
    rules.patterns += [fine, odd]
    rules.code_contexts.append({"name": "hook", "version": "0.4.0", "message": "m", "kind": "xpath", "how": "xpath", "target": "", "xpath": "//expr[LEFT_ASSIGN and expr[1]/SYMBOL[text() = 'hook'] and expr[FUNCTION]]", "positive_examples": ["hook <- function() 1"], "negative_examples": ["hook <- 1", "nook <- function() 1"]})
    assert sorted(broken_examples(spark, rules)) == [("odd", "functions", "brew()"), ("odd", "negative_examples", "stew()"), ("odd", "positive_examples", "brew()")]
