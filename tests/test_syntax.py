import pytest

from surfacescan.operators.rsyntax import RSyntaxError, parse, rows, tokens

GOOD = [
    "x <- function(a, b = 2, ...) { a + b }", "function(x) x -> y", "if (a) b else c", "{\nif (a)\n b\nelse c\n}", "x[[1]][2, , drop = FALSE]", "a %in% b |> f()", "\\(x) x^-2",
    'r"(a "quoted" )" -> z', "for (i in 1:10) { next }", "while (TRUE) break", "repeat { x }", "-1:3", "!a && b || c", "y ~ x + z", "~ x", "x$`a b`@c", '"f"(1)', "x <<- 1; y := 2",
    "f(a = , b)", "f(\n a,\n b\n)", "f(if (a) b else c)", "?help", "a::b$c()", "f(x)(y)", "", "# only\n", "0x1FL; 1e-3; 5i", "function(x, y = function(z) z) NULL", "if (a) x = 1",
]
BAD = ["x <- ", "f(", "a b", "1 +* 2", ")", "function x", '"abc', "a < b < c", "if (a) b\nelse c", "{", "f(a b)", "x$1", 'r"(open']


@pytest.mark.parametrize("text", GOOD)
def test_accepts(text):
    n = list(rows(parse(text)))
    assert [r[0] for r in n] == list(range(len(n)))
    for r in n:  # a subtree is a range, and a child lies in its parent's
        assert r[0] + r[1] < len(n) and (r[2] < 0 or n[r[2]][0] < r[0] <= n[r[2]][0] + n[r[2]][1])


@pytest.mark.parametrize("text", BAD)
def test_refuses(text):
    with pytest.raises(RSyntaxError):
        parse(text)


def tags(text):
    return [(r[6], r[7]) for r in rows(parse(text)) if r[7]]


def test_calls_and_packages():
    assert ("SYMBOL_FUNCTION_CALL", "f") in tags("p::f(1)") and ("SYMBOL_PACKAGE", "p") in tags("p::f(1)")
    assert ("SYMBOL", "f") in tags("x$f") and ("SYMBOL_FUNCTION_CALL", "f") in tags("x$f()")
    assert ("SYMBOL_SUB", "a") in tags("f(a = 1)") and ("EQ_SUB", "=") in tags("f(a = 1)")


def test_columns_are_characters():
    t = [x for x in tokens("éé <- curl(1)") if x.text == "curl"][0]
    assert (t.line, t.col) == (1, 7)


def test_deep_nesting_is_an_error_not_a_crash():
    with pytest.raises(RSyntaxError):
        parse("(" * 100_000)


def test_pipe_placeholder():
    tree = parse("x |> f(y = _)\nx |> f(y = _) |> g(z = _$a)\nsystem(1)")
    assert [r[7] for r in rows(tree) if r[6] == "SYMBOL_FUNCTION_CALL"] == ["f", "f", "g", "system"]
    for bad in ("_", "f(y = _)", "_ + 1", "x |> f(y = _); _"):
        with pytest.raises(RSyntaxError):
            parse(bad)
