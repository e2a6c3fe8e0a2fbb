from surfacescan.operators.extract import _rmd, _rnw, _rsp, blank_except, placed, read_lines
from surfacescan.operators.rdsyntax import read_macros, read_page, sexpr_stage

M = lambda: {"errors": []}


def test_rmd_chunks_languages_and_guards():
    lines = ["---", "title: x", "---", "```{r, eval=FALSE}", "system('a')", "```", "", "```{python}", "x = 1", "```", "```{.css}", "a", "```", "```{r}", "#| eval: false", "y", "````", "text `r f(1)` and `r g(2)`", "``r no``"]
    out = _rmd(lines, M())
    assert [s[0] for s in out] == ["R", "python", "R", "R"]
    assert all(len(s[2]) == len(lines) for s in out)
    assert out[0][2][4] == "system('a')" and out[0][3] == [5] and out[2][3] == [15, 16]
    assert out[3][2][17] == " " * 8 + "f(1)" + ";" + " " * (lines[17].index("g(2)") - 13) + "g(2)" and not out[3][2][18]


def test_rmd_unterminated_and_quoted():
    assert _rmd(["> ```{r}", "> x <- 1"], M())[0][2] == ["", "  x <- 1"]


def test_rnw():
    out = _rnw(["text \\Sexpr{f(1)} more", "<<a, eval=FALSE>>=", "system('x')", "@ ", "<<b>>=", "y"], M())
    assert out[0][2] == [" " * 12 + "f(1)", "", "system('x')", "", "", "y"] and out[0][3] == [3]


def test_rsp():
    out = _rsp(["a <%= f(1) %> b <% g() -%>", "<%-- gone --%><%@ x %>", "<% open", "to the end"], M())
    body = out[0][2]
    assert "f(1)" in body[0] and ";" in body[0] and body[0].index("g()") == len("a <%= f(1) %> b <% ") and body[1] == "" and body[2] == "   open" and body[3] == "to the end"


def test_rd_sections_and_guards():
    page = ["\\name{x}", "\\description{\\Sexpr[stage=build]{b()} and \\Sexpr{i()}}", "\\examples{", "f(1) % note", "\\dontrun{", "g(\"}\")", "}", "h(\\dots)", "}"]
    found, problem = read_page(page)
    by = {label: (lines, guarded) for label, lines, guarded in found}
    assert problem is None and set(by) == {"Rd_examples", "Rd_Sexpr_build", "Rd_Sexpr_install"}
    assert by["Rd_examples"][0][3].strip() == "f(1)" and 'g("}")' in by["Rd_examples"][0][5] and 6 in by["Rd_examples"][1] and by["Rd_examples"][0][7] == "h(...)"
    assert by["Rd_Sexpr_build"][0][1].strip() == "b()" and by["Rd_Sexpr_build"][0][1].index("b()") == page[1].index("b()")


def test_rd_damage_keeps_what_was_read():
    found, problem = read_page(["\\examples{", "f(1)"])
    assert problem and found[0][1][1] == "f(1)"


def test_rd_macros_and_stage():
    macros = read_macros("\\newcommand{\\now}{\\Sexpr[stage=render]{Sys.time()}}")
    assert read_page(["\\now text"], macros)[0][0][0] == "Rd_Sexpr_render"
    assert [sexpr_stage(x) for x in ("stage=build", "results=hide", "stage = Render", "stage=other")] == ["build", "install", "render", "install"]


def test_rd_macros_with_arguments_and_nesting():
    macros = read_macros("% help\n\\newcommand{\\go}{\\Sexpr[stage=build]{f(#1)}}\n\\newcommand{\\two}{\\go{#2} and \\go{#1}}\n\\newcommand{\\calm}{nothing}")
    code, problem = read_page(["\\two{a}{b} \\calm", "\\examples{", "x <- 1", "\\go{z}", "}"], macros)
    assert problem is None and code[1] == ("Rd_Sexpr_build", ["f(b); f(a)", "", "", "f(z)", ""], [])
    assert code[0][1][2] == "x <- 1"
    # A page's own definition, and an argument that is not given.
    assert read_page(["\\newcommand{\\q}{\\Sexpr{g(#1)}}", "\\q"])[0][0][1] == ["", "g()"]


def test_rd_macros_without_an_end_and_unknown_ones():
    assert read_page(["\\a"], {"a": "\\a"})[1] == "macros are used without an end"
    assert read_page(["\\a"], {"a": "\\b\\b", "b": "\\c\\c"} | {x: f"\\{y}\\{y}" for x, y in zip("cdefghijklm", "defghijklmn")} | {"n": "x"})[1] == "macros are used without an end"
    code, problem = read_page(["\\lifecycle{x} \\S3method{print}{y} \\code{'\\d'} \\emph{z}", "\\insertRef{a}{b} \\lifecycle{x} \\usage{f('\\w')}"])
    assert code == [] and problem == "unknown macro '\\lifecycle'; unknown macro '\\insertRef'"


def test_lines():
    assert read_lines(b"a\r\nb\rc\n") == (["a", "b", "c"], None)
    assert read_lines(b"a\n\xff\nb")[0] == ["a", "", "b"] and read_lines(b"\xff")[1]
    assert blank_except(["a", "b"], {2}) == ["", "b"] and placed([(2, "x"), (6, "y")]) == "  x;  y"
