"""The driver's tables seen as packages, lines, findings and nodes, so that the operators can run on them and be checked by SQL.

Each package holds a document at each path of PATHS, and every file rule claims one of these. Every view has a Spark form and a DuckDB form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .functions.lineage import scratch
from .schemas import PHASES

PATHS = (
    "R/code.R", "man/page.Rd", "vignettes/intro.Rmd", "src/code.c", "src/Makevars", "configure", "data/set.rda", "tests/testthat/test-a.R", "exec/run.sh", "inst/www/app.js", "misc/notes.R",
    "DESCRIPTION", "inst/img.png", "cleanup", "src/deep/util.cpp", ".Rprofile", "misc/configure", "README.md", "inst/CITATION", "tools/x.py", "demo/d.R", "R/sysdata.rda", "src/Makefile.win", ".git/config",
    "R/unix/u.R", "R/windows/w.R", "cleanup.ucrt", "cleanup.win", "configure.ac", "configure.in", "configure.ucrt", "configure.win", "data/make.R", "exec/tool.py", "exec/tool.R", "inst/tests/t.R", "inst/tinytest/t.R",
    "inst/unitTests/t.R", "man/unix/u.Rd", "man/windows/w.Rd", "src/install.libs.R", "src/Makefile", "src/Makefile.ucrt", "src/Makevars.in", "src/Makevars.ucrt", "src/Makevars.win", "tests/all.R", "tools/build.R",
    "vignettes/book.qmd", "vignettes/old.Rnw", "vignettes/page.rsp",
)
N = len(PATHS)
#: One line finding of each rule, by the remainder of (31 * doc_id + line) that gets it appended; the last is none.
SNIPPETS = (
    ("chmod", "chmod 777 f"), ("credentials", ".netrc"), ("curl", "curl -s x"), ("decoding", "base64 --decode f"), ("install", "pip install x"), ("interpreter", "python x"), ("persistence", "crontab"),
    ("rscript", "Rscript a"), ("socket", "ncat h"), ("transfer", "scp a b"), ("wget", "wget x"), (None, "-lcurl"),
)
EVERY = 19
LINE_SPLIT = "\r\n|\n|\r"


def _case(subject: str, pairs: list[tuple[object, str]], other: str) -> str:
    return f"CASE {subject} " + " ".join(f"WHEN {k} THEN {v}" for k, v in pairs) + f" ELSE {other} END"


_PATHS = ", ".join(f"'{p}'" for p in PATHS)
PATH, PATH_DUCK = f"element_at(array({_PATHS}), CAST(doc_id % {N} AS INT) + 1)", f"list_extract([{_PATHS}], doc_id % {N} + 1)"
INJECTED = _case("(doc_id * 31 + n) % 19", [(i, f"concat(line, ' && {s}')") for i, (_, s) in enumerate(SNIPPETS)], "line")

_TAILS = f"array({', '.join(f"' && {s}'" for _, s in SNIPPETS)})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        f"concat(source, '-', doc_id DIV {N}) AS package", "CAST(NULL AS STRING) AS version", f"{PATH} AS file_context", "CAST(octet_length(text) AS BIGINT) AS bytes", "CAST(text AS BINARY) AS content",
        "doc_id % 97 = 5 AS is_symlink", "doc_id", "text",
    )


VFILES = f"vfiles AS (SELECT concat(source, '-', doc_id // {N}) AS package, {PATH_DUCK} AS file_context, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, doc_id % 97 = 5 AS is_symlink, doc_id, text FROM documents)"


#: A document's path in vtree(): every third one's name begins with an underscore.
TREE_PATH = "CASE WHEN doc_id % 3 = 0 THEN regexp_replace(file_context, '([^/]+)$', '_{group}') ELSE file_context END"


def vtree(spark: SparkSession, sf_dir: str) -> str:
    """The root of a folder tree, below the shared scratch folder, with every document as a file."""
    root = scratch(spark, "tree")

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(root)
        for b in it:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store.create_dir(f"{top}/{path}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{top}/{path}") as f:
                    f.write(content)
            yield b.select([0])

    rows = vfiles(spark, sf_dir).selectExpr(f"concat(package, '/', {TREE_PATH.format(group='$1')}) AS path", "content").where("content IS NOT NULL")
    rows.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    return root


VTREE = f"vtree AS (SELECT package, {TREE_PATH.format(group=chr(92) + '1')} AS file_context, bytes, text FROM vfiles WHERE text IS NOT NULL)"


def vsegments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a shell segment with findings put at the ends of lines."""
    rows = vfiles(spark, sf_dir).selectExpr("package", "version", "file_context", "doc_id", "split(text, '\\r\\n|\\n|\\r', -1) AS parts")
    rows = rows.selectExpr("package", "version", "file_context", "doc_id", "slice(parts, 1, size(parts) - IF(element_at(parts, -1) = '', 1, 0)) AS raw")
    return rows.selectExpr("package", "version", "file_context", "'shell' AS language", f"transform(raw, (line, i) -> concat(line, coalesce(get({_TAILS}, CAST((doc_id * 31 + i + 1) % 19 AS INT)), ''))) AS lines", "doc_id")


VLINES = f"""raw_lines AS (
  SELECT package, file_context, doc_id, string_split(replace(replace(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM vfiles WHERE text <> ''),
numbered AS (SELECT package, file_context, doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS line FROM raw_lines),
vlines AS (SELECT package, file_context, doc_id, CAST(n AS INTEGER) AS line_number, {INJECTED} AS line, line AS plain, CAST((doc_id * 31 + n) % 19 AS INTEGER) AS k FROM numbered)"""


def vfindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made of events: rule, file, position, context and phases by their numbers."""
    phases = [f"event_id % {i + 3} = 0 AND event_id % 7 <> 3 AS {p}" for i, p in enumerate(PHASES)]
    return table(spark, sf_dir, "events").selectExpr(
        "concat('p', user_id % 40) AS package", "CAST(NULL AS STRING) AS version", "event_type AS rule", "concat('R/', user_id % 11, '.R') AS file_context", "CAST(event_id % 50 AS INT) AS line_number",
        "CAST(event_id % 9 AS INT) AS column_number", "CASE WHEN event_id % 5 = 0 THEN 'top_level' WHEN event_id % 5 = 1 THEN 'in_function' ELSE 'onLoad_base' END AS code_context", "event_id % 2 = 0 AS guarded",
        "event_id % 3 = 0 AS indirect", "concat('call ', event_id % 4) AS preview", "concat('does ', event_type) AS message", "concat('T', length(event_type)) AS attck", *phases, "event_id",
    )


VFINDINGS = (
    "vfindings AS (SELECT concat('p', user_id % 40) AS package, event_type AS rule, concat('R/', user_id % 11, '.R') AS file_context, CAST(event_id % 50 AS INTEGER) AS line_number, CAST(event_id % 9 AS INTEGER) AS column_number, "
    "CASE WHEN event_id % 5 = 0 THEN 'top_level' WHEN event_id % 5 = 1 THEN 'in_function' ELSE 'onLoad_base' END AS code_context, event_id % 2 = 0 AS guarded, event_id % 3 = 0 AS indirect, "
    "concat('call ', event_id % 4) AS preview, concat('does ', event_type) AS message, concat('T', length(event_type)) AS attck, "
    + ", ".join(f"event_id % {i + 3} = 0 AND event_id % 7 <> 3 AS {p}" for i, p in enumerate(PHASES))
    + ", event_id FROM events)"
)

_TEXTS = ("eval", "parse", "readRDS", "system", "options", "f")
_TEXT = _case("(l_orderkey + l_linenumber) % 6", [(i, f"'{t}'") for i, t in enumerate(_TEXTS[:-1])], "'f'")
_NODE = (
    "concat('s', l_suppkey) AS file_context, 'R_scripts' AS rule, 0 AS seg_ord, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS INT) AS pre, "
    f"CAST(l_quantity AS INT) AS size, l_linenumber AS ord, l_returnflag AS flag, {_TEXT} AS text, l_discount > 0.05 AS after_dollar, l_tax > 0.06 AS after_at, l_linestatus = 'O' AS in_function"
)


def vnodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as syntax nodes: a supplier is a segment, a quantity the size of a subtree."""
    return table(spark, sf_dir, "lineitem").selectExpr("'p' AS package", "CAST(NULL AS STRING) AS version", *_split(_NODE))


def _split(columns: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


VNODES = f"vnodes AS (SELECT 'p' AS package, {_NODE} FROM lineitem)"


#: R code at a path (before and after the number of its document) with the findings that it must give: rule, line, column, code context, whether indirect.
CODE = [
    *(("tests/f", ".R", f"x <- {f}(y)", [(rule, 1, 6, "top_level", False)]) for rule, f in (
        ("chmod", "Sys.chmod"), ("curl", "curl_download"), ("decoding", "base64decode"), ("deserialization", "readRDS"), ("download_file", "download.file"), ("dynload", "dyn.load"), ("fs", "file_chown"),
        ("httr", "POST"), ("httr2", "req_perform"), ("install", "install.packages"), ("namespace", "unlockBinding"), ("python", "py_eval"), ("rcurl", "getForm"), ("socket", "make.socket"), ("source", "source"),
        ("system", "system2"), ("system_callr", "r_bg"), ("system_sys", "exec_wait"))),
    ("tests/f", ".R", "rawToChar(as.raw(c(1, 2)))", [("decoding", 1, 1, "top_level", False)]),
    ("tests/f", ".R", "1\neval(parse(text = rawToChar(x)))", [("eval_parse", 2, 1, "top_level", False)]),
    ("tests/f", ".R", "options(repos = c(a = 'b'))", [("options_repos", 1, 1, "top_level", False)]),
    ("tests/f", ".R", "y <- '~/.bashrc'", [("persistence", 1, 6, "top_level", False)]),
    ("tests/f", ".R", "k = Sys.getenv('GITHUB_TOKEN')", [("credentials", 1, 5, "top_level", False)]),
    ("tests/f", ".R", "process$new('a')", [("system_processx", 1, 1, "top_level", False)]),
    ("tests/f", ".R", "y |> lapply(X = _)\nsystem('a')", [("system", 2, 1, "top_level", False)]),
    ("tests/f", ".R", "x$system('a'); install('x'); eval(x); list(digits = 3)", []),
    ("tests/f", ".R", "do.call('system', list('a'))", [("system", 1, 9, "top_level", True)]),
    ("tests/f", ".R", "match.fun(FUN = 'unserialize')(y)", [("deserialization", 1, 17, "top_level", True)]),
    ("R/f", ".R", "g <- function(a) {\n  url(a)\n}", [("download_file", 2, 3, "in_function", False)]),
    *(("R/f", ".R", f"{name} <- function(l, p) {{\n  system('x')\n}}", [("system", 2, 3, context, False)]) for name, context in (
        (".onLoad", "onLoad_base"), (".onAttach", "onAttach_base"), (".onDetach", "onDetach_base"), (".onUnload", "onUnload_base"), (".Last.lib", "LastLib_base"))),
    ("R/f", ".R", "on_load(\n  source('x'))", [("source", 2, 3, "on_load_rlang", False)]),
    ("man/f", ".Rd", "\\name{f}\n\\examples{\nunserialize(u)\n}", [("deserialization", 3, 1, "Rd_examples", False)]),
    *(("man/f", ".Rd", f"\\name{{f}}\n\\description{{\n\\Sexpr[stage={stage}]{{GET(u)}}\n}}", [("httr", 3, 16 + len(stage), f"Rd_Sexpr_{stage}", False)]) for stage in ("build", "install", "render")),
    ("vignettes/f", ".Rmd", "text\n```{r}\nsystem('a')\n```", [("system", 3, 1, "top_level", False)]),
    ("vignettes/f", ".qmd", "```{r}\n#| echo: false\nshell('a')\n```", [("system", 3, 1, "top_level", False)]),
    ("vignettes/f", ".Rnw", "<<>>=\npipe('a')\n@", [("system", 2, 1, "top_level", False)]),
    ("vignettes/f", ".rsp", "a <% source('b') %>", [("source", 1, 6, "top_level", False)]),
]


def vcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file with one of the pieces of CODE, a hundred to a package."""
    texts = spark.createDataFrame([(k, a, b, code) for k, (a, b, code, _) in enumerate(CODE)], "k int, a string, b string, code string")
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"CAST(doc_id % {len(CODE)} AS INT) AS k").join(texts, "k")
    return rows.selectExpr(
        "concat('p', doc_id DIV 100) AS package", "CAST(NULL AS STRING) AS version", "concat(a, doc_id, b) AS file_context", "CAST(octet_length(code) AS BIGINT) AS bytes", "CAST(code AS BINARY) AS content", "false AS is_symlink"
    )
