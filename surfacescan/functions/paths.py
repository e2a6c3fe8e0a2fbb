"""Expressions over package-relative paths and file bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension, the languages that are read here, and formats without text.
LANGUAGES = {
    "R": "R r S s q", "Rd": "Rd rd", "Rmd": "Rmd rmd", "qmd": "qmd", "Rnw": "Rnw rnw", "rsp": "rsp", "shell": "sh bash ksh zsh csh",
    "c": "c h", "cpp": "cc cpp cxx hpp hxx ipp", "objc": "m mm", "fortran": "f f90 f95 f03 f77 for", "rust": "rs", "python": "py pyx",
    "js": "js ts", "java": "java", "perl": "pl pm", "ruby": "rb", "lua": "lua",
}
ANALYZED = ("R", "Rd", "Rmd", "qmd", "Rnw", "rsp", "shell")
SERIALIZED = "rda RData Rdata rdata rds Rds RDS rdb rdx".split()
BINARY = (
    "so dll dylib o a obj lib class jar exe png jpg jpeg gif bmp ico pdf eps zip gz bz2 xz tar tgz 7z rar woff woff2 ttf otf eot mo npy nc h5 parquet"
).split()
EXCLUDED = (r"^\.git/", r"^\.Rproj\.user/", r"^renv/library/")
SCAN_LIMIT = 10 * 1024**2


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The part before the last slash; "." at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """After the last dot of the name; a name's leading dot does not count."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def language_of(ext: Column) -> Column:
    out = F.lit(None).cast("string")
    for language, exts in LANGUAGES.items():
        out = F.when(ext.isin(*exts.split()), F.lit(language)).otherwise(out)
    return out


def top_level(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.concat(F.substring_index(path, "/", 1), F.lit("/"))).otherwise(F.lit("."))


def coverage_type(language: Column, path: Column) -> Column:
    return F.coalesce(language, F.nullif(extension(path), F.lit("")), basename(path))


def excluded(path: Column, patterns: tuple[str, ...] = EXCLUDED) -> Column:
    return any_of([path.rlike(p) for p in patterns])


def split_lines(text: Column) -> Column:
    """Lines by LF, CRLF or CR; a final line end adds none."""
    parts = F.split(text, "\r\n|\n|\r", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def relativize(path: Column, root: str) -> Column:
    """The path below root; others unchanged."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def over_limit(size: Column, limit: int = SCAN_LIMIT) -> Column:
    return size > limit


def limit_message(size: Column, limit: int = SCAN_LIMIT) -> Column:
    return F.format_string(f"File is %.0f MB, above the {limit / 1024**2:.0f} MB scanning limit; it was not read.", size.cast("double") / 1024**2)


def lead_of(names: list[str]) -> Column:
    """Whether any of the boolean columns is true."""
    return any_of([F.col(n) for n in names])
