"""Files of package trees: (package, version, file_context, bytes, content, is_symlink)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.paths import SCAN_LIMIT
from ..schemas import FILES
from .folder import NAME, FolderSource, Wanted


def read_tree(
    spark: SparkSession, root: str, package: str | None = None, limit: int = SCAN_LIMIT, content: bool = True, splits: int | None = None, packages: list[str] | None = None, match: str | None = None, largest: int | None = None
) -> DataFrame:
    """All files below a root, one package; without a name, each folder below the root is a package, and files beside these belong to the package ".".

    Everything is listed, hidden files too; `problem` says why a row has no content. Content above the
    limit is not read, nor is any without `content`; links are rows and never followed. Of the packages,
    paths (an expression found in them) and lengths that are asked for, no others are listed or opened.
    """
    spark.dataSource.register(FolderSource)
    options = {"limit": str(limit), "content": str(content).lower(), **Wanted.options(packages, match, largest)}
    options |= {} if package is None else {"package": package}
    options |= {} if splits is None else {"splits": str(splits)}
    return spark.read.format(NAME).options(**options).load(root)


def from_memory(spark: SparkSession, packages: dict[str, dict[str, list[str] | str | bytes]], version: str | None = None) -> DataFrame:
    """Packages given as {package: {path: lines, text or bytes}}."""

    def body(x: list[str] | str | bytes) -> bytes:
        return x if isinstance(x, bytes) else (x if isinstance(x, str) else "".join(f"{line}\n" for line in x)).encode()

    rows = [(p, version, f, len(body(x)), body(x), False) for p, files in packages.items() for f, x in files.items()]
    return spark.createDataFrame(rows, FILES)
