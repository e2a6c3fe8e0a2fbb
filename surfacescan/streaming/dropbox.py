"""A folder that archives or files are dropped into, audited batch by batch; the checkpoint resumes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import SCAN_LIMIT, split_lines
from ..operators.matches import find_matches
from ..plans.corpus import survey
from ..rules import RuleBase, default_rules

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
#: The frames of a survey below the folder it writes to, in the order they are written; FINISHED, the archives of each batch, comes last.
SURVEYED = ("file_contexts", "patterns", "matches", "coverage", "errors", "provenance")
FINISHED = "finished"
_SEEN = ("path", "modificationTime", "length")
#: Archives of one batch, at most.
BATCH_ARCHIVES = 200


def stream_matches(spark: SparkSession, folder: str, rules: RuleBase | None = None, limit: int = SCAN_LIMIT) -> DataFrame:
    """A stream of line findings in shell files dropped below folder/package/: stateless, so any output mode serves.

    Files above the limit are not read; lines that are not valid UTF-8 are left empty.
    """
    rules = rules or default_rules()
    files = spark.readStream.schema(BINARY_FILE).format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= limit)
    parts = F.split("path", "/")
    raw = lambda line: F.encode(line, "ISO-8859-1").cast("string")
    lines = F.transform(split_lines(F.decode("content", "ISO-8859-1")), lambda line: F.when(F.is_valid_utf8(raw(line)), raw(line)).otherwise(""))
    segments = files.select(
        F.element_at(parts, -2).alias("package"), F.lit(None).cast("string").alias("version"), F.element_at(parts, -1).alias("file_context"), F.lit("shell").alias("language"), lines.alias("lines"),
    )
    return find_matches(segments, rules)


def _finished(spark: SparkSession, out: str, run: str, number: int) -> DataFrame | None:
    """The archives that other batches have finished; None while there are none."""
    try:
        return spark.read.parquet(f"{out}/{FINISHED}").where((F.col("run") != run) | (F.col("batch") != number)).select(*_SEEN)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def write_batch(spark: SparkSession, archives: DataFrame, run: str, number: int, out: str, rules: RuleBase | None = None) -> int:
    """Audit the archives (path, modificationTime, length) that no other batch has finished, and write the frames below out/; how many there were.

    Every frame goes to the batch's own folder, out/<frame>/run=<run>/batch=<number>, in place of what an earlier
    try has left there, and the list of finished archives last: a batch that was killed on its way, and
    comes again, leaves nothing twice. Archives are told apart by path, time and length, so that finished
    ones are not opened again.
    """
    done = _finished(spark, out, run, number)
    todo = archives.select(*_SEEN).distinct()
    todo = todo if done is None else todo.join(done, list(_SEEN), "left_anti")
    paths = sorted(r["path"] for r in todo.select("path").collect())  # a batch's archives: a bounded list of names
    if not paths:
        return 0
    found, refused, odd = survey(spark, paths, rules)
    frames = {name: getattr(found, name) for name in SURVEYED[:4]} | {"errors": found.errors.unionByName(refused), "provenance": odd}
    frames[FINISHED] = archives.select(*_SEEN).where(F.col("path").isin(paths)).distinct()
    for name in (*SURVEYED, FINISHED):
        frames[name].write.mode("overwrite").parquet(f"{out}/{name}/run={run}/batch={number}")
    found.release()
    return len(paths)


def stream_archives(spark: SparkSession, folder: str, out: str, checkpoint: str, rules: RuleBase | None = None, available_now: bool = True, archives: int = BATCH_ARCHIVES) -> StreamingQuery:
    """The five frames, and identity mismatches, of every archive that arrives, below out/<frame>/run=<query>/batch=<n>; each batch, of so many archives at most, is one audit plan.

    A batch that comes again replaces what it has written. With a new checkpoint and the same `out`, archives
    that are finished there are left alone.
    """
    source = spark.readStream.schema(BINARY_FILE).format("binaryFile").option("pathGlobFilter", "*.{tar.gz,tgz,tar}").option("maxFilesPerTrigger", archives).load(folder)

    def batch(df: DataFrame, number: int) -> None:
        write_batch(spark, df, df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), number, out, rules)

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
