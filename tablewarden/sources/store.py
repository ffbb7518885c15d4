"""Current and archive stores.

* ``current``: ``<root>/run=<yyyyMMdd_HHmmss>/`` Parquet, committed by a claim on its
  base in ``<root>/commits``; each backup or restore writes a new run and readers take
  the latest committed one, so the table is never overwritten while it is read, a
  failed write leaves the old run, and of two runs from one base one is refused.
* ``archive``: ``<root>`` Parquet appended per run, partitioned by
  ``archive_date`` (string ``yyyyMMdd``) so a date filter prunes folders; the
  record key stays a column (per-key folders would make many tiny files).
* Version files: ``<key>_<yyyyMMdd_HHmmss>.json`` read whole with
  ``wholetext`` and named by ``_metadata.file_name``.

Writes are idempotent per ``run_ts``: a retried run overwrites its own
partition/run folder only.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.stamps import DATE_FORMAT, STAMP_FORMAT, parse_version_file

CURRENT_SCHEMA = "record_key STRING, body STRING, saved_at TIMESTAMP_NTZ"
_COMPACTED = "compacted_"
ARCHIVE_SCHEMA = "record_key STRING, version_ts TIMESTAMP_NTZ, body STRING, archive_date STRING"


def _stamp(run_ts: datetime) -> str:
    return run_ts.strftime("%Y%m%d_%H%M%S")


def _commits(root: str) -> str:
    return f"{root}/commits"


class ConflictError(RuntimeError):
    """Another run has been committed on the same base."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _claim(spark: SparkSession, root: str, base: str | None, run: str) -> None:
    """Commit ``run`` as the successor of ``base``: the claim is a file named by the base,
    created only if it is not there (as exclusive as the store's own create). A run that
    holds its claim already, as a retried one does, is committed."""
    fs, path = _path(spark, f"{_commits(root)}/after-{base or 'none'}")
    try:
        out = fs.create(path, False)
    except Exception as e:
        if not fs.exists(path):
            raise
        holder = spark.read.text(path.toString()).first()
        if holder is None or holder[0] != run:
            raise ConflictError(f"{base or 'the empty store'} already has a successor, {holder and holder[0]}; {run} is refused") from e
        return
    try:
        out.write(bytearray(run.encode()))
    finally:
        out.close()


def write_current(df: DataFrame, root: str, run_ts: datetime, base=...) -> str:
    """Write a complete current snapshot as a new run folder, then commit it as
    the successor of ``base``, the run it was made from (None: there was none; left out:
    the newest older run). Of two runs made from one base the second is refused with
    :class:`ConflictError`, and its folder is never read. A retried run commits the same."""
    spark, run = df.sparkSession, f"run={_stamp(run_ts)}"
    if base is ...:
        base = max((r for r in committed_runs(spark, root) if r < run), default=None)
    path = f"{root}/{run}"
    df.select("record_key", "body", "saved_at").hint("rebalance").write.mode("overwrite").parquet(path)
    _claim(spark, root, base, run)
    return path


def committed_runs(spark: SparkSession, root: str) -> list[str]:
    """Names of the committed runs under ``root``, oldest first: one short string a
    run (metadata, not data)."""
    try:
        rows = spark.read.text(_commits(root)).distinct().collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r[0] for r in rows)


def read_current(spark: SparkSession, root: str, before: datetime | None = None) -> DataFrame:
    """The latest committed run (runs are named by their stamp, so the
    lexicographic maximum is the newest); only that folder is read.

    ``before``: only runs stamped earlier count. A job that writes run ``T``
    should read its base with ``before=T``: if it is retried after writing,
    it still reads the same base and writes the same output.
    Raises ``FileNotFoundError`` when no run qualifies."""
    runs = committed_runs(spark, root)
    if before is not None:
        runs = [r for r in runs if r < f"run={_stamp(before)}"]
    if not runs:
        raise FileNotFoundError(f"no committed current run under {root}")
    return spark.read.schema(CURRENT_SCHEMA).parquet(f"{root}/{runs[-1]}")


def write_archive(df: DataFrame, root: str, run_ts: datetime) -> None:
    """Add archived versions, partitioned by ``archive_date`` and ``run``.

    Dynamic partition overwrite replaces only this run's folders, so a retried
    run is idempotent and other runs of the same day are untouched.
    """
    (df.select("record_key", "version_ts", "body", "archive_date", F.lit(_stamp(run_ts)).alias("run"))
     # few files a folder; AQE splits a date that holds most rows
     .hint("rebalance", "archive_date")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("archive_date", "run").parquet(root))


def _compactions(spark: SparkSession, root: str) -> dict[str, set[str]]:
    """Committed compactions and the runs each replaced (one short row a run)."""
    try:
        rows = spark.read.schema("compacted STRING, replaced STRING").parquet(f"{root}/_compactions").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    out: dict[str, set[str]] = {}
    for r in rows:
        out.setdefault(r.compacted, set()).add(r.replaced)
    return out


def _live_archive(spark: SparkSession, root: str) -> DataFrame:
    """Archive rows with ``run``: replaced runs and compactions that were not committed
    are pruned by their folders."""
    done = _compactions(spark, root)
    replaced = sorted(set().union(*done.values()))
    df = spark.read.schema(ARCHIVE_SCHEMA + ", run STRING").parquet(root)
    live = ~F.col("run").startswith(_COMPACTED) | F.col("run").isin(sorted(done))
    return df.filter(live & ~F.col("run").isin(replaced)) if replaced else df.filter(live)


def compact_archive(spark: SparkSession, root: str, run_ts: datetime) -> list[str]:
    """Rewrite the folders of all live runs into few files a date. The new folders
    count from the commit on (one write of the list of replaced runs), the old ones no
    more; reads give the same rows before, during and after. Returns the replaced runs.
    A retried compaction that was committed does nothing."""
    name = _COMPACTED + _stamp(run_ts)
    if name in _compactions(spark, root):
        return []
    live = _live_archive(spark, root)
    runs = sorted(r[0] for r in live.select("run").distinct().collect())
    rows = live.filter(F.col("run").isin(runs)).drop("run")
    (rows.withColumn("run", F.lit(name)).hint("rebalance", "archive_date")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("archive_date", "run").parquet(root))
    done = spark.createDataFrame([(name, r) for r in runs], "compacted STRING, replaced STRING")
    done.coalesce(1).write.mode("append").parquet(f"{root}/_compactions")
    return runs


def drop_archive_run(spark: SparkSession, root: str, run_ts: datetime) -> None:
    """Take back what a refused run has added to the archive."""
    fs, pattern = _path(spark, f"{root}/archive_date=*/run={_stamp(run_ts)}")
    for status in fs.globStatus(pattern) or []:
        fs.delete(status.getPath(), True)


def read_archive(spark: SparkSession, root: str, *, date_from: str | None = None,
                 date_to: str | None = None) -> DataFrame:
    """Archive rows; the optional ``yyyyMMdd`` bounds prune partitions. The
    partition columns are typed string (``20250814`` would infer as an int)."""
    df = _live_archive(spark, root)
    if date_from:
        df = df.filter(F.col("archive_date") >= date_from)
    if date_to:
        df = df.filter(F.col("archive_date") <= date_to)
    return df.drop("run")


def _file_name() -> Column:
    """The file's name as it is: the metadata column escapes it as a URL does (a plus
    sign stands for itself there)."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def read_version_files(spark: SparkSession, path: str) -> DataFrame:
    """``(record_key, version_stamp, version_ts, body, file_name)`` from a
    folder tree of ``<key>_<stamp>.json`` files; other files are ignored."""
    df = (spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true")
          .text(path, wholetext=True))
    named = df.select(F.col("value").alias("body"), _file_name().alias("file_name"))
    parsed = named.select("*", parse_version_file(F.col("file_name")).alias("p"))
    return parsed.filter(F.col("p.record_key").isNotNull()).select(
        F.col("p.record_key").alias("record_key"), F.col("p.version_stamp").alias("version_stamp"),
        F.try_to_timestamp(F.col("p.version_stamp"), F.lit(STAMP_FORMAT)).cast("timestamp_ntz")
        .alias("version_ts"), "body", "file_name")


def read_documents(spark: SparkSession, path: str, key_from_name: bool = True) -> DataFrame:
    """One JSON document per file ``<key>.json`` → ``(record_key, body)``."""
    df = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true") \
        .text(path, wholetext=True)
    out = df.select(F.col("value").alias("body"), _file_name().alias("file_name"))
    if key_from_name:
        out = out.withColumn("record_key", F.regexp_extract("file_name", r"^(.*)\.json$", 1))
    return out


__all__ = ["ConflictError", "DATE_FORMAT", "committed_runs", "compact_archive", "drop_archive_run", "read_archive", "read_current",
           "read_documents", "read_version_files", "write_archive", "write_current"]
