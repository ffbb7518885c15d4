"""Batch jobs: the operators wired to the stores, as a scheduled run uses them.

Every job takes its run stamp as a parameter (no wall clock inside), reads the
state older than that stamp and writes new folders only, so a retried run
reproduces its own output and never reads what it writes.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.stamps import archive_date
from tablewarden.operators.delete import delete_rows
from tablewarden.operators.normalize import Rewrite, create_from_stored, reset_from_stored
from tablewarden.operators.registry import check_paths, filter_by_tags, select_records
from tablewarden.operators.versions import backup, restore
from tablewarden.sources.store import (
    CURRENT_SCHEMA, ConflictError, committed_runs, drop_archive_run, read_archive, read_current, read_documents,
    read_version_files, write_archive, write_current,
)


def _stamp(run_ts: datetime) -> str:
    return run_ts.strftime("%Y%m%d_%H%M%S")


# Outcomes of a selection that finds nothing, and of a path that can not be used.
NO_JOB_NAMED = "No job found with name: "
NO_JOB_TAGGED = "No jobs found with tags: "
INVALID_PATH = "Skipping invalid path: "


def _base(spark: SparkSession, current_root: str, run_ts: datetime) -> tuple[DataFrame, str | None]:
    """The newest run before ``run_ts`` and its name. Readers take the newest run of all,
    so a run stamped before it would never be read: that is an error."""
    runs, own = committed_runs(spark, current_root), f"run={_stamp(run_ts)}"
    if runs and runs[-1] > own:
        raise ValueError(f"{own} is older than the committed {runs[-1]}")
    older = [r for r in runs if r < own]
    if not older:
        return spark.createDataFrame([], CURRENT_SCHEMA), None
    return read_current(spark, current_root, before=run_ts), older[-1]


@dataclass(frozen=True)
class Report:
    """What a job did: ``counts`` by name, taken while its tables were written, and
    ``problems`` (record_key, error)."""

    counts: Mapping[str, int]
    problems: DataFrame


def _observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` and the observation of its rows, filled by the write that reads it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _rows(seen: Observation) -> int:
    try:
        return seen.get["rows"]
    except Py4JJavaError as e:
        # a plan that turns out empty is cut away together with its observation
        if "AssertionError" not in str(e.java_exception):
            raise
        return 0


def run_backup(spark: SparkSession, captures_path: str, current_root: str, archive_root: str, run_ts: datetime, *,
               listing: DataFrame | None = None, want: Mapping[str, object] | None = None, name: str | None = None,
               record_root: str | None = None) -> Report:
    """Back up captured documents ``<key>.json`` (S2): replaced versions go to
    the archive stamped ``run_ts``, the captures become the current run.

    With ``listing``, only the captures of the jobs selected by ``want`` or ``name`` (see
    :func:`select_stored`). A run that loses its base to another takes its archive rows
    back and raises ``ConflictError``."""
    docs = read_documents(spark, captures_path).select("record_key", "body")
    problems = spark.createDataFrame([], "record_key string, error string")
    if listing is not None:
        chosen = select_stored(listing, docs, want, name=name, record_root=record_root)
        docs, problems = chosen.records, chosen.problems
    saved = F.lit(run_ts.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    base, base_run = _base(spark, current_root, run_ts)
    result = backup(docs.withColumn("saved_at", saved), base, run_ts)
    archive, archived = _observed(result.archive, "archived")
    current, written = _observed(result.current, "current")
    write_archive(archive, archive_root, run_ts)
    try:
        write_current(current, current_root, run_ts, base_run)
    except ConflictError:
        drop_archive_run(spark, archive_root, run_ts)
        raise
    return Report({"archived": _rows(archived), "current": _rows(written)}, problems)


def run_restore(spark: SparkSession, requests: DataFrame, current_root: str, archive_root: str,
                run_ts: datetime, *, date_from: str | None = None) -> DataFrame:
    """Restore the requested versions ``(record_key, restore_stamp)`` into a new
    current run; other current rows stay. Returns the requests that could not
    be served (with the reason)."""
    res = restore(read_archive(spark, archive_root, date_from=date_from), requests, run_ts)
    base, base_run = _base(spark, current_root, run_ts)
    restored = res.current.select("record_key", "body", "saved_at")
    kept = base.join(restored.select("record_key"), "record_key", "left_anti")
    write_current(kept.unionByName(restored), current_root, run_ts, base_run)
    return res.missing


def run_restore_selected(spark: SparkSession, listing: DataFrame, current_root: str, archive_root: str, run_ts: datetime, *,
                         want: Mapping[str, object] | None = None, name: str | None = None, stamp: str | None = None,
                         record_root: str | None = None) -> DataFrame:
    """Restore the jobs selected by ``want`` or ``name`` to the version ``stamp`` (the latest
    without it). Returns ``(record_key, requested_stamp, error)`` of what was not served."""
    chosen = select_stored(listing, _base(spark, current_root, run_ts)[0], want, name=name, record_root=record_root)
    requests = chosen.records.select("record_key", F.lit(stamp).cast("string").alias("restore_stamp"))
    missing = run_restore(spark, requests, current_root, archive_root, run_ts)
    return missing.unionByName(chosen.problems.select("record_key", F.lit(stamp).cast("string").alias("requested_stamp"), "error"))


def run_version_import(spark: SparkSession, files_path: str, archive_root: str, run_ts: datetime) -> DataFrame:
    """S6 into S10: a tree of version files ``<key>_<stamp>.json`` becomes archive
    rows of their own stamps, so a restore can serve them. Returns the files whose
    stamp is no time; those are left out."""
    files = read_version_files(spark, files_path)
    good = files.filter(F.col("version_ts").isNotNull())
    write_archive(good.select("record_key", "version_ts", "body", archive_date(F.col("version_ts")).alias("archive_date")),
                  archive_root, run_ts)
    return files.filter(F.col("version_ts").isNull()).select("file_name")


@dataclass(frozen=True)
class Selection:
    """Stored records an operation works on: ``records`` (record_key, body), ``skipped``
    (job_id, job_name, reason), and ``problems`` (record_key, error): a selection that
    found nothing, and records whose path can not be used."""

    records: DataFrame
    skipped: DataFrame
    problems: DataFrame


def select_stored(listing: DataFrame, current: DataFrame, want: Mapping[str, object] | None = None, *,
                  name: str | None = None, record_root: str | None = None) -> Selection:
    """The records an operation works on. Records belong to jobs by name.

    ``name``: single mode, the job that :func:`select_records` picks for the name (an
    exact one first, then the lowest id). ``want``: the listed jobs whose stored
    configuration has all these tags. Neither: every stored record. With
    ``record_root``, records whose path ``<record_root><key>/`` is invalid (F10) are left
    out and reported."""
    spark = current.sparkSession
    skipped = listing.select("job_id", "job_name", F.lit(None).cast("string").alias("reason")).limit(0)
    records, what = current.select("record_key", "body"), None
    if name is not None:
        picked = select_records(listing, spark.createDataFrame([(name,)], "name string")).filter("selected").select(F.col("job_name").alias("_name")).distinct()
        records, what = records.join(picked, F.col("record_key") == F.col("_name"), "left_semi"), NO_JOB_NAMED + name
    elif want is not None:
        stored = current.select(F.col("record_key").alias("_key"), "body")
        configs = listing.select("job_id", "job_name").join(stored, F.col("job_name") == F.col("_key")).select("job_id", "body")
        status = filter_by_tags(listing, configs, want)
        matched = status.filter("status = 'matched'").select(F.col("job_name").alias("_name")).distinct()
        records, what = records.join(matched, F.col("record_key") == F.col("_name"), "left_semi"), NO_JOB_TAGGED + json.dumps(dict(want), sort_keys=True)
        skipped = status.filter("status = 'skipped'").select("job_id", "job_name", "reason")
    problems = spark.createDataFrame([], "record_key string, error string")
    if what is not None:
        none = records.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0")
        problems = none.select(F.lit(None).cast("string").alias("record_key"), F.lit(what).alias("error"))
    if record_root is not None:
        path = F.concat(F.lit(record_root), F.col("record_key").cast("string"), F.lit("/"))
        checked = check_paths(records.withColumn("_path", path), "_path")
        problems = problems.union(checked.filter(~F.col("valid")).select(
            F.col("record_key").cast("string"), F.concat(F.lit(INVALID_PATH + "'"), "_path", F.lit("'"))))
        records = checked.filter("valid").select("record_key", "body")
    return Selection(records, skipped, problems)


def _write_rewrite(rewrite: Rewrite, chosen: Selection, output_path: str) -> DataFrame:
    """Write each record's payload or error once and return the errors as written, and
    the problems of the selection."""
    spark = rewrite.outcomes.sparkSession
    out = rewrite.outcomes.select("record_key", "job_id", "payload", "error")
    out.write.mode("overwrite").parquet(output_path)
    written = spark.read.schema(out.schema).parquet(output_path)
    problems = chosen.problems.select("record_key", F.lit(None).cast("bigint").alias("job_id"), "error")
    return written.filter(F.col("error").isNotNull()).select("record_key", "job_id", "error").unionByName(problems)


def run_create(spark: SparkSession, listing: DataFrame, current_root: str, output_path: str, *, storage_path: str,
               want: Mapping[str, object] | None = None, name: str | None = None, record_root: str | None = None, **rewrite) -> DataFrame:
    """C11 as a job: the create payloads of the selected records (all without ``want`` or
    ``name``) into ``output_path``. An invalid storage path stops the run before
    anything is read. Returns the records rejected and the problems of the selection."""
    if not check_paths(spark.createDataFrame([(storage_path,)], "path string")).first()["valid"]:
        raise ValueError(f"invalid path: {storage_path!r}")
    chosen = select_stored(listing, read_current(spark, current_root), want, name=name, record_root=record_root)
    return _write_rewrite(create_from_stored(chosen.records, storage_path=storage_path, **rewrite), chosen, output_path)


def run_reset(spark: SparkSession, listing: DataFrame, current_root: str, output_path: str, *,
              want: Mapping[str, object] | None = None, name: str | None = None, record_root: str | None = None, **rewrite) -> DataFrame:
    """C12 as a job: the reset envelopes of the selected records (all without ``want`` or
    ``name``) into ``output_path``. Returns the records rejected and the problems of the
    selection."""
    chosen = select_stored(listing, read_current(spark, current_root), want, name=name, record_root=record_root)
    return _write_rewrite(reset_from_stored(chosen.records, **rewrite), chosen, output_path)


def run_row_deletion(spark: SparkSession, table_path: str, requests: DataFrame, key_cols: Sequence[str],
                     output_path: str, *, dry_run: bool = True) -> DataFrame:
    """C4 as a job: write the surviving rows of a Parquet table to
    ``output_path`` (a new folder; the input is never overwritten while read).
    A dry run writes nothing. Returns the request keys matching no row."""
    table = spark.read.parquet(table_path)
    res = delete_rows(table, requests, key_cols, dry_run=dry_run)
    if not dry_run:
        res.survivors.write.mode("overwrite").parquet(output_path)
    return res.not_found
