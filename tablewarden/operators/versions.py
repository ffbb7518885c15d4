"""Versioned records: backup, restore, history and file names.

Tables:
* ``current``  ``(record_key, body, saved_at)``, at most one row per key;
* ``archive``  ``(record_key, version_ts, body)``; ``version_ts`` is the stamp
  of the backup that *replaced* the version (1-second resolution);
* ``incoming`` ``(record_key, body, saved_at)``: fresh captures.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewarden.functions.stamps import (
    archive_date, parse_version_file, version_file_name, version_stamp,
)

# Messages for restore requests that cannot be served.
NO_ARCHIVE = "No archived configs found"
NO_VERSION = "No archive found for timestamp: "
CROWD = 50_000  # versions of one key in one hour that one task ranks
HOUR = 3_600_000_000  # in microseconds
_STAMP = r"^\d{8}_\d{6}$"
_DATE = r"^\d{4,}$"


def _ts(run_ts: datetime):
    return F.lit(run_ts.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def latest_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """The row with the greatest ``order_col`` per key, via ``max_by``
    (partial aggregation: a key holding a third of the rows is reduced on
    every map task before the shuffle)."""
    others = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order_col)).alias("_r"))
            .select(key, *[F.col(f"_r.{c}").alias(c) for c in others]))


@dataclass(frozen=True)
class Backup:
    """``current``: the complete new snapshot; ``archive``: rows to append."""

    current: DataFrame
    archive: DataFrame


def backup(incoming: DataFrame, current: DataFrame, run_ts: datetime) -> Backup:
    """Current rows of keys that come in again go to the archive, stamped
    with ``run_ts`` (always, even if unchanged: no comparison is made); the
    incoming rows become current, other current rows stay.

    Incoming is reduced to its latest row per key; then a semi join gives the
    archive rows and an anti join the current rows that stay. Both join the
    (usually small) incoming keys, so Spark / AQE can broadcast them and the
    large current table is never shuffled.
    """
    inc = latest_per_key(incoming.select("record_key", "body", "saved_at"), "record_key", "saved_at")
    keys = inc.select("record_key")
    cur = current.select("record_key", "body", "saved_at")
    new_current = cur.join(keys, "record_key", "left_anti").unionByName(inc)
    stamp = _ts(run_ts)
    archived = cur.join(keys, "record_key", "left_semi").select(
        "record_key", stamp.alias("version_ts"), "body", archive_date(stamp).alias("archive_date"))
    return Backup(new_current, archived)


@dataclass(frozen=True)
class Restore:
    """``restored``: chosen versions; ``missing``: requests that cannot be
    served, with the reason; ``current``: restored rows as current rows."""

    restored: DataFrame
    missing: DataFrame
    current: DataFrame


def restore(archive: DataFrame, requests: DataFrame, run_ts: datetime) -> Restore:
    """Per request ``(record_key, restore_stamp)``: the version with that
    exact stamp, or the latest version when the stamp is null/empty.

    Versions are chosen on narrow columns, and only those of requested keys are
    aggregated: a semi join with the requests comes first. The latest is a
    pre-aggregated maximum, an exact one an equi join on key and stamp (of several within
    that second the last). Only chosen bodies are then fetched, by key and time. An
    archive with ``archive_date`` (the date of ``version_ts``) is pruned by it: exact
    versions and bodies are looked for in the folders of their dates only (dynamic
    partition pruning). Key equality is exact (a key that is a prefix of another never
    matches it). Of versions of one key and time the greatest body counts.
    """
    key, ts = F.col("record_key"), F.col("version_ts")
    req = requests.select(key.alias("_k"), F.nullif(F.col("restore_stamp"), F.lit("")).alias("req")).distinct()
    dated = "archive_date" in archive.columns
    narrow = archive.select("record_key", "version_ts", *["archive_date"] * dated)
    keys = req.select(F.col("_k").alias("_rk")).distinct()
    latest = (narrow.join(keys, key == F.col("_rk"), "left_semi").groupBy(key.alias("_lk")).agg(F.max(ts).alias("_latest")))
    # a request that is no stamp can match nothing
    exact = req.filter(F.col("req").rlike(_STAMP)).select(F.col("_k").alias("_xk"), F.col("req").alias("_xs"))
    on = (key == F.col("_xk")) & (version_stamp(ts) == F.col("_xs"))
    if dated:
        on = on & (F.col("archive_date") == F.col("_xs").substr(1, 8))
    by_stamp = narrow.join(exact, on).groupBy(F.col("_xk").alias("_ek"), F.col("_xs").alias("_es")).agg(F.max(ts).alias("_exact"))
    chosen = (req.join(latest, F.col("_k") == F.col("_lk"), "left")
              .join(by_stamp, (F.col("_k") == F.col("_ek")) & (F.col("req") == F.col("_es")), "left")
              .select("_k", "req", "_latest", F.when(F.col("req").isNull(), F.col("_latest")).otherwise(F.col("_exact")).alias("_ts")))
    wanted = chosen.filter(F.col("_ts").isNotNull())
    on = (key == F.col("_k")) & (ts == F.col("_ts"))
    if dated:
        wanted = wanted.withColumn("_date", archive_date(F.col("_ts"))).filter(F.col("_date").rlike(_DATE))
        on = on & (F.col("archive_date") == F.col("_date"))
    restored = (archive.join(wanted, on).groupBy("record_key", F.col("req").alias("requested_stamp"), "version_ts")
                .agg(F.max("body").alias("body"))
                .select("record_key", "requested_stamp", version_stamp(ts).alias("version_stamp"), "body",
                        F.when(F.col("requested_stamp").isNull(), F.lit("latest")).otherwise(F.lit("exact")).alias("mode")))
    missing = chosen.filter(F.col("_ts").isNull()).select(
        F.col("_k").alias("record_key"), F.col("req").alias("requested_stamp"),
        F.when(F.col("_latest").isNull(), F.lit(NO_ARCHIVE))
        .otherwise(F.concat(F.lit(NO_VERSION), F.col("req"))).alias("error"))
    cur = latest_per_key(restored.select("record_key", "body", F.col("version_stamp").alias("_o")),
                         "record_key", "_o")
    current = cur.select("record_key", "body", _ts(run_ts).alias("saved_at"))
    return Restore(restored, missing, current)


def version_history(archive: DataFrame) -> DataFrame:
    """``(record_key, version_no, valid_from, valid_to)`` per archived
    version: its rank by stamp and the stamps that bound it (``valid_from`` is
    the previous replacement stamp, null for the first).

    No task sorts a whole key: versions are ranked within their key and bucket of time,
    and shifted by the counts of the key's earlier buckets. A bucket is an hour, or,
    where a key has more than CROWD versions in an hour, an equal part of it, down to a
    microsecond: the parts are as many as the hour's count asks for, so a key with all
    its versions in one hour is ranked by many tasks. Buckets are values of the row, so a
    recomputed task sees the same.
    """
    hour = F.date_trunc("hour", "version_ts")
    counts = archive.groupBy(F.col("record_key").alias("_k"), hour.alias("_h")).agg(F.count(F.lit(1)).alias("_in_hour"))
    crowded = counts.filter(F.col("_in_hour") > CROWD).select("_k", "_h", F.greatest(
        F.floor(F.lit(HOUR * CROWD) / F.col("_in_hour")), F.lit(1)).cast("bigint").alias("_width"))
    rows = archive.select("record_key", "version_ts", hour.alias("_hour")).join(
        crowded, F.col("record_key").eqNullSafe(F.col("_k")) & (F.col("_hour") == F.col("_h")), "left")
    micros = F.unix_micros(F.col("version_ts").cast("timestamp")) - F.unix_micros(F.col("_hour").cast("timestamp"))
    rows = rows.select("record_key", "version_ts", "_hour", F.coalesce(F.floor(micros / F.col("_width")), F.lit(0)).alias("_part"))
    bucket = ["record_key", "_hour", "_part"]
    w = Window.partitionBy(*bucket).orderBy("version_ts")
    local = rows.select(*bucket, "version_ts", F.row_number().over(w).alias("_n"), F.lag("version_ts").over(w).alias("_prev"))
    earlier = Window.partitionBy("record_key").orderBy("_hour", "_part")
    shifts = (rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_c"), F.max("version_ts").alias("_last"))
              .select(F.col("record_key").alias("_k"), F.col("_hour").alias("_h"), F.col("_part").alias("_p"),
                      F.coalesce(F.sum("_c").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                      F.lag("_last").over(earlier).alias("_last_before")))
    j = local.join(shifts, F.col("record_key").eqNullSafe(F.col("_k")) & (F.col("_hour") == F.col("_h")) & (F.col("_part") == F.col("_p")))
    prev = F.when(F.col("_n") == 1, F.col("_last_before")).otherwise(F.col("_prev"))
    return j.select("record_key", (F.col("_n") + F.col("_before")).cast("bigint").alias("version_no"),
                    version_stamp(prev).alias("valid_from"), version_stamp(F.col("version_ts")).alias("valid_to"))


def version_names(archive: DataFrame) -> DataFrame:
    """The file name, stamp and date folder of each archived version,
    and the key and stamp read back from the name (a round trip check)."""
    key = F.col("record_key").cast("string")
    name = version_file_name(key, F.col("version_ts"))
    parsed = parse_version_file(name)
    return archive.select(
        F.col("record_key"), version_stamp(F.col("version_ts")).alias("version_stamp"),
        name.alias("file_name"), archive_date(F.col("version_ts")).alias("archive_date"),
        parsed["record_key"].alias("parsed_key"), parsed["version_stamp"].alias("parsed_stamp"))
