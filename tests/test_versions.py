"""Backup, restore, history and the stores on temporary folders."""

import os
import tempfile
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewarden.operators import backup, latest_per_key, restore, version_history
from tablewarden.plans import fixtures as fx
from tablewarden.sources.store import (
    read_archive, read_current, read_version_files, write_archive, write_current,
)

from conftest import SMALL, rows

T1 = datetime(2025, 8, 14, 10, 0, 0)
T2 = datetime(2025, 8, 15, 9, 30, 5)


def cur(spark, data):
    return spark.createDataFrame(
        [(k, b, datetime(2025, 1, 1)) for k, b in data], "record_key string, body string, saved_at timestamp_ntz")


def test_backup_archives_replaced_rows_even_if_unchanged(spark):
    current = cur(spark, [("job", "v1"), ("other", "o1")])
    incoming = cur(spark, [("job", "v1"), ("new", "n1")])
    b = backup(incoming, current, T1)
    assert rows(b.current, "record_key", "body") == [("job", "v1"), ("new", "n1"), ("other", "o1")]
    assert rows(b.archive, "record_key", "body", "archive_date") == [("job", "v1", "20250814")]


def test_backup_then_restore_latest_returns_previous_body(spark):
    current = cur(spark, [("job", "old")])
    b = backup(cur(spark, [("job", "new")]), current, T1)
    req = spark.createDataFrame([("job", None)], "record_key string, restore_stamp string")
    r = restore(b.archive.select("record_key", "version_ts", "body"), req, T2)
    assert rows(r.restored, "record_key", "body", "version_stamp") == [("job", "old", "20250814_100000")]
    assert rows(r.current, "record_key", "body") == [("job", "old")]


def test_restore_exact_prefix_keys_and_misses(spark):
    arc = spark.createDataFrame(
        [("job", T1, "a"), ("job", T2, "b"), ("job_b", T2, "x")],
        "record_key string, version_ts timestamp_ntz, body string")
    req = spark.createDataFrame(
        [("job", "20250814_100000"), ("job", "19990101_000000"), ("job", ""), ("nojob", None)],
        "record_key string, restore_stamp string")
    r = restore(arc, req, T2)
    assert sorted(rows(r.restored, "requested_stamp", "body", "mode"), key=lambda x: x[2]) == [
        ("20250814_100000", "a", "exact"), (None, "b", "latest")]
    assert rows(r.missing, "record_key", "error") == [
        ("job", "No archive found for timestamp: 19990101_000000"), ("nojob", "No archived configs found")]


def test_history_and_latest_match_window_forms(spark):
    arc = fx.f_archive(spark, SMALL)
    h = version_history(arc)
    w = Window.partitionBy("record_key").orderBy(F.desc("version_ts"))
    by_window = arc.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("record_key", "body")
    assert rows(latest_per_key(arc, "record_key", "version_ts"), "record_key", "body") == rows(by_window)
    firsts = h.filter("version_no = 1")
    assert firsts.filter(F.col("valid_from").isNotNull()).count() == 0
    assert firsts.count() == arc.select("record_key").distinct().count()


def test_stores_round_trip(spark):
    root = tempfile.mkdtemp(prefix="tw-store-")
    current = cur(spark, [("job", "old"), ("x", "1")])
    write_current(current, f"{root}/current", T1)
    b = backup(cur(spark, [("job", "new")]), read_current(spark, f"{root}/current"), T2)
    write_archive(b.archive, f"{root}/archive", T2)
    write_archive(b.archive, f"{root}/archive", T2)  # a retried run is idempotent
    write_current(b.current, f"{root}/current", T2)
    assert rows(read_current(spark, f"{root}/current"), "record_key", "body") == [("job", "new"), ("x", "1")]
    # A newer run that never committed is ignored.
    cur(spark, [("junk", "j")]).write.parquet(f"{root}/current/run=29990101_000000")
    assert rows(read_current(spark, f"{root}/current"), "record_key") == [("job",), ("x",)]
    arc = read_archive(spark, f"{root}/archive", date_from="20250815")
    assert rows(arc, "record_key", "body", "archive_date") == [("job", "old", "20250815")]
    assert read_archive(spark, f"{root}/archive", date_to="20250814").count() == 0


def test_version_files_scan(spark):
    root = tempfile.mkdtemp(prefix="tw-files-")
    files = {"20250814/job/job_20250814_100000.json": '{"a": 1}',
             "20250814/job_b/job_b_20250814_100001.json": '{"b": 2}',
             "20250814/job/notes.txt": "x", "20250814/job/bad_name.json": "{}"}
    import os
    for rel, body in files.items():
        os.makedirs(os.path.dirname(f"{root}/{rel}"), exist_ok=True)
        with open(f"{root}/{rel}", "w") as fh:
            fh.write(body)
    df = read_version_files(spark, root)
    assert rows(df, "record_key", "version_stamp", "body") == [
        ("job", "20250814_100000", '{"a": 1}'), ("job_b", "20250814_100001", '{"b": 2}')]


def test_history_equals_the_window_on_a_hot_key(spark):
    ev = fx.table(spark, SMALL, "events")
    # One key holds most rows, in many hours.
    arc = ev.select(F.when(F.col("user_id") % 10 < 8, F.lit(1)).when(F.col("user_id") % 10 < 9, None)
                    .otherwise(F.col("user_id")).alias("record_key"), F.col("ts").alias("version_ts"))
    arc = arc.dropDuplicates(["record_key", "version_ts"])
    w = Window.partitionBy("record_key").orderBy("version_ts")
    stamp = lambda c: F.date_format(c, "yyyyMMdd_HHmmss")
    plain = arc.select("record_key", F.row_number().over(w).cast("bigint"), stamp(F.lag("version_ts").over(w)), stamp("version_ts"))
    got = version_history(arc)
    assert got.count() == arc.count() and rows(got) == rows(plain)


def test_document_scan_by_file_name(spark):
    from tablewarden.sources.store import read_documents
    root = tempfile.mkdtemp(prefix="tw-docs-")
    os.makedirs(f"{root}/job_a")
    with open(f"{root}/job_a/job_a.json", "w") as fh:
        fh.write('{\n  "job_id": 1\n}')
    with open(f"{root}/notes.txt", "w") as fh:
        fh.write("x")
    assert rows(read_documents(spark, root), "record_key", "body") == [("job_a", '{\n  "job_id": 1\n}')]


def test_backup_keeps_one_current_row_per_key(spark):
    b = backup(fx.f_incoming(spark, SMALL), fx.f_current(spark, SMALL), T1)
    assert b.current.count() == b.current.select("record_key").distinct().count()
    keys = fx.f_incoming(spark, SMALL).select("record_key").union(fx.f_current(spark, SMALL).select("record_key"))
    assert b.current.count() == keys.distinct().count()


def test_checkpoint_dir_is_one_folder_a_session(spark):
    from tablewarden.session import checkpoint_dir
    assert len({checkpoint_dir(spark) for _ in range(5)}) == 1


def test_a_key_with_all_versions_in_one_hour_is_ranked_in_parts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tablewarden.operators import versions
    monkeypatch.setattr(versions, "CROWD", 20)
    ids = spark.range(1000).select(
        F.when(F.col("id") < 900, "hot").when(F.col("id") < 980, "cold").alias("record_key"),
        (F.lit("2025-01-01 10:00:00").cast("timestamp_ntz") + F.make_interval(secs=(F.col("id") * 37 % 3599).cast("decimal(18,6)"))).alias("version_ts"))
    plan = versions.version_history(ids)
    got = sorted((str(r.record_key), r.version_no, r.valid_from, r.valid_to) for r in plan.collect())
    by_key = {}
    for r in ids.collect():
        by_key.setdefault(str(r.record_key), []).append(r.version_ts)
    want = []
    for key, times in by_key.items():
        stamps = [t.strftime("%Y%m%d_%H%M%S") for t in sorted(times)]
        want += [(key, i + 1, stamps[i - 1] if i else None, s) for i, s in enumerate(stamps)]
    assert got == sorted(want)
