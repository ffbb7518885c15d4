"""Batch jobs on temporary folders."""

import json
import os
import tempfile
from datetime import datetime

import pytest

from pyspark.sql import functions as F

from tablewarden.jobs import (
    run_backup, run_create, run_reset, run_restore, run_restore_selected, run_row_deletion, run_version_import, select_stored,
)
from tablewarden.plans import fixtures as fx
from tablewarden.sources.listings import ordered_lines
from tablewarden.sources.store import (
    ConflictError, committed_runs, compact_archive, read_archive, read_current, write_archive, write_current,
)

from conftest import SMALL, rows


def _captures(root, docs):
    os.makedirs(root, exist_ok=True)
    for key, body in docs.items():
        with open(os.path.join(root, f"{key}.json"), "w") as fh:
            fh.write(body)


def test_backup_then_restore_runs(spark):
    root = tempfile.mkdtemp(prefix="tw-jobs-")
    t1, t2, t3 = datetime(2025, 3, 1, 8), datetime(2025, 3, 2, 8), datetime(2025, 3, 3, 8)
    _captures(f"{root}/in1", {"a": '{"v": 1}', "b": '{"v": 1}'})
    run_backup(spark, f"{root}/in1", f"{root}/current", f"{root}/archive", t1)
    _captures(f"{root}/in2", {"a": '{"v": 2}'})
    run_backup(spark, f"{root}/in2", f"{root}/current", f"{root}/archive", t2)
    run_backup(spark, f"{root}/in2", f"{root}/current", f"{root}/archive", t2)  # retried run
    assert rows(read_current(spark, f"{root}/current"), "record_key", "body") == [
        ("a", '{"v": 2}'), ("b", '{"v": 1}')]
    assert rows(read_archive(spark, f"{root}/archive"), "record_key", "body") == [("a", '{"v": 1}')]
    req = spark.createDataFrame([("a", None), ("b", None)], "record_key string, restore_stamp string")
    missing = run_restore(spark, req, f"{root}/current", f"{root}/archive", t3)
    assert rows(missing, "record_key", "error") == [("b", "No archived configs found")]
    assert rows(read_current(spark, f"{root}/current"), "record_key", "body") == [
        ("a", '{"v": 1}'), ("b", '{"v": 1}')]


def test_row_deletion_job(spark):
    out = tempfile.mkdtemp(prefix="tw-del-") + "/survivors"
    req = fx.rows_to_delete(spark, SMALL)
    docs = f"{SMALL}/documents.parquet"
    nf = run_row_deletion(spark, docs, req, ["doc_id"], out, dry_run=True)
    assert not os.path.exists(out) and nf.count() == 2
    run_row_deletion(spark, docs, req, ["doc_id"], out, dry_run=False)
    kept = spark.read.parquet(out)
    assert kept.count() + fx.table(spark, SMALL, "documents").join(req, "doc_id", "left_semi").count() == \
        fx.table(spark, SMALL, "documents").count()


def test_an_older_backup_is_an_error(spark):
    root = tempfile.mkdtemp(prefix="tw-jobs-")
    _captures(f"{root}/in", {"a": "{}"})
    run_backup(spark, f"{root}/in", f"{root}/current", f"{root}/archive", datetime(2025, 3, 2))
    with pytest.raises(ValueError, match="older"):
        run_backup(spark, f"{root}/in", f"{root}/current", f"{root}/archive", datetime(2025, 3, 1))


def test_create_and_reset_runs(spark):
    root = tempfile.mkdtemp(prefix="tw-jobs-")
    doc = lambda i, tag: json.dumps({"job_id": i, "settings": {"tags": {"t": tag}, "tasks": [{"task_key": "k"}]}})
    _captures(f"{root}/in", {"a": doc(1, "x"), "b": doc(2, "y"), "c": "{broken", "d": json.dumps({"job_id": 4, "settings": {}})})
    run_backup(spark, f"{root}/in", f"{root}/current", f"{root}/archive", datetime(2025, 3, 2))
    listing = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "gone")], "job_id bigint, job_name string")
    args = {"storage_path": "acct", "tags": {"o": "p"}, "target_root": "/Workspace/sample/"}
    errors = run_create(spark, listing, f"{root}/current", f"{root}/all", **args)
    assert rows(errors, "record_key") == [("c",), ("d",)]
    assert json.loads(spark.read.parquet(f"{root}/all").filter("record_key = 'a'").first()["payload"])["tags"] == {"o": "p"}
    assert run_create(spark, listing, f"{root}/current", f"{root}/some", want={"t": "x"}, **args).count() == 0
    assert rows(spark.read.parquet(f"{root}/some"), "record_key") == [("a",)]
    with pytest.raises(ValueError, match="invalid path"):
        run_create(spark, listing, f"{root}/current", f"{root}/bad", **{**args, "storage_path": "a b"})
    assert rows(run_reset(spark, listing, f"{root}/current", f"{root}/reset"), "record_key") == [("c",)]
    assert spark.read.parquet(f"{root}/reset").filter("error IS NULL").count() == 3
    chosen = select_stored(listing, read_current(spark, f"{root}/current"), {"t": "x"})
    assert rows(chosen.skipped, "job_name", "reason") == [("c", "config unreadable"), ("gone", "config not found")]


def test_version_files_can_be_restored(spark):
    root = tempfile.mkdtemp(prefix="tw-jobs-")
    _captures(f"{root}/in", {"job_a_20250814_100000": '{"v": 1}', "job_a_20250815_100000": '{"v": 2}', "job_a_99999999_999999": "{}"})
    bad = run_version_import(spark, f"{root}/in", f"{root}/archive", datetime(2025, 9, 1))
    assert rows(bad) == [("job_a_99999999_999999.json",)]
    req = spark.createDataFrame([("job_a", "20250814_100000")], "record_key string, restore_stamp string")
    assert run_restore(spark, req, f"{root}/current", f"{root}/archive", datetime(2025, 9, 2)).count() == 0
    assert rows(read_current(spark, f"{root}/current"), "record_key", "body") == [("job_a", '{"v": 1}')]


LISTING = [(1, "a"), (2, "b"), (3, "b long"), (4, "gone")]


def _doc(i, tag):
    return json.dumps({"job_id": i, "settings": {"tags": {"t": tag}, "tasks": [{"task_key": "k"}]}})


def _listing(spark):
    return spark.createDataFrame(LISTING, "job_id bigint, job_name string")


def test_two_runs_from_one_base_commit_once(spark, tmp_path):
    root = str(tmp_path / "current")
    rows_of = lambda v: spark.createDataFrame([("k", v)], "record_key string, body string").withColumn("saved_at", F.lit("2025-01-01").cast("timestamp_ntz"))
    write_current(rows_of("base"), root, datetime(2025, 1, 1))
    base = committed_runs(spark, root)[-1]
    write_current(rows_of("first"), root, datetime(2025, 1, 2), base)
    with pytest.raises(ConflictError, match="successor"):
        write_current(rows_of("second"), root, datetime(2025, 1, 3), base)
    assert read_current(spark, root).first()["body"] == "first"
    # a retry of the committed run is no conflict
    write_current(rows_of("first again"), root, datetime(2025, 1, 2), base)
    assert read_current(spark, root).first()["body"] == "first again" and len(committed_runs(spark, root)) == 2


def test_a_refused_backup_takes_its_archive_rows_back(spark, monkeypatch, tmp_path):
    from tablewarden import jobs
    root = str(tmp_path)
    _captures(f"{root}/in", {"a": "{}"})
    report = run_backup(spark, f"{root}/in", f"{root}/current", f"{root}/archive", datetime(2025, 1, 1))
    assert report.counts == {"archived": 0, "current": 1}
    read = jobs._base
    monkeypatch.setattr(jobs, "_base", lambda s, r, ts: read(s, r, datetime(2025, 1, 2)))  # both read the first run
    assert run_backup(spark, f"{root}/in", f"{root}/current", f"{root}/archive", datetime(2025, 1, 2)).counts == {"archived": 1, "current": 1}
    monkeypatch.setattr(jobs, "_base", lambda s, r, ts: (read_current(s, r, before=datetime(2025, 1, 2)), "run=20250101_000000"))
    with pytest.raises(ConflictError):
        run_backup(spark, f"{root}/in", f"{root}/current", f"{root}/archive", datetime(2025, 1, 3))
    assert read_archive(spark, f"{root}/archive").select("archive_date").distinct().collect()[0][0] == "20250102"


def test_backup_and_restore_of_a_selection(spark, tmp_path):
    root, listing = str(tmp_path), _listing(spark)
    place = (f"{root}/current", f"{root}/archive")
    _captures(f"{root}/in1", {"a": _doc(1, "x"), "b": _doc(2, "y"), "b long": _doc(3, "x")})
    tagged = run_backup(spark, f"{root}/in1", *place, datetime(2025, 1, 1), listing=listing, want={"t": "x"}, record_root="/store/")
    assert rows(read_current(spark, place[0]), "record_key") == [("a",)]
    assert rows(tagged.problems) == [("b long", "Skipping invalid path: '/store/b long/'")]
    single = run_backup(spark, f"{root}/in1", *place, datetime(2025, 1, 2), listing=listing, name="B")
    assert rows(read_current(spark, place[0]), "record_key") == [("a",), ("b",)] and single.problems.count() == 0
    _captures(f"{root}/in2", {"a": _doc(1, "z"), "b": _doc(2, "z")})
    run_backup(spark, f"{root}/in2", *place, datetime(2025, 1, 3))
    assert rows(run_restore_selected(spark, listing, *place, datetime(2025, 1, 4), name="a")) == []
    bodies = dict(rows(read_current(spark, place[0]), "record_key", "body"))
    assert json.loads(bodies["a"])["settings"]["tags"]["t"] == "x" and json.loads(bodies["b"])["settings"]["tags"]["t"] == "z"
    assert rows(run_restore_selected(spark, listing, *place, datetime(2025, 1, 5), want={"t": "z"}, stamp="20250103_000000")) == []
    assert json.loads(dict(rows(read_current(spark, place[0]), "record_key", "body"))["b"])["settings"]["tags"]["t"] == "y"
    late = run_restore_selected(spark, listing, *place, datetime(2025, 1, 6), name="a", stamp="20200101_000000")
    assert rows(late, "record_key", "error") == [("a", "No archive found for timestamp: 20200101_000000")]


def test_a_selection_that_finds_nothing_says_so(spark, tmp_path):
    root, listing = str(tmp_path), _listing(spark)
    _captures(f"{root}/in", {"a": _doc(1, "x")})
    run_backup(spark, f"{root}/in", f"{root}/current", f"{root}/archive", datetime(2025, 1, 1))
    args = {"storage_path": "acct", "tags": {}, "target_root": "/w/"}
    assert rows(run_create(spark, listing, f"{root}/current", f"{root}/o1", want={"t": "none"}, **args)) == [
        (None, None, 'No jobs found with tags: {"t": "none"}')]
    assert rows(run_reset(spark, listing, f"{root}/current", f"{root}/o2", name="nope")) == [(None, None, "No job found with name: nope")]
    assert rows(run_restore_selected(spark, listing, f"{root}/current", f"{root}/archive", datetime(2025, 1, 2), name="gone"), "error") == [
        ("No job found with name: gone",)]
    assert run_create(spark, listing, f"{root}/current", f"{root}/o3", name="a", **args).count() == 0
    assert rows(spark.read.parquet(f"{root}/o3"), "record_key") == [("a",)]


def test_compaction_keeps_every_read_equal(spark, tmp_path):
    root = str(tmp_path / "archive")
    for i in range(4):
        part = spark.range(30).select(F.concat(F.lit("k"), "id").alias("record_key"), F.lit("2025-02-01 10:00:00").cast("timestamp_ntz").alias("version_ts"),
                                      F.lit(f"v{i}").alias("body"), F.format_string("2025020%d", (F.col("id") % 3 + 1).cast("int")).alias("archive_date"))
        write_archive(part, root, datetime(2025, 2, 1, i))
    before = rows(read_archive(spark, root))
    # a compaction that was not committed counts nothing
    part.withColumn("run", F.lit("compacted_20250301_000000")).write.mode("append").partitionBy("archive_date", "run").parquet(root)
    assert rows(read_archive(spark, root)) == before
    assert len(compact_archive(spark, root, datetime(2025, 3, 1))) == 4
    assert rows(read_archive(spark, root)) == before and len(read_archive(spark, root).inputFiles()) >= 3
    files = read_archive(spark, root).select(F.input_file_name().alias("f"), "archive_date").distinct().groupBy("archive_date").count().collect()
    assert {r["count"] for r in files} == {1}
    assert compact_archive(spark, root, datetime(2025, 3, 1)) == []
    write_archive(part.limit(1), root, datetime(2025, 3, 2))
    assert len(rows(read_archive(spark, root))) == len(before) + 1
    assert len(compact_archive(spark, root, datetime(2025, 3, 3))) == 2 and len(rows(read_archive(spark, root))) == len(before) + 1


def test_ordered_lines_across_splits(spark, tmp_path):
    path = str(tmp_path / "requests")
    os.makedirs(path)
    lines = [f"name {i % 977} {'x' * (i % 50)}" for i in range(20_000)]
    for n in range(2):
        with open(f"{path}/part-{n}.txt", "w") as fh:
            fh.write("\n".join(lines[n * 12_000:(n + 1) * 12_000]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = ordered_lines(spark, path)
        assert got.rdd.getNumPartitions() >= 1
        assert [r.value for r in got.orderBy("pos").collect()] == lines
        assert got.agg(F.min("pos"), F.max("pos"), F.countDistinct("pos")).first()[:] == (0, 19_999, 20_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
