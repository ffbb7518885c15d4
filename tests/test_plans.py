"""Plan checks: pushdown, broadcast behind size checks, no Python in plans."""

import pytest

from tablewarden.plans import fixtures as fx
from tablewarden.plans.queries import QUERIES

from conftest import SMALL


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_plans(spark, name):
    text = plan_text(QUERIES[name](spark, SMALL))
    for marker in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas"):
        assert marker not in text


def test_prefix_filter_reaches_parquet_scan(spark):
    from pyspark.sql import functions as F
    df = fx.table(spark, SMALL, "pages").filter(F.col("url").startswith("https://")).select("page_id")
    text = plan_text(df)
    assert "StringStartsWith(url,https://)" in text
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text


@pytest.mark.parametrize("name", ["q_cleanup_matrix", "q_cleanup_token", "q_delete_by_pattern", "q_rows_by_pattern",
                                  "q_rows_by_pattern_survive", "q_listing_match"])
def test_no_all_pairs_join(spark, name):
    df = QUERIES[name](spark, SMALL)
    df.collect()
    text = plan_text(df)
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["q_restore_latest", "q_restore_exact"])
def test_restore_fetches_chosen_bodies_only(spark, name):
    """One scan reads bodies; those that choose the versions read two columns."""
    import re
    schemas = re.findall(r"ReadSchema: (\S+)", plan_text(QUERIES[name](spark, SMALL)))
    assert sum("props" in s for s in schemas) == 1


def test_version_history_has_no_whole_key_window_of_versions(spark):
    import re
    from tablewarden.operators.versions import version_history
    text = plan_text(version_history(fx.f_archive(spark, SMALL)))
    specs = re.findall(r"row_number\(\) windowspecdefinition\(([^,]+), ([^,]+)", text)
    assert specs and all("_hour" in second for _, second in specs) and "checkpoint" not in text.lower()


def test_tags_are_read_below_the_join(spark):
    plan = QUERIES["q_tag_filter"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "tags" not in plan[:plan.index("Join")]


def test_restore_filters_by_requested_keys_before_it_aggregates(spark):
    from tablewarden.operators.versions import restore
    archive = fx.f_archive(spark, SMALL)
    requests = spark.createDataFrame([(1, None), (2, "20240101_000000")], "record_key bigint, restore_stamp string")
    from datetime import datetime
    plan = restore(archive, requests, datetime(2025, 1, 1)).missing._jdf.queryExecution().optimizedPlan().toString()
    import re
    latest = plan[re.search(r"Aggregate \[record_key#\d+L?\], \[record_key#\d+L? AS _lk", plan).start():]
    assert "LeftSemi" in latest.split("Aggregate")[1]


def test_restore_prunes_archive_folders(spark, tmp_path):
    from datetime import datetime
    from pyspark.sql import functions as F
    from tablewarden.operators.versions import backup, restore
    from tablewarden.sources.store import read_archive, write_archive
    root = str(tmp_path / "archive")
    for day in range(1, 6):
        run = datetime(2025, 3, day)
        rows = spark.range(50).select(F.concat(F.lit("k"), "id").alias("record_key"), F.lit(f"v{day}").alias("body"),
                                      F.lit("2025-01-01").cast("timestamp_ntz").alias("saved_at"))
        write_archive(backup(rows, rows, run).archive, root, run)
    requests = spark.createDataFrame([("k1", "20250303_000000"), ("k2", None)], "record_key string, restore_stamp string")
    res = restore(read_archive(spark, root), requests, datetime(2025, 4, 1))
    got = sorted((r.record_key, r.body) for r in res.restored.collect())
    assert got == [("k1", "v3"), ("k2", "v5")]
    assert plan_text(res.restored).count("dynamicpruning") >= 2
    assert res.missing.count() == 0


def test_a_rewrite_with_a_lookup_parses_each_body_once(spark, tmp_path):
    from tablewarden.operators.normalize import create_from_stored, reset_from_stored
    from tablewarden.sources import scratch
    path = str(tmp_path / "stored")
    body = '{"job_id": 1, "settings": {"tasks": [{"task_key": "a", "pipeline_task": {"pipeline_id": "p0"}}]}}'
    spark.createDataFrame([("j", body)], "record_key string, body string").write.parquet(path)
    stored = spark.read.parquet(path)
    lookup = spark.createDataFrame([("a", "p9")], "name string, pipeline_id string")
    before = scratch.written_tables(spark)
    for rew in (reset_from_stored(stored, lookup=lookup), create_from_stored(stored, lookup=lookup, tags={}, target_root="/x/")):
        assert "p9" in rew.records.first()["payload"]
        text = plan_text(rew.outcomes)
        # the body's one reader is the table that was written: nothing left reads or parses it
        assert "body" not in text and "parse_json(" not in text.replace("parse_json({", "")
    assert scratch.drop_written(spark, before) == 2
