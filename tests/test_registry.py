"""Listings, tag filters, selection rules, reports and decoders."""

import json

from tablewarden.operators import (
    check_paths, check_report, expand_grants, filter_by_tags, parse_tag_filters, pick_preferred,
    select_records,
)
from tablewarden.sources.listings import (
    capture_errors, decode_positional, job_listing, rows_to_frame, statement_errors,
)

from conftest import rows


def test_tag_text(spark):
    df = spark.createDataFrame([(1, "a:b"), (2, "a:b:c"), (3, " a : b "), (4, "ab"), (5, "\ta: b")],
                               "pos int, raw string")
    got = {r["pos"]: (r["tag_key"], r["tag_value"], r["valid"]) for r in parse_tag_filters(df).collect()}
    assert got == {1: ("a", "b", True), 2: ("a", "b:c", True), 3: ("a", "b", True),
                   4: (None, None, False), 5: ("a", "b", True)}


def test_tag_filter_subset_missing_and_unreadable(spark):
    listing = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")],
                                    "job_id bigint, job_name string")
    cfg = spark.createDataFrame([
        (1, json.dumps({"settings": {"tags": {"Application": "Sample", "x": "y"}}})),
        (2, json.dumps({"settings": {"tags": {"Application": "sample", "n": 1}}})),
        (3, json.dumps({"settings": {}})), (4, "{not json")], "job_id bigint, body string")
    got = rows(filter_by_tags(listing, cfg, {"Application": "Sample"}), "job_id", "status", "reason")
    assert got == [(1, "matched", None), (4, "skipped", "config unreadable"), (5, "skipped", "config not found")]
    assert filter_by_tags(listing, cfg, {}).filter("status = 'matched'").count() == 3
    typed = lambda want: rows(filter_by_tags(listing, cfg, want).filter("status = 'matched'"), "job_id")
    assert typed({"n": 1}) == [(2,)] and typed({"n": "1"}) == [] and typed({"n": True}) == []


def test_select_records_exact_first_and_all(spark):
    caps = spark.createDataFrame([(0, json.dumps({"jobs": [
        {"job_id": 5, "settings": {"name": "Nightly ETL"}}, {"job_id": 2, "settings": {"name": "etl"}},
        {"job_id": 1, "settings": {"name": "ETL backfill"}}]})), (1, json.dumps({"has_more": False}))],
        "capture_pos int, doc string")
    listing = job_listing(caps)
    names = spark.createDataFrame([("ETL",), ("",), ("zzz",)], "name string")
    got = select_records(listing, names)
    sel = rows(got.filter("selected"), "name", "job_id", "n_matches")
    assert sel == [("", 1, 3), ("ETL", 2, 3)]


def test_unreadable_captures_are_errors(spark):
    caps = spark.createDataFrame([(0, '{"jobs": ['), (1, "{}"), (2, None), (3, '{"status": {"state": "FAILED"}}'),
                                  (4, '{"status": {"state": "SUCCEEDED"}, "result": {}}')], "capture_pos int, doc string")
    bad = "response is not valid JSON"
    assert rows(capture_errors(caps, keep=["capture_pos"])) == [(0, bad), (2, bad)]
    assert rows(statement_errors(caps, keep=["capture_pos"])) == [(0, bad), (2, bad), (3, "Statement failed")]


def test_empty_listing_has_a_schema(spark):
    df = rows_to_frame(spark, [], "job_id bigint, job_name string")
    assert df.count() == 0 and df.columns == ["job_id", "job_name"]


def test_pick_preferred(spark):
    df = spark.createDataFrame([("g", 1, "STOPPED", "a"), ("g", 2, "RUNNING", "b"), ("g", 3, "RUNNING", "c"),
                                ("h", 5, "STOPPED", "d"), ("h", 4, None, "e")],
                               "grp string, pos int, state string, id string")
    assert rows(pick_preferred(df, ["grp"], "pos", "state"), "grp", "id") == [("g", "b"), ("h", "e")]


def test_check_report(spark):
    df = spark.createDataFrame([("a", True), ("b", False)], "check string, passed boolean")
    r = check_report(df).collect()[0]
    assert (r["passed"], r["total"], r["all_passed"]) == (1, 2, False)
    empty = check_report(df.limit(0)).collect()[0]
    assert (empty["total"], empty["all_passed"]) == (0, True)


def test_grants(spark):
    jobs = spark.createDataFrame([(1, "a")], "job_id bigint, job_name string")
    acl = [{"group_name": "g", "permission_level": "CAN_VIEW"}, {"service_principal_name": "p", "permission_level": "IS_OWNER"}]
    got = rows(expand_grants(jobs, acl), "grant_pos", "principal_kind", "permission_level")
    assert got == [(0, "group", "CAN_VIEW"), (1, "service_principal", "IS_OWNER")]


def test_positional_and_paths(spark):
    st = spark.createDataFrame([("s", json.dumps({"result": {"data_array": [["db", "t1", "false"], ["db"], []]}})),
                                ("e", json.dumps({"result": {}}))], "statement string, doc string")
    assert rows(decode_positional(st, keep=["statement"])) == [("s", "t1")]
    p = spark.createDataFrame([("a/b",), ("a b",), ("a%",), ("",), (None,)], "path string")
    assert rows(check_paths(p), "path", "valid") == [("",  False), ("a b", False), ("a%", False),
                                                     ("a/b", True), (None, False)]
