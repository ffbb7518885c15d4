"""Guarded deletion: hand fixtures for each decision, invariants, strategies."""

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import (
    cleanup_by_token, cleanup_matrix, delete_rows, delete_rows_by_pattern, inventory_from_listing,
    list_objects, plan_delete, plan_delete_by_pattern, share_patterns, summarize,
)
from tablewarden.operators.patterns import match_patterns, normalize_patterns
from tablewarden.plans import fixtures as fx
from tablewarden.sources.listings import requests_from_list

from conftest import SMALL, rows

LISTING = [
    ("c", "s", "temp_a", "table"), ("c", "s", "tempXa", "table"), ("c", "s", "v1", "table"),
    ("c", "s", "v1", "view"), ("c", "s", "t`q", "table"), ("c", "s2", "temp_b", "table"),
]


@pytest.fixture()
def inv(spark):
    df = spark.createDataFrame(LISTING, "catalog string, schema string, object string, listed_as string")
    return inventory_from_listing(df)


def pats(spark, data):
    return spark.createDataFrame(data, "pattern_id int, prefix string, suffix string, contains string")


def test_view_listed_twice_is_a_view(inv):
    assert rows(inv.filter("object = 'v1'"), "object_type") == [("view",)]
    assert inv.count() == 5


def test_plan_dedupes_first_wins_and_reports_every_request(spark, inv):
    req = requests_from_list(spark, ["v1", "temp_a", "v1", "ghost"], "c", "s")
    plan = plan_delete(inv, req, dry_run=True, purge=True)
    got = {r["name"]: r for r in plan.collect()}
    assert set(got) == {"v1", "temp_a", "ghost"}
    assert got["v1"]["pos"] == 0 and got["v1"]["n_requested"] == 2
    assert got["v1"]["sql"] == "DROP VIEW IF EXISTS `c`.`s`.`v1`"
    assert got["temp_a"]["sql"] == "DROP TABLE IF EXISTS `c`.`s`.`temp_a` PURGE"
    assert got["temp_a"]["status"] == "dry_run"
    assert got["ghost"]["outcome"] == "error"
    assert got["ghost"]["error"] == "Object not found or not a table/view"
    assert got["ghost"]["sql"] is None and got["ghost"]["type"] is None


def test_backtick_is_doubled_and_not_dry_run_status(spark, inv):
    req = requests_from_list(spark, ["t`q"], "c", "s")
    r = plan_delete(inv, req, dry_run=False).collect()[0]
    assert r["object"] == "`c`.`s`.`t``q`"
    assert r["status"] == "deleted"


def test_type_restriction_and_unknown_namespace(spark, inv):
    req = requests_from_list(spark, ["v1", "temp_a"], "c", "s").unionByName(
        requests_from_list(spark, ["temp_a"], "nope", "s").withColumn("pos", F.lit(9).cast("bigint")))
    plan = plan_delete(inv, req, types=["table"])
    got = {(r["catalog"], r["name"]): (r["outcome"], r["error"]) for r in plan.collect()}
    assert got[("c", "v1")] == ("error", "Object not found or not a table")
    assert got[("c", "temp_a")] == ("executed", None)
    assert got[("nope", "temp_a")] == ("error", "Invalid catalog or schema")
    with pytest.raises(ValueError):
        plan_delete(inv, req, types=["index"])


def test_empty_request_is_refused(spark, inv):
    req = requests_from_list(spark, [], "c", "s")
    s = summarize(plan_delete(inv, req), dry_run=True).collect()[0]
    assert (s["success"], s["executed"], s["errors"], s["message"]) == (False, 0, 0, "No objects specified")


def test_pattern_is_literal_not_like(spark, inv):
    plan = plan_delete_by_pattern(inv, pats(spark, [(1, "temp_", None, None)]))
    assert rows(plan, "name") == [("temp_a",), ("temp_b",)]


def test_refused_and_unmatched_patterns(spark, inv):
    plan = plan_delete_by_pattern(inv, pats(spark, [(1, "", None, ""), (2, "zzz", None, None)]))
    got = plan.collect()
    assert len(got) == 1 and got[0]["pattern_id"] == 1 and got[0]["outcome"] == "error"
    s = summarize(plan.filter("pattern_id = 2"), dry_run=True, by_pattern=True).collect()[0]
    assert s["success"] and s["message"] == "No objects found matching pattern"


def test_all_three_filters_conjunction(spark, inv):
    plan = plan_delete_by_pattern(inv, pats(spark, [(1, "temp", "a", "_")]))
    assert rows(plan, "name") == [("temp_a",)]


def test_patterns_against_python(spark):
    inv = inventory_from_listing(fx.f_listing(spark, SMALL))
    raw = [(1, "Customer#", "7", None), (2, None, "00", None), (3, None, None, "12"),
           (4, "Cust_mer", None, None), (5, None, None, None), (6, None, "1", "0001"),
           (7, "Supplier#0", None, "9"), *((i, "Customer#0000000"[:i - 20], None, None) for i in range(30, 37))]
    got = match_patterns(inv, normalize_patterns(pats(spark, raw)), "object")
    want = [(i, r["object"]) for r in inv.collect() for i, p, s, c in raw if (p or s or c)
            and r["object"].startswith(p or "") and r["object"].endswith(s or "") and (c or "") in r["object"]]
    assert want and rows(got, "pattern_id", "object") == sorted(want, key=repr)


def test_many_pattern_lengths(spark):
    """No bound on patterns or lengths: 1,500 prefixes of as many lengths and 70 of one."""
    name = "x" * 2000
    inv = spark.createDataFrame([("c", "s", name, "table"), ("c", "s", "x" * 70, "table")],
                                "catalog string, schema string, object string, object_type string")
    many = [(i, "x" * i, None, None) for i in range(1, 1501)] + [(2000 + i, "x" * 69 + chr(97 + i % 26), None, None) for i in range(70)]
    got = match_patterns(inv, normalize_patterns(pats(spark, many)), "object")
    assert got.filter(F.length("object") == 2000).count() == 1500 + sum(i % 26 == 23 for i in range(70))
    assert got.filter(F.length("object") == 70).count() == 70 + sum(i % 26 == 23 for i in range(70))


def test_patterns_derived_from_the_inventory(spark, inv):
    """Cleaning every schema there is: patterns and inventory are one table."""
    m = cleanup_matrix(inv, inv.select("catalog", "schema"), ["temp"])
    assert all(r["success"] for r in m.collect())
    own = inv.select(F.col("object").alias("pattern_id"), F.col("object").alias("prefix"), F.lit(None).cast("string").alias("suffix"),
                     F.lit(None).cast("string").alias("contains"), "catalog", "schema")
    plan = plan_delete_by_pattern(inv, own)
    assert plan.filter("outcome = 'error'").count() == 0
    assert {r["name"] for r in plan.collect()} == {r["object"] for r in inv.collect()}


def test_scopes(spark, inv):
    p = spark.createDataFrame([(1, "t", "c", None), (2, "t", None, "s2"), (3, "t", "c", "s2"), (4, "t", "zz", None),
                               (5, "t", None, "zz"), (6, "t", "c", "zz"), (7, "t", None, None)],
                              "pattern_id int, prefix string, catalog string, schema string")
    p = p.withColumn("suffix", F.lit(None).cast("string")).withColumn("contains", F.lit(None).cast("string"))
    plan = plan_delete_by_pattern(inv, p).collect()
    assert {r["pattern_id"] for r in plan if r["error"] == "Invalid catalog or schema"} == {4, 5, 6}
    want = {(i, r["name"], r["schema"]) for i, c, s in [(1, "c", None), (2, None, "s2"), (3, "c", "s2"), (7, None, None)]
            for r in plan if r["outcome"] == "executed" and r["pattern_id"] == 7
            and (c is None or r["catalog"] == c) and (s is None or r["schema"] == s)}
    assert {(r["pattern_id"], r["name"], r["schema"]) for r in plan if r["outcome"] == "executed"} == want


def test_delete_rows_invariants(spark):
    docs = fx.table(spark, SMALL, "documents")
    req = fx.rows_to_delete(spark, SMALL)
    dry = delete_rows(docs, req, ["doc_id"], dry_run=True)
    assert dry.survivors.count() == docs.count()
    res = delete_rows(docs, req, ["doc_id"], dry_run=False)
    assert res.removed.count() + res.survivors.count() == docs.count()
    assert sorted(rows(res.not_found)) == [(-2,), (-1,)]


@pytest.mark.parametrize("n", [1, 64, 65, 200])
def test_rows_by_pattern_split_exactly(spark, n):
    """Keys that are not unique or null, at any number of patterns."""
    table = spark.createDataFrame([("h", "/en/x"), ("h", "/fr/y"), (None, "/en/z"), (None, None), ("k", "/fr/y")],
                                  "k string, url string")
    p = pats(spark, [(0, None, None, "/en/"), *((i, None, None, f"none{i}") for i in range(1, n)), (-1, "", "", "")])
    res = delete_rows_by_pattern(table, "url", p, dry_run=False)
    assert rows(res.removed) == sorted([("h", "/en/x"), (None, "/en/z")], key=repr)
    assert rows(res.survivors) == sorted([("h", "/fr/y"), (None, None), ("k", "/fr/y")], key=repr)
    assert rows(res.not_found) == sorted([(i, False) for i in range(1, n)] + [(-1, True)], key=repr)
    assert delete_rows_by_pattern(table, "url", p).survivors.count() == 5


def test_cleanup_matrix_and_tokens(spark, inv):
    schemas = spark.createDataFrame([("c", "s"), ("c", "gone")], "catalog string, schema string")
    m = {r["schema"]: r for r in cleanup_matrix(inv, schemas, ["temp", "t"]).collect()}
    assert m["s"]["executed"] == 3 and m["s"]["errors"] == 0 and m["s"]["success"]
    assert m["gone"]["errors"] == 2 and not m["gone"]["success"]
    toks = spark.createDataFrame([("a",), ("zz",)], "token string")
    plan = cleanup_by_token(inv, toks, template="temp_{}")
    assert rows(plan, "token", "name") == [("a", "temp_a")]


def test_list_objects_counts_include_zero(spark, inv):
    got = rows(list_objects(inv), "schema", "object_type", "n_objects")
    assert got == [("s", "table", 3), ("s", "view", 1), ("s2", "table", 1), ("s2", "view", 0)]


def test_invariants_on_driver_tables(spark):
    from pyspark.sql.window import Window
    inv = inventory_from_listing(fx.f_listing(spark, SMALL))
    req = fx.f_requests(spark, SMALL)
    plan = plan_delete(inv, req)
    key = ["catalog", "schema", "object"]
    distinct = req.select(*key).distinct().count()
    assert plan.count() == distinct
    assert plan.filter(~F.col("outcome").isin("executed", "error")).count() == 0
    assert plan.select("catalog", "schema", "name").distinct().count() == distinct
    w = Window.partitionBy(*key).orderBy("pos")
    first = req.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(
        "catalog", "schema", F.col("object").alias("name"), "pos")
    assert rows(plan, "catalog", "schema", "name", "pos") == rows(first)
    s = summarize(plan, dry_run=True).collect()[0]
    assert s["executed"] + s["errors"] == distinct


def test_patterns_that_are_alike_are_planned_once(spark):
    schema = "pattern_id bigint, prefix string, suffix string, contains string"
    patterns = spark.createDataFrame([(5, "a", None, None), (3, "a", None, None), (None, "a", None, None), (4, "b", None, "x"), (3, "a", None, None),
                                      (7, None, "1", None), (7, "b", None, "x"), (9, None, None, None)], schema)
    shared, members = share_patterns(patterns)
    assert rows(shared) == sorted([(3, "a", None, None), (4, "b", None, "x"), (7, None, "1", None), (7, "b", None, "x"), (9, None, None, None)], key=repr)
    assert rows(members) == sorted([(3, 3), (3, 5), (3, None), (4, 4), (7, 7), (9, 9)], key=repr)
    inventory = spark.createDataFrame([("c", "s", n, t) for n, t in (("a1", "table"), ("a1", "view"), ("bx1", "table"), ("q", "view"))],
                                      "catalog string, schema string, object string, object_type string")
    plan = plan_delete_by_pattern(inventory, patterns)
    want = [(p, "a1", "table", "executed") for p in (3, 5, None, 7)] + [(p, "bx1", "table", "executed") for p in (4, 7)] + [(9, None, None, "error")]
    assert rows(plan, "pattern_id", "name", "type", "outcome") == sorted(want, key=repr)


def test_patterns_that_are_alike_meet_the_names_once(spark):
    """100 ids of one pattern: the rows before the last join are those of one id."""
    inventory = spark.range(200).select(F.lit("c").alias("catalog"), F.lit("s").alias("schema"), F.format_string("t%04d", "id").alias("object"),
                                        F.lit("table").alias("object_type"))
    patterns = spark.range(100).select(F.col("id").alias("pattern_id"), F.lit("t").alias("prefix"), F.lit(None).cast("string").alias("suffix"),
                                       F.lit(None).cast("string").alias("contains"))
    shared, members = share_patterns(patterns)
    assert (shared.count(), members.count()) == (1, 100)
    plan = plan_delete_by_pattern(inventory, patterns)
    assert plan.count() == 20_000 and plan.select("pattern_id", "object").distinct().count() == 20_000
    nodes = plan._jdf.queryExecution().optimizedPlan().toString()
    # no step groups or deduplicates by the id of a pattern and a name
    assert not [x for x in nodes.splitlines() if "Aggregate [" in x and "_member" in x.split("]")[0]]
