"""Boolean coercion, create/reset rewrites and the lookup."""

import json

from pyspark.sql import functions as F

from tablewarden.functions.jsonfix import coerce_boolean_json, coerce_boolean_text
from tablewarden.operators import build_lookup, coerce_booleans, create_from_stored, reset_from_stored
from tablewarden.sources.listings import pipeline_entries

from conftest import rows


def create(store, **kw):
    return create_from_stored(store, tags={"Application": "sample"}, target_root="/Workspace/sample/", **kw)


def coerce(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r["s"] for r in coerce_booleans(df, "s").orderBy("i").collect()]


def test_coercion_cases(spark):
    got = coerce(spark, [
        '{"a": "True", "b": "FALSE", "c": " true", "d": "yes", "true": "x"}',
        '["true", ["False", {"k": "TRUE"}], "say \\"true\\""]',
        '"true"', '"FaLsE"', '{"a": ', '{"a": 1, "a": 2}', '{"n": 2.50, "e": "tru"}'])
    assert json.loads(got[0]) == {"a": True, "b": False, "c": " true", "d": "yes", "true": "x"}
    assert json.loads(got[1]) == [True, [False, {"k": True}], 'say "true"']
    assert got[2] == "true" and got[3] == "false"
    assert got[4] is None and got[5] is None  # malformed, duplicate keys
    assert json.loads(got[6]) == {"n": 2.5, "e": "tru"}


def test_coercion_at_any_distance(spark):
    for n in (255, 256, 257, 5000):
        got = coerce(spark, ['{"a":' + " " * n + '"true", "b": [' + "\n" * n + '"FALSE"]}'])[0]
        assert json.loads(got) == {"a": True, "b": [False]}


def test_coercion_before_parsing(spark):
    texts = ['{"a": "True"}', '{"a": "\\u0074rue", "b": "x"}', '{"a": "yes", "true": 1}', '{"a": ', '["FALSE", {"k":   "true"}]', "3"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    both = df.select(F.to_json(F.try_parse_json(coerce_boolean_text(F.col("s")))), coerce_boolean_json(F.col("s"))).collect()
    assert all(a == b for a, b in both) and both[1][0] == '{"a":true,"b":"x"}'


def test_coercion_is_idempotent(spark):
    once = coerce(spark, ['{"a": ["True", {"b": "false"}]}'])[0]
    assert coerce(spark, [once])[0] == once


def _store(spark, docs):
    return spark.createDataFrame([(k, json.dumps(d)) for k, d in docs], "record_key string, body string")


DOC = {"job_id": 7, "settings": {
    "name": "orig", "run_as": {"user_name": "u"}, "tags": {"Application": "X"}, "extra": {"keep": "me"},
    "schedule": {"pause_status": "UNPAUSED", "quartz": "0 0"},
    "tasks": [
        {"task_key": "t1", "existing_cluster_id": "old", "email_notifications": {"on": ["a"]},
         "notebook_task": {"notebook_path": "/Workspace/a/Workspace/b", "base_parameters": {"Path": "p", "z": "1"}},
         "flag": "True"},
        {"task_key": "pipe", "pipeline_task": {"pipeline_id": "p0", "full": True},
         "notebook_task": {"notebook_path": "/Workspace/sample/a"}},
        {"task_key": "t3", "notebook_task": {"notebook_path": "/Repos/x",
                                             "base_parameters": {"z": "2", "on": "TRUE", "n": 3}}},
        {"task_key": "t4", "notebook_task": {"notebook_path": "a/Workspace/b"}}]}}


def test_create_rewrites_and_keeps_unknown_fields(spark):
    lookup = spark.createDataFrame([("pipe", "NEW")], "name string, pipeline_id string")
    docs = [("job_a", DOC), ("job_b", {"job_id": 8, "settings": {"name": "b", "tasks": []}}),
            ("job_c", {"job_id": 9, "settings": {"name": "c"}})]
    rw = create(_store(spark, docs), lookup=lookup, cluster_id="C1", storage_path="S")
    out = {r["record_key"]: json.loads(r["payload"]) for r in rw.records.collect()}
    s = out["job_a"]
    assert s["name"] == "job_a" and "run_as" not in s and s["tags"] == {"Application": "sample"}
    assert s["schedule"] == {"pause_status": "PAUSED", "quartz": "0 0"}
    assert s["extra"] == {"keep": "me"}
    t1, t2, t3, t4 = s["tasks"]
    assert t1["existing_cluster_id"] == "C1" and "email_notifications" not in t1 and t1["flag"] is True
    assert t1["notebook_task"] == {"notebook_path": "/Workspace/sample/a/Workspace/b",
                                   "base_parameters": {"z": "1", "Path": "S", "storage_account_name": "S"}}
    assert "existing_cluster_id" not in t2
    assert t2["pipeline_task"] == {"pipeline_id": "NEW", "full": True}
    assert t2["notebook_task"]["notebook_path"] == "/Workspace/sample/a"
    assert t3["notebook_task"] == {"notebook_path": "/Repos/x",
                                   "base_parameters": {"z": "2", "on": True, "n": 3}}
    assert t4["notebook_task"]["notebook_path"] == "a/Workspace/sample/b"
    assert rows(rw.errors, "record_key", "error") == [
        ("job_b", "No tasks found in job config for job: job_b"),
        ("job_c", "No tasks found in job config for job: job_c")]


def test_lookup_of_any_size_and_repeated_names(spark):
    st = _store(spark, [("job_a", DOC), ("job_b", DOC)]).union(
        spark.createDataFrame([(None, json.dumps(DOC))], "record_key string, body string"))
    for extra in (0, 2, 20_000):
        names = spark.range(extra).select(F.concat(F.lit("n"), "id").alias("name"), F.lit("x").alias("pipeline_id"), F.col("id").alias("pos"))
        lookup = names.union(spark.createDataFrame([("pipe", "OLD", 1), ("pipe", "NEW", 9), (None, "none", 3), ("pipe", "MID", 5)],
                                                   "name string, pipeline_id string, pos bigint"))
        out = create(st, lookup=lookup, cluster_id="C1", storage_path="S").outcomes.collect()
        assert len(out) == 3
        for r in out:
            if r["record_key"]:
                assert [t.get("pipeline_task") for t in json.loads(r["payload"])["tasks"]] == [
                    None, {"pipeline_id": "NEW", "full": True}, None, None]


def test_tasks_that_are_no_objects_stay(spark):
    doc = {"job_id": 1, "settings": {"tasks": ["x", None, 3, {"task_key": "k"}]}}
    lookup = spark.createDataFrame([("k", "1")], "name string, pipeline_id string")
    for kw in ({}, {"lookup": lookup}):
        assert json.loads(create(_store(spark, [("a", doc)]), **kw).records.first()["payload"])["tasks"] == doc["settings"]["tasks"]
        assert json.loads(reset_from_stored(_store(spark, [("a", doc)]), **kw).records.first()["payload"]) == {
            "job_id": 1, "new_settings": doc["settings"]}


def test_reset_needs_a_job_id_and_settings(spark):
    st = spark.createDataFrame([("a", '{"job_id": 1}'), ("b", "[]"), ("c", '{"job_id": 1, "settings": []}'),
                                ("d", '{"settings": {}}'), ("e", '{"job_id": 1, "settings": {}}')], "record_key string, body string")
    assert rows(reset_from_stored(st).outcomes, "record_key", "payload", "error") == sorted([
        ("a", None, "config has no settings object"), ("b", None, "config has no job_id"),
        ("c", None, "config has no settings object"), ("d", None, "config has no job_id"),
        ("e", '{"job_id":1,"new_settings":{}}', None)], key=repr)


def test_reset_changes_only_cluster_and_pipeline(spark):
    lookup = spark.createDataFrame([("pipe", "NEW")], "name string, pipeline_id string")
    rw = reset_from_stored(_store(spark, [("job_a", DOC)]), lookup=lookup, cluster_id="C1")
    env = json.loads(rw.records.collect()[0]["payload"])
    assert env["job_id"] == 7
    s = env["new_settings"]
    assert s["run_as"] == {"user_name": "u"} and s["tags"] == {"Application": "X"}
    assert s["tasks"][0]["existing_cluster_id"] == "C1"
    assert s["tasks"][0]["notebook_task"]["notebook_path"] == "/Workspace/a/Workspace/b"
    assert s["tasks"][0]["flag"] == "True"
    assert s["tasks"][1]["pipeline_task"]["pipeline_id"] == "NEW"


def test_lookup_statuses_fallback_and_last_wins(spark):
    caps = spark.createDataFrame([
        (0, json.dumps({"statuses": [{"name": "A widget", "pipeline_id": "1"}, {"name": None, "pipeline_id": "n"}]})),
        (1, json.dumps({"statuses": [], "pipelines": [{"name": "A widget", "pipeline_id": "2"},
                                                      {"name": "bolt", "pipeline_id": "3"}]})),
        (2, json.dumps({}))], "capture_pos int, doc string")
    ent = pipeline_entries(caps)
    assert ent.count() == 4
    assert rows(build_lookup(ent, "WIDGET")) == [("A widget", "2")]
    assert rows(build_lookup(ent, None), "name", "pipeline_id") == [("", "n"), ("A widget", "2"), ("bolt", "3")]


def test_unreadable_documents_go_to_errors(spark):
    st = spark.createDataFrame([("bad", '{"job_id": 1, "settings": '), ("dup", '{"a": 1, "a": 2}'),
                                ("ok", json.dumps({"job_id": 2, "settings": {"tasks": [{"task_key": "k"}]}}))],
                               "record_key string, body string")
    c = create(st)
    assert rows(c.errors, "record_key", "error") == [("bad", "config is not valid JSON"),
                                                     ("dup", "config is not valid JSON")]
    assert rows(c.records, "record_key") == [("ok",)]
    r = reset_from_stored(st)
    assert rows(r.errors, "record_key") == [("bad",), ("dup",)]
    assert rows(r.records, "record_key") == [("ok",)]


def test_rewrite_keeps_nulls_and_mixed_types(spark):
    docs = [("a", {"job_id": 1, "settings": {"x": "s", "nul": None, "tasks": [{"task_key": "k", "odd": None}]}}),
            ("b", {"job_id": 2, "settings": {"x": {"deep": [1, "TRUE"]}, "tasks": [{"task_key": "k",
                                                                                 "notebook_task": "not an object"}]}})]
    out = {r["record_key"]: json.loads(r["payload"]) for r in create(_store(spark, docs)).records.collect()}
    assert out["a"]["nul"] is None and "nul" in out["a"] and out["a"]["x"] == "s"
    assert out["a"]["tasks"] == [{"task_key": "k", "odd": None}]
    assert out["b"]["x"] == {"deep": [1, True]}
    assert out["b"]["tasks"][0]["notebook_task"] == "not an object"


def test_coercion_leaves_readable_text_as_it_is(spark):
    """Only what is a whole value changes, without the slow way through canonical text."""
    texts = ['{"b": "True", "a": 1.50, "false" : "FALSE"}', '{"a": "say \\"true\\"", "c": ":\\"true\\","}', '["abc"true"]"]', '["abc "true"]"]',
             '"tRue"', '{"k":"x,true", "t": [ "true" ,"false"]}', '{"a": "\\\\", "b":"true"}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    text = coerce_boolean_text(F.col("s"))
    got = df.select(text.alias("t"), F.to_json(F.try_parse_json(text)).alias("a"), coerce_boolean_json(F.col("s")).alias("b")).orderBy("i").collect()
    assert [r.a for r in got] == [r.b for r in got]
    assert got[0].t == '{"b": true, "a": 1.50, "false" : false}'


def test_few_names_need_no_shuffle_and_many_give_the_same(spark, monkeypatch):
    from tablewarden.operators import normalize
    st = _store(spark, [("job_a", DOC), ("job_b", {"job_id": 8, "settings": {"tasks": [{"task_key": "pipe", "pipeline_task": 5}, 3]}}),
                        ("job_c", {"job_id": 9, "settings": {"tasks": [{"task_key": "none", "pipeline_task": {"pipeline_id": "p1"}}]}})])
    entries = [("pipe", "NEW", 9), ("pipe", "OLD", 1), ("none", None, 2), (None, "x", 3)]
    for lookup in (spark.createDataFrame(entries, "name string, pipeline_id string, pos int"),
                   spark.createDataFrame([], "name string, pipeline_id string, pos int")):
        found = []
        for few in (256, -1):
            monkeypatch.setattr(normalize, "FEW_NAMES", few)
            for out in (create(st, lookup=lookup, storage_path="S").outcomes, reset_from_stored(st, lookup=lookup).outcomes):
                assert few < 0 or "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
                found.append(sorted((r.record_key, r.payload, r.error) for r in out.collect()))
        assert found[:2] == found[2:]
