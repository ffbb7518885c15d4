"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
with flat, aliased columns (arrays and maps exploded) so results compare by
value against the DuckDB oracles in :mod:`tablewarden.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.operators import (
    backup, build_lookup, check_paths, check_report, cleanup_by_token, cleanup_matrix,
    coerce_booleans, create_from_stored, delete_rows, delete_rows_by_pattern, expand_grants,
    filter_by_tags, inventory_from_listing, list_object_names, list_objects, parse_tag_filters, pick_preferred,
    plan_delete, plan_delete_by_pattern, reset_from_stored, restore, select_records, share_patterns, summarize,
    version_history, version_names,
)
from tablewarden.operators.patterns import match_patterns, normalize_patterns
from tablewarden.plans import fixtures as fx
from tablewarden.sources.listings import (
    capture_errors, decode_jobs, decode_positional, job_listing, ordered_lines, pipeline_entries, statement_errors,
)
from tablewarden.sources.scratch import new_folder
from tablewarden.sources.store import (
    committed_runs, compact_archive, read_archive, read_current, write_archive, write_current,
)

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered queries.
RUN_TS = datetime(2024, 2, 1, 12, 0, 0)
CLUSTER_ID = "uc-0001"
STORAGE = "acct01"
LOOKUP_FILTER = "WIDGET"
WANTED_TAGS = {"Application": "F", "Tier": "1-URGENT"}
TYPED_TAGS = {"Level": 1}
TAGS = {"Application": "sample"}
TARGET_ROOT = "/Workspace/sample/"
ACL = ({"group_name": "developers", "permission_level": "CAN_MANAGE"},
       {"group_name": "admins", "permission_level": "CAN_MANAGE"},
       {"group_name": "readers", "permission_level": "CAN_VIEW"},
       {"service_principal_name": "deployer", "permission_level": "IS_OWNER"})
SEARCH_NAMES = ["RING", "widget", "no-such-job"]
CLEANUP_PREFIXES = ["Customer#00000001", "Supplier#", "tmp_"]
TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    return inventory_from_listing(fx.f_listing(spark, d))


def q_delete_plan(spark: SparkSession, d: str) -> DataFrame:
    return plan_delete(_inventory(spark, d), fx.f_requests(spark, d), dry_run=True, purge=True)


def q_delete_summary(spark: SparkSession, d: str) -> DataFrame:
    return summarize(q_delete_plan(spark, d), dry_run=True)


def q_delete_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    return plan_delete_by_pattern(_inventory(spark, d), fx.f_patterns(spark, d), dry_run=True)


def q_pattern_family(spark: SparkSession, d: str) -> DataFrame:
    """Patterns that share a prefix: objects of each. Patterns that are alike have the same
    objects, which are counted once."""
    shared, members = share_patterns(fx.f_family_patterns(spark, d))
    plan = plan_delete_by_pattern(_inventory(spark, d), shared)
    per = plan.groupBy(F.col("pattern_id").alias("_id")).agg(
        F.count(F.lit(1)).alias("n_objects"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))
    return members.join(per.hint("merge"), F.col("shared_id").eqNullSafe(F.col("_id"))).select(
        "pattern_id", "n_objects", "first_name", "last_name")


def q_passages(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts that contain a whole benchmark text."""
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    return match_patterns(docs, normalize_patterns(fx.f_passages(spark, d)), "text").select("doc_id", F.col("pattern_id").alias("item_id"))


def q_delete_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables only, and not a dry run."""
    return plan_delete(_inventory(spark, d), fx.f_requests(spark, d), types=["table"], dry_run=False)


def q_delete_nothing(spark: SparkSession, d: str) -> DataFrame:
    """No request at all is refused; patterns that match nothing are a success."""
    inv = _inventory(spark, d)
    none = summarize(plan_delete(inv, fx.f_requests(spark, d).filter("pos < 0")), dry_run=True)
    odd = fx.f_patterns(spark, d).filter("prefix = 'Cust_mer'")
    return none.withColumn("kind", F.lit("requests")).unionByName(
        summarize(plan_delete_by_pattern(inv, odd), dry_run=True, by_pattern=True).withColumn("kind", F.lit("patterns")))


def q_pattern_summary(spark: SparkSession, d: str) -> DataFrame:
    return summarize(q_delete_by_pattern(spark, d), dry_run=True, by_pattern=True)


def _doc_deletion(spark: SparkSession, d: str):
    return delete_rows(fx.table(spark, d, "documents"), fx.rows_to_delete(spark, d), ["doc_id"],
                       dry_run=False)


def q_rows_removed(spark: SparkSession, d: str) -> DataFrame:
    return _doc_deletion(spark, d).removed


def q_rows_survive(spark: SparkSession, d: str) -> DataFrame:
    return _doc_deletion(spark, d).survivors


def q_rows_not_found(spark: SparkSession, d: str) -> DataFrame:
    return _doc_deletion(spark, d).not_found


def _page_deletion(spark: SparkSession, d: str):
    return delete_rows_by_pattern(fx.table(spark, d, "pages"), "url", fx.f_url_patterns(spark), dry_run=False)


def q_rows_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    return _page_deletion(spark, d).removed


def q_rows_by_pattern_survive(spark: SparkSession, d: str) -> DataFrame:
    return _page_deletion(spark, d).survivors


def q_rows_by_pattern_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Customers' patterns that no part name matches, and those refused."""
    parts = fx.table(spark, d, "part")
    words = fx.table(spark, d, "customer").select(
        F.col("c_custkey").alias("pattern_id"), F.lit(None).cast("string").alias("prefix"),
        F.lit(None).cast("string").alias("suffix"),
        F.when(F.col("c_custkey") % 9 != 0, F.lower(F.substring("c_mktsegment", 1, 2))).alias("contains"))
    return delete_rows_by_pattern(parts, "p_name", words).not_found


def q_cleanup_matrix(spark: SparkSession, d: str) -> DataFrame:
    return cleanup_matrix(_inventory(spark, d), fx.f_schemas(spark, d), CLEANUP_PREFIXES)


def q_cleanup_token(spark: SparkSession, d: str) -> DataFrame:
    tokens = fx.table(spark, d, "part").select(
        F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("token")).distinct()
    plan = cleanup_by_token(_inventory(spark, d), tokens, template="{}")
    per = plan.filter(F.col("outcome") == "executed").groupBy("token").agg(
        F.count(F.lit(1)).alias("n_objects"),
        F.count_if(F.col("type") == "table").alias("n_tables"),
        F.count_if(F.col("type") == "view").alias("n_views"))
    return tokens.join(per, "token", "left").select(
        "token", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                   for c in ("n_objects", "n_tables", "n_views")])


def q_listing_match(spark: SparkSession, d: str) -> DataFrame:
    listing = job_listing(fx.job_captures(spark, d))
    names = spark.createDataFrame([(n,) for n in SEARCH_NAMES], "name string")
    return select_records(listing, names)


def q_listing_errors(spark: SparkSession, d: str) -> DataFrame:
    return capture_errors(fx.job_captures(spark, d), keep=["capture_pos"])


def q_listing_decode(spark: SparkSession, d: str) -> DataFrame:
    """Rows and errors of one pass over listings, some of which are none."""
    return decode_jobs(fx.odd_captures(spark, d), keep=["capture_pos"])


def q_ordered_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requested names written to ordered text files and read back with their places:
    the first of each name."""
    root = new_folder(spark, "requests")
    fx.f_requests(spark, d).repartitionByRange("pos").sortWithinPartitions("pos").select("object").write.text(root)
    return ordered_lines(spark, root).groupBy(F.col("value").alias("object")).agg(
        F.min("pos").cast("bigint").alias("first_pos"), F.count(F.lit(1)).alias("n"))


def q_inventory_names(spark: SparkSession, d: str) -> DataFrame:
    return list_object_names(_inventory(spark, d), ["view"])


def q_inventory_counts(spark: SparkSession, d: str) -> DataFrame:
    return list_objects(_inventory(spark, d))


def q_tag_filter(spark: SparkSession, d: str) -> DataFrame:
    cfg = fx.f_faulty_configs(spark, d).filter("job_id % 13 != 0").select("job_id", "body")
    return filter_by_tags(fx.f_config_listing(spark, d), cfg, WANTED_TAGS)


def q_tag_typed(spark: SparkSession, d: str) -> DataFrame:
    """A wanted number is not met by the same digits as text."""
    return filter_by_tags(fx.f_config_listing(spark, d), fx.f_configs(spark, d).select("job_id", "body"), TYPED_TAGS)


def q_lookup(spark: SparkSession, d: str) -> DataFrame:
    return build_lookup(pipeline_entries(fx.pipeline_captures(spark, d)), LOOKUP_FILTER)


def _ts_text(c: str) -> Column:
    return F.date_format(F.col(c), TS_TEXT)


def _backup(spark: SparkSession, d: str):
    return backup(fx.f_incoming(spark, d), fx.f_current(spark, d), RUN_TS)


def q_backup_current(spark: SparkSession, d: str) -> DataFrame:
    cur = _backup(spark, d).current
    return cur.select("record_key", "body", _ts_text("saved_at").alias("saved_at"))


def q_backup_archive(spark: SparkSession, d: str) -> DataFrame:
    arc = _backup(spark, d).archive
    return arc.select("record_key", F.date_format("version_ts", "yyyyMMdd_HHmmss").alias("version_stamp"),
                      "archive_date", "body")


def q_current_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of the current store: the second is read back, its base is named."""
    root = new_folder(spark, "current")
    named = lambda df: df.withColumn("record_key", F.col("record_key").cast("string"))
    write_current(named(fx.f_current(spark, d)), root, datetime(2024, 1, 20))
    base = read_current(spark, root)
    write_current(backup(named(fx.f_incoming(spark, d)), base, RUN_TS).current, root, RUN_TS)
    return read_current(spark, root).select("record_key", "body", _ts_text("saved_at").alias("saved_at"),
                                            F.lit(len(committed_runs(spark, root))).cast("bigint").alias("n_runs"))


def q_archive_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Every version written to the archive in three runs, compacted and read back."""
    root = new_folder(spark, "archive")
    rows = fx.f_archive(spark, d).select(F.col("record_key").cast("string").alias("record_key"), "version_ts", "body",
                                         F.date_format("version_ts", "yyyyMMdd").alias("archive_date"))
    for i in range(3):
        write_archive(rows.filter(F.pmod(F.dayofmonth("version_ts"), F.lit(3)) == i), root, datetime(2024, 3, 1 + i))
    replaced = compact_archive(spark, root, RUN_TS)
    return read_archive(spark, root).select("record_key", F.date_format("version_ts", "yyyyMMdd_HHmmss").alias("version_stamp"), "body",
                                            "archive_date", F.lit(len(replaced)).cast("bigint").alias("n_replaced"))


def _restore(spark: SparkSession, d: str):
    return restore(fx.f_archive(spark, d), fx.f_restore(spark, d), RUN_TS)


def q_restore_latest(spark: SparkSession, d: str) -> DataFrame:
    r = _restore(spark, d).restored
    return r.filter(F.col("mode") == "latest").select("record_key", "version_stamp", "body")


def q_restore_exact(spark: SparkSession, d: str) -> DataFrame:
    r = _restore(spark, d).restored
    return r.filter(F.col("mode") == "exact").select("record_key", "version_stamp", "body")


def q_restore_missing(spark: SparkSession, d: str) -> DataFrame:
    return _restore(spark, d).missing


def q_version_history(spark: SparkSession, d: str) -> DataFrame:
    return version_history(fx.f_archive(spark, d))


def q_version_names(spark: SparkSession, d: str) -> DataFrame:
    return version_names(fx.f_archive(spark, d))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return fx.f_configs(spark, d).select(F.col("job_name").alias("record_key"), "body")


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    """All names, not only those of the filter."""
    return build_lookup(fx.f_pipelines(spark, d))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _tasks(records: DataFrame, settings: Column) -> DataFrame:
    """One row per task of the rewritten settings (``map<string, variant>``)."""
    tasks = F.try_element_at(settings, F.lit("tasks")).try_cast("array<map<string,variant>>")
    ex = records.select("job_id", F.posexplode(tasks).alias("_pos", "t"))
    t = F.col("t")

    def get(key: str) -> Column:
        return F.try_element_at(t, F.lit(key))

    return ex.select(
        F.col("job_id").cast("bigint").alias("job_id"), (F.col("_pos") + 1).cast("bigint").alias("task_pos"),
        _text(get("task_key"), "$").alias("task_key"),
        _text(get("existing_cluster_id"), "$").alias("existing_cluster_id"),
        _text(get("pipeline_task"), "$.pipeline_id").alias("pipeline_id"),
        _text(get("notebook_task"), "$.notebook_path").alias("notebook_path"),
        _text(get("notebook_task"), "$.base_parameters.Path").alias("param_path"),
        _text(get("notebook_task"), "$.base_parameters.storage_account_name").alias("param_storage"),
        _text(get("notebook_task"), "$.base_parameters.k").alias("param_k"),
        F.map_contains_key(t, "email_notifications").alias("has_email"))


def _create(spark: SparkSession, d: str):
    return create_from_stored(_stored(spark, d), lookup=_lookup(spark, d), cluster_id=CLUSTER_ID,
                              storage_path=STORAGE, tags=TAGS, target_root=TARGET_ROOT)


def q_create_tasks(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(_create(spark, d).records, F.col("settings"))


def q_create_settings(spark: SparkSession, d: str) -> DataFrame:
    out = _create(spark, d).outcomes  # one pass for created and rejected records
    s = F.col("settings")
    ok = F.col("error").isNull()

    def get(key: str) -> Column:
        return F.try_element_at(s, F.lit(key))

    return out.select(
        F.col("job_id").cast("bigint").alias("job_id"),
        F.coalesce(_text(get("name"), "$"), F.col("record_key")).alias("name"),
        F.when(ok, F.lit("created")).otherwise(F.lit("rejected")).alias("outcome"), "error",
        F.when(ok, F.map_contains_key(s, "run_as")).alias("has_run_as"),
        _text(get("tags"), "$.Application").alias("tag_application"),
        F.size(get("tags").try_cast("map<string,variant>")).cast("bigint").alias("n_tags"),
        _text(get("schedule"), "$.pause_status").alias("pause_status"),
        F.size(get("tasks").try_cast("array<variant>")).cast("bigint").alias("n_tasks"))


def q_reset_tasks(spark: SparkSession, d: str) -> DataFrame:
    rw = reset_from_stored(_stored(spark, d), lookup=_lookup(spark, d), cluster_id=CLUSTER_ID)
    out = _tasks(rw.records, F.col("settings"))
    return out.drop("param_storage", "param_k")


def q_create_payload(spark: SparkSession, d: str) -> DataFrame:
    """The payload text read back: name override and boolean coercion."""
    v = F.parse_json("payload")
    return _create(spark, d).records.select(
        "record_key", F.try_variant_get(v, "$.name", "string").alias("name"),
        F.to_json(F.try_variant_get(v, "$.flag", "variant")).alias("flag"),
        F.try_variant_get(v, "$.budget", "double").alias("budget"),
        F.size(F.try_variant_get(v, "$.tasks", "array<variant>")).cast("bigint").alias("n_tasks"))


def q_reset_payload(spark: SparkSession, d: str) -> DataFrame:
    """The envelope text read back, and the errors, over faulty configurations."""
    stored = fx.f_faulty_configs(spark, d).select(F.col("job_name").alias("record_key"), "body")
    v = F.parse_json("payload")
    return reset_from_stored(stored, lookup=_lookup(spark, d), cluster_id=CLUSTER_ID).outcomes.select(
        "record_key", F.try_variant_get(v, "$.job_id", "bigint").alias("job_id"),
        F.try_variant_get(v, "$.new_settings.name", "string").alias("name"),
        F.try_variant_get(v, "$.new_settings.run_as.user_name", "string").alias("run_as"),
        F.to_json(F.try_variant_get(v, "$.new_settings.flag", "variant")).alias("flag"),
        F.size(F.try_variant_get(v, "$.new_settings.tasks", "array<variant>")).cast("bigint").alias("n_tasks"), "error")


def q_coerce(spark: SparkSession, d: str) -> DataFrame:
    c = coerce_booleans(fx.f_bool_json(spark, d), "body", "coerced")
    c = c.select("doc_id", F.parse_json(F.col("coerced")).alias("v"))
    v = F.col("v")
    return c.select(
        "doc_id", F.to_json(F.variant_get(v, "$.flag", "variant")).alias("flag"),
        F.to_json(F.variant_get(v, "$.nested.a", "variant")).alias("a"),
        F.variant_get(v, "$['nested']['true']", "string").alias("nested_true"),
        F.variant_get(v, "$.text", "string").alias("text"))


def q_grants(spark: SparkSession, d: str) -> DataFrame:
    return expand_grants(fx.f_jobs(spark, d), ACL)


def q_checks(spark: SparkSession, d: str) -> DataFrame:
    lab = fx.table(spark, d, "labels")
    checks = lab.select(F.col("doc_id").cast("string").alias("check"),
                        (F.col("quality") == 1).alias("passed"), "toxic")
    return check_report(checks, by=["toxic"])


def q_pick_preferred(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return pick_preferred(o, ["o_custkey"], "o_orderkey", "o_orderstatus", preferred="O")


def q_positional(spark: SparkSession, d: str) -> DataFrame:
    return decode_positional(fx.statement_results(spark, d), keep=["statement"])


def q_statement_errors(spark: SparkSession, d: str) -> DataFrame:
    return statement_errors(fx.statement_results(spark, d), keep=["statement"])


def q_tag_text(spark: SparkSession, d: str) -> DataFrame:
    return parse_tag_filters(fx.f_tag_text(spark, d))


def q_path_check(spark: SparkSession, d: str) -> DataFrame:
    return check_paths(fx.f_paths(spark, d))


QUERIES: dict[str, Query] = {
    name: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
