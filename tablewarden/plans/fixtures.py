"""Fixture views over the driver tables (FIXTURES.md part B), built with Spark.

Each builder reads the given Parquet tables and derives the operator inputs,
so every query's work grows with the tables. The same definitions exist as
DuckDB SQL in :mod:`tablewarden.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed values of the fixtures (FIXTURES.md part B).
UNKNOWN_CATALOG = "ATLANTIS"
VERSION_SPLIT = "2024-01-20 00:00:00"
MISSING_STAMP = "19990101_000000"
NEW_KEYS = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _namespaces(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.col("r_name").alias("catalog"), F.col("n_name").alias("schema"))


def f_obj(spark: SparkSession, d: str) -> DataFrame:
    """Customers as tables, suppliers as views, namespaced by region and nation."""
    ns = _namespaces(spark, d)
    c = table(spark, d, "customer")
    s = table(spark, d, "supplier")
    tables = c.join(ns, c.c_nationkey == ns.n_nationkey).select(
        "catalog", "schema", F.col("c_name").alias("object"), F.lit("table").alias("object_type"))
    views = s.join(ns, s.s_nationkey == ns.n_nationkey).select(
        "catalog", "schema", F.col("s_name").alias("object"), F.lit("view").alias("object_type"))
    return tables.unionByName(views)


def f_listing(spark: SparkSession, d: str) -> DataFrame:
    """Two listings as the catalog reports them: the table listing holds every
    object (views too), the view listing only the views."""
    obj = f_obj(spark, d)
    return obj.select("catalog", "schema", "object", F.lit("table").alias("listed_as")).unionByName(
        obj.filter(F.col("object_type") == "view").select(
            "catalog", "schema", "object", F.lit("view").alias("listed_as")))


def f_requests(spark: SparkSession, d: str) -> DataFrame:
    """Delete requests from orders: real tables, real views, missing names and
    an unknown catalog; many duplicates."""
    o, c, s = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "supplier")
    ns = _namespaces(spark, d)
    k = F.col("o_orderkey")
    is_ghost, is_supp = (k % 7 == 0), (k % 3 == 0)
    obj = (F.when(is_ghost, F.concat(F.lit("Ghost#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))
           .when(is_supp, F.concat(F.lit("Supplier#"),
                                   F.lpad((F.col("o_custkey") % 100).cast("string"), 9, "0")))
           .otherwise(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))))
    base = o.select("o_orderkey", "o_custkey", obj.alias("object"),
                    F.when(~is_ghost & is_supp, F.col("o_custkey") % 100).alias("supp_key"))
    j = (base.join(c, base.o_custkey == c.c_custkey, "left")
         .join(s, base.supp_key == s.s_suppkey, "left"))
    j = j.withColumn("nk", F.coalesce("s_nationkey", "c_nationkey"))
    j = j.join(ns, j.nk == ns.n_nationkey, "left")
    return j.select(
        F.col("o_orderkey").alias("pos"),
        F.when(k % 14 == 0, F.lit(UNKNOWN_CATALOG)).otherwise(F.col("catalog")).alias("catalog"),
        "schema", "object")


def f_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Six name patterns (parameters): prefix+suffix, prefix+contains, contains
    only, a prefix with '_' (a LIKE implementation would match it), an empty
    pattern (refused), and all three parts; and one per supplier, of six kinds:
    a long prefix, a suffix, a substring, each whole, scoped to the supplier's
    region or to its nation's schema, or to a namespace that may not exist."""
    rows = [(-1, "Customer#", "7", None), (-2, "Supplier#", None, "00"), (-3, None, None, "12"),
            (-4, "Cust_mer", None, None), (-5, "", "", ""), (-6, "Customer#", "9", "55")]
    fixed = spark.createDataFrame(rows, "pattern_id bigint, prefix string, suffix string, contains string")
    fixed = fixed.select("*", F.lit(None).cast("string").alias("catalog"), F.lit(None).cast("string").alias("schema"))
    s, ns = table(spark, d, "supplier"), _namespaces(spark, d)
    k = F.col("s_suppkey")
    digits = F.lpad((k * 7 % 1500).cast("string"), 9, "0")
    m = k % 6
    return fixed.union(s.join(ns, s.s_nationkey == ns.n_nationkey).select(
        k.cast("bigint"), F.when(m % 3 == 0, F.concat(F.lit("Customer#"), F.substring(digits, 1, 8))),
        F.when(m % 3 == 1, F.substring(digits, 6, 4)), F.when(m % 3 == 2, F.substring(digits, 5, 4)),
        F.when(m == 3, F.col("catalog")).when(m == 5, F.when(k % 5 == 0, F.lit(UNKNOWN_CATALOG)).otherwise(F.col("catalog"))),
        F.when(m.isin(4, 5), F.when(k % 7 == 0, F.lit("no_schema")).otherwise(F.col("schema")))))


def f_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Every schema there is, and one unknown beside every fifth."""
    ns = _namespaces(spark, d)
    return ns.select("catalog", "schema").union(
        ns.filter(F.col("n_nationkey") % 5 == 0).select(F.lit(UNKNOWN_CATALOG), "schema"))


def f_url_patterns(spark: SparkSession) -> DataFrame:
    rows = [(1, "https://", None, None), (2, None, "#top", None), (3, None, None, "/en/")]
    return spark.createDataFrame(rows, "pattern_id int, prefix string, suffix string, contains string")


def f_family_patterns(spark: SparkSession, d: str) -> DataFrame:
    """One pattern a customer, all with one prefix: a suffix, a substring, both, or the
    prefix alone with the customer's whole name as a suffix."""
    k = F.col("c_custkey")
    digits = F.lpad((k * 13 % 2000).cast("string"), 4, "0")
    return table(spark, d, "customer").select(
        k.cast("bigint").alias("pattern_id"), F.lit("Customer#").alias("prefix"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 3, F.col("c_name")).otherwise(F.substring(digits, 2, 3)).alias("suffix"),
        F.when(k % 4 == 0, digits).when(k % 4 == 1, F.substring(digits, 1, 2)).alias("contains"))


def f_passages(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts as substrings to be found in documents."""
    none = F.lit(None).cast("string")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("pattern_id"), none.alias("prefix"), none.alias("suffix"),
                                               F.col("text").alias("contains"))


def rows_to_delete(spark: SparkSession, d: str) -> DataFrame:
    """Documents labelled toxic, plus two ids that do not exist."""
    lab = table(spark, d, "labels")
    # From spark.range (not a local list) so the planner has size statistics.
    ghosts = spark.range(1, 3).select((-F.col("id")).alias("doc_id"))
    return lab.filter(F.col("toxic") == 1).select("doc_id").unionByName(ghosts)


def f_jobs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("job_id"), F.col("p_name").alias("job_name"))


def job_captures(spark: SparkSession, d: str) -> DataFrame:
    """Captured job-listing responses: parts grouped 100 per capture, as JSON
    ``{"jobs": [{"job_id", "settings": {"name"}}]}``, each followed by a
    trailer capture without ``jobs`` (which must add nothing) and, every third,
    by one that broke off (an error)."""
    p = table(spark, d, "part")
    cap = F.floor(F.col("p_partkey") / 100).cast("bigint")
    entry = F.struct(F.col("p_partkey").alias("job_id"),
                     F.struct(F.col("p_name").alias("name")).alias("settings"))
    grouped = p.groupBy(cap.alias("capture")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("p_partkey").alias("k"), entry.alias("e")))).alias("a"))
    page = F.struct((F.col("capture") * 3).alias("capture_pos"),
                    F.to_json(F.struct(F.transform("a", lambda x: x["e"]).alias("jobs"))).alias("doc"))
    trailer = F.struct((F.col("capture") * 3 + 1).alias("capture_pos"),
                       F.to_json(F.struct(F.lit(False).alias("has_more"))).alias("doc"))
    broken = F.struct((F.col("capture") * 3 + 2).alias("capture_pos"), F.lit('{"jobs": [').alias("doc"))
    return grouped.select(F.inline(F.when(F.col("capture") % 3 == 0, F.array(page, trailer, broken))
                                   .otherwise(F.array(page, trailer))))


def odd_captures(spark: SparkSession, d: str) -> DataFrame:
    """Job listings that are JSON but not always a listing: per 100 parts a good page, an
    error body, an object and a text in place of the list, a list in place of the body,
    and a page with an entry without an id and one that is no object."""
    p = table(spark, d, "part")
    cap = F.floor(F.col("p_partkey") / 100).cast("bigint")
    entry = F.struct(F.col("p_partkey").alias("job_id"), F.struct(F.col("p_name").alias("name")).alias("settings"))
    grouped = p.groupBy(cap.alias("capture")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("p_partkey").alias("k"), entry.alias("e")))).alias("a"))
    page = F.to_json(F.struct(F.transform("a", lambda x: x["e"]).alias("jobs")))
    denied = F.format_string('{"error_code": "DENIED", "message": "no access to %s"}', F.col("capture").cast("string"))
    texts = [page, denied, F.lit('{"jobs": {"a": 1}}'), F.lit('{"jobs": "none"}'), F.lit("[]"),
             F.lit('{"jobs": [{"settings": {"name": "x"}}, 7]}'), F.lit('{"jobs": null}')]
    return grouped.select(F.posexplode(F.array(*texts)).alias("_i", "doc"), "capture").select(
        (F.col("capture") * 10 + F.col("_i")).alias("capture_pos"), "doc")


def pipeline_captures(spark: SparkSession, d: str) -> DataFrame:
    """Captured pipeline listings from part, 100 entries per capture; even
    captures use ``statuses``, odd ones an empty ``statuses`` plus ``pipelines``."""
    p = table(spark, d, "part")
    cap = F.floor(F.col("p_partkey") / 100).cast("bigint")
    entry = F.struct(F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("pipeline_id"))
    grouped = p.groupBy(cap.alias("capture_pos")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("p_partkey").alias("k"), entry.alias("e")))).alias("a"))
    entries = F.transform("a", lambda x: x["e"])
    doc = F.when(F.col("capture_pos") % 2 == 0, F.to_json(F.struct(entries.alias("statuses"))))\
        .otherwise(F.to_json(F.struct(F.array().cast("array<struct<name:string,pipeline_id:string>>")
                                      .alias("statuses"), entries.alias("pipelines"))))
    return grouped.select("capture_pos", doc.alias("doc"))


def _task_rows(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    ln = F.col("l_linenumber")
    path = (F.when(ln == 1, F.lit("/Workspace/sample/nb")).when(ln == 2, F.lit("/Workspace/a/Workspace/b"))
            .when(ln == 3, F.lit("/Repos/x")).otherwise(F.concat(F.lit("/Workspace/nb"), ln.cast("string"))))
    # in the order of their names, as objects are stored
    params = (F.when(ln % 2 == 0, F.create_map(F.lit("Path"), F.lit("old"), F.lit("k"), F.col("l_returnflag")))
              .when(ln % 3 == 0, F.create_map(F.lit("k"), F.col("l_returnflag"))))
    task = F.struct(
        F.lit("m").alias("email_notifications"),
        F.when(F.col("l_returnflag") == "A", F.lit("old")).alias("existing_cluster_id"),
        F.struct(params.alias("base_parameters"), path.alias("notebook_path")).alias("notebook_task"),
        F.when(F.col("l_linestatus") == "F", F.struct(F.lit("p0").alias("pipeline_id"))).alias("pipeline_task"),
        F.col("p_name").alias("task_key"))
    order_cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select("l_orderkey", F.struct(*order_cols).alias("ord"), task.alias("task"))


def f_configs(spark: SparkSession, d: str) -> DataFrame:
    """Stored job configurations ``(job_id, job_name, body)`` as JSON text, one
    per order; tasks from its line items in a fixed order; orders without lines
    have no ``tasks``. The stored name differs from the job's, the tag Level is a
    number or a text, and a flag is a boolean written as text.

    Each task is serialised per line, so the grouping shuffles short strings
    and sorts them with ``sort_array`` (the task structs hold maps, which do
    not order); the body is put together from the texts of its parts.
    """
    o = table(spark, d, "orders")
    rows = _task_rows(spark, d).select("l_orderkey", F.struct("ord", F.to_json("task").alias("j")).alias("e"))
    tasks = (rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("e")).alias("t"))
             .select("l_orderkey", F.concat(F.lit("["), F.array_join(F.col("t.j"), ","), F.lit("]")).alias("tasks")))
    k = F.col("o_orderkey")
    j = o.join(tasks, o.o_orderkey == tasks.l_orderkey, "left")
    name = F.concat(F.lit("job_"), k.cast("string"))
    tags = [F.col("o_orderstatus").alias("Application"), F.col("o_orderpriority").alias("Tier")]
    level = k % 3

    def member(key: str, text: Column) -> Column:
        return F.concat(F.lit(f'"{key}":'), text)

    def members(*cols: Column) -> Column:
        """Those of a flat struct, without the braces; none if all are null."""
        text = F.to_json(F.struct(*cols))
        return F.nullif(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(""))

    settings = F.concat_ws(
        ",", members(F.concat(F.lit("stored "), k.cast("string")).alias("name")),
        F.when(k % 11 != 0, member("tags", F.when(k % 2 == 0, F.to_json(F.struct(*tags, level.alias("Level"))))
                                   .otherwise(F.to_json(F.struct(*tags, level.cast("string").alias("Level")))))),
        F.when(k % 5 == 0, F.lit('"flag":"True"')).otherwise(F.lit('"flag":"no"')),
        F.when(k % 2 == 0, F.lit('"schedule":{"pause_status":"UNPAUSED","cron":"0 0 * * *"}')),
        member("run_as", F.to_json(F.struct(F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("user_name")))),
        member("tasks", F.col("tasks")), members(F.col("o_totalprice").alias("budget")))
    body = F.concat(F.lit("{"), F.concat_ws(",", members(k.alias("job_id")), member("settings", F.concat(F.lit("{"), settings, F.lit("}")))), F.lit("}"))
    return j.select(k.alias("job_id"), name.alias("job_name"), body.alias("body"))


def f_faulty_configs(spark: SparkSession, d: str) -> DataFrame:
    """The configurations with some broken off, without a job id or without settings."""
    k = F.col("job_id")
    body = (F.when(k % 17 == 0, F.substring("body", 1, 20)).when(k % 19 == 0, F.lit('{"settings": {"x": 1}}'))
            .when(k % 23 == 0, F.lit('{"job_id": 1, "settings": []}')).otherwise(F.col("body")))
    return f_configs(spark, d).withColumn("body", body)


def f_config_listing(spark: SparkSession, d: str) -> DataFrame:
    """Job listing for the tag filter: every order is a job."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("job_id"),
                    F.concat(F.lit("job_"), F.col("o_orderkey").cast("string")).alias("job_name"))


def f_pipelines(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"),
                    F.col("p_partkey").cast("string").alias("pipeline_id"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("record_key"), F.col("ts").alias("version_ts"),
                    F.col("props").alias("body"), "event_type")


def _latest_flag(df: DataFrame) -> DataFrame:
    last = df.groupBy("record_key").agg(F.max("version_ts").alias("_last"))
    return df.join(last, "record_key").withColumn("_is_last", F.col("version_ts") == F.col("_last")).drop("_last")


def f_current(spark: SparkSession, d: str) -> DataFrame:
    """Latest version per key before the split: ``(record_key, body, saved_at)``.
    Every tenth key gets a name of its own, so it never comes in again."""
    k = F.col("record_key")
    e = _events(spark, d).filter(F.col("version_ts") < F.lit(VERSION_SPLIT).cast("timestamp_ntz"))
    return _latest_flag(e.withColumn("record_key", F.when(k % 10 == 1, -k - 1).otherwise(k))).filter("_is_last").select(
        "record_key", "body", F.col("version_ts").alias("saved_at"))


def f_archive(spark: SparkSession, d: str) -> DataFrame:
    """Every event as an archived version: ``(record_key, version_ts, body)``."""
    return _events(spark, d).select("record_key", "version_ts", "body")


def f_incoming(spark: SparkSession, d: str) -> DataFrame:
    """Latest version per key after the split: ``(record_key, body, saved_at)``;
    every tenth key is new."""
    k = F.col("record_key")
    e = _events(spark, d).filter(F.col("version_ts") >= F.lit(VERSION_SPLIT).cast("timestamp_ntz"))
    return _latest_flag(e.withColumn("record_key", F.when(k % 10 == 0, k + NEW_KEYS).otherwise(k))).filter("_is_last").select(
        "record_key", "body", F.col("version_ts").alias("saved_at"))


def f_restore(spark: SparkSession, d: str) -> DataFrame:
    """Restore requests per archived key: the latest, the earliest stamp, a stamp
    that does not exist, all three of these; and keys without an archive."""
    first = f_archive(spark, d).groupBy("record_key").agg(F.min("version_ts").alias("first_ts"))
    k = F.col("record_key") % 4
    latest, missing = F.lit(None).cast("string"), F.lit(MISSING_STAMP)
    exact = F.date_format("first_ts", "yyyyMMdd_HHmmss")
    stamps = (F.when(k == 0, F.array(latest)).when(k == 1, F.array(exact)).when(k == 2, F.array(missing))
              .otherwise(F.array(latest, exact, missing)))
    ghosts = first.filter(F.col("record_key") % 5 == 0).select((-F.col("record_key") - 1).alias("record_key"), latest)
    return first.select("record_key", F.explode(stamps).alias("restore_stamp")).union(ghosts)


def f_bool_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON documents with boolean-like strings at several depths, carrying the
    whole document text."""
    doc = table(spark, d, "documents")
    m = F.col("doc_id") % 3
    flag = F.when(m == 0, F.lit("True")).when(m == 1, F.lit("fAlSe")).otherwise(F.lit("no"))
    body = F.to_json(F.struct(
        F.col("doc_id").alias("id"), flag.alias("flag"),
        F.struct(F.array(F.lit("TRUE"), F.col("lang")).alias("a"), F.lit(" true").alias("true")).alias("nested"),
        F.col("text").alias("text")))
    return doc.select("doc_id", body.alias("body"))


def f_paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    m = F.col("p_partkey") % 4
    under = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    path = (F.when(m == 0, F.col("p_name")).when(m == 1, under)
            .when(m == 2, F.concat(under, F.lit("%"))).otherwise(F.lit("")))
    return p.select(F.col("p_partkey").alias("pos"), path.alias("path"))


def f_tag_text(spark: SparkSession, d: str) -> DataFrame:
    """``key:value`` filter texts from part: padded, with a second colon,
    without a colon, and with an empty value."""
    p = table(spark, d, "part")
    m = F.col("p_partkey") % 4
    text = (F.when(m == 0, F.concat(F.lit("  "), F.col("p_brand"), F.lit(" : "), F.col("p_type"), F.lit(" ")))
            .when(m == 1, F.concat(F.col("p_brand"), F.lit(":"), F.col("p_type"), F.lit(":x")))
            .when(m == 2, F.col("p_name"))
            .otherwise(F.concat(F.col("p_brand"), F.lit(":"))))
    return p.select(F.col("p_partkey").alias("pos"), text.alias("raw"))


def statement_results(spark: SparkSession, d: str) -> DataFrame:
    """Captured statement results, one per region: ``{"result": {"data_array":
    [[catalog, schema, flag], ...]}}``; every 4th nation row has one value only.
    Each region also has a statement that failed and one whose response broke off."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    row = F.when(F.col("n_nationkey") % 4 == 0, F.array(F.col("r_name")))\
        .otherwise(F.array(F.col("r_name"), F.col("n_name"), F.lit("false")))
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    g = j.groupBy("r_regionkey", "r_name").agg(
        F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("row")))).alias("rows"))
    doc = F.to_json(F.struct(F.struct(F.lit("SUCCEEDED").alias("state")).alias("status"),
                             F.struct(F.transform("rows", lambda x: x["row"]).alias("data_array")).alias("result")))
    failed = F.lit('{"status": {"state": "FAILED", "error": {"message": "no such schema"}}}')
    answers = [(F.col("r_name"), doc), (F.concat("r_name", F.lit(" failed")), failed),
               (F.concat("r_name", F.lit(" broken")), F.lit('{"status": '))]
    return g.select(F.inline(F.array(*[F.struct(n.alias("statement"), t.alias("doc")) for n, t in answers])))
