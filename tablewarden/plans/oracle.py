"""DuckDB oracle SQL for every registered query.

The fixture views of :mod:`tablewarden.plans.fixtures` are restated as SQL
CTEs over the pre-registered driver tables; each query's SQL names the
fixtures it uses and :func:`with_fixtures` prepends them (with their
dependencies) in order.
"""

from __future__ import annotations

import re

FIXTURE_SQL: dict[str, str] = {
    "f_ns": """SELECT n_nationkey, r_name AS catalog, n_name AS schema
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "f_obj": """SELECT catalog, schema, c_name AS object, 'table' AS object_type
          FROM customer JOIN f_ns ON c_nationkey = n_nationkey
        UNION ALL
        SELECT catalog, schema, s_name AS object, 'view' AS object_type
          FROM supplier JOIN f_ns ON s_nationkey = n_nationkey""",
    "f_listing": """SELECT catalog, schema, object, 'table' AS listed_as FROM f_obj
        UNION ALL SELECT catalog, schema, object, 'view' FROM f_obj WHERE object_type = 'view'""",
    "f_inv": """SELECT catalog, schema, object,
          CASE WHEN max(CASE WHEN listed_as = 'view' THEN 1 ELSE 0 END) = 1 THEN 'view' ELSE 'table' END
            AS object_type
        FROM f_listing GROUP BY catalog, schema, object""",
    "f_requests": """SELECT o.o_orderkey AS pos,
          CASE WHEN o.o_orderkey % 14 = 0 THEN 'ATLANTIS' ELSE ns.catalog END AS catalog,
          ns.schema AS schema, b.object
        FROM (SELECT o_orderkey, o_custkey,
                CASE WHEN o_orderkey % 7 = 0 THEN 'Ghost#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')
                     WHEN o_orderkey % 3 = 0 THEN 'Supplier#' || lpad(CAST(o_custkey % 100 AS VARCHAR), 9, '0')
                     ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS object,
                CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 = 0 THEN o_custkey % 100 END AS supp_key
              FROM orders) b
        JOIN orders o ON o.o_orderkey = b.o_orderkey
        LEFT JOIN customer c ON b.o_custkey = c.c_custkey
        LEFT JOIN supplier s ON b.supp_key = s.s_suppkey
        LEFT JOIN f_ns ns ON ns.n_nationkey = coalesce(s.s_nationkey, c.c_nationkey)""",
    "f_patterns": """SELECT CAST(pattern_id AS BIGINT) AS pattern_id, prefix, suffix, contains, NULL AS catalog, NULL AS schema
        FROM (VALUES (-1, 'Customer#', '7', NULL), (-2, 'Supplier#', NULL, '00'),
          (-3, NULL, NULL, '12'), (-4, 'Cust_mer', NULL, NULL), (-5, '', '', ''),
          (-6, 'Customer#', '9', '55')) t(pattern_id, prefix, suffix, contains)
        UNION ALL
        SELECT k, CASE WHEN k % 3 = 0 THEN 'Customer#' || substr(g, 1, 8) END, CASE WHEN k % 3 = 1 THEN substr(g, 6, 4) END,
          CASE WHEN k % 3 = 2 THEN substr(g, 5, 4) END,
          CASE k % 6 WHEN 3 THEN catalog WHEN 5 THEN CASE WHEN k % 5 = 0 THEN 'ATLANTIS' ELSE catalog END END,
          CASE WHEN k % 6 >= 4 THEN CASE WHEN k % 7 = 0 THEN 'no_schema' ELSE schema END END
        FROM (SELECT s_suppkey AS k, lpad(CAST(s_suppkey * 7 % 1500 AS VARCHAR), 9, '0') AS g, catalog, schema
              FROM supplier JOIN f_ns ON s_nationkey = n_nationkey)""",
    "f_pattern_plan": """WITH p AS (SELECT pattern_id, nullif(prefix, '') AS prefix,
              nullif(suffix, '') AS suffix, nullif(contains, '') AS contains, catalog AS pc, schema AS ps FROM f_patterns),
        hits AS (SELECT p.pattern_id, i.catalog, i.schema, i.object,
              arg_min(i.object_type, CASE i.object_type WHEN 'table' THEN 1 ELSE 2 END) AS type
            FROM f_inv i JOIN p ON (p.prefix IS NOT NULL OR p.suffix IS NOT NULL OR p.contains IS NOT NULL)
              AND (p.prefix IS NULL OR starts_with(i.object, p.prefix))
              AND (p.suffix IS NULL OR ends_with(i.object, p.suffix))
              AND (p.contains IS NULL OR contains(i.object, p.contains))
              AND (p.pc IS NULL OR i.catalog = p.pc) AND (p.ps IS NULL OR i.schema = p.ps)
            GROUP BY p.pattern_id, i.catalog, i.schema, i.object),
        q AS (SELECT *, '`' || replace(catalog, '`', '``') || '`.`' || replace(schema, '`', '``') || '`.`'
              || replace(object, '`', '``') || '`' AS fq FROM hits)
        SELECT pattern_id, catalog, schema, object AS name, fq AS object, type, 'executed' AS outcome,
               'dry_run' AS status, 'DROP ' || upper(type) || ' IF EXISTS ' || fq AS sql,
               CAST(NULL AS VARCHAR) AS error FROM q
        UNION ALL
        SELECT pattern_id, pc, ps, CAST(NULL AS VARCHAR),
               CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'error', CAST(NULL AS VARCHAR),
               CAST(NULL AS VARCHAR),
               CASE WHEN prefix IS NULL AND suffix IS NULL AND contains IS NULL
                 THEN 'At least one filter (prefix, suffix, contains) must be specified'
                 ELSE 'Invalid catalog or schema' END
        FROM p WHERE (prefix IS NULL AND suffix IS NULL AND contains IS NULL) OR NOT EXISTS (
          SELECT 1 FROM f_inv i WHERE (p.pc IS NULL OR i.catalog = p.pc) AND (p.ps IS NULL OR i.schema = p.ps))""",
    "f_schemas": """SELECT catalog, schema FROM f_ns
        UNION ALL SELECT 'ATLANTIS', schema FROM f_ns WHERE n_nationkey % 5 = 0""",
    "f_del_req": """SELECT doc_id FROM labels WHERE toxic = 1
        UNION ALL SELECT CAST(-1 AS BIGINT) UNION ALL SELECT CAST(-2 AS BIGINT)""",
    "f_plan": """SELECT CAST(r.pos AS BIGINT) AS pos, r.catalog, r.schema, r.object AS name,
          '`' || replace(r.catalog, '`', '``') || '`.`' || replace(r.schema, '`', '``') || '`.`'
            || replace(r.object, '`', '``') || '`' AS fq,
          CASE WHEN ns.catalog IS NOT NULL AND i.object_type IS NOT NULL THEN i.object_type END AS type,
          ns.catalog IS NOT NULL AS ns_ok, r.n_requested
        FROM (SELECT catalog, schema, object, min(pos) AS pos, count(*) AS n_requested
              FROM f_requests GROUP BY catalog, schema, object) r
        LEFT JOIN f_inv i ON r.catalog = i.catalog AND r.schema = i.schema AND r.object = i.object
        LEFT JOIN (SELECT DISTINCT catalog, schema FROM f_inv) ns
          ON r.catalog = ns.catalog AND r.schema = ns.schema""",
    "f_delete_plan": """SELECT pos, catalog, schema, name, fq AS object, type,
          CASE WHEN type IS NOT NULL THEN 'executed' ELSE 'error' END AS outcome,
          CASE WHEN type IS NOT NULL THEN 'dry_run' END AS status,
          CASE WHEN type IS NOT NULL THEN 'DROP ' || upper(type) || ' IF EXISTS ' || fq
            || CASE WHEN type = 'table' THEN ' PURGE' ELSE '' END END AS sql,
          CASE WHEN type IS NULL THEN CASE WHEN NOT ns_ok THEN 'Invalid catalog or schema'
            ELSE 'Object not found or not a table/view' END END AS error,
          n_requested
        FROM f_plan""",
    "f_jobs": "SELECT p_partkey AS job_id, p_name AS job_name FROM part",
    "f_config_orders": """SELECT o_orderkey AS job_id, 'job_' || CAST(o_orderkey AS VARCHAR) AS job_name,
          o_orderstatus, o_orderpriority, o_custkey, o_totalprice FROM orders""",
    "f_lookup": """SELECT p_name AS name, arg_max(CAST(p_partkey AS VARCHAR), p_partkey) AS pipeline_id
        FROM part GROUP BY p_name""",
    "f_task_lines": """SELECT l.l_orderkey AS job_id,
          row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
            l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus,
            l.l_shipdate) AS task_pos,
          p.p_name AS task_key, l.l_returnflag, l.l_linestatus, l.l_linenumber AS ln
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
        WHERE l.l_orderkey IN (SELECT o_orderkey FROM orders)""",
    "f_events": """SELECT user_id AS record_key, ts AS version_ts, props AS body FROM events""",
    "f_current": """SELECT CASE WHEN record_key % 10 = 1 THEN -record_key - 1 ELSE record_key END AS record_key, body, version_ts AS saved_at
        FROM (SELECT *, version_ts = max(version_ts) OVER (PARTITION BY record_key) AS is_last
              FROM f_events WHERE version_ts < TIMESTAMP '2024-01-20 00:00:00') WHERE is_last""",
    "f_archive": """SELECT record_key, version_ts, body, strftime(version_ts, '%Y%m%d_%H%M%S') AS stamp FROM f_events""",
    "f_incoming": """SELECT CASE WHEN record_key % 10 = 0 THEN record_key + 1000000000 ELSE record_key END AS record_key, body, saved_at FROM (
          SELECT record_key, body, version_ts AS saved_at,
            version_ts = max(version_ts) OVER (PARTITION BY record_key) AS is_last
          FROM f_events WHERE version_ts >= TIMESTAMP '2024-01-20 00:00:00')
        WHERE is_last""",
    "f_restore": """WITH first AS (SELECT record_key, min(version_ts) AS ts FROM f_archive GROUP BY record_key)
        SELECT record_key, CAST(NULL AS VARCHAR) AS restore_stamp FROM first WHERE record_key % 4 IN (0, 3)
        UNION ALL SELECT record_key, strftime(ts, '%Y%m%d_%H%M%S') FROM first WHERE record_key % 4 IN (1, 3)
        UNION ALL SELECT record_key, '19990101_000000' FROM first WHERE record_key % 4 IN (2, 3)
        UNION ALL SELECT -record_key - 1, NULL FROM first WHERE record_key % 5 = 0""",
}

_TS = "'%Y-%m-%d %H:%M:%S.%f'"

QUERY_SQL: dict[str, str] = {
    "q_delete_plan": "SELECT * FROM f_delete_plan",
    "q_delete_summary": """SELECT (errors = 0 AND n > 0) AS success, executed, errors, true AS dry_run,
          CASE WHEN n = 0 THEN 'No objects specified' END AS message
        FROM (SELECT count(*) FILTER (WHERE outcome = 'executed') AS executed,
                     count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) AS n
              FROM f_delete_plan)""",
    "q_delete_by_pattern": "SELECT * FROM f_pattern_plan",
    "q_pattern_summary": """SELECT errors = 0 AS success, executed, errors, true AS dry_run,
          CASE WHEN executed + errors = 0 THEN 'No objects found matching pattern' END AS message
        FROM (SELECT count(*) FILTER (WHERE outcome = 'executed') AS executed,
                     count(*) FILTER (WHERE outcome = 'error') AS errors FROM f_pattern_plan)""",
    "q_pattern_family": """WITH p AS (SELECT c_custkey AS pattern_id, c_custkey % 4 AS m, c_name,
              lpad(CAST(c_custkey * 13 % 2000 AS VARCHAR), 4, '0') AS g FROM customer)
        SELECT CAST(p.pattern_id AS BIGINT) AS pattern_id, count(DISTINCT (i.catalog, i.schema, i.object)) AS n_objects,
               min(i.object) AS first_name, max(i.object) AS last_name
        FROM p JOIN f_inv i ON starts_with(i.object, 'Customer#')
          AND CASE p.m WHEN 0 THEN contains(i.object, p.g) WHEN 3 THEN ends_with(i.object, p.c_name)
                WHEN 1 THEN ends_with(i.object, substr(p.g, 2, 3)) AND contains(i.object, substr(p.g, 1, 2))
                ELSE ends_with(i.object, substr(p.g, 2, 3)) END
        GROUP BY p.pattern_id""",
    "q_passages": """SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)""",
    "q_delete_tables": """SELECT pos, catalog, schema, name, fq AS object,
          CASE WHEN ok THEN 'table' END AS type, CASE WHEN ok THEN 'executed' ELSE 'error' END AS outcome,
          CASE WHEN ok THEN 'deleted' END AS status, CASE WHEN ok THEN 'DROP TABLE IF EXISTS ' || fq END AS sql,
          CASE WHEN NOT ok THEN CASE WHEN NOT ns_ok THEN 'Invalid catalog or schema'
            ELSE 'Object not found or not a table' END END AS error, n_requested
        FROM (SELECT *, coalesce(type = 'table', false) AS ok FROM f_plan)""",
    "q_delete_nothing": """SELECT * FROM (VALUES
          (false, CAST(0 AS BIGINT), CAST(0 AS BIGINT), true, 'No objects specified', 'requests'),
          (true, 0, 0, true, 'No objects found matching pattern', 'patterns'))
          t(success, executed, errors, dry_run, message, kind)""",
    "q_rows_removed": "SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM f_del_req)",
    "q_rows_survive": "SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f_del_req)",
    "q_rows_not_found": """SELECT DISTINCT doc_id FROM f_del_req
        WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "q_rows_by_pattern": """SELECT * FROM pages WHERE starts_with(url, 'https://') OR ends_with(url, '#top')
        OR contains(url, '/en/')""",
    "q_rows_by_pattern_survive": """SELECT * FROM pages WHERE NOT coalesce(starts_with(url, 'https://')
        OR ends_with(url, '#top') OR contains(url, '/en/'), false)""",
    "q_rows_by_pattern_unmatched": """SELECT c_custkey AS pattern_id, c_custkey % 9 = 0 AS refused FROM customer
        WHERE c_custkey % 9 = 0 OR NOT EXISTS (SELECT 1 FROM part WHERE contains(p_name, lower(c_mktsegment[1:2])))""",
    "q_listing_errors": """SELECT DISTINCT CAST(floor(p_partkey / 100) AS BIGINT) * 3 + 2 AS capture_pos,
          'response is not valid JSON' AS error FROM part WHERE CAST(floor(p_partkey / 100) AS BIGINT) % 3 = 0""",
    "q_listing_decode": """WITH caps AS (SELECT DISTINCT CAST(floor(p_partkey / 100) AS BIGINT) AS c FROM part)
        SELECT CAST(floor(p_partkey / 100) AS BIGINT) * 10 AS capture_pos,
          CAST(row_number() OVER (PARTITION BY floor(p_partkey / 100) ORDER BY p_partkey) - 1 AS INTEGER) AS entry,
          p_partkey AS job_id, p_name AS job_name, CAST(NULL AS VARCHAR) AS error FROM part
        UNION ALL
        SELECT c * 10 + k, e, NULL, n, replace(error, '#', CAST(c AS VARCHAR)) FROM caps, (VALUES
          (1, NULL, NULL, 'DENIED: no access to #'), (2, NULL, NULL, 'jobs is not a list'), (3, NULL, NULL, 'jobs is not a list'),
          (4, NULL, NULL, 'response is not a JSON object'), (5, 0, 'x', 'job without a job_id'), (5, 1, NULL, 'entry is not an object'))
          t(k, e, n, error)""",
    "q_ordered_requests": """SELECT object, min(p) AS first_pos, count(*) AS n
        FROM (SELECT object, row_number() OVER (ORDER BY pos) - 1 AS p FROM f_requests) GROUP BY object""",
    "q_current_runs": f"""SELECT CAST(record_key AS VARCHAR) AS record_key, body, strftime(saved_at, {_TS}) AS saved_at, CAST(2 AS BIGINT) AS n_runs
        FROM (SELECT record_key, body, saved_at FROM f_incoming
          UNION ALL SELECT record_key, body, saved_at FROM f_current WHERE record_key NOT IN (SELECT record_key FROM f_incoming))""",
    "q_archive_compacted": """SELECT CAST(record_key AS VARCHAR) AS record_key, stamp AS version_stamp, body,
          strftime(version_ts, '%Y%m%d') AS archive_date, CAST(3 AS BIGINT) AS n_replaced FROM f_archive""",
    "q_inventory_names": "SELECT catalog, schema, object, object_type FROM f_inv WHERE object_type = 'view'",
    "q_statement_errors": """SELECT r_name || k AS statement, error FROM region,
          (VALUES (' failed', 'Statement failed: no such schema'), (' broken', 'response is not valid JSON')) t(k, error)""",
    "q_tag_typed": """SELECT o_orderkey AS job_id, 'job_' || CAST(o_orderkey AS VARCHAR) AS job_name,
          'matched' AS status, CAST(NULL AS VARCHAR) AS reason
        FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 2 = 0 AND o_orderkey % 3 = 1""",
    "q_create_payload": """SELECT o.job_name AS record_key, o.job_name AS name,
          CASE WHEN o.job_id % 5 = 0 THEN 'true' ELSE '"no"' END AS flag, CAST(o.o_totalprice AS DOUBLE) AS budget, n.n AS n_tasks
        FROM f_config_orders o JOIN (SELECT job_id, count(*) AS n FROM f_task_lines GROUP BY job_id) n ON o.job_id = n.job_id""",
    "q_reset_payload": """SELECT o.job_name AS record_key, CASE WHEN error IS NULL THEN o.job_id END AS job_id,
          CASE WHEN error IS NULL THEN 'stored ' || CAST(o.job_id AS VARCHAR) END AS name,
          CASE WHEN error IS NULL THEN 'user' || CAST(o.o_custkey AS VARCHAR) END AS run_as,
          CASE WHEN error IS NULL THEN CASE WHEN o.job_id % 5 = 0 THEN '"True"' ELSE '"no"' END END AS flag,
          CASE WHEN error IS NULL THEN n.n END AS n_tasks, error
        FROM (SELECT *, CASE WHEN job_id % 17 = 0 THEN 'config is not valid JSON'
                WHEN job_id % 19 = 0 THEN 'config has no job_id'
                WHEN job_id % 23 = 0 THEN 'config has no settings object' END AS error FROM f_config_orders) o
        LEFT JOIN (SELECT job_id, count(*) AS n FROM f_task_lines GROUP BY job_id) n ON o.job_id = n.job_id""",
    "q_cleanup_matrix": """WITH sch AS (SELECT DISTINCT catalog, schema FROM f_schemas),
        pre AS (SELECT * FROM (VALUES ('Customer#00000001'), ('Supplier#'), ('tmp_')) t(prefix)),
        ok AS (SELECT s.catalog, s.schema, EXISTS (SELECT 1 FROM f_inv i WHERE i.catalog = s.catalog
              AND i.schema = s.schema) AS valid FROM sch s),
        hits AS (SELECT s.catalog, s.schema, count(DISTINCT i.object) AS n FROM sch s, pre,
              f_inv i WHERE i.catalog = s.catalog AND i.schema = s.schema AND starts_with(i.object, pre.prefix)
            GROUP BY s.catalog, s.schema)
        SELECT ok.catalog, ok.schema, CAST(3 AS BIGINT) AS n_prefixes,
               coalesce(hits.n, 0) AS executed,
               CAST(CASE WHEN ok.valid THEN 0 ELSE 3 END AS BIGINT) AS errors, ok.valid AS success
        FROM ok LEFT JOIN hits ON ok.catalog = hits.catalog AND ok.schema = hits.schema""",
    "q_cleanup_token": """WITH tok AS (SELECT DISTINCT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS token FROM part)
        SELECT t.token, count(i.object) AS n_objects,
               count(i.object) FILTER (WHERE i.object_type = 'table') AS n_tables,
               count(i.object) FILTER (WHERE i.object_type = 'view') AS n_views
        FROM tok t LEFT JOIN f_inv i ON contains(i.object, t.token) GROUP BY t.token""",
    "q_listing_match": """WITH listing AS (SELECT p_partkey AS job_id, p_name AS job_name FROM part),
        names AS (SELECT * FROM (VALUES ('RING'), ('widget'), ('no-such-job')) t(name)),
        pairs AS (SELECT n.name, l.job_id, l.job_name FROM listing l JOIN names n
              ON contains(lower(coalesce(l.job_name, '')), lower(n.name)))
        SELECT name, job_id, job_name, count(*) OVER (PARTITION BY name) AS n_matches,
               row_number() OVER (PARTITION BY name ORDER BY lower(job_name) <> lower(name), job_id) = 1
                 AS selected
        FROM pairs""",
    "q_inventory_counts": """SELECT i.catalog, i.schema, t.object_type,
               count(*) FILTER (WHERE i.object_type = t.object_type) AS n_objects
        FROM f_inv i, (VALUES ('table'), ('view')) t(object_type)
        GROUP BY i.catalog, i.schema, t.object_type""",
    "q_tag_filter": """SELECT o_orderkey AS job_id, 'job_' || CAST(o_orderkey AS VARCHAR) AS job_name,
          CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 'skipped' ELSE 'matched' END AS status,
          CASE WHEN o_orderkey % 13 = 0 THEN 'config not found' WHEN o_orderkey % 17 = 0 THEN 'config unreadable' END AS reason
        FROM orders
        WHERE o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 OR (o_orderkey % 11 <> 0 AND o_orderkey % 19 <> 0
           AND o_orderkey % 23 <> 0 AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""",
    "q_lookup": "SELECT name, pipeline_id FROM f_lookup WHERE contains(lower(name), 'widget')",
    "q_backup_current": f"""SELECT record_key, body, strftime(saved_at, {_TS}) AS saved_at FROM f_incoming
        UNION ALL
        SELECT record_key, body, strftime(saved_at, {_TS}) FROM f_current
        WHERE record_key NOT IN (SELECT record_key FROM f_incoming)""",
    "q_backup_archive": """SELECT record_key, '20240201_120000' AS version_stamp, '20240201' AS archive_date, body
        FROM f_current WHERE record_key IN (SELECT record_key FROM f_incoming)""",
    "q_restore_latest": """SELECT a.record_key, arg_max(a.stamp, a.version_ts) AS version_stamp,
               arg_max(a.body, a.version_ts) AS body
        FROM f_archive a JOIN f_restore r ON a.record_key = r.record_key
        WHERE r.restore_stamp IS NULL GROUP BY a.record_key""",
    "q_restore_exact": """SELECT r.record_key, a.stamp AS version_stamp, arg_max(a.body, a.version_ts) AS body
        FROM f_restore r JOIN f_archive a ON a.record_key = r.record_key AND a.stamp = r.restore_stamp
        GROUP BY r.record_key, a.stamp""",
    "q_restore_missing": """SELECT r.record_key, r.restore_stamp AS requested_stamp,
               coalesce('No archive found for timestamp: ' || r.restore_stamp, 'No archived configs found') AS error
        FROM f_restore r WHERE NOT EXISTS (
          SELECT 1 FROM f_archive a WHERE a.record_key = r.record_key
            AND (r.restore_stamp IS NULL OR a.stamp = r.restore_stamp))""",
    "q_version_history": """SELECT record_key,
               row_number() OVER (PARTITION BY record_key ORDER BY version_ts) AS version_no,
               lag(stamp) OVER (PARTITION BY record_key ORDER BY version_ts) AS valid_from,
               stamp AS valid_to
        FROM f_archive""",
    "q_version_names": """SELECT record_key, stamp AS version_stamp,
               CAST(record_key AS VARCHAR) || '_' || stamp || '.json' AS file_name,
               strftime(version_ts, '%Y%m%d') AS archive_date,
               CAST(record_key AS VARCHAR) AS parsed_key, stamp AS parsed_stamp
        FROM f_archive""",
    "q_create_tasks": """SELECT t.job_id, t.task_pos, t.task_key,
               CASE WHEN t.l_returnflag = 'A' THEN 'uc-0001' END AS existing_cluster_id,
               CASE WHEN t.l_linestatus = 'F' THEN coalesce(k.pipeline_id, 'p0') END AS pipeline_id,
               CASE t.ln WHEN 1 THEN '/Workspace/sample/nb' WHEN 2 THEN '/Workspace/sample/a/Workspace/b'
                 WHEN 3 THEN '/Repos/x' ELSE '/Workspace/sample/nb' || CAST(t.ln AS VARCHAR) END
                 AS notebook_path,
               CASE WHEN t.ln % 2 = 0 THEN 'acct01' END AS param_path,
               CASE WHEN t.ln % 2 = 0 THEN 'acct01' END AS param_storage,
               CASE WHEN t.ln % 2 = 0 OR t.ln % 3 = 0 THEN t.l_returnflag END AS param_k,
               false AS has_email
        FROM f_task_lines t LEFT JOIN f_lookup k ON t.task_key = k.name""",
    "q_create_settings": """SELECT o.job_id, o.job_name AS name,
               CASE WHEN n.n IS NULL THEN 'rejected' ELSE 'created' END AS outcome,
               CASE WHEN n.n IS NULL THEN 'No tasks found in job config for job: ' || o.job_name END AS error,
               CASE WHEN n.n IS NOT NULL THEN false END AS has_run_as,
               CASE WHEN n.n IS NOT NULL THEN 'sample' END AS tag_application,
               CASE WHEN n.n IS NOT NULL THEN CAST(1 AS BIGINT) END AS n_tags,
               CASE WHEN n.n IS NOT NULL AND o.job_id % 2 = 0 THEN 'PAUSED' END AS pause_status,
               n.n AS n_tasks
        FROM f_config_orders o
        LEFT JOIN (SELECT job_id, count(*) AS n FROM f_task_lines GROUP BY job_id) n ON o.job_id = n.job_id""",
    "q_reset_tasks": """SELECT t.job_id, t.task_pos, t.task_key,
               CASE WHEN t.l_returnflag = 'A' THEN 'uc-0001' END AS existing_cluster_id,
               CASE WHEN t.l_linestatus = 'F' THEN coalesce(k.pipeline_id, 'p0') END AS pipeline_id,
               CASE t.ln WHEN 1 THEN '/Workspace/sample/nb' WHEN 2 THEN '/Workspace/a/Workspace/b'
                 WHEN 3 THEN '/Repos/x' ELSE '/Workspace/nb' || CAST(t.ln AS VARCHAR) END AS notebook_path,
               CASE WHEN t.ln % 2 = 0 THEN 'old' END AS param_path,
               true AS has_email
        FROM f_task_lines t LEFT JOIN f_lookup k ON t.task_key = k.name""",
    "q_coerce": """SELECT doc_id,
               CASE doc_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '"no"' END AS flag,
               '[true,' || CAST(to_json(lang) AS VARCHAR) || ']' AS a,
               ' true' AS nested_true,
               CASE WHEN lower(text) IN ('true', 'false') THEN lower(text) ELSE text END AS text
        FROM documents""",
    "q_grants": """SELECT j.job_id, j.job_name, a.grant_pos, a.principal_kind, a.principal, a.permission_level
        FROM f_jobs j, (VALUES (0, 'group', 'developers', 'CAN_MANAGE'),
            (1, 'group', 'admins', 'CAN_MANAGE'), (2, 'group', 'readers', 'CAN_VIEW'),
            (3, 'service_principal', 'deployer', 'IS_OWNER'))
          a(grant_pos, principal_kind, principal, permission_level)""",
    "q_checks": """SELECT toxic, count(*) FILTER (WHERE quality = 1) AS passed, count(*) AS total,
               count(*) FILTER (WHERE quality = 1) = count(*) AS all_passed
        FROM labels GROUP BY toxic""",
    "q_pick_preferred": """SELECT o_custkey, o_orderkey, o_orderstatus FROM (
          SELECT *, row_number() OVER (PARTITION BY o_custkey
              ORDER BY coalesce(o_orderstatus = 'O', false) DESC, o_orderkey) AS rn
          FROM orders) WHERE rn = 1""",
    "q_positional": """SELECT r_name AS statement, n_name AS value
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0""",
    "q_tag_text": """WITH t AS (SELECT p_partkey AS pos,
              CASE p_partkey % 4 WHEN 0 THEN '  ' || p_brand || ' : ' || p_type || ' '
                WHEN 1 THEN p_brand || ':' || p_type || ':x' WHEN 2 THEN p_name ELSE p_brand || ':' END AS raw
            FROM part)
        SELECT pos, raw,
               CASE WHEN strpos(raw, ':') > 0 THEN trim(substr(raw, 1, strpos(raw, ':') - 1)) END AS tag_key,
               CASE WHEN strpos(raw, ':') > 0 THEN trim(substr(raw, strpos(raw, ':') + 1)) END AS tag_value,
               strpos(raw, ':') > 0 AS valid,
               CASE WHEN strpos(raw, ':') = 0 THEN 'Invalid tag filter format; expected ''key:value''' END
                 AS error
        FROM t""",
    "q_path_check": """WITH t AS (SELECT p_partkey AS pos,
              CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_')
                WHEN 2 THEN replace(p_name, ' ', '_') || '%' ELSE '' END AS path FROM part)
        SELECT pos, path, NOT (path IS NULL OR path = '' OR contains(path, ' ') OR contains(path, '%')) AS valid
        FROM t""",
}

_REF = re.compile(r"\bf_\w+\b")


def _deps(name: str, seen: list[str]) -> None:
    for dep in _REF.findall(FIXTURE_SQL[name]):
        if dep != name and dep in FIXTURE_SQL and dep not in seen:
            _deps(dep, seen)
    if name not in seen:
        seen.append(name)


def with_fixtures(sql: str) -> str:
    """Prepend the fixture CTEs ``sql`` refers to, dependencies first."""
    order: list[str] = []
    for ref in _REF.findall(sql):
        if ref in FIXTURE_SQL:
            _deps(ref, order)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


ORACLE_SQL: dict[str, str] = {name: with_fixtures(sql) for name, sql in QUERY_SQL.items()}
