"""Nested-record normalisation.

Configurations are JSON text ``{job_id, settings, ...}``. The rewrites parse
``settings`` as ``map<string, variant>``: every field, known or not, keeps its
JSON value exactly (explicit nulls included), and nested objects are rewritten
as maps and turned back into objects with ``to_variant_object``. No schema has
to be inferred first, so a rewrite is one pass over the records; with a lookup the
parsed records are written on the way, which runs when the rewrite is called. Task arrays
are rewritten in place with ``transform``, keeping task order; a field the
record does not have stays absent.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from tablewarden.functions.jsonfix import coerce_boolean_json, coerce_boolean_text
from tablewarden.functions.text import contains_ignore_case, let
from tablewarden.sources.scratch import written

# Defaults of the create rewrite and error texts.
DEFAULT_PAUSE = "PAUSED"
SOURCE_ROOT = "/Workspace/"
NO_TASKS = "No tasks found in job config for job: "
UNREADABLE = "config is not valid JSON"
NO_JOB_ID = "config has no job_id"
NO_SETTINGS = "config has no settings object"

OBJ = "map<string,variant>"
FEW_NAMES, FEW_CHARS = 256, 1 << 16  # a lookup of so many names, and their characters, is a constant


# --- small helpers on JSON objects held as map<string, variant> -------------

def obj(v: Column) -> Column:
    """A variant as an object (map), or null if it is not an object."""
    return v.try_cast(OBJ)


def field(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def as_variant(value: Column | str) -> Column:
    return (F.lit(value) if isinstance(value, str) else value).cast("variant")


def update(m: Column, changes: Mapping[str, Column], drop: tuple[str, ...] = ()) -> Column:
    """``m`` with the keys of ``changes`` whose value is not null replaced (or
    added) and the keys in ``drop`` removed; null changes leave ``m`` as is.

    The changed keys are known statically: they are filtered out and added
    back with ``coalesce(new, old)``; a key that was absent and gets no new
    value is dropped again by the final null filter (a JSON null stays: it is
    a variant, not a SQL null)."""
    if not changes:
        return F.map_filter(m, lambda k, v: ~k.isin(*drop)) if drop else m
    removed = (*drop, *changes)
    added = F.map_filter(
        F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), F.coalesce(v, field(m, k)))]),
        lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(m, lambda k, v: ~k.isin(*removed)), added)


def replaced(m: Column, changes: Mapping[str, Callable[[Column], Column]], drop: tuple[str, ...] = ()) -> Column:
    """``m`` with the values of the keys in ``changes`` that it has replaced by what the
    key's function makes of them (null: left as is) and the keys in ``drop`` removed."""
    kept = F.map_filter(m, lambda k, v: ~k.isin(*drop)) if drop else m

    def value(k: Column, v: Column) -> Column:
        out = None
        for key, change in changes.items():
            out = (F if out is None else out).when(k == key, F.coalesce(change(v), v))
        return v if out is None else out.otherwise(v)

    return F.transform_values(kept, value) if changes else kept


# --- rewrites -----------------------------------------------------------------

def coerce_booleans(df: DataFrame, json_col: str, out_col: str | None = None) -> DataFrame:
    """C17: ``json_col`` rewritten by P17 (canonical JSON; "true"/"false" string
    values of any case become booleans at any depth; invalid JSON -> null)."""
    return df.withColumn(out_col or json_col, coerce_boolean_json(F.col(json_col)))


def build_lookup(entries: DataFrame, name_filter: str | None = None) -> DataFrame:
    """C14: ``(name, pipeline_id)`` from ``(pos, name, pipeline_id)`` entries:
    names containing ``name_filter`` ignoring case (null name = ''), the last
    entry of a duplicated name wins."""
    kept = entries.filter(contains_ignore_case(F.col("name"), F.lit(name_filter or "")))
    return (kept.withColumn("name", F.coalesce(F.col("name"), F.lit("")))
            .groupBy("name").agg(F.max_by("pipeline_id", F.col("pos")).alias("pipeline_id")))


def _quote_regex(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _quote_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def reroot(path: Column, source_root: str, target_root: str) -> Column:
    """P10: unless the path already starts with ``target_root``, replace the
    first ``source_root`` anywhere in it by ``target_root``."""
    first = F.regexp_replace(path, "(?s)^(.*?)" + _quote_regex(source_root),
                             "$1" + _quote_replacement(target_root))
    return F.when(path.startswith(target_root), path).otherwise(first)


def with_parameters(bp: Column, storage_path: str) -> Column:
    """If the parameters have ``Path``, set ``Path`` and
    ``storage_account_name``; otherwise null (no change)."""
    value = as_variant(storage_path)
    return F.when(F.map_contains_key(bp, "Path"),
                  update(bp, {"Path": value, "storage_account_name": value}))


def _task_rewriter(*, cluster_id: str | None, create: bool, storage_path: str | None = None,
                   source_root: str = SOURCE_ROOT, target_root: str = ""):
    """``fn(task_map, new_pipeline_id)``: P7, P8 and, for create, P9-P11."""

    def path(v: Column) -> Column:
        return let(text_of(v), lambda p: F.when(p.isNotNull(), as_variant(reroot(p, source_root, target_root))))

    def parameters(v: Column) -> Column:
        return let(obj(v), lambda bp: F.to_variant_object(with_parameters(bp, storage_path)))

    def notebook(v: Column) -> Column:
        changes = {"notebook_path": path} | ({"base_parameters": parameters} if storage_path is not None else {})
        return F.to_variant_object(replaced(obj(v), changes))

    def fn(t: Column, new_id: Column | None) -> Column:
        def pipeline(v: Column) -> Column:
            return let(new_id, lambda i: F.when(i.isNotNull(), let(obj(v), lambda pt: F.to_variant_object(
                update(pt, {"pipeline_id": as_variant(i)})))))

        changes: dict[str, Callable[[Column], Column]] = {}
        if cluster_id is not None:
            changes["existing_cluster_id"] = lambda v: as_variant(cluster_id)
        if new_id is not None:
            changes["pipeline_task"] = pipeline
        if create:
            changes["notebook_task"] = notebook
        return replaced(t, changes, ("email_notifications",) if create else ())

    return fn


@dataclass(frozen=True)
class Rewrite:
    """``outcomes``: ``(record_key, job_id, settings, payload, error)``, one row
    per stored record; ``settings`` is the rewritten object as
    ``map<string, variant>``, ``payload`` its JSON text, ``error`` null when
    rewritten. ``records`` and ``errors`` are its two halves; a caller needing
    both should read ``outcomes`` once."""

    outcomes: DataFrame

    @property
    def records(self) -> DataFrame:
        return self.outcomes.filter(F.col("error").isNull()).drop("error")

    @property
    def errors(self) -> DataFrame:
        return self.outcomes.filter(F.col("error").isNotNull()).select("record_key", "job_id", "error")


def _parse(current: DataFrame, text: Column) -> DataFrame:
    """Parse once into a variant (``try_parse_json``: invalid JSON and
    duplicate keys give null) and take ``job_id`` and ``settings``. The values come
    from ``inline`` of a one-element array: filters on them (records vs
    errors) cannot be pushed below the generator, which would copy the parse
    into every predicate."""
    # The variant is computed in its own projection below the generator: the
    # generator does not share common sub-expressions, so referring to the
    # parse four times inside it would parse (and coerce) four times.
    staged = current.select("record_key", F.try_parse_json(text).alias("_v"))
    v = F.col("_v")
    pair = F.struct(v.isNotNull().alias("_ok"),
                    F.try_variant_get(v, "$.job_id", "bigint").alias("job_id"),
                    F.try_variant_get(v, "$.settings", "variant").alias("_sv"))
    return staged.select("record_key", F.inline(F.array(pair)))


def _last_ids(lookup: DataFrame) -> DataFrame:
    """``(_name, _id)``: a name that the lookup has several times counts once: the last by
    its ``pos`` column if it has one, else the greatest id. A null name matches nothing."""
    order = F.col("pos") if "pos" in lookup.columns else F.col("pipeline_id")
    return (lookup.filter(F.col("name").isNotNull()).groupBy(F.col("name").alias("_name"))
            .agg(F.max_by("pipeline_id", order).alias("_id")))


def _few_ids(ids: DataFrame) -> Column | None:
    """A lookup of few short names as one constant map from name to id, else null."""
    kind = ids.schema["_id"].dataType
    rows = ids.limit(FEW_NAMES + 1).collect()
    if len(rows) > FEW_NAMES or sum(len(r["_name"]) for r in rows) > FEW_CHARS:
        return None
    pairs = [F.lit(x) for r in rows for x in (r["_name"], r["_id"])]
    return (F.create_map(*pairs) if pairs else F.create_map()).cast(MapType(StringType(), kind))


def _task_ids(parsed: DataFrame, ids: DataFrame) -> DataFrame:
    """``(_key, _ids)``: for each record with a task in the lookup, the map from task
    key to pipeline id. Records give up their distinct task keys only, and only
    matched ones are grouped, so no document is shuffled for the lookup."""
    wanted = parsed.select(F.col("record_key").alias("_key"), F.explode("_names").alias("_task"))
    return (wanted.join(ids, F.col("_task") == F.col("_name")).groupBy("_key")
            .agg(F.map_from_entries(F.collect_set(F.struct("_task", "_id"))).alias("_ids")))


def _rewrite_tasks(parsed: DataFrame, lookup: DataFrame | None, task_fn) -> DataFrame:
    """Adds ``_s``, the settings as an object map, ``_t0``, their tasks, and ``_tasks``: the
    tasks in their order, objects rewritten, anything else as it is (null when the record
    has no task array).

    With a lookup the parsed records are written first: each body is read and parsed once.
    A lookup of few names is a constant of the rewrite; for any other the records' task
    keys are written beside them, and the lookup reads the keys alone."""
    ids = None
    if lookup is not None:
        known = _last_ids(lookup)
        ids = _few_ids(known)
        if ids is None:
            names = F.array_distinct(F.transform(_task_array(), lambda t: F.try_variant_get(t, "$.task_key", "string")))
            wide = written(parsed.withColumn("_names", names), "parsed")
            found = _task_ids(wide, known)
            parsed = wide.join(found, F.col("record_key").eqNullSafe(F.col("_key")), "left")
            ids = F.col("_ids")
        else:
            parsed = written(parsed, "parsed")
    new_id = lambda m: None if ids is None else F.try_element_at(ids, text_of(field(m, "task_key")))
    return parsed.withColumns({"_s": obj(F.col("_sv")), "_t0": _task_array()}).withColumn("_tasks", F.transform("_t0", lambda t: let(
        obj(t), lambda m: F.when(m.isNull(), t).otherwise(F.to_variant_object(task_fn(m, new_id(m)))))))


def _task_array() -> Column:
    return F.try_variant_get("_sv", "$.tasks", "array<variant>")


def _outcomes(rew: DataFrame, settings: Column, ok: Column, error: Column, payload) -> Rewrite:
    out = rew.select("record_key", "job_id", F.when(ok, settings).alias("settings"), error.alias("error"))
    return Rewrite(out.select("record_key", "job_id", "settings", payload, "error"))


def create_from_stored(current: DataFrame, *, lookup: DataFrame | None = None,
                       cluster_id: str | None = None, storage_path: str | None = None,
                       tags: Mapping[str, str], target_root: str, pause_status: str = DEFAULT_PAUSE,
                       source_root: str = SOURCE_ROOT) -> Rewrite:
    """C11: the create payload (the settings object) of every stored
    ``(record_key, body)``.

    Steps: coerce booleans (P17), name := record key (P15), reject records
    without tasks (F9), per task: cluster (P7), pipeline lookup (P8/J3),
    parameters (P9), path re-rooting (P10), drop ``email_notifications``
    (P11); drop ``run_as`` (P12); replace ``tags`` (P13); set the pause status
    where a schedule exists (P14).
    """
    parsed = _parse(current, coerce_boolean_text(F.col("body")))
    task_fn = _task_rewriter(cluster_id=cluster_id, create=True, storage_path=storage_path,
                             source_root=source_root, target_root=target_root)
    rew = _rewrite_tasks(parsed, lookup, task_fn)
    s = F.col("_s")
    schedule = let(obj(field(s, "schedule")), lambda sc: F.when(
        sc.isNotNull(), F.to_variant_object(update(sc, {"pause_status": as_variant(pause_status)}))))
    settings = update(s, {
        "name": as_variant(F.col("record_key").cast("string")),
        "tasks": F.to_variant_object(F.col("_tasks")),
        "tags": F.parse_json(F.lit(json.dumps(dict(tags)))),
        "schedule": schedule,
    }, drop=("run_as",))
    has_tasks = F.coalesce(F.size("_t0"), F.lit(0)) > 0
    error = (F.when(~F.col("_ok"), F.lit(UNREADABLE))
             .when(~has_tasks, F.concat(F.lit(NO_TASKS), F.col("record_key").cast("string"))))
    return _outcomes(rew, settings, F.col("_ok") & has_tasks, error,
                     F.to_json("settings").alias("payload"))


def reset_from_stored(current: DataFrame, *, lookup: DataFrame | None = None,
                      cluster_id: str | None = None) -> Rewrite:
    """The reset envelope ``{job_id, new_settings}`` of every stored record
    with only the cluster (P7) and pipeline (P8) rewritten: no coercion, no
    re-rooting, tags and other fields kept. Records without tasks pass
    unchanged; without a job id or a settings object they are errors."""
    parsed = _parse(current, F.col("body"))
    task_fn = _task_rewriter(cluster_id=cluster_id, create=False)
    rew = _rewrite_tasks(parsed, lookup, task_fn)
    settings = update(F.col("_s"), {"tasks": F.when(F.col("_tasks").isNotNull(),
                                                    F.to_variant_object(F.col("_tasks")))})
    payload = F.to_json(F.struct(F.col("job_id"), F.col("settings").alias("new_settings")))
    error = (F.when(~F.col("_ok"), F.lit(UNREADABLE)).when(F.col("job_id").isNull(), F.lit(NO_JOB_ID))
             .when(F.col("_s").isNull(), F.lit(NO_SETTINGS)))
    return _outcomes(rew, settings, error.isNull(), error, F.when(F.col("error").isNull(), payload).alias("payload"))
