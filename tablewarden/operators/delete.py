"""Guarded bulk deletion.

Requests and patterns are matched against an *inventory* table
``(catalog, schema, object, object_type)`` in one plan instead of per-object
metadata calls. Every distinct request ends in exactly one outcome row,
``executed`` or ``error``; nothing is issued here: the plan carries the
statement text, and :func:`delete_rows` removes rows from a data table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.names import drop_statement, not_found_error, qualified_name
from tablewarden.operators.patterns import match_patterns, normalize_patterns

# Object types, their default order, and outcome/status/message texts.
OBJECT_TYPES = ("table", "view")
INVALID_NAMESPACE = "Invalid catalog or schema"
NO_OBJECTS = "No objects specified"
NO_FILTER = "At least one filter (prefix, suffix, contains) must be specified"
NO_MATCH = "No objects found matching pattern"

NS = ["catalog", "schema"]
KEY = ["catalog", "schema", "object"]

OUTCOME_COLUMNS = ["pos", "catalog", "schema", "name", "object", "type", "outcome", "status",
                   "sql", "error", "n_requested"]
PATTERN_OUTCOME_COLUMNS = ["pattern_id", "catalog", "schema", "name", "object", "type", "outcome",
                           "status", "sql", "error"]


def check_types(types: Sequence[str] | None) -> tuple[str, ...]:
    """``None`` means both types, in the default order."""
    if types is None:
        return OBJECT_TYPES
    types = tuple(types)
    bad = [t for t in types if t not in OBJECT_TYPES]
    if bad or not types:
        raise ValueError(f"object types must be a non-empty subset of {OBJECT_TYPES}, got {types}")
    return types


def inventory_from_listing(listing: DataFrame) -> DataFrame:
    """U4: listing rows ``(catalog, schema, object, listed_as)`` to an inventory.

    Table listings also contain views; a name listed as a view anywhere is a
    view, otherwise a table. One aggregation (partial before the shuffle)
    also removes duplicate listing rows.
    """
    is_view = F.max((F.col("listed_as") == "view").cast("int"))
    return (listing.groupBy(*KEY).agg(is_view.alias("_v"))
            .select(*KEY, F.when(F.col("_v") == 1, "view").otherwise("table").alias("object_type")))


def _priority(types: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in types]), F.col("object_type"))


def _first_type(types: Sequence[str]) -> Column:
    """The type of the smallest priority; ``min`` over an int keeps the
    aggregation hash-based (``min_by`` on a string would sort)."""
    return F.get(F.array(*[F.lit(t) for t in types]), (F.min(_priority(types)) - 1).cast("int"))


def resolve_types(inventory: DataFrame, types: Sequence[str]) -> DataFrame:
    """Per name, the first type in ``types`` order the inventory has it as."""
    return (inventory.filter(F.col("object_type").isin(list(types)))
            .groupBy(*KEY)
            .agg(_first_type(types).alias("type")))


def _namespaces(inventory: DataFrame, namespaces: DataFrame | None) -> DataFrame:
    """Distinct namespaces. No hint: counting them first would cost a pass
    over the inventory; AQE broadcasts them at run time from the measured
    size of their (small) shuffle stage."""
    ns = (namespaces if namespaces is not None else inventory).select(*NS).distinct()
    return ns.withColumn("_ns_ok", F.lit(True))


def _status(dry_run: bool) -> Column:
    return F.lit("dry_run" if dry_run else "deleted")


def plan_delete(inventory: DataFrame, requests: DataFrame, *, types: Sequence[str] | None = None,
                dry_run: bool = True, purge: bool = False,
                namespaces: DataFrame | None = None) -> DataFrame:
    """One outcome row per distinct ``(catalog, schema, object)`` request.

    ``requests``: ``(pos, catalog, schema, object)``; duplicates collapse to the
    first position with ``n_requested``. ``namespaces`` (``catalog, schema``)
    defaults to the namespaces present in the inventory.
    """
    types = check_types(types)
    req = (requests.groupBy(*KEY)
           .agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n_requested")))
    found = resolve_types(inventory, types)
    ns = _namespaces(inventory, namespaces)
    j = req.join(found, KEY, "left").join(ns, NS, "left")
    fq = qualified_name(F.col("catalog"), F.col("schema"), F.col("object"))
    ok = F.col("_ns_ok").isNotNull() & F.col("type").isNotNull()
    return j.select(
        F.col("pos").cast("bigint").alias("pos"), "catalog", "schema",
        F.col("object").alias("name"), fq.alias("object"),
        F.when(ok, F.col("type")).alias("type"),
        F.when(ok, F.lit("executed")).otherwise(F.lit("error")).alias("outcome"),
        F.when(ok, _status(dry_run)).alias("status"),
        F.when(ok, drop_statement(F.col("type"), fq, purge)).alias("sql"),
        F.when(~ok, F.when(F.col("_ns_ok").isNull(), F.lit(INVALID_NAMESPACE))
               .otherwise(not_found_error(types))).alias("error"),
        F.col("n_requested").cast("bigint").alias("n_requested"),
    )


def _unknown_scopes(inventory: DataFrame, pats: DataFrame) -> DataFrame:
    """usable patterns whose scope no namespace has. The three ways to be
    scoped are three equi anti joins; the namespace side gets fresh columns, so
    patterns may derive from the inventory."""
    ns = inventory.select(F.col("catalog").alias("_nc"), F.col("schema").alias("_ns")).distinct()
    p = pats.filter(~F.col("refused")).select("pattern_id", F.col("catalog").alias("_c"), F.col("schema").alias("_s"))
    c, s = F.col("_c"), F.col("_s")
    both = p.filter(c.isNotNull() & s.isNotNull()).join(ns, (c == F.col("_nc")) & (s == F.col("_ns")), "left_anti")
    catalog = p.filter(c.isNotNull() & s.isNull()).join(ns.select("_nc").distinct(), c == F.col("_nc"), "left_anti")
    schema = p.filter(c.isNull() & s.isNotNull()).join(ns.select("_ns").distinct(), s == F.col("_ns"), "left_anti")
    return both.union(catalog).union(schema)


def share_patterns(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns that differ in nothing but their id as one: ``(shared, members)``, where
    ``shared`` has the columns of ``patterns`` under the least of the ids, and ``members``
    has ``(shared_id, pattern_id)`` for every id, each once. An id with several different
    patterns is shared with no other."""
    rest = F.struct(*[c for c in patterns.columns if c != "pattern_id"])
    ids = patterns.groupBy("pattern_id").agg(F.min(rest).alias("_least"), F.max(rest).alias("_most"))
    alone = F.col("_least").eqNullSafe(F.col("_most"))
    # one row a pattern id, and of those alike one id: read twice each, and small beside the patterns
    single = ids.filter(alone).groupBy(F.col("_least").alias("_rest")).agg(F.min("pattern_id").alias("_id"))
    member = ids.filter(alone).select("pattern_id", F.col("_least").alias("_mine")).join(
        single.hint("merge"), F.col("_mine") == F.col("_rest")).select(F.col("_id").alias("shared_id"), "pattern_id")
    several = ids.filter(~alone).select(F.col("pattern_id").alias("_id"))
    own = patterns.join(several.hint("merge"), F.col("pattern_id").eqNullSafe(F.col("_id")), "left_semi").distinct()
    shared = single.select(F.col("_id").alias("pattern_id"), "_rest.*").select(*patterns.columns).union(own)
    return shared, member.union(several.select("_id", F.col("_id").alias("pattern_id")))


def plan_delete_by_pattern(inventory: DataFrame, patterns: DataFrame, *,
                           types: Sequence[str] | None = None, dry_run: bool = True,
                           purge: bool = False) -> DataFrame:
    """Match patterns ``(pattern_id, prefix, suffix, contains[, catalog, schema])``
    against the inventory and plan the deletion of every match.

    Patterns with no filter give one refusal row (F3); a pattern scoped to an
    unknown namespace gives one error row (F4); a pattern with no match gives
    no row (a success). Names matched twice by one pattern (as table and view)
    collapse to the first type in ``types``. Patterns that are alike are matched once, and
    their ids come in last: no step but the output has a row for each id and match.
    """
    types = check_types(types)
    scope = [c for c in NS if c in patterns.columns]
    pats = normalize_patterns(patterns, scope)
    if len(scope) < 2:
        for c in NS:
            if c not in scope:
                pats = pats.withColumn(c, F.lit(None).cast("string"))
    shared, members = share_patterns(pats.filter(~F.col("refused")))
    # distinct: an id with several patterns may match a name with each
    hits = match_patterns(resolve_types(inventory, types), shared, "object", scope_cols=NS).select(
        F.col("pattern_id").alias("shared_id"), *KEY, "type").distinct()
    # a pattern without its like needs no join to find its id
    several = members.filter(~F.col("shared_id").eqNullSafe(F.col("pattern_id"))).select("shared_id").distinct()
    ids = members.join(several.select(F.col("shared_id").alias("_id")), F.col("shared_id").eqNullSafe(F.col("_id")), "left_semi").select(
        F.col("shared_id").alias("_shared"), F.col("pattern_id").alias("_member"), F.lit(True).alias("_is_member"))
    hits = hits.join(ids, F.col("shared_id").eqNullSafe(F.col("_shared")), "left").withColumn(
        "pattern_id", F.when(F.col("_is_member"), F.col("_member")).otherwise(F.col("shared_id")))
    fq = qualified_name(F.col("catalog"), F.col("schema"), F.col("object"))
    executed = hits.select(
        "pattern_id", "catalog", "schema", F.col("object").alias("name"), fq.alias("object"),
        "type", F.lit("executed").alias("outcome"), _status(dry_run).alias("status"),
        drop_statement(F.col("type"), fq, purge).alias("sql"),
        F.lit(None).cast("string").alias("error"))

    errors = pats.filter("refused").select("pattern_id", *NS, F.lit(NO_FILTER).alias("_err")).union(
        _unknown_scopes(inventory, pats).select("pattern_id", "_c", "_s", F.lit(INVALID_NAMESPACE)))
    error_rows = errors.select(
        "pattern_id", "catalog", "schema", F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("object"), F.lit(None).cast("string").alias("type"),
        F.lit("error").alias("outcome"), F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("sql"), F.col("_err").alias("error"))
    return executed.unionByName(error_rows)


def summarize(outcomes: DataFrame, *, dry_run: bool, by_pattern: bool = False) -> DataFrame:
    """One row ``(success, executed, errors, dry_run, message)``.

    For requests an empty plan is a refusal (F12); for patterns zero matches
    is a success with a message.
    """
    agg = outcomes.agg(
        F.count_if(F.col("outcome") == "executed").alias("executed"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count(F.lit(1)).alias("_n"))
    if by_pattern:
        success = F.col("errors") == 0
        message = F.when(F.col("_n") == 0, F.lit(NO_MATCH))
    else:
        success = (F.col("errors") == 0) & (F.col("_n") > 0)
        message = F.when(F.col("_n") == 0, F.lit(NO_OBJECTS))
    return agg.select(success.alias("success"), F.col("executed").cast("bigint").alias("executed"),
                      F.col("errors").cast("bigint").alias("errors"),
                      F.lit(dry_run).alias("dry_run"), message.cast("string").alias("message"))


@dataclass(frozen=True)
class RowDeletion:
    """C4 result. In a dry run ``survivors`` is the whole table and ``removed``
    the preview; otherwise the caller writes ``survivors`` as the new table.
    ``not_found``: requests (or patterns) that match no row."""

    removed: DataFrame
    survivors: DataFrame
    not_found: DataFrame


def delete_rows(table: DataFrame, requests: DataFrame, key_cols: Sequence[str], *,
                dry_run: bool = True) -> RowDeletion:
    """C4 by key: semi join (removed), anti join (survivors), and requests
    matching no row (not_found). Requests are de-duplicated first; the
    de-duplication's hash partitioning on the keys is reused by the joins."""
    keys = list(key_cols)
    req = requests.select(*keys).dropDuplicates(keys)
    removed = table.join(req, keys, "left_semi")
    survivors = table if dry_run else table.join(req, keys, "left_anti")
    not_found = req.join(table.select(*keys), keys, "left_anti")
    return RowDeletion(removed, survivors, not_found)


def delete_rows_by_pattern(table: DataFrame, column: str, patterns: DataFrame, *,
                           dry_run: bool = True) -> RowDeletion:
    """C4 by pattern on one string column; refused patterns match nothing.

    The predicate depends on the column's value only, so distinct values are
    matched, and ``removed`` (semi join) and ``survivors`` (anti join) split the
    rows by value exactly: a null never matches and survives."""
    pats = normalize_patterns(patterns)
    hits = match_patterns(table.select(F.col(column).alias("_value")).distinct(), pats, "_value")
    matched = hits.select("_value").distinct()
    on = F.col(column) == F.col("_value")
    removed = table.join(matched, on, "left_semi")
    survivors = table if dry_run else table.join(matched, on, "left_anti")
    not_found = pats.select("pattern_id", "refused").join(
        hits.select(F.col("pattern_id").alias("_id")).distinct(), F.col("pattern_id") == F.col("_id"), "left_anti")
    return RowDeletion(removed, survivors, not_found)


def cleanup_matrix(inventory: DataFrame, schemas: DataFrame, prefixes: Sequence[str], *,
                   types: Sequence[str] | None = None, dry_run: bool = True,
                   purge: bool = False) -> DataFrame:
    """The pattern plan for every schema x prefix, totals per schema.

    ``schemas``: ``(catalog, schema)``. The prefixes are a short parameter list,
    expanded per schema row by ``explode`` (no join). An object matched by
    several prefixes of one schema is counted once.
    """
    if not prefixes:
        raise ValueError("at least one prefix is required")
    arr = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(p).alias("prefix"))
                    for i, p in enumerate(prefixes)])
    sch = schemas.select("catalog", "schema").dropDuplicates()
    pats = (sch.select("catalog", "schema", F.explode(arr).alias("_p"))
            .select(F.concat_ws("/", "catalog", "schema", F.col("_p.k").cast("string")).alias("pattern_id"),
                    "catalog", "schema", F.col("_p.prefix").alias("prefix"),
                    F.lit(None).cast("string").alias("suffix"),
                    F.lit(None).cast("string").alias("contains")))
    plan = plan_delete_by_pattern(inventory, pats, types=types, dry_run=dry_run, purge=purge)
    per_name = (plan.groupBy("catalog", "schema", "name", "outcome")
                .agg(F.count(F.lit(1)).alias("_rows")))
    totals = per_name.groupBy("catalog", "schema").agg(
        F.count_if(F.col("outcome") == "executed").alias("executed"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "error", F.col("_rows"))), F.lit(0)).alias("errors"))
    return (sch.join(totals, NS, "left")
            .select("catalog", "schema", F.lit(len(prefixes)).cast("bigint").alias("n_prefixes"),
                    F.coalesce("executed", F.lit(0)).cast("bigint").alias("executed"),
                    F.coalesce("errors", F.lit(0)).cast("bigint").alias("errors"),
                    (F.coalesce("errors", F.lit(0)) == 0).alias("success")))


def cleanup_by_token(inventory: DataFrame, tokens: DataFrame, *, template: str = "job_{}",
                     types: Sequence[str] | None = None, dry_run: bool = True,
                     purge: bool = False) -> DataFrame:
    """The pattern plan with ``contains = template.format(token)`` for every
    row of ``tokens(token)``; outcome rows carry ``token`` as the pattern id."""
    head, _, tail = template.partition("{}")
    pats = tokens.select(
        F.col("token").cast("string").alias("pattern_id"),
        F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("string").alias("suffix"),
        F.concat(F.lit(head), F.col("token").cast("string"), F.lit(tail)).alias("contains"))
    return plan_delete_by_pattern(inventory, pats, types=types, dry_run=dry_run,
                                  purge=purge).withColumnRenamed("pattern_id", "token")
