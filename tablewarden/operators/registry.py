"""Listings, name search, tag filters and selection rules."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.text import invalid_path, split_key_value
from tablewarden.operators.delete import check_types
from tablewarden.operators.patterns import match_patterns, normalize_patterns

# Messages for skipped configurations and bad filter text.
CONFIG_MISSING = "config not found"
CONFIG_UNREADABLE = "config unreadable"
BAD_TAG_TEXT = "Invalid tag filter format; expected 'key:value'"


def list_objects(inventory: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """``(catalog, schema, object_type, n_objects)`` for every namespace and
    every requested type, zero included. Counts only: names are never
    collected into one row (use :func:`list_object_names` for the names)."""
    types = check_types(types)
    counts = inventory.groupBy("catalog", "schema").agg(
        *[F.count_if(F.col("object_type") == t).alias(f"_n_{t}") for t in types])
    per_type = F.array(*[F.struct(F.lit(t).alias("object_type"), F.col(f"_n_{t}").alias("n"))
                         for t in types])
    return counts.select("catalog", "schema", F.inline(per_type)).select(
        "catalog", "schema", "object_type", F.col("n").cast("bigint").alias("n_objects"))


def list_object_names(inventory: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """C1, names form: one row per object of the requested types."""
    return inventory.filter(F.col("object_type").isin(list(check_types(types))))


def select_records(listing: DataFrame, names: DataFrame, *, name_col: str = "job_name",
                   id_col: str = "job_id") -> DataFrame:
    """Every listing row whose name contains a requested name ignoring
    case (F1; an empty name matches all), with ``n_matches`` per requested
    name and ``selected`` marking the one a single-record operation uses:
    an exact (case-insensitive) name first, then the lowest id.
    """
    req = names.select(F.coalesce(F.col("name"), F.lit("")).alias("name")).distinct()
    pats = normalize_patterns(req.select(
        F.col("name").alias("pattern_id"), F.lit(None).cast("string").alias("prefix"),
        F.lit(None).cast("string").alias("suffix"), F.lower("name").alias("contains")))
    lowered = listing.withColumn("_lname", F.lower(F.coalesce(F.col(name_col), F.lit(""))))
    pairs = match_patterns(lowered, pats, "_lname").withColumnRenamed("pattern_id", "name")
    # The names are a parameter table: a bounded check decides whether the
    # "empty name lists everything" branch (a second listing scan) is needed.
    if req.filter(F.col("name") == "").limit(1).count() > 0:
        pairs = pairs.unionByName(lowered.withColumn("name", F.lit("")))
    # Read twice below, by the aggregate and by the join to it: one shuffle of the
    # pairs, reused, in place of matching twice; it has no key that could be hot.
    pairs = pairs.select("name", id_col, name_col, "_lname").hint("rebalance")
    rank = F.struct((F.col("_lname") != F.lower("name")).alias("_inexact"), F.col(id_col).alias("_id"))
    best = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("n_matches"), F.min(rank).alias("_best"))
    # One row per requested name; AQE broadcasts it from its measured size.
    out = pairs.join(best, "name")
    return out.select("name", id_col, name_col, F.col("n_matches").cast("bigint").alias("n_matches"),
                      (F.col(id_col) == F.col("_best._id")).alias("selected"))


def _tags_match(tags: Column, want: Mapping[str, object]) -> Column:
    """every wanted pair present with an equal value of the same type (text is
    case-sensitive, the number 1 is not "1"); an empty ``want`` matches everything.
    Values are compared as canonical JSON."""
    cond = F.lit(True)
    for k, v in want.items():
        wanted = F.to_json(F.parse_json(F.lit(json.dumps(v))))
        cond = cond & F.to_json(F.try_element_at(tags, F.lit(k))).eqNullSafe(wanted)
    return cond


def filter_by_tags(listing: DataFrame, configs: DataFrame, want: Mapping[str, object], *,
                   body_col: str = "body") -> DataFrame:
    """``(job_id, job_name, status, reason)``. Jobs whose configuration tags
    contain all of ``want`` get ``matched``; jobs whose configuration is
    missing or not JSON are ``skipped`` with a reason; the rest are dropped.
    Missing ``settings.tags`` counts as no tags."""
    # Two flags a configuration cross the join, not its document: both are computed
    # below it, behind a generator that filters on them are not pushed through.
    parsed = configs.select("job_id", F.try_parse_json(F.col(body_col)).alias("_v"))
    tags = F.coalesce(F.try_variant_get("_v", "$.settings.tags", "map<string,variant>"),
                      F.create_map().cast("map<string,variant>"))
    cfg = parsed.select("job_id", F.inline(F.array(F.struct(
        F.col("_v").isNotNull().alias("_readable"), _tags_match(tags, want).alias("_match")))))
    j = listing.join(cfg, "job_id", "left")
    status = (F.when(~F.coalesce("_readable", F.lit(False)), F.lit("skipped"))
              .when(F.col("_match"), F.lit("matched")))
    reason = (F.when(F.col("_readable").isNull(), F.lit(CONFIG_MISSING))
              .when(~F.col("_readable"), F.lit(CONFIG_UNREADABLE)))
    return (j.select("job_id", "job_name", status.alias("status"), reason.alias("reason"))
            .filter(F.col("status").isNotNull()))


def parse_tag_filters(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """adds ``tag_key, tag_value, valid, error``; malformed text is kept
    as an error row (its filter would otherwise be empty and match all)."""
    kv = split_key_value(F.col(raw_col))
    return df.select("*", kv["tag_key"].alias("tag_key"), kv["tag_value"].alias("tag_value"),
                     kv["valid"].alias("valid"),
                     F.when(~kv["valid"], F.lit(BAD_TAG_TEXT)).alias("error"))


def check_paths(df: DataFrame, path_col: str = "path") -> DataFrame:
    """adds ``valid``; empty paths and paths with a space or ``%`` are invalid."""
    return df.withColumn("valid", ~invalid_path(F.col(path_col)))


def pick_preferred(df: DataFrame, group_cols: Sequence[str], order_col: str, state_col: str,
                   preferred: str = "RUNNING") -> DataFrame:
    """Per group, the first row (by ``order_col``) whose state is
    ``preferred``, else the first row. ``min_by`` aggregates partially before
    the shuffle, so a hot group costs no more than a cold one."""
    others = [c for c in df.columns if c not in group_cols]
    key = F.struct((~F.coalesce(F.col(state_col) == preferred, F.lit(False))).alias("_miss"),
                   F.col(order_col).alias("_o"))
    picked = df.groupBy(*group_cols).agg(F.min_by(F.struct(*others), key).alias("_r"))
    return picked.select(*group_cols, *[F.col(f"_r.{c}").alias(c) for c in others])
