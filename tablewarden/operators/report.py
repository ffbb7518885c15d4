"""Grant expansion and check summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Principal fields of an ACL entry and the kind each denotes.
PRINCIPAL_FIELDS = (("group_name", "group"), ("service_principal_name", "service_principal"),
                    ("user_name", "user"))


def _acl_entry(entry: Mapping[str, str], pos: int):
    for field, kind in PRINCIPAL_FIELDS:
        if entry.get(field):
            return F.struct(F.lit(pos).alias("grant_pos"), F.lit(kind).alias("principal_kind"),
                            F.lit(entry[field]).alias("principal"),
                            F.lit(entry.get("permission_level")).alias("permission_level"))
    raise ValueError(f"ACL entry without a principal: {entry}")


def expand_grants(records: DataFrame, acl: Sequence[Mapping[str, str]]) -> DataFrame:
    """One row per record and ACL entry with the principal kind resolved.

    The ACL is a short parameter list, so it becomes an array literal that
    each record row expands with ``inline``: no join and no shuffle.
    """
    entries = F.array(*[_acl_entry(e, i) for i, e in enumerate(acl)])
    return records.select("*", F.inline(entries))


def check_report(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``passed``, ``total`` and ``all_passed`` over ``(check, passed)``
    rows, globally or per ``by`` group. No checks means all passed."""
    agg = [F.count_if(F.col("passed")).cast("bigint").alias("passed"),
           F.count(F.lit(1)).cast("bigint").alias("total")]
    out = checks.groupBy(*by).agg(*agg) if by else checks.agg(*agg)
    return out.withColumn("all_passed", F.col("passed") == F.col("total"))
