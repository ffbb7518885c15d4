"""Object naming and statement text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote_ident(c: Column) -> Column:
    """Back-quote an identifier, doubling any back-quote inside it."""
    return F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))


def qualified_name(catalog: Column, schema: Column, obj: Column) -> Column:
    """`` `catalog`.`schema`.`object` ``; null if a part is null."""
    dot = F.lit(".")
    return F.concat(quote_ident(catalog), dot, quote_ident(schema), dot, quote_ident(obj))


def drop_statement(object_type: Column, fq_name: Column, purge: bool) -> Column:
    """``DROP <TYPE> IF EXISTS <fq>``; `` PURGE`` only for tables when asked.

    Spark accepts PURGE on DROP TABLE and rejects it on DROP VIEW.
    """
    stmt = F.concat(F.lit("DROP "), F.upper(object_type), F.lit(" IF EXISTS "), fq_name)
    if purge:
        stmt = F.concat(stmt, F.when(object_type == "table", F.lit(" PURGE")).otherwise(F.lit("")))
    return stmt


def not_found_error(types: Sequence[str]) -> Column:
    """Error text for a request whose name is not among the considered types."""
    return F.lit("Object not found or not a " + "/".join(types))
