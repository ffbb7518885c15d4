"""Captured listings and statement results.

Inputs are DataFrames of JSON text, one captured response per row with a
``capture_pos`` giving the order of captures (read them with
``spark.read.text(path, wholetext=True)`` plus a position column). Each response is
parsed once, into a variant, and becomes rows or errors in one pass (the ``decode_*``
functions; the others take one side of them). Entries are exploded with their
position so first/last-wins rules never depend on row order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

# The state of a statement that has its result, and the error texts.
SUCCEEDED = "SUCCEEDED"
UNREADABLE_CAPTURE = "response is not valid JSON"
NOT_AN_OBJECT = "response is not a JSON object"
NOT_A_LIST = " is not a list"
NO_JOB_ID = "job without a job_id"
NOT_AN_ENTRY = "entry is not an object"
NOT_A_ROW = "row is not a list"

_OBJECT = "map<string,variant>"
_LIST = "array<variant>"


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _body_error(v: Column, lists: Sequence[str]) -> Column:
    """Why a response has no rows at all, or null: not JSON, not an object, an error body
    (``error_code`` and ``message``), or something else where a list is due."""
    wrong = [F.when(_get(v, path, "variant").isNotNull() & ~F.is_variant_null(_get(v, path, "variant")) & _get(v, path, _LIST).isNull(),
                    F.lit(path.split(".")[-1] + NOT_A_LIST)) for path in lists]
    code = _get(v, "$.error_code")
    return F.coalesce(F.when(v.isNull(), F.lit(UNREADABLE_CAPTURE)), F.when(_get(v, "$", _OBJECT).isNull(), F.lit(NOT_AN_OBJECT)),
                      F.when(code.isNotNull(), F.concat_ws(": ", code, _get(v, "$.message"))), *wrong)


def _decoded(captures: DataFrame, doc_col: str, keep: Sequence[str], lists: Sequence[str], entries: Callable[[Column], Column],
             row: Callable[[Column], Sequence[Column]], extra_error: Callable[[Column], Column] | None = None) -> DataFrame:
    """One pass over the responses: ``keep``, ``entry`` (its place in the response), the
    values of ``row`` and ``error``. A response that can not be read is one error row
    (entry null); an entry that can not be read is one of its own; the rest are rows."""
    staged = captures.select(*keep, F.try_parse_json(F.col(doc_col)).alias("_v"))
    v = F.col("_v")
    error = _body_error(v, lists) if extra_error is None else F.coalesce(_body_error(v, lists), extra_error(v))
    staged = staged.select(*keep, "_v", error.alias("_error"))
    blank = F.array(F.lit(None).cast("variant"))
    each = staged.select(*keep, "_error", F.posexplode(F.when(F.col("_error").isNotNull(), blank).otherwise(
        F.coalesce(entries(v), F.array().cast(_LIST)))).alias("_i", "_e"))
    *values, wrong = row(F.col("_e"))
    failed = F.col("_error").isNotNull()
    return each.select(*keep, F.when(~failed, F.col("_i")).alias("entry"), *values, F.coalesce("_error", wrong).alias("error"))


def decode_jobs(captures: DataFrame, doc_col: str = "doc", keep: Sequence[str] = ()) -> DataFrame:
    """S1 + P1: ``keep``, ``entry``, ``job_id``, ``job_name`` and ``error`` of job listings. A
    response without ``jobs`` adds nothing."""
    def row(e: Column) -> list[Column]:
        job_id = _get(e, "$.job_id", "bigint")
        return [job_id.alias("job_id"), _get(e, "$.settings.name").alias("job_name"),
                F.when(_get(e, "$", _OBJECT).isNull(), F.lit(NOT_AN_ENTRY)).when(job_id.isNull(), F.lit(NO_JOB_ID))]

    return _decoded(captures, doc_col, keep, ["$.jobs"], lambda v: _get(v, "$.jobs", _LIST), row)


def decode_pipelines(captures: DataFrame, doc_col: str = "doc", keep: Sequence[str] = ()) -> DataFrame:
    """S3: ``keep``, ``entry``, ``name``, ``pipeline_id`` and ``error`` of pipeline listings: the
    entries of ``statuses``, or of ``pipelines`` when ``statuses`` is missing *or empty*
    (a plain coalesce would keep the empty list)."""
    def entries(v: Column) -> Column:
        statuses = _get(v, "$.statuses", _LIST)
        return F.when(F.size(statuses) > 0, statuses).otherwise(_get(v, "$.pipelines", _LIST))

    return _decoded(captures, doc_col, keep, ["$.statuses", "$.pipelines"], entries, lambda e: [
        _get(e, "$.name").alias("name"), _get(e, "$.pipeline_id").alias("pipeline_id"),
        F.when(_get(e, "$", _OBJECT).isNull(), F.lit(NOT_AN_ENTRY))])


def decode_statements(statements: DataFrame, doc_col: str = "doc", index: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, ``entry``, ``value`` and ``error`` of statement results: the value at
    ``index`` of each row of ``result.data_array``; rows with fewer values are left out.
    A failed statement is an error with its state and message."""
    def failure(v: Column) -> Column:
        state = _get(v, "$.status.state")
        return F.when(state != SUCCEEDED, F.concat_ws(": ", F.concat(F.lit("Statement "), F.lower(state)), _get(v, "$.status.error.message")))

    each = _decoded(statements, doc_col, keep, ["$.result.data_array"], lambda v: _get(v, "$.result.data_array", _LIST), lambda e: [
        F.size(_get(e, "$", _LIST)).alias("_n"), _get(e, f"$[{index}]").alias("value"),
        F.when(_get(e, "$", _LIST).isNull(), F.lit(NOT_A_ROW))], failure)
    return each.filter(F.col("error").isNotNull() | (F.col("_n") > index)).drop("_n")


def capture_errors(captures: DataFrame, doc_col: str = "doc", keep: Sequence[str] = ()) -> DataFrame:
    """What could not be read of job listings (``keep`` columns and ``error``); a caller
    reports these in place of an empty result."""
    return decode_jobs(captures, doc_col, keep).filter(F.col("error").isNotNull()).select(*keep, "error")


def statement_errors(statements: DataFrame, doc_col: str = "doc", keep: Sequence[str] = ()) -> DataFrame:
    """What could not be read of statement results (``keep`` columns and ``error``)."""
    return decode_statements(statements, doc_col, keep=keep).filter(F.col("error").isNotNull()).select(*keep, "error")


def job_listing(captures: DataFrame, doc_col: str = "doc") -> DataFrame:
    """S1 + P1: ``(job_id, job_name)`` of the entries that can be read."""
    return decode_jobs(captures, doc_col).filter(F.col("error").isNull()).select("job_id", "job_name")


def pipeline_entries(captures: DataFrame, doc_col: str = "doc",
                     pos_col: str = "capture_pos") -> DataFrame:
    """S3: ``(pos, name, pipeline_id)`` of the entries that can be read, where ``pos`` is a
    struct ``(capture, index)`` ordering entries across captures."""
    good = decode_pipelines(captures, doc_col, [pos_col]).filter(F.col("error").isNull())
    return good.select(F.struct(F.col(pos_col).alias("capture"), F.col("entry").alias("index")).alias("pos"), "name", "pipeline_id")


def decode_positional(statements: DataFrame, doc_col: str = "doc", index: int = 1,
                      keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and ``value`` of the rows that can be read."""
    return decode_statements(statements, doc_col, index, keep).filter(F.col("error").isNull()).select(*keep, "value")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, value)`` of the lines of text files, ``pos`` from 0 in order of file name
    and line, whatever the number of splits: lines are numbered within their split, and
    shifted by the counts of the splits before (one row a split)."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = lines.join(shifts, (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
    return numbered.select((F.col("_before") + F.col("_id") - F.col("_first")).alias("pos"), "value")


def rows_to_frame(spark: SparkSession, rows: Iterable[tuple], schema: str | StructType) -> DataFrame:
    """Inline rows with an explicit schema (an empty list is a valid,
    typed, empty table)."""
    return spark.createDataFrame(list(rows), schema)


def requests_from_list(spark: SparkSession, names: Sequence[str], catalog: str,
                       schema: str) -> DataFrame:
    """A Python list of names to ``(pos, catalog, schema, object)``; the
    position is a value of the row, never row order."""
    rows = rows_to_frame(spark, enumerate(names), "pos bigint, object string")
    return rows.select("pos", F.lit(catalog).alias("catalog"), F.lit(schema).alias("schema"), "object")
