"""Version stamps and version-file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stamp and date formats of version files.
STAMP_FORMAT = "yyyyMMdd_HHmmss"
DATE_FORMAT = "yyyyMMdd"
FILE_NAME_PATTERN = r"^(.*)_(\d{8}_\d{6})\.json$"


def version_stamp(ts: Column) -> Column:
    return F.date_format(ts, STAMP_FORMAT)


def archive_date(ts: Column) -> Column:
    return F.date_format(ts, DATE_FORMAT)


def stamp_to_ts(stamp: Column) -> Column:
    """Parse ``yyyyMMdd_HHmmss``; malformed text gives null instead of an error."""
    return F.try_to_timestamp(stamp, F.lit(STAMP_FORMAT)).cast("timestamp_ntz")


def version_file_name(key: Column, ts: Column) -> Column:
    """``<key>_<yyyyMMdd_HHmmss>.json``."""
    return F.concat(key, F.lit("_"), version_stamp(ts), F.lit(".json"))


def parse_version_file(file_name: Column) -> Column:
    """Split a version file name into ``struct<record_key, version_stamp>``.

    The key is everything before the last ``_<stamp>.json``, so keys may contain
    ``_``. Names that do not fit give null fields.
    """
    fits = file_name.rlike(FILE_NAME_PATTERN)
    return F.struct(
        F.when(fits, F.regexp_extract(file_name, FILE_NAME_PATTERN, 1)).alias("record_key"),
        F.when(fits, F.regexp_extract(file_name, FILE_NAME_PATTERN, 2)).alias("version_stamp"),
    )
