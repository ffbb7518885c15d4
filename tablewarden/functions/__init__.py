"""Column-expression helpers (pure built-in Spark SQL functions, no UDFs)."""

from tablewarden.functions.names import drop_statement, not_found_error, qualified_name, quote_ident
from tablewarden.functions.text import (
    affix_match, blank_to_null, contains_ignore_case, invalid_path, py_strip, split_key_value,
)
from tablewarden.functions.stamps import (
    archive_date, parse_version_file, stamp_to_ts, version_file_name, version_stamp,
)
from tablewarden.functions.jsonfix import canonical_json, coerce_boolean_json

__all__ = [
    "affix_match", "archive_date", "blank_to_null", "canonical_json", "coerce_boolean_json",
    "contains_ignore_case", "drop_statement", "invalid_path", "not_found_error",
    "parse_version_file", "py_strip", "qualified_name", "quote_ident", "split_key_value",
    "stamp_to_ts", "version_file_name", "version_stamp",
]
