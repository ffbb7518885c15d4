"""User-level operators: DataFrames in, DataFrames out."""

from tablewarden.operators.delete import (
    cleanup_by_token, cleanup_matrix, delete_rows, delete_rows_by_pattern,
    inventory_from_listing, plan_delete, plan_delete_by_pattern, share_patterns, summarize,
)
from tablewarden.operators.normalize import (
    build_lookup, coerce_booleans, create_from_stored, reset_from_stored,
)
from tablewarden.operators.registry import (
    check_paths, filter_by_tags, list_object_names, list_objects, parse_tag_filters,
    pick_preferred, select_records,
)
from tablewarden.operators.report import check_report, expand_grants
from tablewarden.operators.versions import (
    backup, latest_per_key, restore, version_history, version_names,
)

__all__ = [
    "backup", "build_lookup", "check_paths", "check_report", "cleanup_by_token", "cleanup_matrix",
    "coerce_booleans", "create_from_stored", "delete_rows",
    "delete_rows_by_pattern", "expand_grants", "filter_by_tags", "inventory_from_listing",
    "latest_per_key", "list_object_names", "list_objects", "parse_tag_filters", "pick_preferred",
    "plan_delete", "plan_delete_by_pattern", "reset_from_stored", "restore", "select_records", "share_patterns",
    "summarize", "version_history", "version_names",
]
