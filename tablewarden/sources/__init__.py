"""Sources and sinks: captured listings and statement results (JSON text),
version files, and the current/archive stores."""

from tablewarden.sources.listings import (
    decode_positional, job_listing, pipeline_entries, requests_from_list, rows_to_frame,
)
from tablewarden.sources.store import (
    read_archive, read_current, read_version_files, read_documents, write_archive, write_current,
)

__all__ = [
    "decode_positional", "job_listing", "pipeline_entries", "read_archive", "read_current",
    "read_documents", "read_version_files", "requests_from_list", "rows_to_frame",
    "write_archive", "write_current",
]
