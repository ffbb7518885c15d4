"""tablewarden: table-lifecycle operators on Spark DataFrames.

Every public operator takes DataFrames and returns DataFrames; the plans are
lazy and built from built-in Spark SQL functions, joins, aggregates and
windows so Catalyst can push filters, prune columns and pick join strategies.
"""

from tablewarden.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
