"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, whole."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row. Catalyst may copy an
    expression into every use of it; a lambda variable is bound only once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts lineage like ``checkpoint()``, compressed and with column pruning, so a
    lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(df: DataFrame, schema: str, row_fn: Callable[..., tuple], *columns: str,
              setup: Callable[[], Callable[..., tuple]] | None = None) -> DataFrame:
    """One output row per input row from ``row_fn(*columns)``, in Arrow batches.

    ``setup`` (instead of ``row_fn``) builds the row function once per task."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    out = to_arrow(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = setup() if setup else row_fn
        for batch in batches:
            for part in small(batch):
                rows = [fn(*values) for values in zip(*(c.to_pylist() for c in part.columns))]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(col, type=f.type) for col, f in zip(zip(*rows), out)], schema=out)

    return df.select(*columns).mapInArrow(run, fields)


def small(batch: pa.RecordBatch, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``max_bytes`` each, so that long texts do not
    all become Python objects at once."""
    n = max(1, min(batch.num_rows, -(-batch.nbytes // max_bytes)))
    step = -(-batch.num_rows // n) if batch.num_rows else 1
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def to_arrow(fields) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)
