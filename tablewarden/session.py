"""Session helpers.

``get_session`` is for tests, the bench and local runs. On a cluster the
caller's session is used as-is; we only fill settings that are unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every plan here relies on; applied only when the session lacks them.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tablewarden") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxMetadataStringLength", "10000")  # plans name all filters of a scan
        .config("spark.driver.memory", os.environ.get("TW_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    )
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be set to shared storage. Only when it is
    unset (tests, local runs) do we create a private scratch folder.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = sc.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
            base = tempfile.mkdtemp(prefix="tw-ckpt-")
        # once a session: each call makes a new folder below the one it is given
        sc.setCheckpointDir(base)
    return sc.getCheckpointDir()
