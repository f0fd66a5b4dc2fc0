"""Where checkpoints go: the shared folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder from ``spark.checkpoint.dir`` where none is set. Only a local session may leave it out: a folder of one machine would be of no use to others."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(base or tempfile.mkdtemp(prefix="gridloom-"))
