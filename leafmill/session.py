"""What operators need of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def with_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the cluster's spark.checkpoint.dir rules. A folder of ours serves only where none is set and
    driver and executors are one process; elsewhere an unset folder is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints")
