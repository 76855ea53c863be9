"""The folder that driver and executors share: where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names in spark.checkpoint.dir; a temporary one only where that is unset
    and the master is this machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def settled(rows: DataFrame) -> DataFrame:
    """rows, computed once and kept in the shared folder. For narrow relations that are read more than once."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)
