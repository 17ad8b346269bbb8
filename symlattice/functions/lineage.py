"""Cutting the lineage of frames that loops build up."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; a local one of our own only on a local master without one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
