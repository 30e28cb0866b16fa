"""Results that are used several times, kept in the folder named by spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """df computed now; its lineage is cut and a lost executor costs nothing. Sets a folder only where none is
    named and all runs in this process."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = folder or "file://" + tempfile.mkdtemp(prefix="regionlake-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
