"""Tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


#: Rows of whole texts that Arrow carries at a time.
BATCH_ROWS = 256


def small_batches() -> None:
    """Has Arrow carry BATCH_ROWS rows at a time in this session from now on."""
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where none is named, and the executors
    are threads of this process, a temporary folder serves; on a cluster that is an error."""
    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        where = f"file://{tempfile.mkdtemp(prefix='tidewater-')}"
        spark.sparkContext.setCheckpointDir(where)
    return os.path.join(where, f"{name}-{uuid.uuid4().hex}")
