"""What a session needs so that Python workers can import this package."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Rows that a Python worker gets at a time, where the session says no less: rows may hold whole texts.
BATCH_ROWS = 1000


def importable(spark: SparkSession) -> SparkSession:
    """Put this checkout on the workers' path; on a cluster without it, ship the package with --py-files."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows from the folder of spark.checkpoint.dir, with a lineage that ends there; a folder of its own only where
    that is unset, as in tests."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", "") or tempfile.mkdtemp(prefix="groundline-"))
    return df.checkpoint(eager=True)
