"""Session settings that the engine relies on."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch handed to a Python worker. Documents are large rows, so the row
#: count alone (Spark's default is 10,000) would not bound a worker's memory.
ARROW_ROWS = 2000
ARROW_BYTES = 32 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers and bound the Arrow batches they get."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(":"):
        env["PYTHONPATH"] = f"{root}:{known}" if known else root
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where it
    is unset, which happens in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    java = spark.sparkContext._jsc.sc().getCheckpointDir()
    if java.isDefined():
        return java.get()
    made = tempfile.mkdtemp(prefix="weftline-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df):
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage there.

    Unlike ``localCheckpoint`` the files outlive the executors that wrote them.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def builder(app: str = "weftline", master: str | None = None) -> SparkSession.Builder:
    """A session builder with the settings the engine is tested with."""
    made = SparkSession.builder.appName(app)
    if master:
        made = made.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in settings.items():
        made = made.config(key, value)
    return made
