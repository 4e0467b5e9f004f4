"""What Python workers need to run this package's readers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

#: Rows and bytes of a batch: contents are whole files, so few are held at once.
BATCH_ROWS, BATCH_BYTES = 64, 8 << 20


def prepare(spark: SparkSession, rows: int | None = None, size: int | None = None) -> None:
    """Let workers import this package, and bound the batches they get where bounds are given."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    if rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
