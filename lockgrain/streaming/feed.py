"""A continuous feed of lockfile pairs (an extension: there is nothing to match it with).

Each micro-batch of new files is compared as a batch and appended; batches are named by their number, so a repeated
batch overwrites its own output and nothing is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lockgrain.operators import lockfile

SCHEMA = "pair string, side string, content string"


def watch(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Read JSON files of (pair, side, content); write changed packages, findings and skipped rows below ``target``."""

    def one(batch: DataFrame, number: int) -> None:
        found = lockfile.diff(batch)
        for name in ("changed", "findings", "skipped"):
            getattr(found, name).write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    rows = spark.readStream.schema(SCHEMA).json(source)
    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
