"""A change log that is fed by a stream: each micro-batch becomes a run of level 0.

The sink is idempotent: a batch that is run again after a failure writes over its own folder, and
readers go through the list of committed batches that the checkpoint keeps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import oplog


def start(stream: DataFrame, to_log, target: str, checkpoint: str, trigger: dict | None = None):
    """Start a query that appends ``to_log(batch)`` to runs below ``target``; at most once for each batch."""

    def append(batch: DataFrame, batch_id: int) -> None:
        to_log(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_available(spark: SparkSession, source: str, base: str, files_per_batch: int = 1) -> DataFrame:
    """Ingest the files of an events table and return the log they make."""
    run = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source + "*")
    query = start(stream, oplog.events_log, f"{run}/log", f"{run}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{run}/log").drop("batch")


def latest_state(stream: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The newest version of each key as a running aggregate, for output mode ``update`` or ``complete``."""
    return stream.groupBy(*keys).agg(*(F.max_by(c, "hlc").alias(c) for c in ("deleted", *values)), F.max("hlc").alias("hlc"))
