"""Writers of micro-batches that survive a replayed batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.operators.telemetry import to_log
from packetloom.sources.sinks import write_threats


def _batch_writer(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch overwrites its own folder, so nothing is doubled.
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def start_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Write every micro-batch of ``stream`` to its own folder below ``path``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(_batch_writer(path)).start()


def start_log(verdicts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write the log rows of a stream of verdicts; ``start_threats`` writes its threats."""
    return start_batches(to_log(verdicts), path, checkpoint, trigger=trigger)


def start_threats(verdicts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the numbered threats of a stream of verdicts to a threat sink.

    Other streams and batch jobs may append to the same sink.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_threats(batch, path, source=checkpoint, batch=batch_id)

    writer = to_log(verdicts).writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_update(updates: DataFrame, *keys: str) -> DataFrame:
    """The newest version of every key of an update-mode stream."""
    values = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v")).select(*keys, "_v.*")
