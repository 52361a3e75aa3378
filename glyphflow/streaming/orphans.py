"""Orphan tracking over streams: every micro-batch advances the tracker's state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import REFS, OrphanTracker

#: One event stream: ``what`` is ref, parent or deletion; the columns of the others are null.
EVENTS = "what string, child string, id long, parent string, key long, at timestamp, period string, first timestamp, last timestamp, deleted timestamp"


def follow(spark: SparkSession, path: str, checkpoint: str, schema: str = EVENTS, state: str | None = None) -> OrphanTracker:
    """Runs all events that have arrived under ``path`` (Parquet) through a tracker and returns it.

    The tracker's tables and a manifest per batch stay in ``state``, by default
    beside the checkpoint, so a restart goes on where the stream does. A batch that
    the stream repeats after a failure starts from the manifest before it and
    overwrites its own tables.
    """
    tracker = OrphanTracker(spark, state or f"{checkpoint.rstrip('/')}-state")
    tracker.restore()

    def advance(batch: DataFrame, batch_id: int) -> None:
        if batch_id and tracker.batch != batch_id - 1 and not tracker.restore(batch_id - 1):
            raise RuntimeError(f"no state before batch {batch_id}")
        if not batch_id:
            tracker.reset()
        of = lambda what: batch.filter(F.col("what") == what)
        tracker.advance(batch_id, of("ref").select(*REFS), of("parent").select("parent", "key", "first", "last"), of("deletion").select("parent", "key", "deleted"))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return tracker
