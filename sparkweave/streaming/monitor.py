"""Metric snapshots accumulated over polls (STR-3, STR-4, SET-1).

Each micro-batch of a snapshot stream becomes one load, under its batch id, so
the accumulated series survives restarts without duplicates.
``processing_time='5 seconds'`` gives the reference's refresh cadence; without
it the stream drains what is available and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkweave.sinks.loads import append_load


def accumulate(snapshots: DataFrame, root: str, checkpoint: str, processing_time: str | None = None):
    """Append the stream's batches to the loads below ``root``."""
    w = (snapshots.writeStream
         .foreachBatch(lambda b, i: append_load(b, root, i) and None)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    q = w.start()
    if not processing_time:
        q.awaitTermination()
    return q
