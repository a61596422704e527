"""Running a versioned index and a metric over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanframe.operators.versions import VersionedIndex


def stream_versions(deliveries: DataFrame, index: VersionedIndex, checkpoint: str, name_of: Callable[[int], str] = lambda n: f"batch-{n}") -> StreamingQuery:
    """Adds each micro-batch of ``doc_id, text`` to the index as a version. A batch that is
    run again replaces its version and finds its contents in the cache, so a restart
    changes nothing."""

    def add(batch: DataFrame, number: int) -> None:
        index.add_version(name_of(number), batch.select("doc_id", "text"))

    return deliveries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hits_per_window(hits: DataFrame, time: str = "scored_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Hits and best score of each query per window of event time; hits later than the
    watermark are left out, so that state stays bounded."""
    return (
        hits.withWatermark(time, late)
        .groupBy(F.window(time, window), "query_id")
        .agg(F.count("*").alias("hits"), F.max("score").alias("best"))
        .select(F.col("window.start").alias("from"), "query_id", "hits", "best")
    )
