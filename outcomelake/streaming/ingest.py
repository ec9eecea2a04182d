"""Streaming ingest: events as they come, each micro-batch merged into the months it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import AttributionPolicy, accepted, normalized
from ..schemas import EVENT
from ..sources.sinks import upsert_experiences
from ..sources.snapshots import upsert_snapshot
from ..sources.storage import written


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(path)


def ingest_stream(events: DataFrame, table: str, checkpoint: str, policy: AttributionPolicy = AttributionPolicy(), *, stream: str | None = None, **trigger: object) -> StreamingQuery:
    """Normalise and upsert; a batch that runs twice gives the same table. Broken rows are left out of the table.

    With the name of a ``stream`` the table is one of snapshots: a batch's months change together, and once.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = accepted(normalized(batch, policy), mode="quarantine").withColumn("batch_seq", F.lit(batch_id).cast("long"))
        if stream is not None:
            upsert_snapshot(written(rows, "batch"), table, stream=stream, batch=batch_id)
        elif not rows.isEmpty():
            upsert_experiences(rows, table)

    writer = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def failure_rates(experiences: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Failures and outcomes by window and class, with a watermark that bounds the state."""
    timed = experiences.withWatermark("recorded_at", late)
    return timed.groupBy(F.window("recorded_at", window), "class").agg(F.count("*").alias("outcomes"), F.count_if(F.col("kind").isin("ci_failure", "revert", "review_correction")).alias("failures"))
