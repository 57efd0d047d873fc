"""Landing folders as streams: the batch operators on micro-batches.

State is bounded by watermarks, sinks are idempotent per batch, progress is checkpointed, so a
lost executor or a restarted query repeats a micro-batch without changing the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import normalize
from ..operators.validate import validate
from ..schemas import SOURCES
from ..sinks import queue_messages

WATERMARK = "10 minutes"


def landing_stream(spark: SparkSession, folder: str, sources: list[str] | None = None,
                   max_files: int = 10_000) -> DataFrame:
    """New files of the landing folder; their modification time is the event time."""
    out = None
    for source in sources or SOURCES:
        files = (spark.readStream.option("maxFilesPerTrigger", max_files)
                 .text(f"{folder}/{source}", wholetext=True))
        part = files.select(
            F.lit(source).alias("source"), F.col("_metadata.file_name").alias("file"),
            F.make_valid_utf8("value").alias("raw"),
            F.col("_metadata.file_modification_time").alias("landed_at"))
        out = part if out is None else out.unionByName(part)
    return out


def ingested(raw: DataFrame) -> DataFrame:
    """Normalise and validate; works on streams and on tables with a ``landed_at`` column."""
    return validate(normalize(raw, F.col("landed_at"))).withColumn(
        "outcome", F.coalesce("disposition", F.lit("valid")))


def deduplicated(docs: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """First copy of each document; a copy that arrives within the watermark is dropped."""
    return docs.withWatermark("ingested_at", watermark).dropDuplicatesWithinWatermark(["document_id"])


def running_counts(docs: DataFrame, watermark: str = WATERMARK, window: str = "1 hour") -> DataFrame:
    """Documents per hour, source and outcome."""
    return (docs.withWatermark("ingested_at", watermark)
            .groupBy(F.window("ingested_at", window), "source", "outcome")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("window_start"), "source", "outcome", "n"))


def write_documents(docs: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Valid documents, dead letters and failures, one folder each, in one pass per micro-batch.

    The batch number is part of the path and each batch overwrites its own folder, so a repeated
    micro-batch leaves the same files.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/batch_id={batch_id}")

    return _start(docs.writeStream.foreachBatch(write), checkpoint, once)


def write_messages(docs: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Queue messages per micro-batch: two work queues for valid documents, else dead letters."""
    def write(batch: DataFrame, batch_id: int) -> None:
        queue_messages(batch).write.mode("overwrite").partitionBy("queue").json(f"{out}/batch_id={batch_id}")

    return _start(docs.writeStream.foreachBatch(write), checkpoint, once)


def write_append(df: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append-mode Parquet sink."""
    writer = df.writeStream.format("parquet").option("path", out).outputMode("append")
    return _start(writer, checkpoint, once)


def write_updates(counts: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Changed groups per micro-batch; the largest ``n`` per group is the current count."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return _start(counts.writeStream.outputMode("update").foreachBatch(write), checkpoint, once)


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stage_timings(query: StreamingQuery) -> list[tuple[str, float]]:
    """(stage, milliseconds) of the query's recent micro-batches, for the latency report."""
    return [(stage, float(ms)) for p in query.recentProgress for stage, ms in p["durationMs"].items()]
