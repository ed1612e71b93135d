"""Streaming: incremental archive ingest with watermarks, and cadence over late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from murmurlake.sources.archive import upsert, write_archive


def stream_messages(spark: SparkSession, path: str, schema, chats: list[int] | None = None) -> DataFrame:
    """New Parquet files of messages as a stream, of the given chats if any are."""
    out = spark.readStream.schema(schema).parquet(path)
    return out.where(F.col("chat_id").isin(*chats)) if chats is not None else out


def ingest(stream: DataFrame, archive: str, checkpoint: str) -> StreamingQuery:
    """Merge what is new into the archive and stop when all is read. A batch that is repeated after a failure merges
    to the same archive, and only a finished batch moves the checkpoint, so nothing is skipped."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            chats = batch.select("chat_id").distinct()
            try:
                there = spark.read.parquet(archive).join(F.broadcast(chats), "chat_id", "left_semi").select(*batch.columns)
            except Exception as missing:  # noqa: BLE001 - the first batch finds no archive
                if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                    raise
                there = batch.limit(0)
            merged = upsert(there, batch)
            from murmurlake.functions.shared import written

            write_archive(written(merged, f"merge{number}"), archive)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_cadence(stream: DataFrame, every: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Messages and media of each window of event time; rows later than ``late`` are dropped (None: the stream has its
    watermark already)."""
    marked = stream.withWatermark("timestamp", late) if late else stream
    counts = marked.groupBy(F.window("timestamp", every)).agg(F.count("*").alias("messages"), F.sum(F.col("has_media").cast("bigint")).alias("media"))
    return counts.select(F.col("window.start").alias("start"), "messages", "media")


def distinct_messages(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["chat_id", "message_id"])
