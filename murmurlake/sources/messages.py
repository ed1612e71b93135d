"""The message model, and how tables of other shapes are read as messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEDIA = T.ArrayType(T.StructType().add("media_type", "string").add("storage_path", "string").add("mime_type", "string").add("file_name", "string"))

MESSAGES = (
    T.StructType()
    .add("channel_id", "long", False)
    .add("message_id", "long", False)
    .add("timestamp", "timestamp_ntz")
    .add("sender_id", "long")
    .add("sender_name", "string")
    .add("text", "string")
    .add("media_refs", MEDIA)
    .add("forwarded_from", "long")
    .add("reply_to_message_id", "long")
    .add("raw_json", "string")
    .add("english_text", "string")
    .add("source_language", "string")
    .add("translated_at", "timestamp_ntz")
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def preferred_text() -> Column:
    """The translation where there is one, else the original, trimmed; never null."""
    return F.trim(F.coalesce(F.nullif("english_text", F.lit("")), "text", F.lit("")))


def used_translation() -> Column:
    """Whether the preferred text is a translation that differs from the original."""
    english = F.trim(F.coalesce("english_text", F.lit("")))
    return (english != "") & (english != F.trim(F.coalesce("text", F.lit(""))))


def normalised(records: DataFrame) -> DataFrame:
    """Archive records as messages: blank text becomes null, media is renamed, the origin of a forward is read from the raw payload."""
    path = lambda p: F.get_json_object("raw_json", p).try_cast("bigint")
    sources = [path(f"$.fwd_from.from_id.{k}") for k in ("channel_id", "chat_id", "user_id")] + [path(f"$.fwd_from.{k}") for k in ("from_id", "channel_id", "saved_from_peer")]
    return records.select(
        F.col("chat_id").alias("channel_id"),
        "message_id",
        F.col("posted_at").alias("timestamp"),
        "sender_id",
        "sender_name",
        F.when(F.trim("text") != "", F.col("text")).alias("text"),
        F.transform("media_files", lambda m: F.struct(m["media_type"].alias("media_type"), m["relative_path"].alias("storage_path"), m["mime_type"].alias("mime_type"), m["file_name"].alias("file_name"))).alias("media_refs"),
        F.coalesce(*sources).alias("forwarded_from"),
        "reply_to_message_id",
        "raw_json",
    )


def with_media_flags(messages: DataFrame) -> DataFrame:
    """Adds ``has_media`` and ``is_media_only`` (the original text is blank)."""
    has = F.coalesce(F.size("media_refs") > 0, F.lit(False))
    return messages.withColumns({"has_media": has, "is_media_only": has & (F.trim(F.coalesce("text", F.lit(""))) == "")})


def event_messages(spark: SparkSession, sf_dir: str, channels: int = 1) -> DataFrame:
    """``events`` as messages without text; a click answers the message ``k`` before it."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    reply = F.when((F.col("event_type") == "click") & (k > 0) & (F.col("event_id") >= k), F.col("event_id") - k)
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % channels).alias("channel_id"), F.col("event_id").alias("message_id"), F.col("ts").alias("timestamp"), F.col("event_type").isin("view", "purchase").alias("has_media"), F.col("props").alias("text"), "value", reply.alias("reply_to_message_id")
    )


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as messages, one an hour; every third has media."""
    hours = F.make_dt_interval(hours=F.col("doc_id").cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("channel"), F.col("doc_id").alias("message_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + hours).alias("timestamp"), "text", F.col("lang").alias("source_language"), (F.col("doc_id") % 3 == 0).alias("has_media")
    )


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as messages; each turn answers the one before."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("channel_id"), F.col("turn").alias("message_id"), "role", "text", F.when(F.col("turn") > 0, F.col("turn") - 1).alias("reply_to_message_id"))


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as sentiment: negative if toxic, else positive if good, else neutral."""
    name = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    score = F.when(F.col("toxic") == 1, -1.0).when(F.col("quality") == 1, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("message_id"), name.alias("sentiment"), score.alias("score"))


#: The same in DuckDB SQL, to stand before a query.
SQL_EVENTS = """ev AS (SELECT event_id AS message_id, ts AS timestamp, event_type IN ('view', 'purchase') AS has_media, props AS text, value,
  CASE WHEN event_type = 'click' AND k > 0 AND event_id >= k THEN event_id - k END AS parent_id
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"""
SQL_DOCS = "dm AS (SELECT source AS channel, doc_id AS message_id, TIMESTAMP '2024-01-01' + doc_id::INT * INTERVAL 1 HOUR AS timestamp, text, doc_id % 3 = 0 AS has_media FROM documents)"
SQL_SCORES = "sc AS (SELECT doc_id AS message_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment, CASE WHEN toxic = 1 THEN -1.0 WHEN quality = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM labels)"
