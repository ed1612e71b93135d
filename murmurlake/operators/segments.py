"""Comparison of messages with and without media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment() -> Column:
    return F.when(F.col("has_media"), "media").otherwise("text")


def star(messages: DataFrame, sentiment: DataFrame | None = None, topics: DataFrame | None = None, frames: DataFrame | None = None) -> DataFrame:
    """Messages with what is known of them, each input's first row for a message; null columns for absent inputs."""
    out = messages
    for df, columns in ((sentiment, {"sentiment": "string", "score": "double"}), (topics, {"topic": "bigint"}), (frames, {"frame": "string", "frame_confidence": "double"})):
        if df is None:
            out = out.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})
        else:
            first = df.groupBy("message_id").agg(F.min(F.struct(*columns)).alias("x")).select("message_id", *(F.col(f"x.{c}").alias(c) for c in columns))
            out = out.join(first, "message_id", "left")
    return out


def summary(joined: DataFrame) -> DataFrame:
    """Counts, share, lengths, sentiment and coverage of either segment."""
    size = F.length(F.coalesce("text", F.lit("")))
    out = joined.groupBy(segment().alias("segment")).agg(F.count("*").alias("messages"), F.round(F.avg(size), 6).alias("mean_length"), F.percentile(size, F.lit(0.5)).alias("median_length"), F.round(F.avg("score"), 6).alias("mean_score"), F.percentile("score", F.lit(0.5)).alias("median_score"), F.count("topic").alias("with_topic"), F.count("sentiment").alias("with_sentiment"))
    return out.withColumn("share", F.round(100.0 * F.col("messages") / F.sum("messages").over(Window.partitionBy(F.lit(1))), 6))


def hourly_share(messages: DataFrame) -> DataFrame:
    """Messages of either segment by hour of day, all 24 of them, and their share in the segment."""
    counted = messages.groupBy(segment().alias("segment"), F.hour("timestamp").alias("hour")).agg(F.count("*").alias("messages"))
    grid = messages.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"), F.explode(F.array(F.lit("media"), F.lit("text"))).alias("segment"))
    full = grid.join(counted, ["segment", "hour"], "left").fillna(0, ["messages"])
    total = F.sum("messages").over(Window.partitionBy("segment"))
    return full.select("segment", F.col("hour").cast("bigint").alias("hour"), "messages", F.round(F.coalesce(100.0 * F.col("messages") / F.nullif(total, F.lit(0)), F.lit(0.0)), 6).alias("share"))


def distribution(joined: DataFrame, category: str, top: int = 8) -> DataFrame:
    """The commonest categories by segment: count, share of the segment's rows in these categories, and the gap."""
    named = joined.where(F.col(category).isNotNull()).select(segment().alias("segment"), F.col(category).cast("string").alias("category"))
    best = named.groupBy("category").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "category").limit(top)
    counts = named.join(F.broadcast(best), "category").groupBy("category", "total").agg(F.count_if(F.col("segment") == "media").alias("media"), F.count_if(F.col("segment") == "text").alias("text"))
    all_ = Window.partitionBy(F.lit(1))
    share = lambda c: F.coalesce(100.0 * F.col(c) / F.nullif(F.sum(c).over(all_), F.lit(0)), F.lit(0.0))
    return counts.select("category", "total", "media", "text", F.round(share("media"), 6).alias("media_share"), F.round(share("text"), 6).alias("text_share"), F.round(share("media") - share("text"), 6).alias("gap"))


def entity_distribution(messages: DataFrame, mentions: DataFrame, top: int = 15) -> DataFrame:
    """The entities of most messages by segment; shares are of all the segment's messages with text."""
    base = messages.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    sizes = base.agg(F.count_if("has_media").alias("nm"), F.count_if(~F.col("has_media")).alias("nt"))
    distinct = mentions.select("message_id", "entity").distinct().join(base.select("message_id", "has_media"), "message_id")
    counts = distinct.groupBy("entity").agg(F.countDistinct(F.when(F.col("has_media"), F.col("message_id"))).alias("media"), F.countDistinct(F.when(~F.col("has_media"), F.col("message_id"))).alias("text"))
    best = counts.orderBy(F.desc(F.col("media") + F.col("text")), "entity").limit(top).crossJoin(F.broadcast(sizes))
    share = lambda c, n: F.round(F.coalesce(100.0 * F.col(c) / F.nullif(n, F.lit(0)), F.lit(0.0)), 6)
    return best.select("entity", "media", "text", share("media", "nm").alias("media_share"), share("text", "nt").alias("text_share"))


def top_value(joined: DataFrame, category: str) -> DataFrame:
    """The commonest value of either segment, the least on ties; empty where there is none."""
    counts = joined.groupBy(segment().alias("segment"), F.col(category).cast("string").alias("value")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("segment").orderBy(F.col("value").isNull(), F.desc("n"), "value"))
    return counts.withColumn("p", place).where("p = 1").select("segment", F.coalesce("value", F.lit("")).alias("value"), F.when(F.col("value").isNull(), 0).otherwise(F.col("n")).alias("n"))


def overview(joined: DataFrame) -> DataFrame:
    """One row: messages, media share, and which inputs are there."""
    return joined.agg(F.count("*").alias("messages"), F.count_if("has_media").alias("media"), F.round(100.0 * F.avg(F.col("has_media").cast("double")), 6).alias("media_share"), F.bool_or(F.col("sentiment").isNotNull()).alias("has_sentiment"), F.bool_or(F.col("topic").isNotNull()).alias("has_topics"))
