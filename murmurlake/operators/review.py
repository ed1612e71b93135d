"""What replies are to their parents by vectors, words and sentiment; the order and the latency of replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions.timegrid import bucket
from murmurlake.operators.replies import KEYS, cosine, counts, first_latency, hint, jaccard, token_set


def ordered(messages: DataFrame) -> DataFrame:
    """Each reply with its place among its parent's replies, by time and then id.

    Places are counted within the hour and raised by the replies of earlier hours, so that a parent with very many
    replies isn't sorted by one task."""
    replies = messages.where("reply_to_message_id is not null").select(*KEYS, "timestamp", F.col("reply_to_message_id").alias("parent_id"), bucket("timestamp", "hour").alias("hour"))
    group = ["channel_id", "parent_id"]
    earlier = F.sum("n").over(Window.partitionBy(*group).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    hours = replies.groupBy(*group, "hour").agg(F.count("*").alias("n")).select(*group, "hour", F.coalesce(earlier, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*group, "hour").orderBy("timestamp", "message_id"))
    return replies.withColumn("p", place).join(hours, [*group, "hour"]).select(*KEYS, "parent_id", (F.col("p") + F.col("before")).cast("bigint").alias("place"))


def latency_histogram(messages: DataFrame) -> DataFrame:
    """Parents by minutes to their first reply, in bins of equal width from the least to the greatest: as many as the
    root of their number and two more, 6 at least and 20 at most; empty bins are included, the last one is closed."""
    latency = first_latency(messages).where("minutes is not null").select("minutes")
    bounds = latency.agg(F.count("*").alias("n"), F.min("minutes").alias("lo"), F.max("minutes").alias("hi")).where("n > 0")
    bins = F.least(F.lit(20), F.greatest(F.lit(6), F.floor(F.sqrt("n")) + 2)).cast("bigint")
    flat = F.col("lo") == F.col("hi")
    grid = bounds.select(bins.alias("bins"), F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    at = F.least(F.col("bins") - 1, F.floor((F.col("minutes") - F.col("lo")) / width)).cast("bigint")
    filled = latency.crossJoin(F.broadcast(grid)).groupBy(at.alias("bin")).agg(F.count("*").alias("parents"))
    every = grid.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)).alias("bin"), "lo", width.alias("width"))
    edges = every.select("bin", F.round(F.col("lo") + F.col("bin") * F.col("width"), 6).alias("low"), F.round(F.col("lo") + (F.col("bin") + 1) * F.col("width"), 6).alias("high"))
    return edges.join(filled, "bin", "left").fillna(0, ["parents"])


def review(messages: DataFrame, vectors: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Each reply to a present parent: likeness of vectors (null where one is missing) and of words, both sentiments
    (null where unknown), how many replies the parent has, and what all that makes of the reply.

    ``vectors`` holds ``message_id, embedding``, ``scores`` ``message_id, sentiment``, one row a message; without them
    their columns are null."""
    own = counts(messages).select(*KEYS, "replies").join(messages.select(*KEYS, "text", "is_media_only", "reply_to_message_id"), KEYS)
    own = own.join(vectors.select("message_id", "embedding"), "message_id", "left") if vectors is not None else own.withColumn("embedding", F.lit(None).cast("array<float>"))
    own = own.join(scores.select("message_id", "sentiment"), "message_id", "left") if scores is not None else own.withColumn("sentiment", F.lit(None).cast("string"))
    own = own.withColumn("words", token_set(F.col("text")))
    parents = own.select("channel_id", F.col("message_id").alias("parent_id"), F.col("words").alias("parent_words"), F.col("embedding").alias("parent_vector"), F.col("sentiment").alias("parent_sentiment"), F.col("replies").alias("parent_replies"))
    replies = own.where("reply_to_message_id is not null").withColumnRenamed("reply_to_message_id", "parent_id")
    lexical, similarity = jaccard(F.col("parent_words"), F.col("words")), cosine(F.col("parent_vector"), F.col("embedding"))
    return replies.join(parents, ["channel_id", "parent_id"]).select(
        *KEYS,
        "parent_id",
        F.round(lexical, 6).alias("jaccard"),
        F.round(similarity, 6).alias("similarity"),
        "sentiment",
        "parent_sentiment",
        "parent_replies",
        hint(F.col("text"), F.col("is_media_only"), similarity, lexical).alias("hint"),
    )
