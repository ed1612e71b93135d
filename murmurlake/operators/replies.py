"""Reply threading: edges, counts, latency, contingency, and how a reply relates to its parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions.timegrid import minutes_between

KEYS = ["channel_id", "message_id"]
CORRECTIONS = ("correction", "corrected", "update", "updated", "clarification", "clarified", "retraction", "fixed", "typo", "edited")


def edges(messages: DataFrame) -> DataFrame:
    """Each reply with its parent in the same channel and the minutes between them (null if the parent is absent)."""
    parents = messages.select("channel_id", F.col("message_id").alias("parent_id"), F.col("timestamp").alias("parent_at"))
    replies = messages.where("reply_to_message_id is not null").select(*KEYS, "timestamp", F.col("reply_to_message_id").alias("parent_id"))
    joined = replies.join(parents, ["channel_id", "parent_id"], "left")
    return joined.select(*KEYS, "parent_id", F.col("parent_at").isNotNull().alias("parent_present"), minutes_between(F.col("timestamp"), F.col("parent_at")).alias("minutes"))


def counts(messages: DataFrame) -> DataFrame:
    """How many replies each message has."""
    inbound = messages.where("reply_to_message_id is not null").groupBy("channel_id", F.col("reply_to_message_id").alias("message_id")).agg(F.count("*").alias("replies"))
    return messages.join(inbound, KEYS, "left").fillna(0, ["replies"]).select(*KEYS, "timestamp", "has_media", F.col("reply_to_message_id").alias("parent_id"), "replies")


def distribution(messages: DataFrame, overflow: int = 3) -> DataFrame:
    """Messages by number of replies, ``overflow`` or more together, and their share."""
    grouped = counts(messages).groupBy(F.least("replies", F.lit(overflow)).alias("replies")).agg(F.count("*").alias("messages"))
    return grouped.select("replies", "messages", F.round(100.0 * F.col("messages") / F.sum("messages").over(Window.partitionBy(F.lit(1))), 6).alias("share"))


def hourly_rate(messages: DataFrame) -> DataFrame:
    """By hour of day: share of messages with replies, and their mean number."""
    return counts(messages).groupBy(F.hour("timestamp").cast("bigint").alias("hour")).agg(F.count("*").alias("messages"), F.round(100.0 * F.avg((F.col("replies") > 0).cast("double")), 6).alias("reply_rate"), F.round(F.avg("replies"), 6).alias("mean_replies"))


def first_latency(messages: DataFrame) -> DataFrame:
    """For each present parent its earliest reply and the minutes until then."""
    own = messages.select(*KEYS, "timestamp")
    present = edges(messages).where("parent_present").join(own, KEYS)
    first = F.min_by(F.struct("message_id", "minutes"), F.struct("timestamp", "message_id")).alias("f")
    return present.groupBy("channel_id", "parent_id").agg(first).select("channel_id", "parent_id", F.col("f.message_id").alias("first_reply_id"), F.col("f.minutes").alias("minutes"))


def top(messages: DataFrame, k: int = 20) -> DataFrame:
    """The messages with most replies, the earlier first on ties, with their rank."""
    order = [F.desc("replies"), F.col("timestamp"), F.col("message_id")]
    best = counts(messages).where("replies > 0").orderBy(*order).limit(k)
    return best.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"), *KEYS, "replies")


def missing_parents(messages: DataFrame) -> DataFrame:
    """Parents that aren't in the table, with their replies."""
    return edges(messages).where("not parent_present").groupBy("channel_id", "parent_id").agg(F.count("*").alias("replies"))


def media_contingency(messages: DataFrame) -> DataFrame:
    """Messages by having media and having replies."""
    return counts(messages).groupBy("has_media", (F.col("replies") > 0).alias("has_replies")).agg(F.count("*").alias("messages"))


def summary(messages: DataFrame) -> DataFrame:
    """One row of totals, with the median minutes to a first reply."""
    c = counts(messages).agg(F.count("*").alias("messages"), F.count("parent_id").alias("replies"), F.count_if(F.col("replies") > 0).alias("replied_to"), F.max("replies").alias("most_replies"))
    present = edges(messages).agg(F.count_if("parent_present").alias("parent_present"))
    latency = first_latency(messages).agg(F.round(F.percentile("minutes", F.lit(0.5)), 6).alias("median_minutes"))
    return c.crossJoin(F.broadcast(present)).crossJoin(F.broadcast(latency))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z][A-Za-z'-]{2,})"), F.lit(1)), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two token sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one is missing, empty, of another length or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot(a, b) / F.nullif(norm, F.lit(0.0)))


def hint(reply: Column, media_only: Column, similarity: Column, lexical: Column, high: float = 0.72, low: float = 0.35) -> Column:
    """What a reply is to its parent: correction, media supplement, continuation, or merely related."""
    said = F.lower(F.coalesce(reply, F.lit("")))
    corrects = F.lit(False)
    for word in CORRECTIONS:
        corrects = corrects | said.contains(word)
    return F.when(corrects, "correction").when(media_only, "media supplement").when(similarity >= high, "continuation").when(similarity <= low, "related").when(lexical > 0, "continuation").otherwise("related")


def content_review(messages: DataFrame) -> DataFrame:
    """Each reply to a present parent with the likeness of their words and what that makes of it."""
    words = token_set(F.col("text"))
    parents = messages.select("channel_id", F.col("message_id").alias("parent_id"), words.alias("a"))
    replies = messages.where("reply_to_message_id is not null").select(*KEYS, F.col("reply_to_message_id").alias("parent_id"), "text", words.alias("b"))
    like = jaccard(F.col("a"), F.col("b"))
    joined = replies.join(parents, ["channel_id", "parent_id"])
    return joined.select(*KEYS, "parent_id", F.round(like, 6).alias("jaccard"), hint(F.col("text"), F.lit(False), like, like).alias("hint"))
