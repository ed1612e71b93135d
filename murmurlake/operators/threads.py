"""Reply threads: root and depth by pointer doubling, thread summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.functions.shared import written

KEYS = ["channel_id", "message_id"]


def depths(messages: DataFrame) -> DataFrame:
    """``channel_id, message_id, root_id, depth, external_root``: where the chain of parents of each message ends.

    A parent outside the table is a root of its own, one step above. Each round doubles how far every message looks,
    so a chain of n takes log n joins. Members of a cycle, and what leads into one, have its least id as root and
    depth null. Repeated ids in a channel count once."""
    rows = messages.groupBy(*KEYS).agg(F.max("reply_to_message_id").alias("parent"))
    known = rows.select("channel_id", F.col("message_id").alias("parent"), F.lit(True).alias("present"))
    base = rows.join(known, ["channel_id", "parent"], "left")
    now = base.select("channel_id", "message_id", F.coalesce("parent", "message_id").alias("up"), F.col("parent").isNotNull().cast("bigint").alias("depth"), (F.col("parent").isNotNull() & F.col("present").isNotNull()).alias("open"), (F.col("parent").isNotNull() & F.col("present").isNull()).alias("external_root"), F.least("message_id", F.coalesce("parent", "message_id")).alias("least"))
    parts, was = [written(now, "depth")], None  # rows that are closed stay where they were written
    while True:
        is_ = tuple(parts[-1].where("open").agg(F.count("*"), F.sum(F.col("least").cast("decimal(38,0)"))).first())
        if not is_[0] or is_ == was:
            break
        was = is_
        every = reduce(DataFrame.unionByName, [*(p.where("not open") for p in parts[:-1]), parts[-1]])
        ahead = every.select("channel_id", F.col("message_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("open").alias("open2"), F.col("external_root").alias("external2"), F.col("least").alias("least2"))
        moving = parts[-1].where("open").drop("external_root").join(ahead, ["channel_id", "up"])
        moved = moving.select("channel_id", "message_id", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), F.col("open2").alias("open"), F.col("external2").alias("external_root"), F.least("least", "least2").alias("least"))
        parts.append(written(moved, "depth"))
    now = reduce(DataFrame.unionByName, [*(p.where("not open") for p in parts[:-1]), parts[-1]])
    cycles = now.where("open").select("channel_id", F.col("message_id").alias("up"), F.col("least").alias("cycle"))
    out = now.join(cycles, ["channel_id", "up"], "left")
    return out.select("channel_id", "message_id", F.when(F.col("open"), F.col("cycle")).otherwise(F.col("up")).alias("root_id"), F.when(~F.col("open"), F.col("depth")).alias("depth"), "external_root")


def summaries(messages: DataFrame) -> DataFrame:
    """Each thread's messages, replies, depth, first and last time, and its most answered message (least id on ties)."""
    d = depths(messages)
    inbound = messages.where("reply_to_message_id is not null").groupBy("channel_id", F.col("reply_to_message_id").alias("message_id")).agg(F.count("*").alias("replies"))
    rows = messages.select(*KEYS, "timestamp", "reply_to_message_id").join(d, KEYS).join(inbound, KEYS, "left").fillna(0, ["replies"])
    top = F.max_by(F.struct("message_id", "replies"), F.struct("replies", (-F.col("message_id")).alias("m"))).alias("top")
    out = rows.groupBy("channel_id", "root_id").agg(F.count("*").alias("messages"), F.count("reply_to_message_id").alias("replies"), F.max("depth").alias("depth"), F.bool_or("external_root").alias("external_root"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), top)
    return out.select("channel_id", "root_id", "messages", "replies", "depth", "external_root", "first_at", "last_at", F.when(F.col("top.replies") > 0, F.col("top.message_id")).alias("top_replied_id"), (F.col("messages") == 1).alias("isolated"))
