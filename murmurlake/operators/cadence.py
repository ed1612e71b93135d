"""Posting cadence: gap-free hourly and daily counts, calendar means, spikes, smoothed media share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions.timegrid import STEPS, bucket, fill_gaps


def _counted(messages: DataFrame, time: str, unit: str) -> DataFrame:
    return messages.groupBy(bucket("timestamp", unit).alias(time)).agg(F.count("*").alias("messages"), F.sum(F.col("has_media").cast("bigint")).alias("media"))


def _share(digits: int = 6):
    return F.round(100.0 * F.col("media") / F.nullif("messages", F.lit(0)), digits).alias("media_share")


def hourly(messages: DataFrame) -> DataFrame:
    """Messages, media and media share (null without messages) of every hour from the first to the last."""
    return fill_gaps(_counted(messages, "hour", "hour"), "hour", STEPS["hour"], ["messages", "media"]).select("hour", "messages", "media", _share())


def peaks(messages: DataFrame) -> DataFrame:
    """Each day's hour with most messages, the earlier on ties."""
    counted = messages.groupBy(F.to_date("timestamp").alias("day"), F.hour("timestamp").alias("hour")).agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("hour", "n"), F.struct("n", (-F.col("hour")).alias("h"))).alias("b")
    return counted.groupBy("day").agg(best).select("day", F.col("b.hour").cast("bigint").alias("peak_hour"), F.col("b.n").alias("peak_messages"))


def daily(messages: DataFrame) -> DataFrame:
    """Every day's counts and media share, with its peak hour (null on a day without messages)."""
    days = fill_gaps(_counted(messages, "t", "day"), "t", STEPS["day"], ["messages", "media"]).select(F.to_date("t").alias("day"), "messages", "media", _share())
    return days.join(peaks(messages), "day", "left")


def day_hours(messages: DataFrame) -> DataFrame:
    """Counts of all 24 hours of every day from the first to the last."""
    counted = messages.groupBy(F.to_date("timestamp").alias("day"), F.hour("timestamp").alias("hour")).agg(F.count("*").alias("messages"))
    bounds = counted.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo is not null")
    cells = bounds.select(F.explode(F.sequence("lo", "hi")).alias("day")).select("day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return cells.join(counted, ["day", "hour"], "left").fillna(0, ["messages"])


def weekday_hour(messages: DataFrame) -> DataFrame:
    """Mean messages of each weekday (Monday 0) and hour over the days observed, empty hours included."""
    return day_hours(messages).groupBy(F.weekday("day").cast("bigint").alias("weekday"), F.col("hour").cast("bigint").alias("hour")).agg(F.round(F.avg("messages"), 6).alias("mean_messages"))


def weekday_observed(messages: DataFrame) -> DataFrame:
    """How many days of each weekday lie between the first and the last."""
    return day_hours(messages).where("hour = 0").groupBy(F.weekday("day").cast("bigint").alias("weekday")).agg(F.count("*").alias("days"))


def top_spikes(messages: DataFrame, top: int = 10) -> DataFrame:
    """The hours with most messages, the earlier first on ties, with their rank."""
    best = _counted(messages, "hour", "hour").orderBy(F.desc("messages"), "hour").limit(top)
    return best.select(F.row_number().over(Window.orderBy(F.desc("messages"), "hour")).cast("bigint").alias("rank"), "hour", "messages", "media")


def spike_messages(messages: DataFrame, top: int = 10) -> DataFrame:
    """Each spike with its hour's longest message, the one of least id on ties."""
    spikes = top_spikes(messages, top)
    near = messages.withColumn("hour", bucket("timestamp", "hour")).join(F.broadcast(spikes.select("hour")), "hour", "left_semi")
    size = F.length(F.coalesce("text", F.lit("")))
    best = near.groupBy("hour").agg(F.min_by(F.struct("message_id", "text"), F.struct((-size).alias("s"), "message_id")).alias("b"))
    return spikes.join(best, "hour", "left").select("rank", "hour", "messages", F.col("b.message_id").alias("message_id"), F.col("b.text").alias("text"))


def summary(messages: DataFrame) -> DataFrame:
    """One row: messages, days, mean a day, media share, busiest day (earliest on ties), busiest hour of day."""
    days = daily(messages).agg(F.sum("messages").alias("messages"), F.sum("media").alias("media"), F.count("*").alias("days"), F.max_by("day", F.struct("messages", (-F.unix_date("day")).alias("d"))).alias("busiest_day"))
    hours = messages.groupBy(F.hour("timestamp").alias("h")).agg(F.count("*").alias("n")).agg(F.max_by(F.col("h").cast("bigint"), F.struct("n", (-F.col("h")).alias("d"))).alias("peak_hour"))
    return days.crossJoin(F.broadcast(hours)).select("messages", "days", F.round(F.col("messages") / F.col("days"), 6).alias("mean_a_day"), F.round(100.0 * F.col("media") / F.nullif("messages", F.lit(0)), 6).alias("media_share"), "busiest_day", "peak_hour")


def calendar(messages: DataFrame) -> DataFrame:
    """A row for each day, a column for each hour."""
    return day_hours(messages).groupBy("day").pivot("hour", list(range(24))).agg(F.sum("messages")).select("day", *(F.col(str(h)).alias(f"h{h:02d}") for h in range(24)))


def smoothed_media_share(messages: DataFrame, width: int = 3) -> DataFrame:
    """Hourly media share over a centred window of ``width`` hours, weighted by messages."""
    w = Window.orderBy("hour").rowsBetween(-(width // 2), (width - 1) // 2)  # the hours are few: one row each
    return hourly(messages).select("hour", F.round(100.0 * F.sum("media").over(w) / F.nullif(F.sum("messages").over(w), F.lit(0)), 6).alias("media_share"))
