"""Aggregation of scored messages: sentiment windows and changes, labels, frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions.timegrid import bucket, fill_gaps, grid, window_start

FRAMES = ("victim", "threat", "triumph", "authority", "moral", "unity", "conflict", "economy")
SENTIMENTS = ("negative", "neutral", "positive")


def windows(scored: DataFrame, hours: int = 6, rolling: int = 3) -> DataFrame:
    """Count, mean, deviation, error and 95 % interval of each window up to the one that the last time ends in, and
    the mean of the last ``rolling`` windows' means. Windows without scores have null means."""
    stats = scored.groupBy(window_start("timestamp", hours).alias("start")).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))
    bounds = scored.agg(F.min(window_start("timestamp", hours)).alias("lo"), F.max(window_start(F.col("timestamp") - F.expr("INTERVAL 1 MICROSECOND"), hours) + F.make_dt_interval(hours=F.lit(hours))).alias("hi"))
    full = grid(bounds, "lo", "hi", f"INTERVAL '{hours}' HOUR", "start").join(stats, "start", "left").fillna(0, ["n"])
    sd = F.when(F.col("n") > 0, F.coalesce("sd", F.lit(0.0)))
    error = sd / F.sqrt(F.greatest("n", F.lit(1)).cast("double"))
    w = Window.orderBy("start").rowsBetween(1 - rolling, 0)  # windows are few: one row each
    return full.select("start", "n", F.round("mean", 9).alias("mean"), F.round(sd, 9).alias("sd"), F.round(error, 9).alias("se"), F.round(1.96 * error, 9).alias("ci95"), F.round(F.avg("mean").over(w), 9).alias("rolling_mean"))


def hourly_change(scored: DataFrame) -> DataFrame:
    """Hourly mean (0 in empty hours), its size, its change from the hour before, and the hour's most extreme message."""
    counted = scored.groupBy(bucket("timestamp", "hour").alias("hour")).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.max_by("message_id", F.struct(F.abs("score"), (-F.col("message_id")).alias("m"))).alias("extreme_id"))
    full = fill_gaps(counted, "hour", "INTERVAL '1' HOUR", ["n", "mean"])
    change = F.coalesce(F.abs(F.col("mean") - F.lag("mean").over(Window.orderBy("hour"))), F.lit(0.0))
    return full.select("hour", "n", F.round("mean", 9).alias("mean"), F.round(F.abs("mean"), 9).alias("size"), F.round(change, 9).alias("change"), "extreme_id")


def candidate_events(scored: DataFrame, each: int = 5, top: int = 10) -> DataFrame:
    """Hours that stand out by change, size or number, without repetition, the largest changes first."""
    hours = hourly_change(scored)
    parts = [hours.where("n > 0").orderBy(F.desc(c), "hour").limit(each) for c in ("change", "size", "n")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct().orderBy(F.desc("change"), F.desc("size"), F.desc("n"), "hour").limit(top)


def label_counts(scored: DataFrame) -> DataFrame:
    counted = scored.groupBy("sentiment").agg(F.count("*").alias("n"))
    return counted.select("sentiment", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"))


def dominant_hourly(scored: DataFrame, labels: tuple[str, ...] = SENTIMENTS) -> DataFrame:
    """Counts of each label by hour and the commonest, the first of ``labels`` on ties; ``no_data`` in empty hours."""
    counted = scored.groupBy(bucket("timestamp", "hour").alias("hour")).agg(*(F.count_if(F.col("sentiment") == x).alias(x) for x in labels))
    full = fill_gaps(counted, "hour", "INTERVAL '1' HOUR", list(labels))
    counts = F.array(*(F.col(x) for x in labels))
    best = F.element_at(F.array(*(F.lit(x) for x in labels)), F.array_position(counts, F.array_max(counts)).cast("int"))
    return full.select("hour", *labels, F.when(F.array_max(counts) > 0, best).otherwise("no_data").alias("dominant"))


def window_shares(scored: DataFrame, hours: int = 6, labels: tuple[str, ...] = SENTIMENTS) -> DataFrame:
    """Share of each label in each window; 0 in empty ones."""
    counted = scored.groupBy(window_start("timestamp", hours).alias("start")).agg(*(F.count_if(F.col("sentiment") == x).alias(x) for x in labels))
    full = fill_gaps(counted, "start", f"INTERVAL '{hours}' HOUR", list(labels))
    total = sum((F.col(x) for x in labels[1:]), F.col(labels[0]))
    return full.select("start", *(F.round(F.coalesce(F.col(x) / F.nullif(total, F.lit(0)), F.lit(0.0)), 9).alias(f"share_{x}") for x in labels))


def best_two(scores: dict[str, Column], threshold: float = 0.35, unsure: str = "mixed") -> dict[str, Column]:
    """The best and second best label of a row, their scores and the gap; the first on ties; ``unsure`` below ``threshold``."""
    entries = F.array(*(F.struct((-c).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, c) in enumerate(scores.items())))
    order = F.array_sort(entries)
    first, second = order[0], order[1]
    return {"frame": F.when(-first["s"] < threshold, unsure).otherwise(first["k"]), "frame_confidence": -first["s"], "second_frame": second["k"], "second_confidence": -second["s"], "confidence_gap": second["s"] - first["s"]}


def frame_windows(framed: DataFrame, hours: int = 12, frames: tuple[str, ...] = FRAMES) -> DataFrame:
    """Mean score of each frame in each window, scaled so that a window's add up to 1; 0 in empty ones."""
    means = framed.groupBy(window_start("timestamp", hours).alias("start")).agg(*(F.avg(x).alias(x) for x in frames))
    full = fill_gaps(means, "start", f"INTERVAL '{hours}' HOUR", list(frames))
    total = sum((F.col(x) for x in frames[1:]), F.col(frames[0]))
    return full.select("start", *(F.round(F.coalesce(F.col(x) / F.nullif(total, F.lit(0.0)), F.lit(0.0)), 9).alias(x) for x in frames))


def frame_counts(framed: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Messages and share of every label, zeros kept, in order."""
    names = framed.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], "frame string, place bigint")
    counted = framed.groupBy("frame").agg(F.count("*").alias("n"))
    full = names.join(counted, "frame", "left").fillna(0, ["n"])
    return full.select("place", "frame", "n", F.round(F.coalesce(100.0 * F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy(F.lit(1))), F.lit(0)), F.lit(0.0)), 6).alias("share"))


def frame_halves(framed: DataFrame) -> DataFrame:
    """Messages and share of each frame in the first and second half of the time spanned (split at its middle)."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bounds = framed.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    middle = micros("lo") + F.floor((micros("hi") - micros("lo")) / 2)
    split = framed.crossJoin(F.broadcast(bounds)).select("frame", F.when(micros("timestamp") <= middle, 1).otherwise(2).cast("bigint").alias("half"))
    counted = split.groupBy("half", "frame").agg(F.count("*").alias("n"))
    return counted.select("half", "frame", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("half")), 6).alias("share"))


def frame_flow(framed: DataFrame) -> DataFrame:
    """From each frame of the first half to each of the second, in proportion to the second's counts."""
    halves = frame_halves(framed)
    one = halves.where("half = 1").select(F.col("frame").alias("source"), F.col("n").alias("n1"))
    two = halves.where("half = 2").select(F.col("frame").alias("target"), F.col("n").alias("n2"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    return one.crossJoin(F.broadcast(two)).select("source", "target", F.round(F.col("n1") * F.col("n2") / F.col("total"), 6).alias("flow"))


def crosstab(framed: DataFrame, scored: DataFrame, labels: tuple[str, ...] = SENTIMENTS) -> DataFrame:
    """Frames by sentiment, with each frame's shares; a message's first score counts."""
    first = scored.groupBy("message_id").agg(F.min("sentiment").alias("sentiment"))
    counted = framed.join(first, "message_id").groupBy("frame").agg(*(F.count_if(F.col("sentiment") == x).alias(x) for x in labels))
    total = sum((F.col(x) for x in labels[1:]), F.col(labels[0]))
    return counted.select("frame", *labels, *(F.round(F.coalesce(F.col(x) / F.nullif(total, F.lit(0)), F.lit(0.0)), 6).alias(f"share_{x}") for x in labels))


def examples(framed: DataFrame, group: str, score: str, k: int = 3) -> DataFrame:
    """The ``k`` surest messages of each group, the least id first on ties."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), "message_id"))
    return framed.withColumn("place", place.cast("bigint")).where(F.col("place") <= k).select(group, "place", "message_id", score)


def stratified_sample(framed: DataFrame, group: str, k: int = 4, seed: int = 42) -> DataFrame:
    """``k`` rows of each group, drawn by hash, the same every time."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), "message_id"), "message_id"))
    return framed.withColumn("place", place.cast("bigint")).where(F.col("place") <= k)
