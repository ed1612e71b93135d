"""Annotated events, entity lists beside messages, and one-row summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions.timegrid import bucket


def events(candidates: DataFrame, manual: DataFrame | None = None, top: int = 5, unit: str = "hour") -> DataFrame:
    """``timestamp, label`` in order of time. Rows of ``manual`` replace all candidates: their times are floored to
    ``unit``, blank labels fall away, of several at a time the least label stays. Otherwise the ``top`` candidates
    (``rank, timestamp, label``)."""
    if manual is None:
        return candidates.orderBy("rank").limit(top).select("timestamp", "label")
    named = manual.where(F.trim(F.coalesce("label", F.lit(""))) != "")
    return named.groupBy(bucket("timestamp", unit).alias("timestamp")).agg(F.min("label").alias("label")).orderBy("timestamp")


def allowed(mentions: DataFrame, drop: DataFrame | None = None, labels: tuple[str, ...] = ()) -> DataFrame:
    """Mentions whose entity isn't in ``drop`` (``entity``) and, if ``labels`` are given, whose label is one of them."""
    out = mentions.where(F.col("label").isin(*labels)) if labels else mentions
    return out if drop is None else out.join(drop.select("entity").distinct(), "entity", "left_anti")


def attached(messages: DataFrame, mentions: DataFrame) -> DataFrame:
    """Every message with its different entities in order, joined, and their number; none are an empty text and 0."""
    listed = mentions.groupBy("message_id").agg(F.array_sort(F.collect_set("entity")).alias("es"))
    joined = messages.select("message_id").join(listed, "message_id", "left")
    return joined.select("message_id", F.coalesce(F.array_join("es", ", "), F.lit("")).alias("entities"), F.coalesce(F.size("es"), F.lit(0)).cast("bigint").alias("n_entities"))


def with_graph(summary: DataFrame, nodes: DataFrame) -> DataFrame:
    """An entity summary with each entity's place in the network: 0 and a dash for those that aren't in it."""
    out = summary.join(nodes, "entity", "left").fillna(0, ["degree", "weighted_degree"])
    return out.fillna("—", ["strongest"])


def entity_overview(messages: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: messages, those that mention any, mentions, different entities, nodes and edges of the network."""
    base = messages.agg(F.count("*").alias("messages"))
    told = mentions.groupBy("message_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("with_entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"))
    different = mentions.select("entity").distinct().agg(F.count("*").alias("entities"))
    graph = edges.select(F.explode(F.array("a", "b")).alias("x")).distinct().agg(F.count("*").alias("nodes"))
    return base.crossJoin(told).crossJoin(different).crossJoin(graph).crossJoin(edges.agg(F.count("*").alias("edges")))


def score_overview(scored: DataFrame) -> DataFrame:
    """One row: messages, mean score, share of each sign, first and last time, the commonest label (least on ties)."""
    by_label = scored.where("sentiment is not null").groupBy("sentiment").agg(F.count("*").alias("n"))
    mode = by_label.agg(F.min_by("sentiment", F.struct((-F.col("n")).alias("m"), "sentiment")).alias("dominant"))
    share = lambda test, name: F.round(100.0 * F.avg(test.cast("double")), 6).alias(name)
    whole = scored.agg(F.count("*").alias("messages"), F.round(F.avg("score"), 6).alias("mean_score"), share(F.col("score") > 0, "positive_share"), share(F.col("score") < 0, "negative_share"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))
    return whole.crossJoin(mode)


def spread(messages: DataFrame, segment: str, value: str) -> DataFrame:
    """Number, extremes, quartiles and median of a value of few different ones (a length) by segment; equal values
    merge before they meet."""
    each = messages.where(F.col(value).isNotNull()).groupBy(segment, value).agg(F.count("*").alias("n"))
    at = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    out = each.groupBy(segment).agg(F.sum("n").alias("n"), F.min(value).cast("double").alias("least"), at.alias("q"), F.max(value).cast("double").alias("greatest"))
    return out.select(segment, "n", "least", F.col("q")[0].alias("lower"), F.col("q")[1].alias("median"), F.col("q")[2].alias("upper"), "greatest")


def cloud(scores: DataFrame, top: int = 120) -> DataFrame:
    """The ``top`` terms of positive score in each period; a period has few scored terms."""
    place = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("score"), "term")).cast("bigint")
    return scores.where("score > 0").withColumn("place", place).where(F.col("place") <= top).select("period", "place", "term", "score")
