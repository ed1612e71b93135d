"""Topic summaries, daily shares and labels; vector likeness; a PCA and k-means fallback where no topics are given."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions.timegrid import fill_gaps
from murmurlake.operators.replies import cosine


def summary(rows: DataFrame) -> DataFrame:
    """Size, share, mean text length and first and last time of each topic."""
    out = rows.groupBy("topic").agg(F.count("*").alias("messages"), F.round(F.avg(F.length(F.coalesce("text", F.lit("")))), 6).alias("mean_length"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))
    return out.withColumn("share", F.round(100.0 * F.col("messages") / F.sum("messages").over(Window.partitionBy(F.lit(1))), 6))


def daily_share(rows: DataFrame) -> DataFrame:
    """Each topic's messages on every day and their share of the day's; 0 on days without."""
    counted = rows.groupBy(F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("t"), "topic").agg(F.count("*").alias("n"))
    days = fill_gaps(counted.groupBy("t").agg(F.sum("n").alias("total")), "t", "INTERVAL '1' DAY", ["total"])
    full = days.crossJoin(F.broadcast(rows.select("topic").distinct())).join(counted, ["t", "topic"], "left").fillna(0, ["n"])
    return full.select(F.to_date("t").alias("day"), "topic", F.col("n").alias("messages"), F.round(F.coalesce(F.col("n") / F.nullif("total", F.lit(0)), F.lit(0.0)), 9).alias("share"))


def label(topic: Column, keywords: Column, overrides: dict[int, str] | None = None) -> Column:
    """``Noise / Mixed`` for topic -1, an override, or the topic's number with its first keywords."""
    out = F.when(topic == -1, "Noise / Mixed")
    for k, v in (overrides or {}).items():
        out = out.when(topic == k, v)
    return out.otherwise(F.concat(F.lit("Topic "), topic.cast("string"), F.lit(": "), F.array_join(F.slice(keywords, 1, 3), ", ")))


def neighbour_cosine(vectors: DataFrame) -> DataFrame:
    """Cosine of each vector with the one before it by id; null without one."""
    before = vectors.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before"))
    return vectors.join(before, "vec_id", "left").select("vec_id", F.round(cosine(F.col("embedding"), F.col("before")), 6).alias("cosine"))


def clusters(vectors: DataFrame, k: int = 10, dimensions: int = 2, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """``vec_id, x, y, topic`` from vectors: scaled to length 1, projected, clustered; those farther from their centre
    than the ``1 - noise`` quantile are noise (-1). An empty table gives an empty one."""
    rows = vectors.where(F.size("embedding") > 0).select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    if rows.isEmpty():
        return vectors.limit(0).select("vec_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).cast("bigint").alias("topic"))
    unit = Normalizer(inputCol="raw", outputCol="unit").transform(rows)
    flat = PCA(k=dimensions, inputCol="unit", outputCol="map").fit(unit).transform(unit)
    model = KMeans(k=k, seed=seed, featuresCol="unit", predictionCol="topic").fit(flat)
    out = model.transform(flat)
    if noise:
        centres = F.array(*(F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()))
        distance = F.aggregate(F.zip_with(vector_to_array("unit"), centres[F.col("topic")], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        limit = F.percentile_approx("distance", F.lit(1 - noise))
        out = out.withColumn("distance", distance)
        out = out.crossJoin(F.broadcast(out.agg(limit.alias("limit")))).withColumn("topic", F.when(F.col("distance") > F.col("limit"), -1).otherwise(F.col("topic")))
    xy = vector_to_array("map")
    return out.select("vec_id", xy[0].alias("x"), xy[1].alias("y"), F.col("topic").cast("bigint").alias("topic"))
