"""Vocabulary over time and between groups: period TF-IDF, rank shifts, movers, lift, class-based TF-IDF."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from murmurlake.functions import counting, words
from murmurlake.functions.shared import written
from murmurlake.functions.text import lexical_tokens
from murmurlake.functions.timegrid import period_index


def tokens(messages: DataFrame) -> DataFrame:
    """Messages with their words, those without any left out."""
    return messages.withColumn("tokens", lexical_tokens(F.coalesce("text", F.lit("")))).where(F.size("tokens") > 0)


def with_period(messages: DataFrame, periods: int = 4) -> DataFrame:
    """Adds ``period``, 1 to ``periods``, over the time that the messages span; bounds join as one row."""
    bounds = messages.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    return messages.crossJoin(F.broadcast(bounds)).withColumn("period", period_index(F.col("timestamp"), F.col("lo"), F.col("hi"), periods)).drop("lo", "hi")


def period_documents(messages: DataFrame, periods: int = 4) -> DataFrame:
    """Messages, tokens and first and last time of each period; the text itself is never put together.

    Texts are cleaned once: the bounds of time and the sums read the number of words and the time, which are written."""
    own = with_period(written(words.tokens(messages, ["timestamp"], "lexical", sizes=True), "sizes"), periods)
    return own.groupBy(F.col("period").cast("bigint").alias("period")).agg(F.count("*").alias("messages"), F.sum("n_tokens").alias("tokens"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))


def tfidf(counts: DataFrame, doc: str, features: int, docs: DataFrame | int) -> DataFrame:
    """TF-IDF of ``doc, term, n``: smooth idf, rows of length 1, the ``features`` commonest terms (ties by term)."""
    total = counts.groupBy("term").agg(F.sum("n").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(features)
    if isinstance(docs, int):
        n = F.lit(float(docs))
        weighed = counts.join(F.broadcast(total), "term")
    else:
        n = F.col("docs").cast("double")
        weighed = counts.join(F.broadcast(total), "term").crossJoin(F.broadcast(docs))
    raw = weighed.withColumn("w", F.col("n") * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return raw.select(doc, "term", "n", (F.col("w") / length).alias("score"))


def period_tfidf(messages: DataFrame, periods: int = 4, features: int = 500) -> DataFrame:
    """Score of each term in each period, every period being one document; hyphenated words count by their parts.

    Texts are cleaned once and the words written as they are; the bounds of time read one column of that, and the
    counts by period and term merge in each task before they move."""
    cleaned = written(words.tokens(messages, ["timestamp"], "lexical"), "words")
    rows = with_period(cleaned, periods).select("period", F.explode("tokens").alias("word"))
    whole = rows.groupBy("period", "word").agg(F.count("*").alias("c"))
    parts = whole.select("period", "c", F.explode(F.split("word", "-")).alias("term")).where("length(term) >= 2")
    counts = parts.groupBy("period", "term").agg(F.sum("c").alias("n"))
    return tfidf(counts, "period", features, periods).select(F.col("period").cast("bigint").alias("period"), "term", "n", F.round("score", 9).alias("score"))


def ranks(scores: DataFrame, periods: int = 4) -> DataFrame:
    """``term, period, score, rank`` for every term and period; a term without score ranks after all terms."""
    terms = scores.select("term").distinct()
    grid = terms.crossJoin(F.broadcast(terms.sparkSession.range(1, periods + 1).withColumnRenamed("id", "period")))
    size = F.broadcast(terms.agg(F.count("*").alias("size")))
    full = grid.join(scores.select("term", "period", "score"), ["term", "period"], "left").fillna(0.0, ["score"]).crossJoin(size)
    place = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("score"), "term"))
    return full.select("term", "period", "score", F.when(F.col("score") > 0, place).otherwise(F.col("size") + 1).cast("bigint").alias("rank"))


def rank_shift(scores: DataFrame, periods: int = 4) -> DataFrame:
    """First, last and best rank of each term, its gain, and its scores at both ends."""
    at = lambda c, p: F.max(F.when(F.col("period") == p, F.col(c)))
    out = ranks(scores, periods).groupBy("term").agg(at("rank", 1).alias("first_rank"), at("rank", periods).alias("last_rank"), F.min("rank").alias("best_rank"), F.max("score").alias("max_score"), at("score", 1).alias("first_score"), at("score", periods).alias("last_score"))
    return out.withColumn("delta", F.col("first_rank") - F.col("last_rank"))


def movers(scores: DataFrame, periods: int = 4, cutoff: int = 30, k: int = 5) -> DataFrame:
    """The terms that rose and fell most, of those that ranked within ``cutoff`` at some time."""
    shift = rank_shift(scores, periods).where(F.col("best_rank") <= cutoff)
    up = shift.where("delta > 0 and last_score > 0").orderBy(F.desc("delta"), "last_rank", "term").limit(k).withColumn("kind", F.lit("riser"))
    down = shift.where("delta < 0 and first_score > 0").orderBy("delta", "first_rank", "term").limit(k).withColumn("kind", F.lit("faller"))
    return up.unionByName(down).select("kind", "term", "first_rank", "last_rank", "delta")


def top_terms(scores: DataFrame, periods: int = 4, top: int = 15, prior: int = 30, dropped: int = 5) -> DataFrame:
    """Each period's top terms with their status against the period before, and the best that left its top."""
    r = ranks(scores, periods)
    before = r.select("term", (F.col("period") + 1).alias("period"), F.col("rank").alias("prior_rank"), F.col("score").alias("prior_score"))
    both = r.join(before, ["term", "period"], "left")
    now = both.where((F.col("score") > 0) & (F.col("rank") <= top))
    status = F.when(F.col("period") == 1, "baseline").when((F.col("prior_rank") <= prior) & (F.col("prior_score") > 0), "recurring").otherwise("new")
    gone = both.where((F.col("prior_rank") <= top) & (F.col("prior_score") > 0) & ((F.col("rank") > top) | (F.col("score") <= 0)))
    place = F.row_number().over(Window.partitionBy("period").orderBy("prior_rank", "term"))
    gone = gone.withColumn("place", place).where(F.col("place") <= dropped)
    return now.select("period", "term", "rank", status.alias("status")).unionByName(gone.select("period", "term", F.col("prior_rank").alias("rank"), F.lit("dropped").alias("status")))


def segment_lift(messages: DataFrame, features: int = 500, k: int = 15) -> DataFrame:
    """Mean TF-IDF of terms in messages with and without media, zeros counting, and the top terms of either by lift."""
    own = tokens(messages).select("message_id", "has_media", F.explode("tokens").alias("term"))
    counts = own.groupBy("message_id", "has_media", "term").agg(F.count("*").alias("n"))
    sizes = tokens(messages).groupBy("has_media").agg(F.count("*").alias("size"))
    docs = sizes.agg(F.sum("size").alias("docs"))
    total = counts.groupBy("term").agg(F.sum("n").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(features)
    weighed = counts.join(F.broadcast(total), "term").crossJoin(F.broadcast(docs)).withColumn("w", F.col("n") * (F.log((1.0 + F.col("docs")) / (1 + F.col("df"))) + 1))
    scored = weighed.withColumn("score", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("message_id"))))
    size = {v: F.max(F.when(F.col("has_media") == v, F.col("size"))) for v in (True, False)}
    sides = F.broadcast(sizes.agg(size[True].alias("size_m"), size[False].alias("size_t")))
    sums = scored.groupBy("term").agg(F.sum(F.when(F.col("has_media"), F.col("score")).otherwise(0.0)).alias("m"), F.sum(F.when(~F.col("has_media"), F.col("score")).otherwise(0.0)).alias("t")).crossJoin(sides)
    mean = sums.select("term", (F.col("m") / F.nullif("size_m", F.lit(0))).alias("media"), (F.col("t") / F.nullif("size_t", F.lit(0))).alias("plain")).fillna(0.0, ["media", "plain"])
    lift = mean.select("term", "media", "plain", F.explode(F.array(F.struct(F.lit("media").alias("segment"), ((F.col("media") + 1e-9) / (F.col("plain") + 1e-9)).alias("lift")), F.struct(F.lit("plain").alias("segment"), ((F.col("plain") + 1e-9) / (F.col("media") + 1e-9)).alias("lift")))).alias("s")).select("term", F.round("media", 9).alias("media"), F.round("plain", 9).alias("plain"), "s.segment", F.round("s.lift", 6).alias("lift"))
    place = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("lift"), "term"))
    return lift.withColumn("place", place.cast("bigint")).where(F.col("place") <= k).select("segment", "place", "term", "media", "plain", "lift")


def _commonest(tokenised: DataFrame, k: int, most: int = 1_000_000) -> tuple[np.ndarray | None, int]:
    """The hashes of words and pairs that are as common as the ``k``-th, in order, and its count; none if there are
    fewer than ``k`` or ties make them more than ``most``."""
    spark = tokenised.sparkSession
    own = tokenised.select("tokens").mapInArrow(lambda batches: counting.hashed(batches, 1, 2), "part int, h bigint, n bigint")
    own = own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").select("h", "n")
    top = written(own.mapInArrow(lambda batches: counting.commonest(batches, k), "h bigint, n bigint"), "commonest")
    found = top.orderBy(F.desc("n")).limit(k).agg(F.count("*").alias("many"), F.min("n").alias("least")).first()
    as_common = top.where(F.col("n") >= F.lit(found.least))
    if found.many < k or as_common.count() > most:
        return None, 0
    return np.sort(np.array([r.h for r in as_common.select("h").collect()], np.int64).view(np.uint64)), found.least


def class_tfidf(messages: DataFrame, topic: str, features: int = 5000, k: int = 10) -> DataFrame:
    """The top words and pairs of each topic by class-based TF-IDF."""
    own = written(words.tokens(messages.withColumn("topic", F.col(topic)), ["topic"], "lexical"), "words")
    schema = StructType([StructField("topic", messages.select(topic).schema[0].dataType), StructField("term", StringType()), StructField("n", LongType())])

    def counted(through: np.ndarray | None) -> DataFrame:
        each = own.mapInArrow(lambda batches: counting.grouped(batches, 2, through), schema)
        return written(each.groupBy("topic", "term").agg(F.sum("n").alias("n")), "terms")

    hashes, least = _commonest(own, features)
    counts = counted(hashes)
    if hashes is not None and counts.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).count() < features:
        counts = counted(None)
    total = counts.groupBy("term").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "term").limit(features)
    kept = counts.join(F.broadcast(total), "term")
    grand = F.broadcast(total.agg(F.sum("total").alias("grand")))
    size = F.sum("n").over(Window.partitionBy("topic"))
    score = F.col("n") / size * (F.log((1.0 + F.col("grand")) / (1 + F.col("total"))) + 1)
    ranked = kept.crossJoin(grand).withColumn("score", F.round(score, 9)).withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "term")).cast("bigint"))
    return ranked.where(F.col("place") <= k).select("topic", "place", "term", "score")


def name_words(names: DataFrame, column: str) -> DataFrame:
    """``word``: the words of channels' names as stop-words, three letters at least."""
    return names.select(F.explode(lexical_tokens(F.coalesce(column, F.lit("")))).alias("word")).distinct()


def summary(messages: DataFrame, periods: int = 4, features: int = 500) -> DataFrame:
    """One row: messages with words, words, different words, periods that have any, terms that are scored."""
    own = written(tokens(messages).select("timestamp", "tokens"), "words")
    base = own.agg(F.count("*").alias("messages"), F.sum(F.size("tokens").cast("bigint")).alias("tokens"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))
    distinct = own.select(F.explode("tokens").alias("w")).distinct().agg(F.count("*").alias("unique_tokens"))
    held = with_period(own, periods).select("period").distinct().agg(F.count("*").alias("periods"))
    terms = period_tfidf(messages, periods, features).select("term").distinct().agg(F.count("*").alias("terms"))
    return base.crossJoin(F.broadcast(distinct)).crossJoin(F.broadcast(held)).crossJoin(F.broadcast(terms))
