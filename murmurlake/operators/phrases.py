"""Phrases: n-gram counts, pointwise mutual information, shifts between halves, and their network."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions import counting, words
from murmurlake.functions.shared import importable, written
from murmurlake.functions.text import STOP_WORDS, ngrams, shorten


def tokens(messages: DataFrame, stop: tuple[str, ...] | None = None) -> DataFrame:
    """``message_id, timestamp, tokens`` of the messages with words; texts are cleaned once and the words written."""
    return written(words.tokens(messages, ["message_id", "timestamp"], "phrase", STOP_WORDS if stop is None else stop), "tokens")


def counts(tokenised: DataFrame, n: int, through: Broadcast | None = None) -> DataFrame:
    """Each n-gram's occurrences, messages, first and last time; none crosses messages. ``through``: a filter of those
    that are wanted; some others may come too.

    A message's n-grams are counted where it is, together with those of many others, so one row of a phrase moves for
    some millions of words, in order of its first word."""
    importable(tokenised.sparkSession)
    part = tokenised.select("timestamp", "tokens").mapInArrow(lambda batches: counting.counted(batches, n, through.value if through else None), "phrase string, n bigint, messages bigint, first_at timestamp_ntz, last_at timestamp_ntz")
    return part.groupBy("phrase").agg(F.sum("n").alias("n"), F.sum(F.coalesce("messages", "n")).alias("messages"), F.min("first_at").alias("first_at"), F.max(F.coalesce("last_at", "first_at")).alias("last_at"))


def frequent(tokenised: DataFrame, n: int, least: int) -> DataFrame:
    """``counts`` of the n-grams with ``least`` occurrences, written.

    Most n-grams are rare. Numbers that they hash to are counted first; where one occurs ``least`` times, a bit is set
    in a filter of fixed size (32 MB), and only phrases with their bit set move. The filter never holds back a phrase
    that is frequent enough, and what else it lets through is told apart by its own count."""
    spark = tokenised.sparkSession
    importable(spark)
    own = tokenised.select("tokens").mapInArrow(lambda batches: counting.hashed(batches, n), "part int, h bigint, n bigint")
    own = own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").select("h", "n")
    parts = own.mapInArrow(lambda batches: counting.bits(batches, least), "part int, bits binary").collect()
    through = spark.sparkContext.broadcast(counting.let_through([(r.part, r.bits) for r in parts]))
    out = written(counts(tokenised, n, through).where(F.col("n") >= least), "frequent")
    through.unpersist()
    return out


def pmi(tokenised: DataFrame, n: int, least: int, floor: float | None = 3.0) -> DataFrame:
    """N-grams of ``least`` occurrences with their mutual information and network score; words count in messages of
    n words at least.

    Only n-grams that occur often enough meet the words' counts, one row of each for its n words."""
    eligible = tokenised.where(F.size("tokens") >= n)
    importable(tokenised.sparkSession)
    vocabulary = written(eligible.select("tokens").mapInArrow(counting.words, "w string, c bigint").groupBy("w").agg(F.sum("c").alias("c")), "words")
    total = F.broadcast(vocabulary.agg(F.sum("c").cast("double").alias("total")))
    often = frequent(eligible, n, least)
    parts = often.select("phrase", F.explode(F.split("phrase", " ")).alias("w"))
    logs = parts.join(vocabulary, "w").groupBy("phrase").agg(F.sum(F.log2(F.col("c").cast("double"))).alias("logs"))
    value = F.log2(F.col("n").cast("double")) + (n - 1) * F.log2("total") - F.col("logs")
    out = often.join(logs, "phrase").crossJoin(total).withColumn("pmi", F.round(value, 6))
    if floor is not None:
        out = out.where(F.col("pmi") >= floor)
    return out.select("phrase", "n", "messages", "first_at", "last_at", "pmi", F.round(F.col("pmi") * F.col("n"), 6).alias("network_score"))


def table(messages: DataFrame, n: int, least: int, floor: float | None = 3.0, entity_terms: DataFrame | None = None) -> DataFrame:
    """``pmi`` ranked, with the words one by one, the first message that has the phrase (least id on ties) and its
    shortened text, and whether a word of it is in ``entity_terms`` (``term``)."""
    tokenised = tokens(messages)
    scored = pmi(tokenised, n, least, floor)
    uses = tokenised.select("message_id", "timestamp", F.explode(F.array_distinct(ngrams(F.col("tokens"), n))).alias("phrase")).join(scored.select("phrase"), "phrase", "left_semi")
    first = uses.groupBy("phrase").agg(F.min(F.struct("timestamp", "message_id")).alias("e")).select("phrase", F.col("e.message_id").alias("message_id"))
    shown = first.join(messages.select("message_id", shorten(F.col("text"), 160).alias("example")), "message_id").select("phrase", F.col("message_id").alias("example_id"), "example")
    flagged = scored.select("phrase", F.explode(F.split("phrase", " ")).alias("term"))
    known = entity_terms.select("term").distinct() if entity_terms is not None else flagged.select("term").limit(0)
    hits = flagged.join(known, "term", "left_semi").select("phrase").distinct().withColumn("entity_term", F.lit(True))
    place = F.row_number().over(Window.orderBy(F.desc("pmi"), F.desc("n"), F.desc("messages"), "phrase")).cast("bigint")
    out = scored.join(shown, "phrase").join(hits, "phrase", "left").withColumn("rank", place)  # phrases are few: those over both thresholds
    return out.select("rank", "phrase", "n", "messages", "first_at", "last_at", "pmi", "network_score", "example_id", "example", F.coalesce("entity_term", F.lit(False)).alias("entity_term"))


def halves(tokenised: DataFrame) -> DataFrame:
    """Adds ``half``: 1 up to the median time, 2 after it."""
    micros = F.percentile(F.unix_micros(F.col("timestamp").cast("timestamp")), F.lit(0.5)).cast("bigint")
    middle = F.broadcast(tokenised.agg(micros.alias("middle")))
    return tokenised.crossJoin(middle).withColumn("half", F.when(F.unix_micros(F.col("timestamp").cast("timestamp")) <= F.col("middle"), 1).otherwise(2)).drop("middle")


def half_shift(messages: DataFrame, least: int = 3, top: int = 50) -> DataFrame:
    """The top pairs of both halves, each with its own counts, and whether they stayed, went or came."""
    split = halves(tokens(messages))
    order = [F.desc("pmi"), F.desc("n"), F.desc("messages"), F.col("phrase")]
    one, two = (pmi(split.where(F.col("half") == h), 2, least, None).orderBy(*order).limit(top).select("phrase", F.col("n").alias(f"n_{h}"), F.col("pmi").alias(f"pmi_{h}")) for h in (1, 2))
    status = F.when(F.col("n_1").isNull(), "new").when(F.col("n_2").isNull(), "dropped").otherwise("retained")
    return one.join(two, "phrase", "full_outer").select("phrase", "n_1", "pmi_1", "n_2", "pmi_2", status.alias("status"))


def edges(messages: DataFrame, least: int = 5, floor: float = 3.0, top: int = 40) -> DataFrame:
    """The strongest pairs as edges from first to second word."""
    best = pmi(tokens(messages), 2, least, floor).orderBy(F.desc("network_score"), "phrase").limit(top)
    parts = F.split("phrase", " ")
    return best.select(parts[0].alias("src"), parts[1].alias("dst"), "n", "pmi", F.col("network_score").alias("weight"))


def nodes(edges_: DataFrame) -> DataFrame:
    """In- and out-degree and weight of each word of the network."""
    ends = edges_.select(F.explode(F.array(F.struct(F.col("src").alias("word"), F.lit(1).alias("o"), F.col("weight").alias("ow"), F.lit(0).alias("i"), F.lit(0.0).alias("iw")), F.struct(F.col("dst").alias("word"), F.lit(0).alias("o"), F.lit(0.0).alias("ow"), F.lit(1).alias("i"), F.col("weight").alias("iw")))).alias("e"))
    return ends.groupBy("e.word").agg(F.sum("e.o").alias("out_degree"), F.round(F.sum("e.ow"), 6).alias("out_weight"), F.sum("e.i").alias("in_degree"), F.round(F.sum("e.iw"), 6).alias("in_weight"))


def summary(messages: DataFrame, least: int = 5, floor: float = 3.0, least_three: int = 3) -> DataFrame:
    """One row: messages, tokens, distinct tokens, and how many pairs and triples pass."""
    own = tokens(messages)
    base = own.agg(F.count("*").alias("messages"), F.sum(F.size("tokens").cast("bigint")).alias("tokens"))
    distinct = own.select(F.explode("tokens").alias("w")).agg(F.countDistinct("w").alias("unique_tokens"))
    two = pmi(own, 2, least, floor).agg(F.count("*").alias("pairs"))
    three = pmi(own, 3, least_three, floor).agg(F.count("*").alias("triples"))
    return base.crossJoin(F.broadcast(distinct)).crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three))


def scaled(df: DataFrame, column: str, low: float, high: float, name: str = "size") -> DataFrame:
    """Adds ``name``: the column between ``low`` and ``high`` by its least and greatest value, their middle where it
    has one value only."""
    bounds = F.broadcast(df.agg(F.min(column).cast("double").alias("__low"), F.max(column).cast("double").alias("__high")))
    span = F.col("__high") - F.col("__low")
    size = F.when(F.abs(span) <= 1e-9 * F.greatest(F.abs("__low"), F.abs("__high")), (low + high) / 2).otherwise(low + (F.col(column) - F.col("__low")) / span * (high - low))
    return df.crossJoin(bounds).withColumn(name, F.round(size, 6)).drop("__low", "__high")


def communities(edges_: DataFrame, top: int = 40) -> DataFrame:
    """``word, community`` of the strongest ``top`` pairs by modularity; so many edges are one task's work at any size."""
    from murmurlake.operators.entities import communities as of

    best = edges_.orderBy(F.desc("weight"), "src", "dst").limit(top)
    pairs = best.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("n").alias("weight"))
    return of(pairs).withColumnRenamed("entity", "word")
