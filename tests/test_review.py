"""Reply review, order and latency; annotations and entity lists, on rows made by hand."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from murmurlake.operators import annotations, review

START = datetime(2024, 1, 1)
MESSAGES = "channel_id bigint, message_id bigint, timestamp timestamp_ntz, text string, has_media boolean, is_media_only boolean, reply_to_message_id bigint"


def thread(spark):
    """Message 1 and six replies over three hours, two of them at once; a reply to nothing that is known."""
    said = ["harbour storm warning issued", "Correction: harbour reopened", "", "storm damage spreads", "unlike", "harbour", None]
    minutes = [0, 5, 50, 50, 70, 130, 190]
    rows = [(1, k + 1, START + timedelta(minutes=m), t, t == "", t == "", 1 if k else None) for k, (m, t) in enumerate(zip(minutes, said))]
    return spark.createDataFrame([*rows, (1, 20, START, "x", False, False, 99)], MESSAGES)


def test_order_of_replies(spark):
    got = {r.message_id: r.place for r in review.ordered(thread(spark)).collect()}
    assert got == {2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 20: 1}


def test_review_tells_all_hints(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (4, [1.0, 0.1]), (5, [0.0, 1.0]), (7, [0.0, 0.0])], "message_id bigint, embedding array<double>")
    scores = spark.createDataFrame([(1, "neutral"), (4, "negative")], "message_id bigint, sentiment string")
    got = {r.message_id: r for r in review.review(thread(spark), vectors, scores).collect()}
    assert {k: r.hint for k, r in got.items()} == {2: "correction", 3: "media supplement", 4: "continuation", 5: "related", 6: "continuation", 7: "related"}
    assert got[4].similarity == round(1 / 1.01**0.5, 6) and got[6].similarity is None and got[7].similarity is None
    assert got[4].sentiment == "negative" and got[5].sentiment is None and got[5].parent_sentiment == "neutral"
    assert {r.parent_replies for r in got.values()} == {6}
    plain = {r.message_id: r for r in review.review(thread(spark)).collect()}
    assert plain.keys() == got.keys() and plain[4].similarity is None and plain[4].sentiment is None


def test_latency_histogram(spark):
    rows = [(1, k, START, "", False, False, None) for k in range(9)]
    rows += [(1, 100 + k, START + timedelta(minutes=10 * k), "", False, False, k) for k in range(9)]
    got = sorted((r.bin, r.low, r.high, r.parents) for r in review.latency_histogram(spark.createDataFrame(rows, MESSAGES)).collect())
    assert len(got) == 6 and got[0][1] == 0 and got[-1][2] == 80 and sum(r[3] for r in got) == 9 and got[-1][3] == 2
    one = review.latency_histogram(spark.createDataFrame([rows[0], rows[9]], MESSAGES)).collect()
    assert len(one) == 6 and sum(r.parents for r in one) == 1 and min(r.low for r in one) == -0.5
    assert review.latency_histogram(spark.createDataFrame([], MESSAGES)).collect() == []


def test_annotations(spark):
    found = spark.createDataFrame([(2, START, "b"), (1, START + timedelta(hours=3), "a"), (3, START, "c")], "rank int, timestamp timestamp_ntz, label string")
    assert [r.label for r in annotations.events(found, top=2).collect()] == ["a", "b"]
    times = [timedelta(hours=5, minutes=59), timedelta(hours=5), timedelta(hours=1), timedelta(hours=2), timedelta(hours=3)]
    manual = spark.createDataFrame([(START + t, x) for t, x in zip(times, ["z", "y", "first", "  ", None])], "timestamp timestamp_ntz, label string")
    assert [(r.timestamp.hour, r.label) for r in annotations.events(found, manual).collect()] == [(1, "first"), (5, "y")]


def test_entity_lists_and_graph(spark):
    mentions = spark.createDataFrame([(1, "rome", "GPE"), (1, "oslo", "GPE"), (1, "rome", "GPE"), (2, "nato", "ORG")], "message_id bigint, entity string, label string")
    got = {r.message_id: (r.entities, r.n_entities) for r in annotations.attached(spark.range(1, 4).withColumnRenamed("id", "message_id"), mentions).collect()}
    assert got == {1: ("oslo, rome", 2), 2: ("nato", 1), 3: ("", 0)}
    drop = spark.createDataFrame([("oslo",), ("oslo",)], "entity string")
    assert sorted(r.entity for r in annotations.allowed(mentions, drop, ("GPE",)).collect()) == ["rome", "rome"]
    nodes = spark.createDataFrame([("rome", 2, 5, "oslo")], "entity string, degree bigint, weighted_degree bigint, strongest string")
    rows = {r.entity: (r.degree, r.strongest) for r in annotations.with_graph(mentions.select("entity").distinct(), nodes).collect()}
    assert rows == {"rome": (2, "oslo"), "oslo": (0, "—"), "nato": (0, "—")}


def test_spread_and_overview(spark):
    rows = spark.createDataFrame([(True, 1), (True, 1), (True, 4), (False, None), (False, 7)], "has_media boolean, length int")
    got = {r.has_media: tuple(r)[1:] for r in annotations.spread(rows, "has_media", "length").collect()}
    assert got == {True: (3, 1.0, 1.0, 1.0, 2.5, 4.0), False: (1, 7.0, 7.0, 7.0, 7.0, 7.0)}
    scored = rows.select(F.lit(START).cast("timestamp_ntz").alias("timestamp"), F.when(F.col("has_media"), 1.0).otherwise(-1.0).alias("score"), F.when(F.col("length") > 1, "b").otherwise("a").alias("sentiment"))
    one = annotations.score_overview(scored).first()
    assert (one.messages, one.mean_score, one.positive_share, one.dominant) == (5, 0.2, 60.0, "a")
