"""Message model, cadence, replies, threads and time grids on hand-made messages."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from murmurlake.functions import timegrid
from murmurlake.operators import cadence, lexical, replies, scores, threads
from murmurlake.sources import messages as model

SHORT = "channel_id bigint, message_id bigint, timestamp timestamp_ntz, text string, has_media boolean, reply_to_message_id bigint"
DAY = datetime(2026, 1, 5)  # a Monday


def frame(spark, rows):
    return spark.createDataFrame(rows, SHORT)


@pytest.fixture(scope="module")
def five(spark):
    at = lambda d, h, m: DAY + timedelta(days=d, hours=h, minutes=m)
    return frame(spark, [(1, 1, at(0, 0, 5), "short", False, None), (1, 2, at(0, 0, 35), "a much longer text", True, 1), (1, 3, at(0, 2, 15), None, True, None), (1, 4, at(1, 13, 0), None, True, 99), (1, 5, at(1, 13, 25), "text", False, 2)]).cache()


def test_hourly_grid_has_no_gaps(five):
    rows = {r.hour: r for r in cadence.hourly(five).collect()}
    assert len(rows) == 38
    assert (rows[DAY].messages, rows[DAY].media, rows[DAY].media_share) == (2, 1, 50.0)
    gap = rows[DAY + timedelta(hours=1)]
    assert (gap.messages, gap.media, gap.media_share) == (0, 0, None)
    assert sum(r.messages for r in rows.values()) == 5


def test_daily_peaks_and_spikes(five):
    first = min(cadence.daily(five).collect(), key=lambda r: r.day)
    assert (first.messages, first.media, first.peak_hour, first.peak_messages) == (3, 2, 0, 2)
    spike = min(cadence.spike_messages(five).collect(), key=lambda r: r.rank)
    assert (spike.hour, spike.message_id) == (DAY, 2)
    assert {(r.weekday, r.hour): r.mean_messages for r in cadence.weekday_hour(five).collect()}[0, 0] == 2.0
    assert {r.weekday: r.days for r in cadence.weekday_observed(five).collect()} == {0: 1, 1: 1}
    (s,) = cadence.summary(five).collect()
    assert (s.messages, s.days, s.mean_a_day, s.media_share, s.busiest_day, s.peak_hour) == (5, 2, 2.5, 60.0, DAY.date(), 0)
    assert len(cadence.calendar(five).columns) == 25 and cadence.smoothed_media_share(five).count() == 38


def test_empty_messages_give_empty_results(spark):
    none = frame(spark, [])
    for f in (cadence.hourly, cadence.daily, cadence.weekday_hour, cadence.top_spikes, cadence.calendar, replies.edges, replies.counts, replies.distribution, threads.depths, threads.summaries, lexical.period_documents, lexical.period_tfidf):
        assert f(none).collect() == [], f
    assert cadence.summary(none).first().messages is None


def test_replies(five):
    edges = {r.message_id: r for r in replies.edges(five).collect()}
    assert (edges[2].minutes, edges[4].parent_present, edges[4].minutes) == (30.0, False, None)
    assert {r.message_id: r.replies for r in replies.counts(five).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    assert {r.parent_id for r in replies.missing_parents(five).collect()} == {99}
    assert sum(r.share for r in replies.distribution(five).collect()) == pytest.approx(100)
    (s,) = replies.summary(five).collect()
    assert (s.messages, s.replies, s.replied_to, s.parent_present) == (5, 3, 2, 2)


def test_reply_hints(spark):
    df = spark.createDataFrame([("fixed a typo", False, 0.9, 0.5), ("x", True, 0.9, 0.5), ("x", False, 0.8, 0.0), ("x", False, 0.2, 0.9), ("x", False, 0.5, 0.1), ("x", False, 0.5, 0.0)], "t string, m boolean, s double, l double")
    got = [r[0] for r in df.select(replies.hint(F.col("t"), F.col("m"), F.col("s"), F.col("l"))).collect()]
    assert got == ["correction", "media supplement", "continuation", "related", "continuation", "related"]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), (None, [1.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] and round(r[0], 4) for r in v.select(replies.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, None, None, None, None]


def test_threads(spark):
    link = lambda c, i, p: (c, i, DAY + timedelta(minutes=i), "", False, p)
    chain = [link(1, i, i - 1 if i > 1 else None) for i in range(1, 40)]
    rows = chain + [link(2, 1, None), link(2, 5, 1), link(1, 100, 999), link(1, 101, 100), link(3, 1, 3), link(3, 2, 1), link(3, 3, 2), link(3, 4, 3), link(4, 7, 7)]
    got = {(r.channel_id, r.message_id): (r.root_id, r.depth, r.external_root) for r in threads.depths(frame(spark, rows)).collect()}
    assert all(got[1, i] == (1, i - 1, False) for i in range(1, 40))
    assert got[2, 5] == (1, 1, False)  # the same ids in another channel are other messages
    assert got[1, 101] == (999, 2, True) and got[1, 100] == (999, 1, True)
    assert all(got[3, i][:2] == (1, None) for i in (1, 2, 3, 4)) and got[4, 7][:2] == (7, None)
    s = {(r.channel_id, r.root_id): r for r in threads.summaries(frame(spark, rows)).collect()}
    assert (s[1, 1].messages, s[1, 1].depth, s[1, 1].top_replied_id) == (39, 38, 1) and s[1, 999].external_root


def test_periods_and_labels(spark):
    times = [(DAY + timedelta(days=d),) for d in (0, 25, 26, 50, 51, 99, 100)]
    df = spark.createDataFrame(times, "t timestamp_ntz")
    lo, hi = F.lit(times[0][0]), F.lit(times[-1][0])
    assert [r[0] for r in df.select(timegrid.period_index(F.col("t"), lo, hi, 4)).collect()] == [1, 1, 2, 2, 3, 4, 4]
    assert [r[0] for r in df.select(timegrid.period_index(F.col("t"), lo, lo, 4)).limit(1).collect()] == [1]
    label = lambda a, b: spark.range(1).select(timegrid.period_label(F.lit(a), F.lit(b))).first()[0]
    assert label(datetime(2025, 12, 17), datetime(2026, 1, 17)) == "2025-12-17–2026-01-17"
    assert label(datetime(2026, 1, 17), datetime(2026, 2, 16)) == "Jan 17–Feb 16"
    m = spark.createDataFrame([(12.0,), (210.0,), (2880.0,)], "m double")
    assert [r[0] for r in m.select(timegrid.gap_label(F.col("m"))).collect()] == ["12m", "3.5h", "2.0d"]


def test_window_series_keeps_gaps_null(spark):
    rows = [(1, DAY, 1.0), (2, DAY + timedelta(hours=1), 0.0), (3, DAY + timedelta(hours=13), -1.0)]
    got = sorted(scores.windows(spark.createDataFrame(rows, "message_id bigint, timestamp timestamp_ntz, score double")).collect(), key=lambda r: r.start)
    assert [(r.n, r.mean) for r in got] == [(2, 0.5), (0, None), (1, -1.0), (0, None)]
    assert got[2].rolling_mean == -0.25 and got[2].sd == 0.0


def test_frames(spark):
    rows = [(1, 0.76, 0.1, 0.05), (2, 0.2, 0.72, 0.05), (3, 0.24, 0.24, 0.1), (4, 0.1, 0.79, 0.79)]
    df = spark.createDataFrame(rows, "message_id bigint, fear double, authority double, triumph double")
    got = {r.message_id: r for r in df.withColumns(scores.best_two({c: F.col(c) for c in ("fear", "authority", "triumph")})).collect()}
    assert [got[i].frame for i in (1, 2, 3, 4)] == ["fear", "authority", "mixed", "authority"]
    assert got[4].second_frame == "triumph" and got[4].confidence_gap == 0.0


def test_normalised_messages(spark):
    rows = [(7, 1, DAY, None, None, " ", [("photo", "a.jpg", None, None)], 5, '{"fwd_from": {"from_id": {"channel_id": 777}}}'), (7, 2, DAY, 1, "n", "hello", None, None, None)]
    schema = "chat_id bigint, message_id bigint, posted_at timestamp_ntz, sender_id bigint, sender_name string, text string, media_files array<struct<media_type:string,relative_path:string,mime_type:string,file_name:string>>, reply_to_message_id bigint, raw_json string"
    out = model.with_media_flags(model.normalised(spark.createDataFrame(rows, schema))).orderBy("message_id").collect()
    assert (out[0].text, out[0].forwarded_from, out[0].media_refs[0].storage_path, out[0].is_media_only) == (None, 777, "a.jpg", True)
    assert (out[1].forwarded_from, out[1].has_media) == (None, False)
    t = spark.createDataFrame([("a", ""), ("a", " b "), ("a", "  "), (None, None)], "text string, english_text string")
    assert [tuple(r) for r in t.select(model.preferred_text(), model.used_translation()).collect()] == [("a", False), ("b", True), ("", False), ("", False)]
