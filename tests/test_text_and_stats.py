"""Text functions, phrases, entities, scorers and statistics."""

import math
import textwrap
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from murmurlake.functions import scorers, stats, text
from murmurlake.operators import entities, phrases, segments


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t"))).collect()]


def test_shorten_is_like_textwrap(spark):
    cases = ["a b c", "one two three four five six", "x" * 50, "exact fit is here..", "  many   spaces\n and\tlines here  ", "ends with a longwordthatdoesnotfit"]
    for width in (10, 19, 20):
        assert column(spark, cases, lambda c: text.shorten(c, width)) == [textwrap.shorten(c, width, placeholder="...") for c in cases]
    assert column(spark, [None, " "], lambda c: text.shorten(c, 10)) == ["(media-only message)"] * 2


def test_cleaners(spark):
    assert column(spark, ["See https://x.y/z now 😀 ---"], text.for_sentiment) == ["See now"]
    assert column(spark, ["• Hello @you – see www.x.org"], text.for_topics) == ["hello – see"]
    assert column(spark, ["The #BigDeal is re-signed -- by @them, and fast"], lambda c: F.array_join(text.lexical_tokens(c), " ")) == ["bigdeal re-signed fast"]
    assert column(spark, ["The US-backed plan’s 'end' #x"], lambda c: F.array_join(text.phrase_tokens(c), " ")) == ["us backed plan's end"]
    assert column(spark, ["a b c", "a", ""], lambda c: F.concat_ws("|", text.ngrams(F.filter(F.split(c, " "), lambda w: w != ""), 2))) == ["a b|b c", "", ""]
    assert column(spark, ["Crème Brûlée!", "??"], text.slugify) == ["creme-brulee", "item"]
    assert column(spark, ["“U.S.A.”", "united nations,", "Some  Name"], text.normal_entity) == ["United States", "United Nations", "Some Name"]
    assert column(spark, ["plain words", "слова", "日本", "café crème", "123", " ", None], text.probably_english) == [True, False, False, False, True, False, False]
    (clipped,) = column(spark, ["head words " * 5 + "tail words"], lambda c: text.clip_middle(c, 21))
    assert len(clipped) <= 21 and "\n" in clipped


def test_phrases(spark):
    at = datetime(2026, 1, 1)
    texts = ["zionist regime alpha nuclear deal"] * 4 + ["resistance axis beta nuclear deal"] * 4
    df = spark.createDataFrame([(i, at + timedelta(hours=i), t) for i, t in enumerate(texts)], "message_id bigint, timestamp timestamp_ntz, text string")
    found = {r.phrase: r for r in phrases.pmi(phrases.tokens(df), 2, 4, 0.0).collect()}
    assert found["zionist regime"].n == found["resistance axis"].n == 4 and found["nuclear deal"].n == 8
    assert found["zionist regime"].pmi == pytest.approx(math.log2(4 * 40 / 16), abs=1e-6)
    status = {r.phrase: r.status for r in phrases.half_shift(df).collect()}
    assert (status["zionist regime"], status["resistance axis"], status["nuclear deal"]) == ("dropped", "new", "retained")
    (s,) = phrases.summary(df).collect()
    assert (s.messages, s.tokens, s.unique_tokens) == (8, 40, 8)


def test_entities(spark):
    at = datetime(2026, 1, 1)
    df = spark.createDataFrame([(1, at, "Alpha Beta Gamma"), (2, at, "Alpha Beta"), (3, at, "Alpha Beta Delta"), (4, at, None)], "message_id bigint, timestamp timestamp_ntz, text string")
    m = entities.capitalised(df)
    assert {tuple(r) for r in entities.edges(m).collect()} == {("alpha", "beta", 3)}
    assert {r.entity: r.messages for r in entities.summary(m).collect()} == {"alpha": 3, "beta": 3, "gamma": 1, "delta": 1}
    two = entities.louvain(["a", "a", "b", "x", "x", "y", "c"], ["b", "c", "c", "y", "z", "z", "x"], [5, 5, 5, 5, 5, 5, 1])
    assert two["a"] == two["b"] == two["c"] != two["x"] == two["y"] == two["z"]
    e = spark.createDataFrame([("a", "b", 2), ("b", "c", 1)], "a string, b string, weight bigint")
    assert {r.entity: (r.degree, r.weighted_degree, r.strongest) for r in entities.nodes(e).collect()}["b"] == (2, 3, "a, c")
    assert entities.communities(e.limit(0)).collect() == []


def test_mann_whitney(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 4.0]
    df = spark.createDataFrame([(True, x) for x in a] + [(False, x) for x in b] + [(True, None), (None, 1.0)], "g boolean, v double")
    (r,) = stats.mann_whitney(df, "g", "v").collect()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert (r.n1, r.n2, r.u) == (4, 3, u) and r.rank_biserial == pytest.approx(1 - 2 * u / 12)
    assert 1 - 2 * 3000032 / (3053 * 2056) == pytest.approx(0.0441, abs=1e-4)
    assert stats.mann_whitney(df.where("g"), "g", "v").first().z is None
    assert stats.exact_u_tail(0, 3, 3) == pytest.approx(0.1) and stats.two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_chi_square(spark):
    table = {("a", "x"): 2250, ("a", "y"): 30, ("b", "x"): 3634, ("b", "y"): 86}
    df = spark.createDataFrame([(*k, n) for k, n in table.items()], "r string, c string, n int").select("r", "c", F.explode(F.sequence(F.lit(1), "n")))
    (r,) = stats.chi_square(df, "r", "c").collect()
    assert r.chi2 == pytest.approx(6.880894, abs=1e-6) and r.dof == 1
    assert stats.chi_square_tail(r.chi2, 1) == pytest.approx(0.008712, abs=1e-6)
    assert stats.chi_square_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi_square(df.where("r = 'a'"), "r", "c").first().chi2 is None


def test_density_adds_up(spark):
    df = spark.createDataFrame([(True, h) for h in (8, 9, 9, 10, 12, 14)] + [(False, 3)], "g boolean, h int")
    rows = [r for r in stats.hour_density(df, "g", "h").collect()]
    assert len(rows) == 240 and sum(r.density for r in rows) * 23 / 239 == pytest.approx(1, abs=0.02)


def test_segments(spark):
    at = datetime(2026, 1, 1, 5)
    df = spark.createDataFrame([(1, at, True, "x", "p", 1.0, 3), (2, at, False, "yy", None, None, None), (3, at, False, "", "n", -1.0, 3)], "message_id bigint, timestamp timestamp_ntz, has_media boolean, text string, sentiment string, score double, topic bigint")
    assert {r.segment: (r.messages, r.with_topic) for r in segments.summary(df).collect()} == {"media": (1, 1), "text": (2, 1)}
    assert segments.hourly_share(df).count() == 48
    bare = segments.star(df.select("message_id", "timestamp", "has_media", "text"))
    assert {r.value for r in segments.top_value(bare, "topic").collect()} == {""}


def test_scorers(spark):
    df = spark.createDataFrame([(1, "good day"), (2, " "), (3, None)], "id int, text string")
    got = {r.id: r.good for r in scorers.score_texts(df, "text", ("good", "bad"), lambda ts: [{"good": 0.9} for _ in ts]).collect()}
    assert got == {1: 0.9, 2: 0.0, 3: 0.0}
    k = scorers.keyword_scores(F.col("text"), {"g": ("good",), "d": ("day", "night")})
    assert [tuple(r) for r in df.select(k["g"], k["d"]).collect()] == [(0.5, 0.5), (0.0, 0.0), (0.0, 0.0)]
    t = spark.createDataFrame([("hello there", None, None), ("привет", None, None), ("", None, None), ("x", "done", "ru")], "text string, english_text string, source_language string")

    def translator(texts):
        if len(texts) != 1:
            raise OSError("down")
        return ["hi"]

    assert [tuple(r)[1:] for r in scorers.translate(t, translator).collect()] == [("hello there", "en"), ("hi", None), (None, "und"), ("done", "ru")]
