"""Repetition coverage against a plain count, against its SQL, and its edge cases."""

import random

import duckdb
import pytest

from murmurlake.llm import quality_rules

SCHEMA = "doc_id bigint, text string, keep string, n_words bigint, lang string"


def plain(text):
    """Shares of characters in repeated n-grams (all occurrences but the first) and in repeated lines."""
    words = (text or "").split()
    total = sum(map(len, words))
    out = {}
    for n in quality_rules.NGRAM_LIMITS:
        seen, hit = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i : i + n])
            if gram in seen:
                hit |= set(range(i, i + n))
            seen.add(gram)
        out[n] = sum(len(words[i]) for i in hit) / total if total else 0.0
    lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
    chars, seen, again = sum(map(len, lines)), set(), 0
    for x in lines:
        again += len(x) if x in seen else 0
        seen.add(x)
    return len(words), out, again / chars if chars else 0.0


def texts():
    rng = random.Random(9)
    words = [rng.choice(["ab", "cé", "d", "efg"]) + str(rng.randrange(6)) for _ in range(40)]
    made = [" ".join(rng.choice(words[: rng.choice([3, 10, 40])]) + rng.choice(["", "", "\n", "\n\n "]) for _ in range(rng.randrange(120))) for _ in range(80)]
    return [*made, "", None, " \n\t", "one", "same line\nsame line\nsame line", "x " * 40000, "a b c d e f g h i j\n" * 500, "  lead\n\ttrail \nlead"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 3, "en") for i, t in rows], SCHEMA)


def test_measures_equal_a_plain_count(spark):
    rows = list(enumerate(texts()))
    for r in quality_rules.repetition_coverage(frame(spark, rows)).collect():
        n, grams, lines = plain(dict(rows)[r.doc_id])
        assert r.n_words == n and r.dup_line_char_share == pytest.approx(lines)
        assert {k: r[f"dup_{k}gram_share"] for k in grams} == pytest.approx(grams)
        assert r.keep == (n > 0 and lines <= quality_rules.LINE_CHARS_LIMIT and all(grams[k] <= v for k, v in quality_rules.NGRAM_LIMITS.items()))


def test_equals_sql(spark):
    rows = list(enumerate(texts()))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(quality_rules.sql())
    names = [d[0] for d in want.description]
    clean = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    got = quality_rules.repetition_coverage(frame(spark, rows)).select(*names).collect()
    assert sorted(map(clean, got)) == sorted(map(clean, want.fetchall()))


def test_filter_and_edges(spark):
    rows = [(1, "fine words that differ all along here"), (1, "fine words that differ all along here"), (None, "other fine words"), (2, None), (3, ""), (4, "again and again " * 30)]
    df = frame(spark, rows)
    kept = quality_rules.quality_filter(df)
    assert kept.schema == df.schema and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]
    assert quality_rules.repetition_coverage(df).count() == 6
    assert quality_rules.quality_filter(df.limit(0)).collect() == [] and quality_rules.repetition_coverage(df.limit(0)).collect() == []
