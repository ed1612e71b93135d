"""Pairs and words counted in Arrow batches, and what moves for it."""

from collections import defaultdict
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from murmurlake.functions import counting
from murmurlake.functions import louvain as modularity
from murmurlake.operators import entities

AT = datetime(2026, 1, 1)


def mentions(spark, rows):
    return spark.createDataFrame([(m, AT + timedelta(hours=h), e) for m, h, e in rows], "message_id bigint, timestamp timestamp_ntz, entity string")


@pytest.mark.parametrize("chunk", [3, 1 << 22])
def test_pairs_are_those_of_plain_code(spark, monkeypatch, chunk):
    monkeypatch.setattr(counting, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    rows = [(m, (m * 7) % 40, f"e{int(e):02d}") for m in range(60) for e in rng.zipf(1.4, 12) % 25]
    in_messages, when, seen = defaultdict(set), {}, defaultdict(set)
    for m, h, e in rows:
        in_messages[m].add(e)
        when[m] = AT + timedelta(hours=h)
        seen[e].add(m)
    want = defaultdict(list)
    for m, es in in_messages.items():
        for a, b in combinations(sorted(e for e in es if len(seen[e]) >= 3), 2):
            want[a, b].append(when[m])
    got = {(r.a, r.b): (r.weight, r.first_at, r.last_at) for r in entities.pairs(mentions(spark, rows)).collect()}
    assert got == {p: (len(t), min(t), max(t)) for p, t in want.items()}
    assert {(r.a, r.b): r.weight for r in entities.edges(mentions(spark, rows)).collect()} == {p: len(t) for p, t in want.items() if len(t) >= 2}


def batches(rows, times):
    columns = {"x": pa.array([r[0] for r in rows], pa.int32()), "ys": pa.array([r[1] for r in rows], pa.list_(pa.int32())), "timestamp": pa.array([r[2] for r in rows], pa.timestamp("us"))}
    whole = pa.RecordBatch.from_pydict(columns if times else {k: v for k, v in columns.items() if k != "timestamp"})
    return (whole.slice(k, 4) for k in range(0, len(rows), 4))


@pytest.mark.parametrize("times", [True, False])
@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
def test_a_number_of_any_many_rows_is_counted_in_bounded_chunks(monkeypatch, chunk, times):
    monkeypatch.setattr(counting, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    rows = [(x, [int(y) for y in rng.integers(0, 6, rng.integers(0, 9))], 100 * x + k) for x in (0, 4, 9) for k in range(30)]
    want = defaultdict(list)
    for x, ys, t in rows:
        for y in ys:
            want[min(x, y), max(x, y), x].append(t)
    got = [row for b in counting.met(batches(rows, times), times) for row in zip(*(c.cast(pa.int64()).to_pylist() for c in b.columns))]
    assert sorted(got) == sorted((a, b, len(t), *((min(t), max(t)) if times else ())) for (a, b, _), t in want.items())
    assert list(counting.met(iter(()), times)) == []


def test_pairs_do_not_move_as_rows(spark):
    rows = [(m, m, f"e{e:02d}") for m in range(3) for e in range(20)]
    plan = entities.pairs(mentions(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(x" in plan and "hashpartitioning(a" not in plan


def plain_louvain(a, b, weight):
    """As it was before links lay on disk."""
    names = sorted({*a, *b})
    place = {n: i for i, n in enumerate(names)}
    graph = {i: defaultdict(float) for i in range(len(names))}
    for x, y, w in zip(a, b, weight):
        graph[place[x]][place[y]] += w
        graph[place[y]][place[x]] += w
    total = sum(weight) * 2 or 1.0
    own = list(range(len(names)))
    while True:
        degree = {i: sum(nb.values()) for i, nb in graph.items()}
        at, mass, moved, ever = {i: i for i in graph}, dict(degree), True, False
        while moved:
            moved = False
            for i in graph:
                links = defaultdict(float)
                for j, w in graph[i].items():
                    if j != i:
                        links[at[j]] += w
                mass[at[i]] -= degree[i]
                best, gain = at[i], links.get(at[i], 0.0) - mass[at[i]] * degree[i] / total
                for c in sorted(links):
                    g = links[c] - mass[c] * degree[i] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                mass[best] += degree[i]
                if best != at[i]:
                    at[i], moved, ever = best, True, True
        if not ever:
            break
        own = [at[c] for c in own]
        joined = {c: defaultdict(float) for c in sorted(set(at.values()))}
        for i, nb in graph.items():
            for j, w in nb.items():
                joined[at[i]][at[j]] += w
        graph = joined
    members = defaultdict(list)
    for n, c in zip(names, own):
        members[c].append(n)
    return {n: k for k, m in enumerate(sorted(members.values(), key=lambda m: (-len(m), m[0]))) for n in m}


@pytest.mark.parametrize("held", [1, 1 << 22])
def test_communities_are_those_of_the_graph_in_memory(monkeypatch, held):
    monkeypatch.setattr(modularity, "HELD", held)
    for seed in range(40):
        rng = np.random.default_rng(seed)
        nodes, links = int(rng.integers(2, 90)), int(rng.integers(1, 400))
        ends = {(min(x, y), max(x, y)) for x, y in rng.integers(0, nodes, (links, 2)).tolist() if x != y}
        a, b = [f"n{x:03d}" for x, _ in ends], [f"n{y:03d}" for _, y in ends]
        weight = [float(1 + int(rng.integers(0, 3)) + 20 * (x % 5 == y % 5)) if seed % 3 else 2.0 for x, y in ends]
        assert entities.louvain(a, b, weight) == plain_louvain(a, b, weight)


def test_communities_hold_nodes_not_links(spark):
    rng = np.random.default_rng(1)
    rows = sorted({(f"n{min(x, y):03d}", f"n{max(x, y):03d}", 2 + int(x % 4 == y % 4) * 9) for x, y in rng.integers(0, 120, (1500, 2)).tolist() if x != y})
    found = entities.communities(spark.createDataFrame(rows, "a string, b string, weight bigint"))
    assert {r.entity: r.community for r in found.collect()} == plain_louvain(*zip(*rows))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan


TEXTS = ["See https://x.y/z's now, WWW.no www.yes.org/a @you_1 and #Big_Deal re-signed", "the US-backed plan’s 'end' ''quoted'' -dash- --two-- it's", "Kelvin İstanbul café naïve 日本 words", "rule at end --- ---\n", "rule---\u0085", "a b\x0bcd\x0cefg\thij\r\nklm", "", " ", None, "#only", "foo_bar/baz x-ray don't", "word " * 50, "@@at ##tag https://", "emoji 😀 between😀words"]


@pytest.mark.parametrize("kind", ["phrase", "lexical"])
def test_words_are_those_of_the_expressions(spark, monkeypatch, kind):
    from pyspark.sql import functions as F

    from murmurlake.functions import text, words

    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "message_id bigint, text string")
    of = {"phrase": text.phrase_tokens, "lexical": text.lexical_tokens}[kind]
    want = {r.message_id: r.t for r in df.select("message_id", of(F.coalesce("text", F.lit(""))).alias("t")).collect() if r.t}
    assert {r.message_id: r.tokens for r in words.tokens(df, ["message_id"], kind).collect()} == want
    assert {r.message_id: r.n_tokens for r in words.tokens(df, ["message_id"], kind, sizes=True).collect()} == {k: len(t) for k, t in want.items()}
    raw = pa.array([(t or "").encode() for t in TEXTS])
    assert words.split(raw[:0], kind, text.STOP_WORDS, 3)[0].tolist() == []


def messages_of_words(rng, many=60):
    tokens = [[f"w{int(w)}" for w in rng.zipf(1.5, int(rng.integers(0, 12))) % 9] for _ in range(many)]
    times = [None if k % 17 == 3 else 1000 * int(rng.integers(0, 50)) for k in range(many)]
    whole = pa.RecordBatch.from_pydict({"tokens": pa.array(tokens, pa.list_(pa.string())), "timestamp": pa.array(times, pa.timestamp("us"))})
    return tokens, times, lambda: (whole.slice(k, 7) for k in range(0, many, 7))


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("chunk", [1, 20, 1 << 22])
def test_rare_ngrams_do_not_move_and_frequent_ones_are_whole(monkeypatch, n, chunk):
    monkeypatch.setattr(counting, "CHUNK", chunk)
    tokens, times, whole = messages_of_words(np.random.default_rng(3))
    want = defaultdict(list)
    for k, (t, at) in enumerate(zip(tokens, times)):
        for i in range(len(t) - n + 1):
            want[" ".join(t[i : i + n])].append((k, at))

    def told(batches):
        out = defaultdict(list)
        for b in batches:
            for phrase, many, messages, first, last in zip(*(c.to_pylist() if i == 0 else c.cast(pa.int64()).to_pylist() for i, c in enumerate(b.columns))):
                out[phrase].append((many, many if messages is None else messages, first, first if last is None else last))
        known = lambda x: [v for v in x if v is not None]
        return {p: (sum(r[0] for r in rows), sum(r[1] for r in rows), min(known(r[2] for r in rows), default=None), max(known(r[3] for r in rows), default=None)) for p, rows in out.items()}

    plain = {p: (len(r), len({k for k, _ in r}), min((t for _, t in r if t is not None), default=None), max((t for _, t in r if t is not None), default=None)) for p, r in want.items()}
    assert told(counting.counted(whole(), n)) == plain
    least = 3
    through = counting.let_through([(b["part"][0].as_py(), b["bits"][0].as_py()) for b in counting.bits(counting.hashed(whole(), n), least)])
    assert told(counting.counted(whole(), n, through)) == {p: v for p, v in plain.items() if v[0] >= least}
    assert any(v[0] < least for v in plain.values()) or n == 1
    topics = (pa.RecordBatch.from_arrays([b["tokens"], pa.array([None if i % 3 == 2 else f"t{i % 3}" for i in range(len(b))], pa.string())], ["tokens", "topic"]) for b in whole())
    found, terms = defaultdict(int), defaultdict(int)
    for b in counting.grouped(topics, n):
        for topic, term, many in zip(*(c.to_pylist() for c in b.columns)):
            found[topic, term] += many
    for k, t in enumerate(tokens):
        for size in range(1, n + 1):
            for i in range(len(t) - size + 1):
                terms[None if k % 7 % 3 == 2 else f"t{k % 7 % 3}", " ".join(t[i : i + size])] += 1
    assert found == terms


def test_phrases_are_counted_in_batches(spark, tmp_path):
    from murmurlake.operators import phrases

    df = spark.createDataFrame([(k, AT, "alpha beta gamma delta") for k in range(6)] + [(9, AT, None)], "message_id bigint, timestamp timestamp_ntz, text string")
    plan = phrases.counts(phrases.tokens(df), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and plan.count("Scan parquet") == 1
    assert {(r.phrase, r.n, r.messages) for r in phrases.pmi(phrases.tokens(df), 3, 3, None).collect()} == {("alpha beta gamma", 6, 6), ("beta gamma delta", 6, 6)}


def test_terms_of_topics_that_are_rare_do_not_move(spark):
    from murmurlake.operators import lexical

    rng = np.random.default_rng(4)
    rows = [(k, f"t{k % 2}", " ".join(f"word{chr(97 + int(w))}" for w in rng.zipf(1.4, 30) % 26)) for k in range(40)]
    df = spark.createDataFrame(rows, "message_id bigint, topic string, text string")
    whole = lexical.class_tfidf(df, "topic", features=100_000, k=100_000)
    few = lexical.class_tfidf(df, "topic", features=20, k=100_000)
    totals = defaultdict(int)
    for _, _, t in rows:
        ws = t.split()
        for term in [*ws, *(f"{x} {y}" for x, y in zip(ws, ws[1:]))]:
            totals[term] += 1
    want = sorted(totals, key=lambda t: (-totals[t], t))
    assert {r.term for r in few.collect()} == set(want[:20]) and {r.term for r in whole.collect()} == set(want)
    own = spark.createDataFrame([(t.split(),) for _, _, t in rows], "tokens array<string>")
    hashes, least = lexical._commonest(own, 20)
    assert least == totals[want[19]] and len(hashes) == sum(n >= least for n in totals.values()) < len(totals)
