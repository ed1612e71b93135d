"""Token counts, packing and decontamination against brute force, and their edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from murmurlake.llm import decontamination, packing, token_counts
from murmurlake.llm.common import Words, string_buffers

SCHEMA = "doc_id bigint, text string, lang string, n_tokens bigint, pack bigint"
TRICKY = ["", " ", "  ", "a", "a  b", "a \nb", "x\n \ny", "a   b\n\n c \n", "don't  we'll 'S", "\tx y　z  ", "naïve café — ß ü", "日本語のテキスト 123 abc\n\n\n", "!!!??? ... (x)", "x" * 3000, "ab" * 2000 + " end", "a​ b", "\r\n \r\n q", "1 22 333 4444"]


def encoding():
    return tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.load_ranks(token_counts.RANKS_PATH), special_tokens={})


def test_token_counts_equal_a_tokenizer(spark):
    rng = random.Random(1)
    texts = TRICKY + ["".join(rng.choice("ab éß \n\t  .,'12日") for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(i, t, "en", 5, 6) for i, t in enumerate(texts)] + [(None, None, None, None, None), (3, "same", "x", 1, 1), (3, "same", "x", 1, 1)]
    got = token_counts.token_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    own = encoding()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(r[0]), len(own.encode_ordinary(r[1] or ""))) for r in rows)
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_token_counts_forget_and_go_on(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_PIECES", 3)
    monkeypatch.setattr(token_counts, "MEMO_SEGMENTS", 2)
    own, counter = encoding(), token_counts.Segments(token_counts.load_ranks(token_counts.RANKS_PATH))
    text = "the quick brown fox jumps over the lazy dog again and again"
    assert counter.count(text, False) == len(own.encode_ordinary(text))
    assert len(counter) <= 2


def greedy(tokens, capacity):
    sequences = [[0, 0.0] for _ in range(max(1, -(-sum(tokens) // capacity)))] if tokens else []
    out = []
    for n in tokens:
        best = None
        for k, (used, cost) in enumerate(sequences):
            if used + n <= capacity and (best is None or cost < sequences[best][1]):
                best = k
        if best is None:
            sequences.append([0, 0.0])
            best = len(sequences) - 1
        sequences[best][0] += n
        sequences[best][1] += packing.LINEAR * n + packing.QUADRATIC * n * n
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_assign_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    tokens = np.sort(rng.integers(1, 60, rng.integers(0, 200)))[::-1]
    assert packing.assign(tokens, 64).tolist() == greedy(tokens.tolist(), 64)


def test_pack_covers_every_token_once(spark):
    rows = [(i, "w" * (i * 37 % 900), "en", 1, 2) for i in range(120)] + [(None, "abcd" * 10, None, None, None), (7, None, "x", 1, 1), (8, "", "x", 1, 1), (5, "same text", "x", 1, 1), (5, "same text", "x", 1, 1), (999, "y" * 5000, "x", 1, 1)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), capacity=100, group_rows=40).collect()
    want, own = {}, encoding()
    for doc, text, *_ in rows:
        want[doc] = want.get(doc, 0) + len(own.encode_ordinary(text or ""))
    have, room = {}, {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.n_tokens
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.n_tokens
    assert have == {k: v for k, v in want.items() if v}
    assert max(room.values()) <= 100
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_leaks(docs, items, k):
    out = set()
    for d, text in docs:
        a = (text or "").split()
        for b, item in items:
            c = (item or "").split()
            best = None
            for i in range(len(a)):
                for j in range(len(c)):
                    n = 0
                    while i + n < len(a) and j + n < len(c) and a[i + n] == c[j + n]:
                        n += 1
                    if n >= k and (best is None or n > best[0]):
                        best = (n, i, j)
            if best:
                out.add((d, b, *best))
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_leaks_equal_brute_force(spark, k):
    rng = random.Random(k)
    words = lambda n: " ".join(rng.choice("a b c dd eé".split()) for _ in range(n))
    items = [(i, words(rng.randrange(12))) for i in range(8)] + [(100, None), (None, "a b c dd a b c dd")]
    docs = [(i, words(rng.randrange(40))) for i in range(60)] + [(200, None), (201, ""), (202, "q " * 500 + "a b c dd")]
    df = spark.createDataFrame([(*d, "x", 1, 1) for d in docs], SCHEMA)
    bench = spark.createDataFrame([(*b, "x") for b in items], "item_id bigint, text string, doc_id string")
    got = {tuple(r) for r in decontamination.leaks(df, bench, min_words=k).collect()}
    assert got == brute_leaks(docs, items, k)
    kept = {r.doc_id for r in decontamination.decontaminate(df, bench, min_words=k).collect()}
    assert kept == {d for d, _ in docs} - {g[0] for g in got}
    if k == 2:
        assert decontamination.leaks(df.limit(0), bench).collect() == [] and decontamination.leaks(df, bench.limit(0)).collect() == []
        twice = decontamination.leaks(df.unionAll(df), bench, min_words=k).collect()
        assert len(twice) == 2 * len(got)


def test_leaks_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SLICE_BYTES", 60)
    items = [(i, f"one two three four five six seven eight {i}") for i in range(9)]
    df = spark.createDataFrame([(i, f"say {t} end") for i, t in items], "doc_id bigint, text string")
    got = decontamination.leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id, r.match_words) for r in got} == {(a, b, 9 if a == b else 8) for a in range(9) for b in range(9)}
    assert decontamination.decontaminate(df, spark.createDataFrame(items, "item_id bigint, text string")).collect() == []


@pytest.mark.parametrize("depth", [2, 3])
def test_suffix_array_is_sorted(depth):
    rng = np.random.default_rng(depth)
    rows = [rng.integers(1, 4, n).tolist() for n in (0, 1, 30, 30, 200)] + [[1, 2] * 40] * 3
    text = pa.array([" ".join(map(str, r)) for r in rows])
    words = Words(*string_buffers(text))
    _, symbols = np.unique(words.hash, return_inverse=True)
    symbols = symbols + 1
    end = words.first[1:][words.doc]
    order, _ = decontamination.suffix_array(symbols, end, depth)
    suffixes = [symbols[i : end[i]].tolist() for i in order]
    assert sorted(order.tolist()) == list(range(len(symbols))) and suffixes == sorted(suffixes)
