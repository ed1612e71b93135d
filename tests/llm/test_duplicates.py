"""Near-duplicates, components and line dedup against brute force, and their edge cases."""

import random

import numpy as np
import pytest

from murmurlake.llm import line_dedup, near_duplicates
from murmurlake.llm.components import components

SCHEMA = "doc_id bigint, text string, node string, key bigint, line_no bigint, text2 string"
PAD = ("k", 1, 2, "t")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *PAD) for r in rows], SCHEMA)


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    want = union_find(pairs, {x for p in pairs for x in p})
    assert got == {k: v for k, v in want.items() if k != v}
    if not seed:
        assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def near_corpus(rng):
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for g in range(60):
        base = text(rng.randrange(40, 200))
        rows.append(base)
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(max(1, len(copy) // rng.choice([15, 25, 60]))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(copy)
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)}


def test_near_duplicates_recall(spark):
    rows = near_corpus(random.Random(3))
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.55 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.group_id for r in near_duplicates.near_duplicates(frame(spark, rows)).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs) > 50
    loose = union_find([(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.35 * len(sets[a] | sets[b])], sets)
    assert all(loose[d] == loose[g] for d, g in got.items())


def test_near_duplicates_edges(spark):
    rows = [(4, "a b c d e"), (2, "A  b\nc d e"), (None, "a b c d e"), (None, None), (7, None), (8, " \n"), (9, "one"), (10, "one"), (10, "one"), (11, "two"), (12, "x " * 30000), (13, "x " * 30000 + "x")]
    got = sorted((str(r.doc_id), str(r.group_id), r.group_size, r.keep) for r in near_duplicates.near_duplicates(frame(spark, rows)).collect())
    assert got == sorted([("4", "2", 3, False), ("2", "2", 3, True), ("None", "2", 3, False), ("None", "None", 1, True), ("7", "7", 1, True), ("8", "8", 1, True), ("9", "9", 3, True), ("10", "9", 3, False), ("10", "9", 3, False), ("11", "11", 1, True), ("12", "12", 2, True), ("13", "12", 2, False)])
    kept = near_duplicates.drop_near_duplicates(frame(spark, rows + [(2, "A  b\nc d e")]))
    assert kept.columns == frame(spark, []).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "None", "7", "8", "9", "11", "12"])
    assert near_duplicates.near_duplicates(frame(spark, [])).collect() == [] and near_duplicates.drop_near_duplicates(frame(spark, [])).collect() == []


def test_linked_finds_all_that_connect():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 9, (6, 32), dtype=np.uint32)
    rows = np.repeat(base, 8, 0)
    for r in rows:
        r[rng.integers(0, 32, rng.integers(0, 12))] = rng.integers(10, 99)
    want = union_find([(a, b) for a in range(48) for b in range(48) if (rows[a] == rows[b]).sum() >= 20], range(48))
    assert union_find(near_duplicates.linked(rows, 20), range(48)) == want


@pytest.mark.parametrize("edits", [1, 2, 3, 5])
def test_banded_distance(edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(600):
        a = [rng.choice("ab cé") for _ in range(rng.randrange(0, 90))]
        b = list(a)
        for _ in range(rng.randrange(0, edits + 3)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice([[], ["x"], ["a"]])
        pairs.append(sorted(("".join(a), "".join(b)), key=len))
    code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    got = line_dedup.within([code(a) for a, _ in pairs], [code(b) for _, b in pairs], edits)
    assert got.tolist() == [min(edits + 1, line_dedup.plain_distance(code(a), code(b))) for a, b in pairs]


def brute_lines(rows, edits, edit_chars):
    lines = []
    for doc, text in rows:
        for k, x in enumerate((text or "").split("\n")):
            if x.strip(" \t\r\v\f"):
                lines.append(((doc is None, doc if doc is not None else 0, k), doc, x.strip(" \t\r\v\f")))
    lines.sort(key=lambda x: x[0])
    out = []
    for i, (p, doc, x) in enumerate(lines):
        for q, source, y in lines[:i]:
            if q == p and x == y:
                continue
            most = min(edits, min(len(x), len(y)) // edit_chars)
            d = 0 if x == y else line_dedup.plain_distance(x, y) if abs(len(x) - len(y)) <= most else 99
            if q < p and d <= most:
                out.append((doc, p[2], source, q[2], d))
                break
    return out


@pytest.mark.parametrize("seed,edits", [(0, 2), (1, 2), (2, 1), (3, 3)])
def test_repeated_lines_equal_brute_force(spark, seed, edits, monkeypatch):
    monkeypatch.setattr(line_dedup, "LARGE", 6)
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde é") for _ in range(rng.randrange(4, 60))).strip() or "q" for _ in range(25)]

    def line():
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            k = rng.randrange(len(x) + 1)
            x[k : k + rng.randrange(2)] = rng.choice([[], ["z"], ["a"]])
        return " " * rng.randrange(2) + "".join(x)

    rows = [(i, "\n".join(line() if rng.random() > 0.1 else "" for _ in range(rng.randrange(6)))) for i in range(60)]
    rows += [(None, line()), (70, None), (71, ""), (72, base[0]), (72, base[0]), (73, "long " * 60 + "\n" + "long " * 60 + "x")]
    got = sorted(map(str, (tuple(r)[:2] + tuple(r)[3:] for r in line_dedup.repeated_lines(frame(spark, rows), edits=edits, edit_chars=4).collect())))
    assert got == sorted(map(str, brute_lines(rows, edits, 4)))


def test_very_long_lines(spark):
    rows = [(1, "long " * 9000), (2, "long " * 9000 + "xy"), (3, "long " * 9000 + "xyz")]
    got = sorted((r.doc_id, r.source_doc_id, r.distance) for r in line_dedup.repeated_lines(frame(spark, rows)).collect())
    assert got == [(3, 2, 1)]  # the blank at the end of the first isn't part of its line


def test_drop_repeated_lines(spark, monkeypatch):
    one, two = "the first line of some length", "another line of some length"
    rows = [(1, f"{one}\n\n{two}"), (2, f"own words here\n  {one}!"), (3, one), (4, None), (5, " \n"), (None, f"{two}\nnull id")]
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.drop_repeated_lines(frame(spark, rows)).collect())
    assert got == sorted([("1", f"{one}\n\n{two}"), ("2", "own words here"), ("4", None), ("5", " \n"), ("None", "null id")], key=lambda x: (x[0], str(x[1])))
    assert line_dedup.drop_repeated_lines(frame(spark, [])).collect() == [] and line_dedup.repeated_lines(frame(spark, [])).collect() == []
    monkeypatch.setattr(line_dedup, "SENT_BYTES", 0)  # as with more lines than are sent to the workers
    monkeypatch.setattr(line_dedup, "FILTER_BITS", 0)
    assert sorted((str(r.doc_id), r.text) for r in line_dedup.drop_repeated_lines(frame(spark, rows)).collect()) == got


def test_short_lines_allow_an_edit_for_ten_characters(spark):
    rows = [(1, "Share this"), (2, "Share this."), (3, "Share that"), (4, "short"), (5, "shor"), (6, "short"), (7, "nineteen characters"), (8, "nineteen charakters."), (9, "nineteen characters!")]
    got = sorted((r.doc_id, r.source_doc_id, r.distance) for r in line_dedup.repeated_lines(frame(spark, rows)).collect())
    assert got == [(2, 1, 1), (6, 4, 0), (9, 7, 1)]


@pytest.mark.parametrize("sent", [True, False])
def test_rows_of_one_document_and_clashing_columns(spark, monkeypatch, sent):
    if not sent:
        monkeypatch.setattr(line_dedup, "SENT_BYTES", 0)
    one, two = "the first line of some length", "another line of some length"
    names = "doc_id bigint, text string, number string, hashes bigint, row_id string, __id string, __line int"
    rows = [(1, f"{one}\n{two}", "a", 1, "x", "y", 2), (1, f"{one}\nother", "b", None, "x", "y", 2), (2, f"own\n{two}", "c", 1, None, "y", 2)]
    got = sorted(map(tuple, line_dedup.drop_repeated_lines(spark.createDataFrame(rows, names)).collect()), key=lambda r: r[2])
    assert got == [rows[0], rows[1], (2, "own", *rows[2][2:])]


def test_near_duplicates_keep_clashing_columns(spark):
    names = "doc_id bigint, text string, row string, keep bigint, stay int, place int, tag int, node int, __node string, __kept_id bigint, ROOT int"
    rows = [(i, t, "r", 1, 2, 3, 4, 5, "n", 6, 7) for i, t in [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, "x y z w"), (3, "x y z w")]]
    got = sorted(map(tuple, near_duplicates.drop_near_duplicates(spark.createDataFrame(rows, names)).collect()))
    assert got == [rows[0], rows[3]]
    assert sorted(r.keep for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, names)).collect()) == [False] * 3 + [True] * 2
