"""The pipeline, stage by stage and whole, against plain code on planted documents."""

import random

import corpus_pipeline
from murmurlake.llm import decontamination, line_dedup, packing
from test_duplicates import brute_lines, shingles, union_find
from test_map_operators import brute_leaks, encoding, greedy
from test_quality_rules import plain
from murmurlake.llm import quality_rules

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "se", "ti") for b in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [line(14) for _ in range(4)]
    docs = [[line(rng.randrange(8, 20)) for _ in range(rng.randrange(2, 6))] for _ in range(60)]
    shared = line(30)
    docs += [[*docs[3]], [shared, line(12)], [shared[:-1] + "x", line(12)], [line(9), items[0], line(9)], [line(5) + " " + items[1]]]
    near = [w for x in docs[7] for w in x.split()]
    near[5] = "changed"
    docs.append([" ".join(near)])  # one line, so that no line of it repeats
    docs += [["say it again " * 40], [""]]
    texts = ["\n".join(d) for d in docs]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, line(20), None, None, None), (900, None, "en", "s", 0)]
    return rows, list(enumerate(items))


def good(text):
    n, grams, lines = plain(text)
    return n > 0 and lines <= quality_rules.LINE_CHARS_LIMIT and all(grams[k] <= v for k, v in quality_rules.NGRAM_LIMITS.items())


def brute_stages(rows, items):
    one = [r for r in rows if good(r[1])]
    gone = {(d, k) for d, k, *_ in brute_lines([r[:2] for r in one], line_dedup.EDITS, line_dedup.EDIT_CHARS)}
    two = []
    for r in one:
        lines = r[1].split("\n")
        left = [x for k, x in enumerate(lines) if (r[0], k) not in gone]
        if any(x.strip() for x in left):
            two.append((r[0], "\n".join(left), *r[2:4], len("\n".join(left))))
    sets = [shingles(r[1]) for r in two]
    order = sorted(range(len(two)), key=lambda i: (two[i][0] is None, two[i][0] or 0))
    pairs = [(a, b) for a in order for b in order if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])]
    roots = union_find(pairs, range(len(two)))
    first = {}
    for i in order:
        first.setdefault(roots[i], i)
    three = [two[i] for i in sorted(first.values())]
    leaked = {g[0] for g in brute_leaks([r[:2] for r in three], items, decontamination.MIN_WORDS)}
    return one, two, three, [r for r in three if r[0] not in leaked]


def test_pipeline_equals_plain_code(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    wants = brute_stages(rows, items)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    schema = docs.schema
    for k, want in enumerate(wants):
        name, stage = corpus_pipeline.STAGES[k]
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert docs.schema == schema
        assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, want)), name
    assert len({len(w) for w in (rows, *wants)}) == 5  # every stage takes something
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    own = encoding()
    tokens = [(len(own.encode_ordinary(r[1] or "")), r[0]) for r in wants[-1]]
    tokens = sorted((t for t in tokens if t[0]), key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    places = greedy([n for n, _ in tokens], packing.CAPACITY)
    assert {(r.doc_id, r.n_tokens, r.sequence_id) for r in packed} == {(d, n, p) for (n, d), p in zip(tokens, places)}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
