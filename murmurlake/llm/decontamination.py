"""Benchmark decontamination with suffix arrays over shards of the training text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import Words, prepare, steps, string_buffers

#: Words in a row that count as leaked.
MIN_WORDS = 8
#: Benchmark bytes that go to the workers at once; a larger benchmark is searched in several passes.
SLICE_BYTES = 32 << 20
#: Training bytes of a shard (one longer document is a shard of its own).
SHARD_BYTES = 4 << 20

SCHEMA = "doc_id bigint, item_id bigint, match_words bigint, doc_word bigint, item_word bigint"


def packed(symbols: np.ndarray, places: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """One integer that orders suffixes by their first ``depth`` symbols: three of 21 bits or two of 32."""
    bits = np.uint64({3: 21, 2: 32}[depth])
    padded = np.append(symbols, np.zeros(depth, symbols.dtype)).astype(np.uint64)
    key = np.zeros(len(places), np.uint64)
    for j in range(depth):
        key = key << bits | np.where(places + j < end, padded[places + j], np.uint64(0))
    return key


def suffix_array(symbols: np.ndarray, end: np.ndarray, depth: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes of rows of symbols (positive, below 2^21 for a depth of 3), and their sorted keys.

    ``end``: for each place the end of its row; a suffix ends there, and an ended one comes first. Prefix doubling:
    only suffixes that are still tied are sorted again, by the rank of what follows the part compared so far; equal
    suffixes stay tied."""
    n = len(symbols)
    key = packed(symbols, np.arange(n), end, depth)
    order = np.argsort(key)
    first = key[order]
    new = np.ones(n, bool)
    new[1:] = first[1:] != first[:-1]
    rank = np.empty(n, np.int64)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    rank[order] = np.repeat(start, size)
    tied = np.flatnonzero(np.repeat(size, size) > 1)
    done = depth
    while len(tied):
        suffix = order[tied]
        next_ = suffix + done
        ends = next_ >= end[suffix]
        pair = rank[suffix] << 32 | np.where(ends, 0, rank[np.where(ends, 0, next_)] + 1)
        by = np.argsort(pair, kind="stable")
        suffix, pair = suffix[by], pair[by]
        order[tied] = suffix
        new = np.ones(len(tied), bool)
        new[1:] = pair[1:] != pair[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(tied)))
        rank[suffix] = np.repeat(tied[start], size)
        tied = tied[(np.repeat(size, size) > 1) & (pair & 0xFFFFFFFF > 0)]
        done *= 2
    return order, first


class Tests:
    """The benchmark's words and suffixes: ``table`` has a row of word hashes for each item."""

    def __init__(self, ids: list[int | None], texts: pa.Array, min_words: int):
        words = Words(*string_buffers(texts))
        count = np.diff(words.first)
        self.ids, self.count, self.min_words = ids, count, min_words
        self.vocabulary, self.word = np.unique(words.hash, return_inverse=True)
        item = words.doc
        at = np.arange(len(item)) - words.first[item]
        use = at + min_words <= count[item]
        self.suffix, self.item, self.at = np.flatnonzero(use), item[use], at[use]
        self.end = words.first[1:][self.item]


def matches(words: Words, tests: Tests) -> dict[str, np.ndarray]:
    """For each pair of row and item with a verbatim match of at least ``min_words`` words the longest one, of equal
    ones the first in the row, then in the item."""
    empty = {k: np.zeros(0, np.int64) for k in ("row", "item", "length", "doc_word", "item_word")}
    if not len(words.hash) or not len(tests.suffix):
        return empty
    known, symbols = np.unique(words.hash, return_inverse=True)
    symbols = symbols + 1
    end = words.first[1:][words.doc]
    depth = 3 if len(known) < (1 << 21) - 1 else 2
    order, key = suffix_array(symbols, end, depth)
    vocab = np.searchsorted(known, tests.vocabulary)
    vocab = np.where(known[np.minimum(vocab, len(known) - 1)] == tests.vocabulary, vocab + 1, 0)
    symbol = vocab[tests.word]  # 0: a word that this shard hasn't
    k = tests.min_words
    head = symbol[tests.suffix[:, None] + np.arange(k)]
    live = np.flatnonzero((head > 0).all(1))
    head = head[live]
    lead = packed(head.ravel(), np.arange(len(live)) * k, np.arange(1, len(live) + 1) * k, depth)
    top = lead | np.uint64((1 << {3: 21, 2: 32}[depth] * max(0, depth - k)) - 1)
    low, high = np.searchsorted(key, lead, "left"), np.searchsorted(key, top, "right")
    some = low < high
    live, head, low, high = live[some], head[some], low[some], high[some]

    padded = np.append(symbols, np.zeros(k, symbols.dtype))
    own_end = np.append(end, 0)

    def bound(after: bool) -> np.ndarray:
        lo, hi = low.copy(), high.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) // 2
            suffix = order[middle]
            reach = suffix[:, None] + np.arange(k)
            there = np.where(reach < own_end[suffix][:, None], padded[reach], 0)
            differs = there != head[open_]
            where = differs.argmax(1)
            less = there[np.arange(len(open_)), where] < head[open_, where]
            right = np.where(differs.any(1), less, after)
            lo[open_[right]] = middle[right] + 1
            hi[open_[~right]] = middle[~right]
        return lo

    begin, stop = bound(False), bound(True)
    count = stop - begin
    pair = np.repeat(np.arange(len(live)), count)
    if not len(pair):
        return empty
    suffix = order[np.repeat(begin, count) + np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)]
    test = live[pair]
    source, source_end, goal_end = tests.suffix[test], tests.end[test], end[suffix]
    length, growing = np.full(len(pair), k), np.arange(len(pair))
    while growing.size:
        a, b = suffix[growing] + length[growing], source[growing] + length[growing]
        ok = (a < goal_end[growing]) & (b < source_end[growing])
        growing, a, b = growing[ok], a[ok], b[ok]
        same = symbols[a] == symbol[b]
        growing = growing[same]
        length[growing] += 1
    row, item = words.doc[suffix], tests.item[test]
    doc_word, item_word = suffix - words.first[row], tests.at[test]
    by = np.lexsort((item_word, doc_word, -length, item, row))
    row, item = row[by], item[by]
    first = np.ones(len(by), bool)
    first[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    return {"row": row[first], "item": item[first], "length": length[by][first], "doc_word": doc_word[by][first], "item_word": item_word[by][first]}


def shards(column: pa.Array, tests: Tests) -> Iterator[dict[str, np.ndarray]]:
    data, offsets = string_buffers(column)
    for a, b in steps(offsets, SHARD_BYTES):
        found = matches(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), tests)
        found["row"] = found["row"] + a
        yield found


def slices(benchmark: DataFrame, id_col: str, text_col: str, min_words: int) -> list[Tests]:
    """The benchmark in parts of bounded size; its size is measured before anything is collected."""
    slim = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // SLICE_BYTES))
    out = []
    for part in range(parts):
        got = slim.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).toArrow()
        out.append(Tests(got.column(0).to_pylist(), got.column(1), min_words))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, item_id, match_words, doc_word, item_word``: for each document and benchmark item that share at
    least ``min_words`` words in a row, the longest such passage and the number of its first word in either.

    Words are runs of non-white-space, compared byte for byte. Of equally long passages the first in the document
    counts, then the first in the item. Every copy of a row is reported; null texts match nothing; null ids stay null;
    items of fewer than ``min_words`` words can't match; other columns are ignored; empty tables give an empty one.
    Map only: each worker builds suffix arrays of its own shards and searches every suffix of the benchmark in them."""
    prepare(docs.sparkSession)

    def finder(tests: Tests):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for found in shards(batch.column(1), tests):
                    ids = batch.column(0).take(pa.array(found["row"]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([tests.ids[i] for i in found["item"]], pa.int64()), *(pa.array(found[k], pa.int64()) for k in ("length", "doc_word", "item_word"))], ["doc_id", "item_id", "match_words", "doc_word", "item_word"])

        return run

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return reduce(DataFrame.unionAll, [slim.mapInArrow(finder(t), SCHEMA) for t in slices(benchmark, item_col, item_text_col, min_words)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that share no ``min_words`` words in a row with any benchmark item; see ``leaks``."""
    prepare(docs.sparkSession)
    place = docs.columns.index(text_col)

    def cleaner(tests: Tests):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for found in shards(batch.column(place), tests):
                    keep[found["row"]] = False
                yield batch.filter(pa.array(keep))

        return run

    for tests in slices(benchmark, item_col, item_text_col, min_words):
        docs = docs.mapInArrow(cleaner(tests), docs.schema)
    return docs


def sql(docs: str = "documents", benchmark: str = "benchmark", min_words: int = MIN_WORDS) -> str:
    """The same passages in DuckDB SQL: equal word n-grams, joined up along diagonals."""
    words = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '')"
    grams = "SELECT {r}, {i}, unnest(range(0, len(ws) - {m})) AS p, unnest(list_transform(range(1, len(ws) - {m} + 1), lambda j: array_to_string(ws[j:j + {m}], ' '))) AS g FROM {t} WHERE len(ws) > {m}"
    k = min_words - 1
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM {docs}),
b AS (SELECT row_number() OVER () AS b, item_id, {words} AS ws FROM {benchmark}),
gd AS ({grams.format(r="r", i="doc_id", m=k, t="d")}),
gb AS ({grams.format(r="b", i="item_id", m=k, t="b")}),
h AS (SELECT r, b, doc_id, item_id, gd.p AS p, gb.p AS q, gd.p - row_number() OVER (PARTITION BY r, b, gd.p - gb.p ORDER BY gd.p) AS island FROM gd JOIN gb USING (g)),
m AS (SELECT r, b, any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, count(*) + {k} AS match_words, min(p) AS doc_word, min(q) AS item_word FROM h GROUP BY r, b, p - q, island)
SELECT doc_id, item_id, match_words::BIGINT AS match_words, doc_word::BIGINT AS doc_word, item_word::BIGINT AS item_word FROM m
QUALIFY row_number() OVER (PARTITION BY r, b ORDER BY match_words DESC, doc_word, item_word) = 1"""
