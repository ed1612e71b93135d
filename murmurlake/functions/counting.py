"""Counting in Arrow batches: what is counted becomes a number, equal numbers meet by sorting, and few rows leave."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Occurrences that are sorted at once, and rows that leave at once.
CHUNK, ROWS = 1 << 22, 1 << 16


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where equal values begin."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))


def pieces(columns: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([c[k : k + ROWS] if isinstance(c, pa.Array) else pa.array(c[k : k + ROWS], f.type) for c, f in zip(columns, schema)], schema=schema)


def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths and values of an array of lists, null ones being empty."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lengths, column.flatten()


def _merged(keys: np.ndarray, *values: np.ndarray, how: tuple[np.ufunc, ...]) -> list[np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = runs(keys)
    return [keys[at], *(f.reduceat(v[order], at) if len(at) else v for f, v in zip(how, values))]


def met(batches: Iterator[pa.RecordBatch], times: bool) -> Iterator[pa.RecordBatch]:
    """``a, b, weight`` and, with ``times``, ``first_at, last_at`` of rows ``x, ys`` and ``timestamp``, which come ordered
    by ``x``; of ``x`` and each of ``ys`` the lesser is ``a``.

    What is known of the ``x`` that a chunk ends in is kept for the next, so a chunk's length doesn't bound an ``x``."""
    stamp = pa.timestamp("us")
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("weight", pa.int64()), *([("first_at", stamp), ("last_at", stamp)] if times else [])])
    how = (np.add, np.minimum, np.maximum) if times else (np.add,)
    held: list[tuple[np.ndarray, ...]] = []
    kept: list[np.ndarray] | None = None
    size = 0

    def counted() -> list[np.ndarray]:
        keys = np.concatenate([h[0] for h in held])
        if times:
            when = np.concatenate([h[1] for h in held])
            order = np.argsort(keys)
            keys, when = keys[order], when[order]
        else:
            keys.sort()
        at = runs(keys)
        n = np.diff(at, append=len(keys))
        out = [keys[at], n, *([np.minimum.reduceat(when, at), np.maximum.reduceat(when, at)] if times else [])]
        if kept is None:
            return out
        same = int(np.searchsorted(out[0], ((kept[0][0] >> 32) + 1) << 32))
        begun = _merged(*(np.concatenate((k, o[:same])) for k, o in zip(kept, out)), how=how)
        return [np.concatenate((b, o[same:])) for b, o in zip(begun, out)]

    def told(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x, y = (found[0] >> 32).astype(np.int32), (found[0] & 0xFFFFFFFF).astype(np.int32)
        yield from pieces([np.minimum(x, y), np.maximum(x, y), *found[1:]], schema)

    for batch in batches:
        lengths, values = lists(batch.column("ys"))
        xs, ends = batch.column("x").to_numpy().astype(np.int64), np.cumsum(lengths)
        values = values.to_numpy()
        when = batch.column("timestamp").cast(pa.int64()).to_numpy(zero_copy_only=False) if times else None
        row = 0
        while row < len(xs):
            before = int(ends[row - 1]) if row else 0
            end = max(row + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
            keys = np.repeat(xs[row:end] << 32, lengths[row:end])
            keys |= values[before : int(ends[end - 1])]
            held.append((keys, *([np.repeat(when[row:end], lengths[row:end])] if times else [])))
            size, row = size + len(keys), end
            if size >= CHUNK:
                found = counted()
                first = int(np.searchsorted(found[0], (found[0][-1] >> 32) << 32))
                kept, held, size = [f[first:].copy() for f in found], [], 0
                yield from told([f[:first] for f in found])
    if size:
        yield from told(counted())
    elif kept is not None:
        yield from told(kept)


#: Bits of a filter of n-grams (32 MB), and the parts that it is made in.
BITS, PARTS = 28, 10


class Chunk:
    """Messages' words as numbers."""

    def __init__(self, tokens: list[pa.Array], others: list[list[pa.Array]]):
        each = [lists(t) for t in tokens]
        self.lengths = np.concatenate([n for n, _ in each])
        found = pa.chunked_array([v for _, v in each]).combine_chunks().dictionary_encode()
        self.words, self.ids = found.dictionary, found.indices.to_numpy()
        self.message = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.others = [pa.chunked_array(list(c)).combine_chunks() for c in zip(*others)]

    def starts(self, n: int) -> np.ndarray:
        """Where the n-grams begin that don't cross messages."""
        most = len(self.ids) - n + 1
        return np.flatnonzero(self.message[:most] == self.message[n - 1 :]).astype(np.int32) if most > 0 else np.zeros(0, np.int32)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """The same number for the same n-gram in any chunk; unlike ones may share one."""
        from pandas.util import hash_array

        own = hash_array(self.words.to_numpy(zero_copy_only=False), categorize=False)
        out = own[self.ids[at]]
        for k in range(1, n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + own[self.ids[at + k]]
        for shift, by in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9), (32, 1)):
            out = (out ^ (out >> np.uint64(shift))) * np.uint64(by)
        return out

    def codes(self, at: np.ndarray, n: int) -> np.ndarray:
        """A number for each different n-gram of the chunk, in no wider range than fits."""
        out, many = self.ids[at].astype(np.int64), len(self.words)
        span = many
        for k in range(1, n):
            if span * many >= 1 << 62:
                out = np.unique(out, return_inverse=True)[1]
                span = int(out.max(initial=0)) + 1
            out, span = out * many + self.ids[at + k], span * many
        return out

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        each = [self.words.take(pa.array(self.ids[at + k])) for k in range(n)]
        return each[0] if n == 1 else pc.binary_join_element_wise(*each, " ")


def chunks(batches: Iterator[pa.RecordBatch], others: list[str]) -> Iterator[Chunk]:
    tokens, rest, size = [], [], 0
    for batch in batches:
        lengths = batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends, row = np.cumsum(lengths), 0
        while row < len(ends):
            begun = int(ends[row - 1]) if row else 0
            end = max(row + 1, int(np.searchsorted(ends, begun + CHUNK - size, "right")))
            tokens.append(batch.column("tokens")[row:end])
            rest.append([batch.column(c)[row:end] for c in others])
            size, row = size + int(ends[end - 1]) - begun, end
            if size >= CHUNK or row < len(ends):
                yield Chunk(tokens, rest)
                tokens, rest, size = [], [], 0
    if tokens:
        yield Chunk(tokens, rest)


def hashed(batches: Iterator[pa.RecordBatch], *sizes: int) -> Iterator[pa.RecordBatch]:
    """``part, h, n``: how often the n-grams of each hash occur in a chunk, those of each of ``sizes``."""
    schema = pa.schema([("part", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])
    for chunk in chunks(batches, []):
        for n in sizes:
            h = np.sort(chunk.hashes(chunk.starts(n), n))
            at = runs(h)
            yield from pieces([(h[at] >> np.uint64(64 - PARTS)).astype(np.int32), h[at].view(np.int64), np.diff(at, append=len(h))], schema)


def _sums(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and their numbers in rows of ``hashed``, all of a part's being among them; equal ones merge on the way."""
    h, n, size, known = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, CHUNK
    for batch in batches:
        h.append(batch.column("h").to_numpy().view(np.uint64))
        n.append(batch.column("n").to_numpy())
        size += len(h[-1])
        if size >= known:
            keys, many = _merged(np.concatenate(h), np.concatenate(n), how=(np.add,))
            h, n, size, known = [keys], [many], len(keys), max(CHUNK, 2 * len(keys))
    return tuple(_merged(np.concatenate(h), np.concatenate(n), how=(np.add,)))


def bits(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """``part, bits`` of rows of ``hashed``: the parts of a filter that has a bit for the first ``BITS`` bits of each
    hash that occurs ``least`` times."""
    h, n = _sums(batches)
    place = (h[n >= least] >> np.uint64(64 - BITS)).astype(np.int64)
    width = 1 << (BITS - PARTS)
    for part in np.unique(place // width):
        own = np.zeros(width, bool)
        own[place[place // width == part] % width] = True
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(np.packbits(own, bitorder="little").tobytes(), 1)], pa.binary())], ["part", "bits"])


def commonest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """``h, n`` of the ``k`` commonest hashes in rows of ``hashed``, and of those as common as the last."""
    h, n = _sums(batches)
    keep = n >= (np.partition(n, -k)[-k] if len(n) > k else 0)
    yield from pieces([h[keep].view(np.int64), n[keep]], pa.schema([("h", pa.int64()), ("n", pa.int64())]))


def let_through(parts: list[tuple[int, bytes]]) -> np.ndarray:
    """The whole filter."""
    out = np.zeros(1 << (BITS - 3), np.uint8)
    width = 1 << (BITS - PARTS - 3)
    for part, own in parts:
        out[part * width : (part + 1) * width] = np.frombuffer(zlib.decompress(own), np.uint8)
    return out


def counted(batches: Iterator[pa.RecordBatch], n: int, through: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """``phrase, n, messages, first_at, last_at`` of a chunk's n-grams, of those that a filter lets through; ``messages``
    is null where it is ``n`` and ``last_at`` where it is ``first_at``, as for most."""
    stamp = pa.timestamp("us")
    schema = pa.schema([("phrase", pa.string()), ("n", pa.int64()), ("messages", pa.int64()), ("first_at", stamp), ("last_at", stamp)])
    for chunk in chunks(batches, ["timestamp"]):
        at = chunk.starts(n)
        if through is not None:
            place = (chunk.hashes(at, n) >> np.uint64(64 - BITS)).astype(np.int64)
            at = at[(through[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0]
        codes = chunk.codes(at, n)
        order = np.argsort(codes, kind="stable").astype(np.int32)
        codes, at = codes[order], at[order]
        message = chunk.message[at]
        del order
        first = runs(codes)
        if not len(first):
            continue
        fresh = np.ones(len(codes), np.int64)
        fresh[1:] = (message[1:] != message[:-1]) | (codes[1:] != codes[:-1])
        # times that aren't known count for nothing, as in any least and greatest
        when = chunk.others[0].cast(pa.int64())
        known, times = when.is_valid().to_numpy(zero_copy_only=False)[message], when.fill_null(0).to_numpy()[message]
        least, most = np.minimum.reduceat(np.where(known, times, np.iinfo(np.int64).max), first), np.maximum.reduceat(np.where(known, times, np.iinfo(np.int64).min), first)
        none = ~np.logical_or.reduceat(known, first)
        many, messages, at = np.diff(first, append=len(codes)), np.add.reduceat(fresh, first), at[first]
        del codes, message, fresh, times, known, first
        for k in range(0, len(at), ROWS):
            some = slice(k, k + ROWS)
            own = [chunk.phrases(at[some], n), many[some], pa.array(messages[some], mask=(messages == many)[some]), pa.array(least[some], stamp, mask=none[some]), pa.array(most[some], stamp, mask=(none | (most == least))[some])]
            yield from pieces(own, schema)


def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``w, c``: how often each word occurs in a chunk."""
    schema = pa.schema([("w", pa.string()), ("c", pa.int64())])
    for chunk in chunks(batches, []):
        yield from pieces([chunk.words, np.bincount(chunk.ids, minlength=len(chunk.words))], schema)


def grouped(batches: Iterator[pa.RecordBatch], most: int, through: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """``topic, term, n``: words and n-grams up to ``most`` words by a message's topic in a chunk; ``through``: hashes, in
    order, of those that are wanted."""
    for chunk in chunks(batches, ["topic"]):
        topics = chunk.others[0].dictionary_encode(null_encoding="encode")
        topic = topics.indices.to_numpy().astype(np.int64)
        schema = pa.schema([("topic", topics.dictionary.type), ("term", pa.string()), ("n", pa.int64())])
        for n in range(1, most + 1):
            at = chunk.starts(n)
            if through is not None:
                h = chunk.hashes(at, n)
                at = at[through[np.searchsorted(through, h).clip(max=len(through) - 1)] == h] if len(through) else at[:0]
            codes = np.unique(chunk.codes(at, n), return_inverse=True)[1] * len(topics.dictionary) + topic[chunk.message[at]]
            _, first, many = np.unique(codes, return_index=True, return_counts=True)
            if len(first):
                yield from pieces([topics.dictionary.take(pa.array(topic[chunk.message[at[first]]])), chunk.phrases(at[first], n), many], schema)
