"""MinHash near-duplicates: universal hash minima, bands, signature verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from murmurlake.llm.common import Recent, Words, dropped, free_name, mix, prepare, sent_if_small, steps, string_buffers, written
from murmurlake.llm.components import components

#: Words of a shingle; bands and minima in each; share of equal minima that makes two documents near-duplicates.
SHINGLE, BANDS, ROWS, THRESHOLD = 3, 32, 4, 0.5

_R = np.random.default_rng(8)
_A = _R.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 1 << 63, 1024, dtype=np.uint64)
_PART = 1 << 15


def sketch(words: Words, shingle: int, hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: a hash of its word sequence, its minima (uint32), and whether it has words.

    A row of fewer words than a shingle is one shingle as a whole."""
    rows = len(words.offsets) - 1
    count = np.diff(words.first)
    at, x = words.ngrams(shingle)
    roll = np.zeros(rows, np.uint64)
    full = np.flatnonzero(count > 0)
    if len(full):
        where = (np.arange(len(words.hash)) - words.first[words.doc]).astype(np.uint64)
        whole = np.add.reduceat(mix(words.hash + where * np.uint64(0x9E3779B97F4A7C15)), words.first[full])
        roll[full] = mix(whole + count[full].astype(np.uint64))
    few = np.flatnonzero((count > 0) & (count < shingle))
    doc = np.concatenate([words.doc[at], few])
    x = np.concatenate([x, roll[few]])
    by = np.argsort(doc, kind="stable")
    doc, x = doc[by], x[by]
    minima = np.full((rows, hashes), np.iinfo(np.uint32).max, np.uint32)
    # a part of the shingles at a time stays in the processor's cache
    for a in range(0, len(x), _PART):
        d, y = doc[a : a + _PART], x[a : a + _PART]
        start = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        own = d[start]
        part = np.empty((hashes, len(own)), np.uint32)
        for k in range(hashes):
            part[k] = np.minimum.reduceat((y * _A[k] + _B[k]) >> np.uint64(32), start)
        minima[own] = np.minimum(minima[own], part.T)
    return roll, minima, count > 0


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(minima), bands), np.uint64)
    for k in range(bands):
        h = np.full(len(minima), np.uint64(k + 1))
        for j in range(k * rows, (k + 1) * rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + minima[:, j])
        keys[:, k] = h
    return keys


def signatures(minima: pa.Array, hashes: int) -> np.ndarray:
    """The rows of a column of packed minima, none of them null."""
    return np.frombuffer(b"".join(minima.to_pylist()), np.uint32).reshape(-1, hashes)


def linked(rows: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs that span the connected parts among signatures that agree in at least ``least`` places.

    Each reached signature is compared with all that are not reached yet, so no pair that matters is left out."""
    out, rest = [], np.arange(len(rows))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            k = queue.pop()
            near = (rows[rest] == rows[k]).sum(1) >= least
            found = rest[near]
            out += [(k, f) for f in found]
            queue += found.tolist()
            rest = rest[~near]
    return out


def shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's ``key, node`` the distinct ones whose key has several nodes, with a hash of all of these in
    place of the key: buckets of the same nodes are one."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    key, node = (np.concatenate(x) for x in zip(*parts))
    by = np.lexsort((node, key))
    key, node = key[by], node[by]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    same = key[1:] == key[:-1]
    many = np.append(same, False) | np.append(False, same)
    key, node = key[many], node[many]
    if not len(key):
        return
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    members = mix(np.add.reduceat(mix(node.view(np.uint64)), start) + size.astype(np.uint64))
    bucket = np.repeat(members, size).view(np.int64)
    for a in range(0, len(bucket), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(bucket[a : a + (1 << 16)]), pa.array(node[a : a + (1 << 16)])], ["bucket", "node"])


def group_edges(key: np.ndarray, node: np.ndarray, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified edges within each run of equal keys."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    two = start[size == 2]
    two = two[(rows[two] == rows[two + 1]).sum(1) >= least]
    u, v = [node[two]], [node[two + 1]]
    for a, n in zip(start[size > 2], size[size > 2]):
        pairs = linked(rows[a : a + n], least)
        if pairs:
            i, j = np.array(pairs).T
            u.append(node[a + i])
            v.append(node[a + j])
    return np.concatenate(u), np.concatenate(v)


def verified(hashes: int, least: float):
    """Edges from a partition of ``key, node, minima`` that is sorted by key; one bucket at least is held at a time."""

    def edges(key: np.ndarray, node: np.ndarray, minima: pa.Array) -> pa.RecordBatch:
        u, v = group_edges(key, node, signatures(minima, hashes), least)
        pair = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last == 0 and (not held or held[-1].column(0)[-1].as_py() == key[0]):
                held.append(batch)
                continue
            t = pa.Table.from_batches([*held, batch.slice(0, last)] if last else held)
            held = [batch.slice(last)]
            yield edges(t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).combine_chunks())
        if held:
            t = pa.Table.from_batches(held)
            yield edges(t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).combine_chunks())

    return run


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart: a 64-bit hash of id and text, nulls included."""
    number, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    return F.xxhash64(number.isNull(), number, text.isNull(), text)


class Groups:
    """Near-duplicate groups of a table.

    ``rows``: ``tag, doc_id, row, node`` of every row, ``tag`` being its own number, ``row`` its ``row_key`` and
    ``node`` a hash of its words (null where there are none); ``roots``: ``node, root`` of the nodes that aren't their
    group's root."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int, threshold: float):
        prepare(docs.sparkSession)
        hashes = bands * rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent, number = Recent(), TaskContext.get().partitionId() << 33
            for batch in batches:
                data, offsets = string_buffers(batch.column(2))
                for a, b in steps(offsets):
                    words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
                    node, minima, has = sketch(words, shingle, hashes)
                    first = np.zeros(b - a, bool)
                    first[np.unique(node, return_index=True)[1]] = True
                    first &= has
                    first[first] = recent.new(node[first])
                    ends = np.append(0, np.cumsum(first * 4 * hashes)).astype(np.int32)
                    raw = pa.Array.from_buffers(pa.binary(), b - a, [pa.array(first).buffers()[1], pa.py_buffer(ends), pa.py_buffer(minima[first].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(b - a)), batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(node.view(np.int64), mask=~has), raw], ["tag", "doc_id", "row", "node", "minima"])
                    number += b - a

        def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = band_keys(signatures(batch.column(1), hashes), bands, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], ["key", "node"])

        slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
        sketches = written(slim.mapInArrow(run, "tag bigint, doc_id bigint, row bigint, node bigint, minima binary"), "sketches")
        self.rows = sketches.select("tag", "doc_id", "row", "node")
        minima = sketches.where("minima is not null").select("node", "minima")
        buckets = minima.mapInArrow(banded, "key bigint, node bigint").repartition("key").mapInArrow(shared_buckets, "bucket bigint, node bigint")
        buckets = written(buckets.distinct(), "buckets")
        wanted = written(buckets.select("node").distinct(), "nodes")
        minima = minima.join(sent_if_small(wanted, 16), "node", "left_semi").dropDuplicates(["node"])
        signed = buckets.join(minima, "node").select("bucket", "node", "minima")
        edges = signed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(verified(hashes, threshold * hashes), "u bigint, v bigint")
        self.roots = components(edges)
        dropped(buckets, wanted)

    def members(self) -> DataFrame:
        """``tag, doc_id, row, node, root`` of every row; ``root`` is the same throughout a group and null without words."""
        return self.rows.join(self.roots, "node", "left").select("tag", "doc_id", "row", "node", F.coalesce("root", "node").alias("root"))

    def judged(self) -> DataFrame:
        """``doc_id, row, group_id, group_size, keep`` of every row: a group's least id, null ids last, names it and is
        kept, of equal ids the row with the least hash of words, of equal rows the first."""
        members = self.members()
        alone = members.where("root is null").select("doc_id", "row", F.col("doc_id").alias("group_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("keep"))
        many = members.where("root is not null")
        best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node", "tag")).alias("best")
        groups = many.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"), best).select("root", "group_id", "group_size", F.col("best.tag").alias("best"))
        return many.join(groups, "root").select("doc_id", "row", "group_id", "group_size", (F.col("tag") == F.col("best")).alias("keep")).unionAll(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, group_id, group_size, keep`` for each row of ``docs``.

    Rows are near-duplicates if at least ``threshold`` of their minima over word shingles (lower case, white space
    aside) agree, and groups are what that connects; the least doc_id names the group and is kept, null ids last. Of
    repeated rows exactly one is kept. Null and blank texts have no shingles: each stays alone, its group_id its own
    id. A text shorter than a shingle is one shingle; a very long one is sketched whole, part by part. An empty table
    gives an empty one; other columns are ignored, whatever their names.

    Texts are read once; signatures, band keys and ids are all that moves. Exact copies leave a partition once; a
    bucket is verified where its signatures meet, each against all that it isn't joined to yet, so what moves is linear
    even in groups of thousands, and buckets of the same members are verified once."""
    groups = Groups(docs, id_col, text_col, shingle, bands, rows, threshold)
    return groups.judged().drop("row")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group, and every row without words; see ``near_duplicates``, also for nulls, empty
    and long texts, ties and empty tables. All columns stay, whatever their names; of rows with the same id and text
    one stays, the one whose other columns have the least hash.

    Rows to go are known by a hash of id and text. The list of these meets the documents, which don't move while it is
    small enough to be sent (it is counted); beyond that both sides are joined by that hash. Documents are read a
    second time only if rows repeat."""
    judged = Groups(docs, id_col, text_col, shingle, bands, rows, threshold).judged()
    fate = judged.groupBy("row").agg(F.bool_or("keep").alias("keep"), F.count_if("keep").alias("stay"), F.count("*").alias("n"))
    fate = written(fate.where("stay < n").select("row", "keep", "stay"), "fate")
    key, keep, stay, place = (free_name(docs.columns, x) for x in ("row", "keep", "stay", "place"))
    names = [docs[c] for c in docs.columns]
    keyed = docs.select(*names, row_key(id_col, text_col).alias(key))
    listed = sent_if_small(fate, 32)
    out = keyed.join(listed.select(F.col("row").alias(key)), key, "left_anti").select(*docs.columns)
    twice = fate.where("keep")
    if twice.limit(1).count():
        again = keyed.join(sent_if_small(twice, 32).select(F.col("row").alias(key), F.col("stay").alias(stay)), key)
        order = Window.partitionBy(key).orderBy(F.xxhash64(*(F.to_json(F.struct(c)) if isinstance(docs.schema[c].dataType, MapType) else F.col(c) for c in docs.columns)))
        out = out.unionAll(again.withColumn(place, F.row_number().over(order)).where(F.col(place) <= F.col(stay)).select(*docs.columns))
    return out
