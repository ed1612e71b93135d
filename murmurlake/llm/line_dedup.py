"""Line deduplication by a segment-partition edit join (after Pass-Join; Li and others, 2011)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from murmurlake.functions.shared import SENT_BYTES
from murmurlake.llm.common import Recent, Words, dropped, free_name, mix, prepare, steps, string_buffers, written

#: Most edits between lines that count as the same, and characters of the shorter line for each of them: none under 10
#: characters, one from 10 on, two from 20 on.
EDITS, EDIT_CHARS = 2, 10
#: Bits of the filter of candidate lines at most, and for each candidate. The filter only saves texts from moving: what
#: it lets through wrongly falls out where lines meet.
FILTER_BITS, CANDIDATE_BITS = 1 << 27, 10
#: Bits of a part of the filter.
_PART = 1 << 15
#: Pairs that are verified at once; lines of a bucket from which it is worked off line by line.
PAIRS, LARGE = 1 << 13, 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Lines:
    """The non-blank lines of rows of text without the white space around them: byte spans, row, number in the row
    (blank lines count), hash, characters."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets)
        self.words = words
        breaks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 10, out=breaks[1:])
        chars = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        self.chars = chars
        solid = np.flatnonzero(~_SPACE[data])
        row = np.searchsorted(offsets, solid, "right") - 1
        line = breaks[solid]
        new = np.ones(len(solid), bool)
        new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(solid)) - 1 if len(first) else first
        self.start, self.end, self.row = solid[first], solid[last] + 1, row[first]
        self.number = line[first] - breaks[offsets[self.row]]
        self.length = chars[self.end] - chars[self.start]
        self.hash = words.span_hash(self.start, self.end)


def segment(length: np.ndarray, edits: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and size of the i-th of ``edits + 1`` nearly equal segments; the longer ones come last."""
    parts = edits + 1
    size, extra = length // parts, length % parts
    before = np.maximum(0, i - (parts - extra))
    return i * size + before, size + (i >= parts - extra)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """``(how much longer, segment, shift)`` of each substring that can match a segment of a line as long or shorter:
    the multi-match-aware selection. Shift is from the segment's place; those of no shift and equal length are the
    segments themselves."""
    out = []
    for longer in range(edits + 1):
        for i in range(edits + 1):
            low = max(-i, longer - (edits - i))
            high = min(i, longer + (edits - i))
            out += [(longer, i, shift) for shift in range(low, high + 1)]
    return out


def allowed(length: np.ndarray, edits: int, edit_chars: int) -> np.ndarray:
    """Edits between a line of so many characters and one that is as long or longer."""
    return np.minimum(edits, length // edit_chars)


def line_keys(lines: Lines, edits: int, edit_chars: int, recent: Recent | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``key, hash`` of each line's segments and probes. A key's last bit tells a segment from a mere probe.

    A line has the segments of the edits that its own length allows, and probes for those of each shorter length that
    is near enough. Lines in ``recent`` are left out."""
    use = np.flatnonzero(lines.length >= max(edit_chars, 2))
    line, at = np.unique(lines.hash[use], return_index=True)
    use = use[at]
    if recent is not None:
        new = recent.new(line)
        line, use = line[new], use[new]
    if not len(use):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, length = lines.chars[lines.start[use]], lines.length[use]
    byte = np.append(np.flatnonzero((lines.words.data & 0xC0) != 0x80), len(lines.words.data))
    keys, ids = [], []
    for most in range(1, edits + 1):
        for longer, i, shift in probes(most):
            there = length - longer
            place, size = segment(there, most, i)
            place = place + shift
            ok = (allowed(there, edits, edit_chars) == most) & (there > most) & (place >= 0) & (place + size <= length)
            a = begin[ok] + place[ok]
            h = lines.words.span_hash(byte[a], byte[a + size[ok]])
            key = mix(h + mix((there[ok] * (edits + 2) + i).astype(np.uint64)))
            own = np.uint64(longer == 0 and shift == 0)
            keys.append(key >> np.uint64(1) << np.uint64(1) | own)
            ids.append(line[ok])
    return np.concatenate(keys).view(np.int64), np.concatenate(ids).view(np.int64)


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's ``key, line`` those that share a segment: ``key`` without its mark, ``line``, ``own``."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    key, line = (np.concatenate(x) for x in zip(*parts))
    by = np.lexsort((-(key & 1), line, key >> 1))
    key, line = key[by], line[by]
    bucket = key >> 1
    new = np.ones(len(key), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (line[1:] != line[:-1])
    bucket, line, own = bucket[new], line[new], (key[new] & 1).astype(bool)
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    size = np.diff(np.append(start, len(bucket)))
    use = np.repeat((size > 1) & (np.add.reduceat(own.astype(np.int64), start) > 0), size)
    bucket, line, own = bucket[use], line[use], own[use]
    for a in range(0, len(bucket), 1 << 16):
        b = a + (1 << 16)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[a:b]), pa.array(line[a:b]), pa.array(own[a:b])], ["key", "line", "own"])


def within(a: list[np.ndarray], b: list[np.ndarray], edits: int) -> np.ndarray:
    """Edit distance of each pair of arrays of characters, ``edits + 1`` where it is more; ``b`` is the longer one.

    Bit-parallel in a band of diagonals (Hyyrö, 2003), one machine word for each pair, many pairs at a time."""
    out = np.full(len(a), edits + 1, np.int64)
    m, n = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    live = np.flatnonzero((n >= m) & (n - m <= edits))
    brief = live[n[live] <= edits]  # the band needs a longer pattern
    for k in brief:
        out[k] = min(edits + 1, plain_distance(a[k], b[k]))
    live = live[n[live] > edits]
    live = live[np.argsort(n[live], kind="stable")]
    kind = np.uint8 if edits <= 3 else np.uint64
    bits = 8 if edits <= 3 else 64
    if edits > 31:
        raise ValueError("more than 31 edits don't fit in the band")
    one = kind(1)
    low = bits - 1 - edits  # rows of padding before the pattern
    for c in range(0, len(live), PAIRS):
        pair = live[c : c + PAIRS]
        ml, nl = m[pair], n[pair]
        widest = int(ml.max())
        pattern = np.full((low + widest + 2 * edits + 1, len(pair)), 0xFFFFFFFF, np.uint32)
        text = np.full((widest, len(pair)), 0xFFFFFFFE, np.uint32)
        for k, p in enumerate(pair):
            pattern[low : low + nl[k], k] = b[p]
            text[: ml[k], k] = a[p]
        vp = np.full(len(pair), ((1 << edits + 1) - 1) << (bits - edits - 1), kind)
        vn = np.zeros(len(pair), kind)
        dist = np.full(len(pair), edits, np.int64)
        top, step, most = kind(1 << bits - 1), nl - edits, 2 * edits - (nl - ml)
        for i in range(widest):
            if i % 32 == 31:  # those that are finished or can't come back leave
                ended = i >= ml
                done = ended | ((dist > most) & (i <= step))
                if done.any():
                    out[pair[ended]] = dist[ended]
                    stay = ~done
                    pair, ml, vp, vn, dist, step, most = (x[stay] for x in (pair, ml, vp, vn, dist, step, most))
                    pattern, text = pattern[:, stay], text[:, stay]
                    if not len(pair):
                        break
            char = text[i]
            x = np.zeros(len(pair), kind)
            for k in range(max(0, bits - 2 * edits - 2), bits):
                x |= (pattern[i + k] == char).astype(kind) << kind(k)
            d0 = (((x & vp) + vp) ^ vp) | x | vn
            hp = vn | ~(d0 | vp)
            hn = d0 & vp
            active = i < ml
            down = active & (i < step)
            dist += down & ((d0 & top) == 0)
            level = (top >> one) >> np.clip(i - step, 0, bits - 2).astype(kind)
            across = active & (i >= step)
            dist += across & ((hp & level) != 0)
            dist -= across & ((hn & level) != 0)
            shifted = d0 >> one
            vp = hn | ~(shifted | hp)
            vn = shifted & hp
        out[pair] = dist
    return np.minimum(out, edits + 1)


def plain_distance(a: np.ndarray, b: np.ndarray) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def bucket_matches(key: np.ndarray, own: np.ndarray, texts: list[str], edits: int, edit_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``later, earlier, distance`` as places: for each line the first before it in its bucket that is near enough.

    Lines stand in order within equal keys. In a large bucket each line in turn is compared with the later ones that
    have found none yet, so a bucket of many like lines costs little more than one pass."""
    codes: dict[int, np.ndarray] = {}

    def code(k: int) -> np.ndarray:
        if k not in codes:
            codes[k] = np.frombuffer(texts[k].encode("utf-32-le"), np.uint32)
        return codes[k]

    def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        pairs = [(code(i), code(j)) for i, j in zip(x, y)]
        pairs = [(p, q) if len(p) <= len(q) else (q, p) for p, q in pairs]
        d = within([p for p, _ in pairs], [q for _, q in pairs], edits)
        return np.where(d <= allowed(np.array([len(p) for p, _ in pairs], np.int64), edits, edit_chars), d, edits + 1)

    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    late, early, dist = [], [], []
    xs, ys = [], []
    for n in range(2, LARGE):
        s = start[size == n]
        if len(s):
            i, j = np.triu_indices(n, 1)
            xs.append((s[:, None] + i).ravel())
            ys.append((s[:, None] + j).ravel())
    x = np.concatenate(xs) if xs else np.zeros(0, np.int64)
    y = np.concatenate(ys) if ys else np.zeros(0, np.int64)
    linked = own[x] | own[y]
    x, y = x[linked], y[linked]
    for c in range(0, len(x), PAIRS):
        d = distances(x[c : c + PAIRS], y[c : c + PAIRS])
        near = d <= edits
        early.append(x[c : c + PAIRS][near])
        late.append(y[c : c + PAIRS][near])
        dist.append(d[near])
    for s, n in zip(start[size >= LARGE], size[size >= LARGE]):
        codes.clear()
        open_ = np.ones(n, bool)
        for k in range(n):
            rest = k + 1 + np.flatnonzero(open_[k + 1 :])
            if not len(rest):
                break
            rest = rest[own[s + rest] | own[s + k]]
            d = distances(np.full(len(rest), s + k), s + rest)
            near = d <= edits
            open_[rest[near]] = False
            early.append(np.full(near.sum(), s + k))
            late.append(s + rest[near])
            dist.append(d[near])
    join = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
    late, early, dist = join(late), join(early), join(dist)
    by = np.lexsort((early, late))
    late, early, dist = late[by], early[by], dist[by]
    first = np.append(True, late[1:] != late[:-1])[: len(late)]
    return late[first], early[first], dist[first]


def verifier(edits: int, edit_chars: int):
    """``line, distance`` and the place of the first near line, from a partition sorted by key and place."""

    def work(t: pa.Table) -> pa.RecordBatch:
        late, early, dist = bucket_matches(t["key"].to_numpy(), t["own"].to_numpy(zero_copy_only=False), t["text"].to_pylist(), edits, edit_chars)
        e = pa.array(early)
        place = [t[c].combine_chunks().take(e) for c in ("no_id", "doc_id", "line_no")]
        return pa.RecordBatch.from_arrays([t["line"].combine_chunks().take(pa.array(late)), *place, pa.array(dist, pa.int64())], ["line", "no_id", "doc_id", "line_no", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last == 0 and (not held or held[-1].column("key")[-1].as_py() == key[0]):
                held.append(batch)
                continue
            t = pa.Table.from_batches([*held, batch.slice(0, last)] if last else held)
            held = [batch.slice(last)]
            yield work(t)
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def filter_of(shared: DataFrame, count: int) -> np.ndarray:
    """A bit for each candidate line, at the place that its hash's low bits name; parts are set where they belong and
    only put together on the driver, ``FILTER_BITS`` at most."""
    bits = _PART
    while bits < min(FILTER_BITS, CANDIDATE_BITS * count):
        bits *= 2

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [b.column(0).to_numpy() for b in batches]
        at = np.unique(np.concatenate(at)) if at else np.zeros(0, np.int64)
        for number in np.unique(at // _PART):
            part = np.zeros(_PART, bool)
            part[at[at // _PART == number] % _PART] = True
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([np.packbits(part).tobytes()], pa.binary())], ["number", "bits"])

    places = shared.select(F.col("line").bitwiseAND(F.lit(bits - 1)).alias("at")).distinct()
    out = np.zeros(bits // 8, np.uint8)
    for row in places.repartition(F.floor(F.col("at") / _PART)).mapInArrow(parts, "number bigint, bits binary").collect():
        out[row.number * _PART // 8 : (row.number + 1) * _PART // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def passes(bits: np.ndarray, line: np.ndarray) -> np.ndarray:
    at = line & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


class Repeats:
    """The lines of a table that repeat earlier ones.

    ``lines``: ``doc_id, line_no, line, text, no_id`` of every line, with the texts of candidates; ``known``: ``line,
    first, near`` of the lines that occur more than once or are near an earlier one: the place where it occurs first,
    and the earliest line that is near that with the distance."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, edits: int, edit_chars: int):
        prepare(docs.sparkSession)
        slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent = Recent()
            for batch in batches:
                data, offsets = string_buffers(batch.column(0))
                for a, b in steps(offsets):
                    key, line = line_keys(Lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), edits, edit_chars, recent)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(line)], ["key", "line"])

        keys = slim.select("text").mapInArrow(keyed, "key bigint, line bigint")
        shared = written(keys.repartition(F.shiftright("key", 1)).mapInArrow(candidates, "key bigint, line bigint, own boolean"), "shared")
        bits = filter_of(shared, shared.count())

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = string_buffers(batch.column(1))
                for a, b in steps(offsets):
                    part = data[offsets[a] : offsets[b]]
                    lines = Lines(part, offsets[a : b + 1] - offsets[a])
                    line = lines.hash.view(np.int64)
                    need = (lines.length >= edit_chars) & passes(bits, line)
                    raw = part.tobytes()
                    texts = [raw[s:e].decode() if n else None for s, e, n in zip(lines.start, lines.end, need)]
                    ids = batch.column(0).slice(a, b - a).take(pa.array(lines.row))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(lines.number), pa.array(line), pa.array(texts, pa.string())], ["doc_id", "line_no", "line", "text"])

        self.lines = written(slim.mapInArrow(placed, "doc_id bigint, line_no bigint, line bigint, text string").withColumn("no_id", F.col("doc_id").isNull()), "lines")
        place = F.struct("no_id", "doc_id", "line_no")
        texts = self.lines.where("text is not null").groupBy("line").agg(F.min(place).alias("p"), F.first("text").alias("text"))
        meeting = shared.join(texts, "line").select("key", "own", "line", "text", "p.no_id", "p.doc_id", "p.line_no")
        near = meeting.repartition("key").sortWithinPartitions("key", "no_id", "doc_id", "line_no").mapInArrow(verifier(edits, edit_chars), "line bigint, no_id boolean, doc_id bigint, line_no bigint, distance bigint")
        near = near.groupBy("line").agg(F.min(F.struct(F.struct("no_id", "doc_id", "line_no").alias("p"), "distance")).alias("near"))
        each = self.lines.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n"))
        self.known = written(each.join(near, "line", "left").where("n > 1 or near is not null").select("line", "first", "near"), "known")
        dropped(shared)

    def rows(self) -> DataFrame:
        """``doc_id, line_no, line, source, distance`` of every line that repeats an earlier one."""
        own = F.struct("no_id", "doc_id", "line_no")
        all_ = self.lines.select("doc_id", "line_no", "line", own.alias("own")).join(self.known, "line").where((F.col("own") != F.col("first")) | F.col("near").isNotNull())
        return all_.select("doc_id", "line_no", "line", F.coalesce("near.p", "first").alias("source"), F.coalesce("near.distance", F.lit(0).cast("bigint")).alias("distance"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """``doc_id, line_no, line, source_doc_id, source_line_no, distance`` for each line that repeats an earlier one:
    the earliest line of the table within the edits that are allowed, one for each ``edit_chars`` characters of the
    shorter line and ``edits`` at most.

    Lines are what newlines part, without the ASCII white space around them; blank ones are no lines, but count in
    ``line_no`` (from 0). Order is by doc_id, then line_no; null ids come last. Lines under ``edit_chars`` characters
    repeat only equal ones. Rows with the same doc_id are one document: an equal line at the same place in both is
    the same line and no repetition. Null and empty texts have no lines; very long texts and lines are taken whole; an
    empty table gives an empty one; other columns are ignored, whatever their names. ``line`` is the line's 64-bit hash.

    Texts are read twice. First every line's segment and probe hashes meet by key, a line's once from each partition.
    Then every line's place is written down, with the text of those that a filter of the candidates' hashes lets
    through, and these are verified where they share a key. That is the plan at every size; beyond 13 million candidate
    lines the filter, which is bounded, lets more and more texts through."""
    found = Repeats(docs, id_col, text_col, edits, edit_chars).rows()
    return found.select("doc_id", "line_no", "line", F.col("source.doc_id").alias("source_doc_id"), F.col("source.line_no").alias("source_line_no"), "distance")


#: Bytes of a known line where it is sent to the workers: hash, place, marks.
_KNOWN_BYTES = 26


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """``docs`` without the lines that ``repeated_lines`` finds, and without the rows that this leaves no line; see
    there for nulls, empty and very long texts, ties, repeated rows and empty tables.

    What stays of a text is unchanged; a text without lines stays as it is. All columns stay, whatever their names.

    While the lines that occur more than once or near another are few enough to be sent (they are counted), each
    document finds its own among them and no document moves; beyond that each document's list joins it by id."""
    repeats = Repeats(docs, id_col, text_col, edits, edit_chars)
    names, place, width = docs.columns, docs.columns.index(text_col), len(docs.columns)

    def cut(batch: pa.RecordBatch, gone) -> pa.RecordBatch:
        """The batch without the lines that ``gone(lines, first row)`` marks."""
        column = batch.column(place)
        data, offsets = string_buffers(column)
        texts, keep = column.to_pylist(), np.ones(batch.num_rows, bool)
        for a, b in steps(offsets):
            lines = Lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out = gone(lines, a)
            for r in np.unique(lines.row[out]):
                low, high = np.searchsorted(lines.row, [r, r + 1])
                number = set(lines.number[low:high][out[low:high]].tolist())
                keep[a + r] = not out[low:high].all()
                texts[a + r] = "\n".join(x for k, x in enumerate(texts[a + r].split("\n")) if k not in number)
        columns = [*batch.columns[:width]]
        columns[place] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    schema = StructType([*docs.schema.fields])
    own = F.col(id_col).cast("bigint")
    number, hashes, row_id = (free_name(names, x) for x in ("number", "hashes", "row_id"))
    whole = docs.withColumn(text_col, F.col(text_col).cast("string"))
    if repeats.known.count() * _KNOWN_BYTES <= SENT_BYTES:
        known = repeats.known.select("line", "first.doc_id", "first.line_no", F.col("near").isNotNull().alias("near")).toArrow()
        line = known.column(0).to_numpy()
        by = np.argsort(line)
        line, no_id = line[by], known.column(1).is_null().to_numpy()[by]
        doc, line_no, near = known.column(1).fill_null(0).to_numpy()[by], known.column(2).to_numpy()[by], known.column(3).to_numpy()[by]

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(width)
                no, value = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()

                def gone(lines: Lines, first: int) -> np.ndarray:
                    hash_, row = lines.hash.view(np.int64), lines.row + first
                    at = np.minimum(np.searchsorted(line, hash_), max(0, len(line) - 1))
                    if not len(line):
                        return np.zeros(len(hash_), bool)
                    earliest = (doc[at] == value[row]) & (no_id[at] == no[row]) & (line_no[at] == lines.number)
                    return (line[at] == hash_) & (near[at] | ~earliest)

                yield cut(batch, gone)

        return whole.withColumn(row_id, own).mapInArrow(sent, schema)
    lists = repeats.rows().groupBy(F.col("doc_id").alias(row_id)).agg(F.collect_set(F.struct("line_no", "line")).alias("g"))
    lists = lists.select(row_id, F.col("g.line_no").alias(number), F.col("g.line").alias(hashes))
    joined = whole.join(lists, own.eqNullSafe(F.col(row_id)), "left").select(*names, number, hashes)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, lines_ = batch.column(width), batch.column(width + 1)

            def gone(lines: Lines, first: int) -> np.ndarray:
                out = np.zeros(len(lines.row), bool)
                for r in np.unique(lines.row):
                    if numbers[first + r].is_valid:
                        drop = set(zip(numbers[first + r].as_py(), lines_[first + r].as_py()))
                        low, high = np.searchsorted(lines.row, [r, r + 1])
                        out[low:high] = [x in drop for x in zip(lines.number[low:high].tolist(), lines.hash.view(np.int64)[low:high].tolist())]
                return out

            yield cut(batch, gone)

    return joined.mapInArrow(listed, schema)
