"""Session settings and vectorised word splitting over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.functions.shared import SENT_BYTES, importable
from murmurlake.functions.shared import dropped as dropped
from murmurlake.functions.shared import written as written

#: Rows and bytes of one Arrow batch sent to a Python worker; a worker's memory follows from these, not from the data.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
#: Text bytes that one vectorised step works on; one longer document is a step of its own.
STEP_BYTES = 2 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that long documents don't add up in a worker, and let workers import this package."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_name(columns: list[str], name: str) -> str:
    """``name``, drawn out until no column has it (Spark doesn't tell capitals from small letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sent_if_small(table: DataFrame, row_bytes: int) -> DataFrame:
    """A written table with a broadcast hint if its rows, which are counted, add up to ``SENT_BYTES`` at most; beyond
    that Spark plans a join of both sides by key."""
    return F.broadcast(table) if table.count() * row_bytes <= SENT_BYTES else table


class Recent:
    """Hashes that a task met lately, in a table of fixed size: what it has forgotten is sent again, which costs a row
    and changes nothing. Copies that stand in one partition so leave it once."""

    def __init__(self, bits: int = 20):
        self.shift, self.slots = np.uint64(64 - bits), np.zeros(1 << bits, np.uint64)

    def new(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the different ``hashes`` aren't remembered; they are from now on."""
        at = (hashes >> self.shift).astype(np.int64)
        out = self.slots[at] != hashes
        self.slots[at] = hashes
        return out


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, one row at least."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


#: Schema of vectors to be added up, and how many a task adds in one step of the tree.
VECTOR, FAN = "part int, values binary", 16


def vector(values: np.ndarray) -> pa.RecordBatch:
    """A partition's float32 vector as its one row."""
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([values.astype(np.float32).tobytes()], pa.binary())], ["part", "values"])


def summed(parts: DataFrame) -> np.ndarray | None:
    """Sum of the vectors of partitions (``VECTOR``, at most one row each), ``FAN`` to a task and level by level, so
    that neither a task nor the driver ever holds more than two; None if there are none.

    Rows are added in the order of their partitions, so a task that is repeated gives the same."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(1):
                values = np.frombuffer(raw.as_buffer(), np.float32)
                total = values.copy() if total is None else np.add(total, values, out=total)
        if total is not None:
            yield vector(total)

    n = parts.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN)
        parts = parts.repartition(n, F.floor(F.col("part") / FAN)).sortWithinPartitions("part").mapInArrow(add, VECTOR)
    rows = parts.collect()
    return np.frombuffer(rows[0]["values"], np.float32) if rows else None


_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the rolling hash's base (or of its inverse) modulo 2^64."""
    key = "inverse" if inverse else "base"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        steps_ = np.full(max(n, 1 << 16), np.uint64(_INVERSE if inverse else _BASE))
        steps_[0] = 1
        have = _POWERS[key] = np.cumprod(steps_, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit moves every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The white-space separated words of a run of documents: byte spans, document numbers and 64-bit hashes.

    ``start``, ``end``: byte spans in ``data``; ``doc``: row number of each word; ``hash``: of the word's bytes;
    ``first``: n+1 word offsets of the rows; ``prefix``: rolling hash of the bytes before each position."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data, self.offsets = data, offsets
        rows = len(offsets) - 1
        word = np.ones(n + 1, bool)
        word[:n] = (data > 32) | ((data < 9) | ((data > 13) & (data < 32)))
        word[n] = False
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n + 1, bool)
        before[0], before[1:] = False, word[:n]
        self.start = np.flatnonzero(word & (~before | edge))
        self.end = np.flatnonzero(before & (~word | edge))
        self.doc = np.searchsorted(offsets, self.start, "right") - 1 if rows else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.doc, np.arange(rows + 1))
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * powers(n), out=prefix[1:])
        self.prefix = prefix
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span, wherever it stands."""
        inverse = powers(len(self.data) + 1, True)
        return mix((self.prefix[end] - self.prefix[start]) * inverse[start] + (end - start).astype(np.uint64))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of each n-gram that stays within its row, and the n-gram's rolling hash."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        roll = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * powers(len(self.hash)), out=roll[1:])
        at = np.flatnonzero(self.doc[: m] == self.doc[n - 1 :])
        return at, mix((roll[at + n] - roll[at]) * powers(m, True)[at])


def repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    if len(values) < 2:
        return np.zeros(len(values), bool)
    order = np.sort(values)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return np.zeros(len(values), bool)
    again = np.unique(again)
    near = np.zeros(1 << 16, bool)
    near[(again >> np.uint64(48)).astype(np.int64)] = True
    out = near[(values >> np.uint64(48)).astype(np.int64)]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(again, values[at]), len(again) - 1)
    out[at] = again[place] == values[at]
    return out
