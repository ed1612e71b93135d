"""Token counts by byte-pair merging with a heap over a linked list; no token ids are made."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import prepare

#: A public byte-level vocabulary: lines of base64 token and rank.
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's tokenizer splits text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's memory of counted pieces; when full it starts afresh, so a worker's size is bounded.
MEMO_PIECES, MEMO_SEGMENTS, MEMO_CHARS = 500_000, 300_000, 48
#: White space beside white space (newlines aside) or of rare kinds: such texts aren't cut at their spaces.
_RUNS = "[ \\t\\r\\f][ \\t\\r\\f\\n]|\\n[ \\t\\r\\f]|[\\v\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged_length(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Symbols that are left of a piece's bytes when no adjacent pair has a rank: the bytes less the merges.

    ``after[i]`` is the end of the symbol that begins at i (0 once it is merged away) and ``before`` its left
    neighbour; a heap entry holds rank, begin and end of a pair and is stale once its symbols have changed."""
    n = len(piece)
    if n < 2:
        return n
    bits = n.bit_length() + 1
    low = (1 << bits) - 1
    find, after, before = ranks.get, list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if (rank := find(piece[i : i + 2])) is not None:
            heap.append((rank << bits | i) << bits | i + 2)
    heapify(heap)
    left = n
    while heap:
        pair = heappop(heap)
        end, begin = pair & low, (pair >> bits) & low
        middle = after[begin]
        if not 0 < middle < n or after[middle] != end:
            continue
        after[begin], after[middle] = end, 0
        left -= 1
        if end < n:
            before[end] = begin
            if (rank := find(piece[begin : after[end]])) is not None:
                heappush(heap, (rank << bits | begin) << bits | after[end])
        if (previous := before[begin]) >= 0 and (rank := find(piece[previous:end])) is not None:
            heappush(heap, (rank << bits | previous) << bits | end)
    return left


class Pieces(dict):
    """Counts of pieces, each merged when first seen."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        count = merged_length(piece.encode(), self.ranks)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = count
        return count


class Segments(dict):
    """Counts of what stands between two single spaces, its leading space included."""

    def __init__(self, ranks: dict[bytes, int]):
        self.piece, self.find = Pieces(ranks).__getitem__, regex.compile(PATTERN).findall

    def __missing__(self, segment: str) -> int:
        count = self.whole(" " + segment)
        if len(segment) <= MEMO_CHARS:
            if len(self) >= MEMO_SEGMENTS:
                self.clear()
            self[segment] = count
        return count

    def whole(self, text: str) -> int:
        return sum(map(self.piece, self.find(text)))

    def count(self, text: str, runs: bool) -> int:
        """Tokens of a text; the splitting never looks across a single space, so without runs segments add up."""
        if runs:
            return self.whole(text)
        head, *rest = text.split(" ")
        return self.whole(head) + sum(map(self.__getitem__, rest))


_COUNTERS: dict[str, Segments] = {}


def counter(path: str) -> Segments:
    """This worker's counter; it lives as long as the worker does."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Segments(load_ranks(path))
    return _COUNTERS[path]


def count_column(column: pa.Array, path: str) -> list[int]:
    column = pc.fill_null(column, "")
    runs = pc.match_substring_regex(column, _RUNS).to_pylist()
    count = counter(path).count
    return [count(text, run) for text, run in zip(column.to_pylist(), runs)]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS_PATH) -> DataFrame:
    """``doc_id, n_tokens`` for each row of ``docs``: its whole text's tokens under the vocabulary at ``ranks_path``.

    Null and empty texts have 0 tokens; repeated rows are counted each; a null id stays null; other columns are
    ignored; an empty table gives an empty one. Map only; the vocabulary is read from its file by each worker."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array(count_column(batch.column(1), ranks_path), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], ["doc_id", "n_tokens"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_tokens bigint")
