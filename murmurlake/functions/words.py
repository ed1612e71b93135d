"""The words of ``text``'s tokenisers for whole columns: texts are cleaned as bytes, and each different word of a batch
is judged once. Rules at the end of a text need no step of their own, as dashes around words go in any case."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from murmurlake.functions import text as T
from murmurlake.functions.shared import importable

#: Bytes of text that are split at once.
BYTES = 1 << 25

_URL, _MENTION, _HASHTAG = (re.compile(r.encode()) for r in (T.URL, T.MENTION, T.HASHTAG))


def _table(kept: bytes) -> bytes:
    return bytes(c if c in kept else 32 for c in range(256))


_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: What each kind keeps within words and strips around them, what a hashtag becomes, and short words that stay.
KINDS = {"phrase": (_table(_LETTERS + b"'"), "'", b" ", ("us", "un", "eu", "uk")), "lexical": (_table(_LETTERS + b"-"), "-", rb" \1 ", ())}


def cleaned(raw: bytes | None, kind: str) -> bytes:
    table, _, tag, _ = KINDS[kind]
    if not raw:
        return b""
    if b"http" in raw or b"www." in raw:
        raw = _URL.sub(b" ", raw)
    if b"@" in raw:
        raw = _MENTION.sub(b" ", raw)
    if b"#" in raw:
        raw = _HASHTAG.sub(tag, raw)
    if not raw.isascii():  # the two other letters that are a-z in lower case, and the apostrophe
        raw = raw.replace("K".encode(), b"k").replace("İ".encode(), b"i ")
        raw = raw.replace("’".encode(), b"'") if kind == "phrase" else raw
    return raw.lower().translate(table)


def split(texts: pa.Array, kind: str, stop: tuple[str, ...], least: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of words of each text, the different words, and which of these the words are."""
    _, around, _, keep = KINDS[kind]
    parts = pc.ascii_split_whitespace(pa.array([cleaned(t, kind) for t in texts.to_pylist()], pa.large_binary()).cast(pa.large_string()))
    ends = np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))
    found = parts.flatten().dictionary_encode()
    whole = pc.ascii_trim(found.dictionary, around).dictionary_encode()
    words = whole.dictionary
    good = pc.and_not(pc.greater_equal(pc.binary_length(words), least), pc.is_in(words, pa.array(stop, words.type)))
    good = pc.or_(good, pc.is_in(words, pa.array(keep, words.type))).to_numpy(zero_copy_only=False)
    which = whole.indices.to_numpy()[found.indices.to_numpy()] if len(words) else np.zeros(0, np.int32)
    stays = good[which] if len(words) else np.zeros(0, bool)
    before = np.concatenate(([0], np.cumsum(stays)))
    return np.diff(before[ends], prepend=0), words, which[stays]


def tokens(messages: DataFrame, columns: list[str], kind: str, stop: tuple[str, ...] = T.STOP_WORDS, least: int = 3, sizes: bool = False) -> DataFrame:
    """``columns`` and ``tokens`` of the messages with words; with ``sizes`` their number, ``n_tokens``, in place of them."""
    own = messages.select(*columns, F.col("text").cast("binary").alias("__text"))
    added = StructField("n_tokens", LongType()) if sizes else StructField("tokens", ArrayType(StringType()))
    schema = StructType([*own.drop("__text").schema, added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text")
            ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
            row = 0
            while row < len(ends):
                begun = int(ends[row - 1]) if row else 0
                end = max(row + 1, int(np.searchsorted(ends, begun + BYTES, "right")))
                n, words, which = split(texts[row:end], kind, stop, least)
                some = n > 0
                if sizes:
                    last = pa.array(n[some], pa.int64())
                else:
                    offsets = pa.array(np.concatenate(([0], np.cumsum(n[some]))), pa.int32())
                    last = pa.ListArray.from_arrays(offsets, words.take(pa.array(which)).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[row:end].filter(pa.array(some)) for c in columns), last], [*columns, added.name])
                row = end

    importable(messages.sparkSession)
    return own.mapInArrow(run, schema)
