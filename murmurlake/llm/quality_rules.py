"""Quality rules: repetition coverage from rolling hashes of several n-gram lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import Words, mix, prepare, repeated, steps, string_buffers

#: Longest share of a document's characters that may lie in repeated n-grams, by n (published repetition filters).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Longest share of the lines' characters that may lie in lines that the document had before.
LINE_CHARS_LIMIT = 0.20


def later(values: np.ndarray) -> np.ndarray:
    """Which values have occurred before."""
    out = np.ones(len(values), bool)
    out[np.unique(values, return_index=True)[1]] = False
    return out


def measure(words: Words, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts for each row; of what repeats, all occurrences but the first count, overlapping ones once."""
    data, rows = words.data, len(words.offsets) - 1
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    size = chars[words.end] - chars[words.start]
    out = {"n_words": np.diff(words.first), "word_chars": np.bincount(words.doc, size, rows).astype(np.int64)}

    salt = mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))
    open_at = None  # a repeated n-gram begins with a repeated shorter one
    for n in sorted(lengths):
        at, h = words.ngrams(n)
        if open_at is not None:
            keep = open_at[at]
            at, h = at[keep], h[keep]
        hit = at[repeated(h ^ salt[words.doc[at]])]
        open_at = np.zeros(len(words.hash), bool)
        open_at[hit] = True
        hit = hit[later((h ^ salt[words.doc[at]])[open_at[at]])]
        edge = np.zeros(len(words.hash) + 1, np.int32)
        edge[hit] += 1
        np.subtract.at(edge, hit + n, 1)
        covered = np.cumsum(edge[:-1]) > 0
        out[f"dup_{n}"] = np.bincount(words.doc[covered], size[covered], rows).astype(np.int64)

    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=ends[1:])
    line = ends[words.start]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (words.doc[1:] != words.doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(line)) - 1 if len(first) else first
    doc = words.doc[first]
    start, end = words.start[first], words.end[last]
    length = chars[end] - chars[start]
    again = later(words.span_hash(start, end) ^ salt[doc])
    out["line_chars"] = np.bincount(doc, length, rows).astype(np.int64)
    out["dup_line_chars"] = np.bincount(doc[again], length[again], rows).astype(np.int64)
    return out


def shares(counts: dict[str, np.ndarray], limits: dict[int, float]) -> dict[str, np.ndarray]:
    part = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    out = {f"dup_{n}gram_share": part(counts[f"dup_{n}"], counts["word_chars"]) for n in limits}
    out["dup_line_char_share"] = part(counts["dup_line_chars"], counts["line_chars"])
    keep = (counts["n_words"] > 0) & (out["dup_line_char_share"] <= LINE_CHARS_LIMIT)
    for n, most in limits.items():
        keep &= out[f"dup_{n}gram_share"] <= most
    return out | {"keep": keep}


def judged(column: pa.Array, limits: dict[int, float]) -> dict[str, np.ndarray]:
    """Measures of a whole Arrow column, made in steps of bounded size."""
    data, offsets = string_buffers(column)
    parts = []
    for a, b in steps(offsets):
        counts = measure(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), tuple(limits))
        parts.append({"n_words": counts["n_words"]} | shares(counts, limits))
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def repetition_coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, float] = NGRAM_LIMITS) -> DataFrame:
    """One row for each row of ``docs``: its share of characters in n-grams and lines that the
    text had before, and whether it passes.

    Words are runs of non-white-space; shares of n-grams are of the words' characters, shares of lines of the
    trimmed, non-empty lines. Null and blank texts have shares 0 and fail: there is nothing to keep. Texts of fewer
    than n words have no n-gram. Repeated rows are judged each; a null id stays null; other columns are ignored.
    An empty table gives an empty one. Map only: no shuffle."""
    prepare(docs.sparkSession)
    names = [f"dup_{n}gram_share" for n in limits] + ["dup_line_char_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = judged(batch.column(1), limits)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got["n_words"], pa.int64()), *(pa.array(got[k], pa.float64()) for k in names), pa.array(got["keep"], pa.bool_())], ["doc_id", "n_words", *names, "keep"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_words bigint, " + ", ".join(f"{k} double" for k in names) + ", keep boolean")


def quality_filter(docs: DataFrame, text_col: str = "text", limits: dict[int, float] = NGRAM_LIMITS) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; see ``repetition_coverage``."""
    prepare(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(judged(batch.column(place), limits)["keep"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


_WORDS = r"list_filter(regexp_split_to_array({text}, '[ \t\n\r\f\v]+'), lambda x: x <> '')"
_LINES = r"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"


def sql(docs: str = "documents", limits: dict[int, float] = NGRAM_LIMITS) -> str:
    """The same measures in DuckDB SQL."""
    w, lines = _WORDS.format(text="coalesce(text, '')"), _LINES.format(text="coalesce(text, '')")
    grams = ",\n".join(
        f"""g{n} AS MATERIALIZED (
  SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY r, g ORDER BY i) AS c FROM (
    SELECT r, unnest(range(1, len(ws) - {n - 2})) AS i, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda j: array_to_string(ws[j:j + {n - 1}], ' '))) AS g FROM w WHERE len(ws) >= {n}
  )) WHERE c > 1),
c{n} AS MATERIALIZED (SELECT r, sum(length(ws[p])) AS chars FROM (SELECT DISTINCT r, unnest(range(i, i + {n})) AS p FROM g{n}) JOIN w USING (r) GROUP BY r)"""
        for n in limits
    )
    joins = "\n".join(f"LEFT JOIN c{n} ON c{n}.r = w.r" for n in limits)
    shares_ = ",\n".join(f"coalesce(coalesce(c{n}.chars, 0) / nullif(w.word_chars, 0), 0.0)::DOUBLE AS dup_{n}gram_share" for n in limits)
    keep = " AND ".join(f"dup_{n}gram_share <= {most}" for n, most in limits.items())
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM {docs}),
w AS MATERIALIZED (SELECT r, doc_id, {w} AS ws, length(array_to_string({w}, '')) AS word_chars, {lines} AS ls FROM d),
{grams},
l AS MATERIALIZED (SELECT r, count(*) AS n, sum(length(line)) AS chars, coalesce(sum(length(line)) FILTER (c > 1), 0) AS dup_chars
  FROM (SELECT r, line, row_number() OVER (PARTITION BY r, line) AS c FROM (SELECT r, unnest(ls) AS line FROM w)) GROUP BY r),
m AS (SELECT w.doc_id, w.r, len(w.ws)::BIGINT AS n_words, {shares_},
  coalesce(l.dup_chars / l.chars, 0.0)::DOUBLE AS dup_line_char_share
  FROM w LEFT JOIN l ON l.r = w.r {joins})
SELECT * EXCLUDE (r), (n_words > 0 AND dup_line_char_share <= {LINE_CHARS_LIMIT} AND {keep}) AS keep FROM m"""
