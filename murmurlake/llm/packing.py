"""Cost-balanced packing of documents into sequences of bounded tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import prepare, written
from murmurlake.llm.token_counts import RANKS_PATH, token_counts

#: Tokens of a sequence; cost of a token and of a pair of tokens in one document (attention's part of the work of a
#: layer of width 2048).
CAPACITY, LINEAR, QUADRATIC = 4096, 1.0, 1.0 / (6 * 2048)
#: Pieces that are packed together; packings of so many are independent, whatever the input's size.
GROUP_ROWS = 20_000

SCHEMA = "sequence_id bigint, doc_id bigint, piece int, first_token bigint, n_tokens bigint, cost double"


def assign(tokens: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Sequence number of each of the descending ``tokens``: of the sequences with room the one of lowest cost so far
    (the first on ties), a new one where none has room. As many as the tokens fill at least are open from the start."""
    open_ = max(1, -(-int(tokens.sum()) // capacity)) if len(tokens) else 0
    room = np.full(open_ + len(tokens), capacity, np.int64)
    cost = np.zeros(len(room))
    out = np.empty(len(tokens), np.int64)
    each = linear * tokens + quadratic * tokens.astype(np.float64) ** 2
    for k, n in enumerate(tokens):
        fits = np.flatnonzero(room[:open_] >= n)
        if len(fits):
            at = fits[np.argmin(cost[fits])]
        else:
            at, open_ = open_, open_ + 1
        out[k] = at
        room[at] -= n
        cost[at] += each[k]
    return out


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, ranks_path: str) -> DataFrame:
    """``doc_id, piece, first_token, n_tokens``: documents cut where they exceed a sequence."""
    sized = token_counts(docs, id_col, text_col, ranks_path).withColumnRenamed("n_tokens", "tokens").where("tokens > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("tokens") - 1, F.lit(capacity).cast("bigint"))
    return sized.select("doc_id", "tokens", F.posexplode(starts).alias("piece", "first_token")).select("doc_id", "piece", "first_token", F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("first_token")).alias("n_tokens"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC, group_rows: int = GROUP_ROWS, ranks_path: str = RANKS_PATH) -> DataFrame:
    """One row for each piece of each document: the sequence it is in, its place in the document, its cost.

    Tokens are counted over the whole text under the vocabulary at ``ranks_path``. A text longer than ``capacity`` is
    cut into pieces of ``capacity`` and a rest. Null and empty texts have no tokens, take no room and have no row.
    Pieces go by hash into groups of about ``group_rows``, each packed on its own in descending order, ties by document
    and place, null ids last. Repeated rows are packed each. An empty table gives an empty one; other columns are
    ignored. Only ids and counts are shuffled."""
    prepare(docs.sparkSession)
    sized = written(pieces(docs, id_col, text_col, capacity, ranks_path), "pieces")
    groups = max(1, round(sized.count() / group_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], na_position="last", kind="stable")
        tokens = pdf["n_tokens"].to_numpy(np.int64)
        at = assign(tokens, capacity, linear, quadratic)
        return pd.DataFrame({"sequence_id": (pdf["pack"].to_numpy(np.int64) << 32) + at, "doc_id": pdf["doc_id"].astype("Int64"), "piece": pdf["piece"], "first_token": pdf["first_token"], "n_tokens": tokens, "cost": linear * tokens + quadratic * tokens.astype(np.float64) ** 2})

    spread = sized.withColumn("pack", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "piece"), F.lit(groups)))
    return spread.groupBy("pack").applyInPandas(run, SCHEMA)
