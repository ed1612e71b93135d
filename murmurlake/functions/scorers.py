"""Model scorers behind one seam: any function from texts to scores, applied to Arrow batches; rule-based fallbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from murmurlake.functions.shared import importable
from murmurlake.functions.text import probably_english

Scorer = Callable[[list[str]], list[dict[str, float]]]


def score_texts(df: DataFrame, text: str, labels: tuple[str, ...], scorer: Scorer, clip: int | None = None, batch: int = 16) -> DataFrame:
    """``df`` with a double column for each label, 0 where the scorer gives none. Blank texts aren't sent and get
    zeros. A scorer that answers with another number of rows is an error."""
    importable(df.sparkSession)
    columns = [*df.columns, *labels]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [(t or "")[:clip] if clip else (t or "") for t in pdf[text]]
            scores: list[dict[str, float]] = [{} for _ in texts]
            full = [i for i, t in enumerate(texts) if t.strip()]
            for a in range(0, len(full), batch):
                part = full[a : a + batch]
                got = scorer([texts[i] for i in part])
                if len(got) != len(part):
                    raise ValueError("a scorer must answer for every text")
                for i, s in zip(part, got):
                    scores[i] = s
            for label in labels:
                pdf[label] = [float(s.get(label, 0.0)) for s in scores]
            yield pdf[columns]

    schema = StructType([*df.schema.fields])  # adding to a frame's own schema would change the frame
    for label in labels:
        schema.add(label, "double")
    return df.mapInPandas(run, schema)


def keyword_scores(text: Column, keywords: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """Share of each label's keywords among all that a text holds: a fallback without a model, all in the JVM."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = {k: sum((low.contains(w).cast("int") for w in words), F.lit(0)) for k, words in keywords.items()}
    total = sum(counts.values(), F.lit(0))
    return {k: F.coalesce(c / F.nullif(total, F.lit(0)), F.lit(0.0)) for k, c in counts.items()}


def translate(df: DataFrame, translator: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Fills ``english_text`` and ``source_language``: what is translated stays; blank is ``und``; English is copied;
    the rest goes to the translator, text by text if a batch of it fails, and stays as it is if that fails too."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    done = F.trim(F.coalesce("english_text", F.lit(""))) != ""
    english = probably_english(F.col("text"))
    ruled = df.withColumns(
        {
            "source_language": F.when(done, F.col("source_language")).when(blank, "und").when(english, "en").otherwise(F.col("source_language")),
            "english_text": F.when(done | blank, F.col("english_text")).when(english, F.col("text")).otherwise(F.col("english_text")),
            "__open": ~done & ~blank & ~english,
        }
    )
    if translator is None:
        return ruled.drop("__open")
    importable(df.sparkSession)
    columns = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            todo = pdf.index[pdf["__open"]].tolist()
            try:
                for i, t in zip(todo, translator([pdf.at[i, "text"] for i in todo]) if todo else []):
                    pdf.at[i, "english_text"] = t
            except Exception:  # noqa: BLE001 - whatever a remote service raises
                for i in todo:
                    try:
                        pdf.at[i, "english_text"] = translator([pdf.at[i, "text"]])[0]
                    except Exception:  # noqa: BLE001
                        continue
            yield pdf[columns]

    return ruled.mapInPandas(run, df.schema)
