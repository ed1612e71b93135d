"""Five stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage needs ``doc_id`` and ``text`` and keeps all other columns, whatever their names; an empty table stays empty;
texts are taken whole however long. Null and empty texts: the quality rules drop documents without words; stages that
get one all the same keep it, as nothing in it repeats or leaks, and packing gives it no room. Null ids count last in
every order. Ties: of equal lines and documents the one with the least id stays, of repeated rows one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.llm import decontamination, line_dedup, near_duplicates, packing, quality_rules
from murmurlake.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules pass; repeated rows are judged each."""
    return quality_rules.quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; those that this leaves nothing go. ``n_chars``, if there is
    such a column, is counted anew (null where the text is)."""
    out = line_dedup.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and those without words."""
    return near_duplicates.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``; without items all stay."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens go: sequence, place in the document, count, cost; ties by id, then by place."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near),
    ("benchmark decontamination", benchmark),
    ("packing", packed),
]

#: No SQL expresses greedy packing or suffix arrays; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
