"""A training corpus from `documents`: quality rules, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents; the
last one adds what the mix takes of each document.  Stages keep extra columns of `docs` out of the way of their own, give no
rows for an empty table, and take repeated rows, rows that share an id, and very long texts as they come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from cliploom.llm.columns import checkpointed, table
from cliploom.llm.oracles import PIPELINE as ORACLE_SQL

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines.  Null, empty and blank texts fail; equal rows get equal verdicts."""
    return quality.clean(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten or more of them hold.

    A null text stays null, with n_chars null; rows with the same id and text are one document; a text may become empty.
    """
    rows = line_dedup.apply(docs, line_dedup.line_bitmaps(docs), counts=False)
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of linked ones; ids are of any type that can be ordered.

    Null and empty texts link with nothing and stay; of rows that share an id one stays; rows with a null id all stay.
    """
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark.  Null and empty texts are clean; an empty benchmark keeps all."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, epochs and taken.

    Texts without words take nothing and go; a null source is a source of its own; ties of the key go by id, size and text.
    """
    return mixing.mix(docs, keep=("text", "lang", "n_chars")).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminated),
    ("source_mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
