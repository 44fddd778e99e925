"""Histories of runs: one partition of JSON per run, replaced as a whole.  K06 of the survey.

A run is written to its own partition, so writing it again, or a task of it again, changes nothing else and leaves no second
row.  Evaluations that come later rewrite the partitions of their runs only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import checkpointed

_RUN = "_run"


def write_runs(rows: DataFrame, path: str, run: str = "run_id") -> None:
    """Writes each run's rows as its partition, in place of what the partition held; other runs stay as they are."""
    dealt = rows.withColumn(_RUN, F.col(run)).repartition(F.col(_RUN))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_RUN).json(path)


def runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the history; columns that a run was written without are null, broken lines are dropped."""
    found = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return found.where("_broken is null").drop("_broken", _RUN)


def upserted(history_rows: DataFrame, evaluations: DataFrame, key: str = "run_id") -> DataFrame:
    """History rows with the evaluation columns of the same run in place of their own."""
    new = [c for c in evaluations.columns if c != key]
    renamed = evaluations.select(key, *(F.col(c).alias(f"_new_{c}") for c in new), F.lit(True).alias("_has"))
    rows = history_rows.join(renamed, key, "left")
    old = lambda c: F.col(c) if c in history_rows.columns else F.lit(None)
    value = lambda c: F.when(F.col("_has"), F.col(f"_new_{c}")).otherwise(old(c))
    return rows.select(*(F.col(c) for c in history_rows.columns if c not in new), *(value(c).alias(c) for c in new))


def evaluate_runs(spark: SparkSession, path: str, evaluations: DataFrame, schema: str, run: str = "run_id") -> None:
    """Puts the evaluations (run, columns of the schema) into the history's rows of these runs; unknown runs are passed over.

    What is read is written to the shared folder first, as its partitions are then replaced.
    """
    once = evaluations.dropDuplicates([run])
    theirs = runs(spark, path, schema).join(once.select(run), run, "left_semi")
    write_runs(checkpointed(upserted(theirs, once, run)), path, run)


def failed_checks(checks: Column) -> Column:
    """How many of an array of checks (passed) failed; a missing one counts as failed."""
    return F.size(F.filter(checks, lambda c: ~F.coalesce(c["passed"], F.lit(False))))
