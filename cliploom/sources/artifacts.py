"""Keyed artifact and cache tables: screening rows, transcripts and model results kept between runs.  K02-K04, S06-S09 of the survey.

A table is parquet in folders by the first two hex digits of its keys' hash, so a look-up reads the folders of its keys only.
Runs append; of the rows that runs wrote for a key, those of the latest run count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import rounded

#: Columns that a table has beside its rows' own.
KEY, RUN, SHARD = "cache_key", "run", "shard"


def artifact_key(asset_id: Column, proxy_path: Column) -> Column:
    """The name of an asset's screening artifact: its id and the first ten hex digits of the MD5 of its proxy's path."""
    return F.concat(asset_id.cast("string"), F.lit("-"), F.substring(F.md5(proxy_path), 1, 10))


def _shard(key: Column) -> Column:
    return F.substring(F.md5(key), 1, 2)


def store(rows: DataFrame, path: str, run: int) -> None:
    """Appends rows (cache_key and their own columns) as those of a run."""
    rows.withColumns({RUN: F.lit(run).cast("long"), SHARD: _shard(F.col(KEY))}).repartition(SHARD).write.mode("append").partitionBy(SHARD).parquet(path)


def looked_up(spark: SparkSession, path: str, keys: DataFrame, schema: str | None = None) -> DataFrame:
    """The stored rows of the wanted keys (a frame with cache_key), of the latest run that wrote each key."""
    reader = spark.read.schema(f"{schema}, {RUN} long, {SHARD} string") if schema else spark.read
    wanted = keys.select(KEY).distinct().withColumn("_shard", _shard(F.col(KEY)))
    found = reader.parquet(path).withColumn("_s", F.col(SHARD).cast("string"))
    found = found.join(wanted.withColumnRenamed(KEY, "_key"), (F.col("_s") == F.col("_shard")) & (F.col(KEY) == F.col("_key")), "left_semi")
    latest = F.max(RUN).over(Window.partitionBy(KEY))
    return found.withColumn("_latest", latest).where(F.col(RUN) == F.col("_latest")).drop("_latest", "_s", RUN, SHARD)


def screening_rows(cache: DataFrame, key: Column | str, metrics: list[str], schema_version: int = 1) -> DataFrame:
    """Cached screening rows of the schema version and compatibility key; an asset with a malformed row is a miss as a whole.

    Malformed is a row without a time, with a time under 0, or with a metric that is missing or no number.  Times are
    rounded to 3 places again, metrics to 4.
    """
    rows = cache.where((F.col("schema_version") == schema_version) & (F.col("compatibility_key") == key))
    odd = F.col("timestamp_sec").isNull() | (F.col("timestamp_sec") < 0)
    for m in metrics:
        odd = odd | F.col(m).isNull() | F.isnan(F.col(m).cast("double"))
    whole = rows.withColumn("_bad", F.max(odd).over(Window.partitionBy("asset_id"))).where("not _bad").drop("_bad")
    return whole.withColumns({"timestamp_sec": rounded("timestamp_sec", 3)} | {m: rounded(m, 4) for m in metrics})


def last_row(history: DataFrame, order: str, run: str = "run_id") -> DataFrame:
    """The latest row of a history; a top-1, no full sort."""
    return history.orderBy(F.desc(order), F.desc(run)).limit(1)
