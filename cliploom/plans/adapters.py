"""Domain frames out of the supplied tables.  Arithmetic is plain, so SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators.scoring import projected_metrics, signal_score
from ..sources.scratch import shares

#: Lines of orders that one task groups.
TASK_LINES = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows that are few bytes but much work each, dealt over four tasks a core: a file of narrow rows is one task's scan,
    however many rows it holds, and a stated number isn't put together again by size."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip per customer: asset_id, asset_name, duration_sec, has_speech."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("asset_id"), F.col("c_name").alias("asset_name"), (F.lit(6.0) + F.col("c_custkey") % 40).alias("duration_sec"), (F.col("c_custkey") % 3 == 0).alias("has_speech"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment per order, with metrics from its lines; orders without lines have null metrics."""
    cents = lambda c: F.sum(F.floor(F.col(c) * 100 + 0.5).cast("long"))
    lines = table(spark, sf_dir, "lineitem")
    # An order's lines meet before they are counted: tasks by the rows, as narrow rows that are grouped by (order, supplier)
    # take many times their bytes, and as many of them as a file split or a shuffle partition holds were one task's.
    tasks = max(spark.sparkContext.defaultParallelism, shares(lines.count(), TASK_LINES))
    lines = lines.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_quantity").alias("qty"),
        cents("l_discount").alias("disc"),
        cents("l_tax").alias("tax"),
        F.countDistinct("l_suppkey").alias("supp"),
        F.count_if(F.col("l_returnflag") == "R").alias("r"),
        F.count_if(F.col("l_linestatus") == "O").alias("o"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(assets(spark, sf_dir), F.col("o_custkey") == F.col("asset_id"))
    n = F.col("n")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("asset_id").orderBy("o_orderkey")))
    rows = rows.withColumn("start_sec", 2.0 * (F.col("pos") - 1)).withColumn("end_sec", F.col("start_sec") + 1.5 * F.coalesce(n, F.lit(0)))
    rows = rows.withColumns(
        {
            "sharpness": rounded(F.col("qty") / (50 * n), 4),
            "stability": rounded(1 - 5.0 * F.col("disc") / (100 * n), 4),
            "visual_novelty": rounded(F.col("supp") / n, 4),
            "subject_clarity": rounded(12.5 * F.col("tax") / (100 * n), 4),
            "motion_energy": rounded(F.col("r") / n, 4),
            "speech_ratio": rounded(F.col("o") / n, 4),
            "audio_energy": rounded(F.least(F.lit(1.0), F.col("o_totalprice") / 500000), 4),
        }
    )
    rows = rows.withColumn("prefilter_score", F.when(n.isNotNull(), rounded(signal_score(F.col("sharpness"), F.col("stability"), F.col("motion_energy"), F.col("visual_novelty"), F.col("subject_clarity")), 4)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = rows.withColumns(projected_metrics(zero("prefilter_score"), zero("subject_clarity"), zero("motion_energy"), zero("visual_novelty"), F.col("end_sec") - F.col("start_sec")))
    return rows.select(
        "asset_id", "asset_name", "duration_sec", "has_speech", F.col("o_orderkey").alias("segment_id"), "pos", "start_sec", "end_sec",
        "sharpness", "stability", "visual_novelty", "subject_clarity", "motion_energy", "speech_ratio", "audio_energy", "prefilter_score",
        "duration_fit", "hook_strength", "story_alignment", F.when(F.col("o_orderpriority") == "1-URGENT", "urgent order").otherwise("").alias("transcript_excerpt"),
    )


def seconds(ts: str) -> Column:
    """Seconds since 2024-01-01 in whole milliseconds, without a time zone."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts})")
    return F.floor(micros / 1000) / F.lit(1000.0)


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audio rows: asset_id, event_id, t, rms_energy, is_silent."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("asset_id"), "event_id", seconds("ts").alias("t"), rounded(F.least(F.lit(1.0), F.col("value") / 500), 4).alias("rms_energy"), (F.col("value") < 5).alias("is_silent"))


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ranges that last their value in minutes."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id"), "event_id", seconds("ts").alias("start_sec"), "value", F.col("event_type").alias("text"))
    return e.withColumn("end_sec", F.col("start_sec") + F.floor(F.col("value") * 100 + 0.5) * 0.6).drop("value")


def ranges(spark: SparkSession, sf_dir: str, step: float = 129600.0, width: float = 20000.0) -> DataFrame:
    """asset_id, range_id, start_sec, end_sec: the same tumbling ranges for each user of events, up to the last event."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.floor(F.max(seconds("ts")) / step).cast("int").alias("_last")).withColumn("_one", F.lit(1))
    rows = events.select(F.col("user_id").alias("asset_id"), F.lit(1).alias("_one")).distinct().join(last, "_one")
    rows = rows.select("asset_id", F.explode(F.sequence(F.lit(0), "_last")).alias("range_id"))
    return rows.withColumns({"start_sec": F.col("range_id") * step, "end_sec": F.col("range_id") * step + width})


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as transcript spans: one every 4 seconds, lasting a second per 100 characters up to 3.5."""
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 4.0
    return c.select(F.col("conv_id").alias("asset_id"), "turn", "role", start.alias("start_sec"), (start + F.least(F.lit(3.5), F.ceil(F.length("text") / 25) * 0.25)).alias("end_sec"), "text")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as media paths: even keys in Originals, odd ones in Proxy."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    name = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.regexp_replace("p_brand", "#", "-"))
    even = F.col("p_partkey") % 2 == 0
    tail = F.when(F.col("p_partkey") % 3 == 0, "mov").otherwise("mp4")
    path = F.when(even, F.concat(F.lit("/media/Originals/"), F.col("p_partkey").cast("string"), F.lit("/"), name, F.lit("."), tail)).otherwise(F.concat(F.lit("/media/Proxy/"), F.col("p_partkey").cast("string"), F.lit("/"), name, F.lit("_proxy.mp4")))
    return p.select("p_partkey", "p_name", "p_brand", path.alias("path"), F.col("p_size").cast("double").alias("duration_sec"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 4 + 22.0).alias("fps"))
