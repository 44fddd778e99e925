"""Media listings and captured probes.  S01-S04, S16, S18, S20 of the survey.

Probes and logs are read from what the programs wrote, which `programs` captures on the executors.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import parsed_float
from ..functions.text import VIDEO_EXTENSIONS, clip_key, file_extension, file_name, file_stem, full_timecode, media_role, timecode_of


def media_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """path, name, stem, ext, role, clip_key, length of the video files under the roots; local roots that are missing are skipped.

    Only the listing is read, never the content.
    """
    present = [r for r in roots if "://" in r or os.path.isdir(r)]
    if not present:
        return spark.createDataFrame([], "path string, name string, stem string, ext string, role string, clip_key string, length long")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(present).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")
    found = found.where(file_extension("path").isin(*VIDEO_EXTENSIONS))
    stem = file_stem("path")
    return found.select("path", file_name("path").alias("name"), stem.alias("stem"), file_extension("path").alias("ext"), media_role("path").alias("role"), clip_key(stem).alias("clip_key"), "length")


def video_count(spark: SparkSession, root: str) -> int:
    return media_files(spark, [root]).count()


PROBE = "struct<streams:array<struct<codec_type:string,avg_frame_rate:string,width:int,height:int,tags:map<string,string>>>,format:struct<duration:string,tags:map<string,string>>>"
TAGS = "array<map<string,string>>"


def probed(captures: DataFrame, json: str = "json") -> DataFrame:
    """Adds duration_sec, fps, width, height, has_audio and timecode from stream-style probe output."""
    rows = captures.withColumn("_p", F.from_json(json, PROBE))
    video = F.get(F.filter("_p.streams", lambda s: s["codec_type"] == "video"), 0)
    audio = F.filter("_p.streams", lambda s: s["codec_type"] == "audio")
    tag = lambda holder: F.try_element_at(holder, F.lit("timecode"))
    code = F.coalesce(full_timecode(tag(video["tags"])), full_timecode(tag(F.get("_p.streams", 0)["tags"])), full_timecode(tag(F.col("_p.format.tags"))))
    return rows.withColumns({"duration_sec": parsed_float(F.col("_p.format.duration")), "fps": parsed_float(video["avg_frame_rate"]), "width": video["width"], "height": video["height"], "has_audio": F.size(audio) > 0, "timecode": code}).drop("_p")


def tag_probed(captures: DataFrame, json: str = "json") -> DataFrame:
    """The same columns from tag-style output (the first element of a list)."""
    rows = captures.withColumn("_t", F.get(F.from_json(json, TAGS), 0))
    tag = lambda *names: F.coalesce(*(F.try_element_at(F.col("_t"), F.lit(n)) for n in names))
    whole = lambda x: x.try_cast("int")
    has_audio = tag("AudioChannels", "AudioFormat").isNotNull()
    return rows.withColumns({"duration_sec": parsed_float(tag("Duration")), "fps": parsed_float(tag("VideoFrameRate", "FrameRate")), "width": whole(tag("ImageWidth", "SourceImageWidth")), "height": whole(tag("ImageHeight", "SourceImageHeight")), "has_audio": has_audio, "timecode": F.coalesce(full_timecode(tag("TimeCode", "StartTimecode")), timecode_of(tag("CreationDateValue", "DateTimeOriginal")))}).drop("_t")


def silence_rows(log: DataFrame, key: str = "asset_id", order: str = "line_no", line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(silences, samples) out of a text log: silence intervals (an open one never ends) and (t, rms) pairs.

    Of two silence starts in a row the later one counts, an end without a start does not.  A level line belongs to the last
    time stamp before it, and only the first one that is a number, inf or nan does; the latter two are silence.
    """
    from pyspark.sql import Window

    from ..operators.signals import linear_from_db

    found = lambda pattern: F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    number = lambda pattern: found(pattern).try_cast("double")
    real = r"([-+0-9.eE]+)"
    level = found(r"RMS_level=([-+0-9.eEinfa]+)")
    none = level.contains("inf") | level.contains("nan")
    rows = log.withColumns({"_s": number(rf"silence_start:\s*{real}"), "_e": number(rf"silence_end:\s*{real}"), "_t": number(rf"pts_time:{real}"), "_rms": F.when(none, F.lit(0.0)).when(level.try_cast("double").isNotNull(), linear_from_db(level.try_cast("double")))})
    w = Window.partitionBy(key).orderBy(order)
    events = rows.where("_s is not null or _e is not null").withColumns({"_end": F.lead("_e").over(w), "_last": F.lead(F.lit(True)).over(w).isNull()})
    starts = events.where("_s is not null and (_end is not null or _last)")
    silences = starts.select(key, F.col("_s").alias("start_sec"), F.coalesce("_end", F.lit(float("inf"))).alias("end_sec"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    timed = rows.withColumns({"_at": F.last("_t", ignorenulls=True).over(so_far), "_stamp": F.count("_t").over(so_far)}).where("_rms is not null and _at is not null")
    one = timed.withColumn("_turn", F.row_number().over(Window.partitionBy(key, "_stamp").orderBy(order))).where("_turn = 1")
    return silences, one.select(key, F.col("_at").alias("t"), F.col("_rms").alias("rms"))
