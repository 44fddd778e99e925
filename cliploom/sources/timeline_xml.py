"""Timelines as interchange XML, written and read for all scopes at once.  K05, S19 of the survey.

A document is one row: Spark's XML functions write and read nested structs, so as many documents as there are scopes are made
and parsed in parallel, and nothing goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import rational_seconds, rational_time, timecode_seconds
from ..operators.sequence import offsets
from .scratch import checkpointed

_ASSET = "struct<_id:string,_name:string,_uid:string,_src:string,_start:string,_duration:string,_hasVideo:string,_hasAudio:string,_audioSources:string,_audioChannels:string,_format:string>"
_CLIP = "struct<_name:string,_ref:string,_offset:string,_start:string,_duration:string,_tcFormat:string,_enabled:string>"
#: What is read of a document; other elements and attributes are passed over.
_READ = f"resources struct<asset:array<{_ASSET}>>, library struct<event:struct<project:struct<sequence:struct<spine:struct<`asset-clip`:array<{_CLIP}>>>>>>"


def clips(items: DataFrame, takes: DataFrame, segments: DataFrame, assets: DataFrame, scope: str = "scope") -> DataFrame:
    """Items in order with offset, length, asset and start in the source (time code + segment start + trim)."""
    rows = offsets(items, scope).join(takes.select("take_id", "segment_id"), "take_id").join(segments.select("segment_id", "asset_id", "start_sec"), "segment_id").join(assets, "asset_id")
    base = timecode_seconds("source_timecode", "fps")
    return rows.withColumns({"length_sec": F.greatest(F.lit(0.0), F.col("trim_out_sec") - F.col("trim_in_sec")), "asset_start": base, "source_start": base + F.col("start_sec") + F.col("trim_in_sec")})


def file_uri(path: Column) -> Column:
    """file:// and the path, with all but unreserved characters and slashes escaped."""
    quoted = F.url_encode(path)
    for shown, wanted in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(shown), F.lit(wanted))
    return F.concat(F.lit("file://"), quoted)


def exported(rows: DataFrame, name: Column | str, scope: str = "scope", order: str = "order_index") -> DataFrame:
    """scope, xml: a format from the first clip's asset, one element per asset in the order of their first clips, clips in order.

    Missing frame rates and sizes are 24, 1920 and 1080; an asset without a reel goes by its name.
    """
    fps = F.coalesce(F.when(F.col("fps") > 0, F.col("fps")), F.lit(24.0))
    text = lambda c: F.col(c).cast("string")
    spoken = F.coalesce(F.col("has_speech"), F.lit(False)) if "has_speech" in rows.columns else F.lit(False)
    flag = lambda yes: F.when(spoken, yes).otherwise("0")
    start = F.col("asset_start") if "asset_start" in rows.columns else F.lit(0.0)
    frame = F.struct(
        F.lit("r1").alias("_id"), F.concat(F.lit("FFVideoFormat"), F.coalesce(text("height"), F.lit("1080")), F.lit("p"), F.floor(fps + 0.5).cast("string")).alias("_name"),
        rational_time(1 / fps).alias("_frameDuration"), F.coalesce(text("width"), F.lit("1920")).alias("_width"), F.coalesce(text("height"), F.lit("1080")).alias("_height"), F.lit("1-1-1 (Rec. 709)").alias("_colorSpace"),
    )
    element = F.struct(
        F.col("name").alias("_name"), F.coalesce(F.nullif("interchange_reel_name", F.lit("")), F.col("name")).alias("_uid"), file_uri(F.col("source_path")).alias("_src"), rational_time(start).alias("_start"), rational_time("duration_sec").alias("_duration"),
        F.lit("1").alias("_hasVideo"), flag("1").alias("_hasAudio"), flag("1").alias("_audioSources"), flag("2").alias("_audioChannels"), F.lit("r1").alias("_format"),
    )
    clip = F.struct(F.col("label").alias("_name"), F.col("asset_id"), rational_time("offset_sec").alias("_offset"), rational_time("source_start").alias("_start"), rational_time("length_sec").alias("_duration"))
    title = (F.lit(name) if isinstance(name, str) else name).alias("_title")
    # Read for the assets and for the clips.
    every = checkpointed(rows.select(scope, "asset_id", order, "length_sec", title, frame.alias("_frame"), element.alias("_element"), clip.alias("_clip")))
    assets = every.groupBy(scope, "asset_id").agg(F.min(order).alias("_first"), F.min_by("_element", order).alias("_element"))
    # Assets are numbered by rows: a map of them, searched for each clip, would take the square of a document's length.
    numbers = assets.withColumn("_ref", F.concat(F.lit("r"), (F.row_number().over(Window.partitionBy(scope).orderBy("_first", "asset_id")) + 1).cast("string")))
    numbers = checkpointed(numbers)
    resource = F.struct(F.col("_ref").alias("_id"), *(F.col("_element")[c].alias(c) for c in ("_name", "_uid", "_src", "_start", "_duration", "_hasVideo", "_hasAudio", "_audioSources", "_audioChannels", "_format")))
    values = lambda listed: F.transform(F.sort_array(F.collect_list(listed)), lambda x: x["_value"])
    listed = numbers.groupBy(scope).agg(values(F.struct("_first", "asset_id", resource.alias("_value"))).alias("_assets"))
    one = F.struct(F.col("_clip._name").alias("_name"), F.col("_ref"), *(F.col(f"_clip.{x}").alias(x) for x in ("_offset", "_start", "_duration")), F.lit("NDF").alias("_tcFormat"), F.lit("1").alias("_enabled"))
    referred = every.join(numbers.select(scope, "asset_id", "_ref"), [scope, "asset_id"])
    spine = referred.groupBy(scope).agg(values(F.struct(F.col(order).alias("_place"), one.alias("_value"))).alias("_clips"), F.min_by("_frame", order).alias("_frame"), F.sum("length_sec").alias("_length"), F.first("_title").alias("_title"))
    docs = spine.join(listed, scope)
    resources = F.struct(F.col("_frame").alias("format"), F.col("_assets").alias("asset"))
    sequence = F.struct(F.lit("r1").alias("_format"), rational_time("_length").alias("_duration"), F.lit("0s").alias("_tcStart"), F.lit("NDF").alias("_tcFormat"), F.lit("stereo").alias("_audioLayout"), F.lit("48k").alias("_audioRate"), F.struct(F.col("_clips").alias("asset-clip")).alias("spine"))
    project = F.struct(F.col("_title").alias("_name"), sequence.alias("sequence"))
    library = F.struct(F.struct(F.col("_title").alias("_name"), project.alias("project")).alias("event"))
    whole = F.to_xml(F.struct(F.lit("1.11").alias("_version"), resources.alias("resources"), library.alias("library")), {"rowTag": "fcpxml"})
    head = F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE fcpxml>\n')
    return docs.select(scope, F.concat(head, whole).alias("xml"))


def parsed(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """The documents' other columns with pos, name, asset_uid, offset_sec, start_sec, duration_sec of each clip.

    A clip's asset is known by its reference within its document; an unknown one has the uid '',
    and of assets with one id the last counts.
    """
    bare = F.regexp_replace(F.col(xml), "<!DOCTYPE [^>]*>", "")
    rows = documents.withColumns({"_doc": F.from_xml(bare, _READ, {"rowTag": "fcpxml"}), "_of": F.monotonically_increasing_id()})
    # Assets and clips leave the document as rows in one list, so that no row carries the document's assets along.
    none = F.lit(None).cast("string")
    asset = lambda a, i: F.struct(F.lit(None).cast("int").alias("pos"), i.alias("_n"), a["_id"].alias("_id"), a["_uid"].alias("_uid"), *(none.alias(c) for c in ("_name", "_offset", "_start", "_duration")))
    clip = lambda c, i: F.struct(i.alias("pos"), F.lit(None).cast("int").alias("_n"), c["_ref"].alias("_id"), none.alias("_uid"), *(c[x].alias(x) for x in ("_name", "_offset", "_start", "_duration")))
    known = F.transform(F.filter(F.coalesce("_doc.resources.asset", F.array()), lambda a: a["_id"].isNotNull()), asset)
    spine = F.transform(F.coalesce(F.col("_doc.library.event.project.sequence.spine").getField("asset-clip"), F.array()), clip)
    kept = [c for c in documents.columns if c != xml]
    found = rows.select(*kept, "_of", F.inline(F.concat(known, spine)))
    last = F.max(F.struct("_n", "_uid")).over(Window.partitionBy("_of", "_id"))
    found = found.withColumn("asset_uid", F.coalesce(last["_uid"], F.lit(""))).where("pos is not null")
    times = {new: rational_seconds(old) for new, old in (("offset_sec", "_offset"), ("start_sec", "_start"), ("duration_sec", "_duration"))}
    return found.select(*kept, "pos", F.col("_name").alias("name"), "asset_uid", *(v.alias(k) for k, v in times.items()))


def export(name: str, rows: DataFrame, order: str = "order_index") -> str:
    """XML text of the one timeline that the rows are."""
    return exported(rows.withColumn("_scope", F.lit(0)), name, "_scope", order).first()["xml"]


def parse(spark: SparkSession, payload: str) -> DataFrame:
    """name, asset_uid, offset_sec, start_sec, duration_sec of one document's clips."""
    return parsed(spark.range(1).select(F.lit(payload).alias("xml"))).drop("pos")
