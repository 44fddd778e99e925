"""Project documents, caches, overrides, manifests and histories as frames.  S05-S13, K01-K04, K06, K07 of the survey."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import checkpointed

ASSET = "struct<id:string,name:string,source_path:string,proxy_path:string,duration_sec:double,fps:double,width:int,height:int,has_speech:boolean,interchange_reel_name:string,source_timecode:string,has_proxy:boolean,proxy_match_confidence:double,proxy_match_reason:string>"
PREFILTER = (
    "struct<score:double,shortlisted:boolean,filtered_before_vlm:boolean,selection_reason:string,sampled_frame_count:int,sampled_frame_timestamps_sec:array<double>,top_frame_timestamps_sec:array<double>,"
    "metrics_snapshot:map<string,double>,deduplicated:boolean,dedup_group_id:int,clip_gated:boolean,vlm_budget_capped:boolean,boundary_strategy:string,boundary_confidence:double,seed_region_ids:array<string>,"
    "seed_region_sources:array<string>,seed_region_ranges_sec:array<array<double>>,assembly_operation:string,assembly_rule_family:string,assembly_source_segment_ids:array<string>,"
    "assembly_source_ranges_sec:array<array<double>>,transcript_turn_ids:array<string>,transcript_turn_ranges_sec:array<array<double>>,transcript_turn_alignment:string,speech_structure_label:string,"
    "speech_structure_cues:array<string>,speech_structure_confidence:double>"
)
UNDERSTANDING = "struct<provider:string,provider_model:string,schema_version:string,summary:string,subjects:array<string>,actions:array<string>,shot_type:string,camera_motion:string,mood:string,story_roles:array<string>,quality_findings:array<string>,keep_label:string,confidence:double,rationale:string,risk_flags:array<string>,visual_distinctiveness:double,clarity:double,story_relevance:double>"
VALIDATION = "struct<status:string,decision:string,reason:string,confidence:double,ambiguity_score:double,target_reason:string,provider:string,provider_model:string,skip_reason:string,applied:boolean,original_range_sec:array<double>,suggested_range_sec:array<double>,split_ranges_sec:array<array<double>>>"
SEGMENT = f"struct<id:string,asset_id:string,start_sec:double,end_sec:double,analysis_mode:string,transcript_excerpt:string,description:string,quality_metrics:map<string,double>,prefilter:{PREFILTER},ai_understanding:{UNDERSTANDING},boundary_validation:{VALIDATION}>"
TAKE = "struct<id:string,candidate_segment_id:string,title:string,is_best_take:boolean,selection_reason:string,score_technical:double,score_semantic:double,score_story:double,score_total:double,outcome:string,within_asset_rank:int,score_gap_to_winner:double,score_driver_labels:array<string>,limiting_factor_labels:array<string>>"
ITEM = "struct<id:string,take_recommendation_id:string,order_index:int,trim_in_sec:double,trim_out_sec:double,label:string,notes:string,source_asset_path:string,source_reel:string,sequence_group:string,sequence_role:string,sequence_score:double>"
PROJECT = f"project struct<id:string,name:string,story_prompt:string,status:string,media_roots:array<string>>, assets array<{ASSET}>, candidate_segments array<{SEGMENT}>, take_recommendations array<{TAKE}>, timeline struct<id:string,version:int,story_summary:string,items:array<{ITEM}>>"


_PARTS = {"assets": "assets", "segments": "candidate_segments", "takes": "take_recommendations"}
_KINDS = {"assets": ASSET, "segments": SEGMENT, "takes": TAKE, "items": ITEM}


def _frames(docs: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Frames of documents parsed into the columns of PROJECT beside `keys`; missing optional values get their defaults."""
    part = lambda array: docs.select(*keys, F.posexplode(array).alias("pos", "x")).select(*keys, "pos", "x.*")
    assets = part("assets").withColumns({"source_timecode": F.coalesce("source_timecode", F.lit("00:00:00:00")), "has_proxy": F.coalesce("has_proxy", F.lit(True)), "proxy_match_confidence": F.coalesce("proxy_match_confidence", F.lit(1.0))})
    return {"project": docs.select(*keys, "project.*", F.col("timeline.story_summary").alias("story_summary")), "assets": assets, "segments": part("candidate_segments"), "takes": part("take_recommendations"), "items": part("timeline.items")}


def project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Frames project, assets, segments, takes and items of project documents; missing optional values get their defaults.

    Every frame but `project` has pos, the place in its document, which breaks ties.
    """
    return _frames(spark.read.schema(PROJECT).option("multiLine", True).json(path), [])


def projects(documents: DataFrame, key: str = "project_id", document: str = "document") -> dict[str, DataFrame]:
    """The frames of many documents (key, text), each row with its key; a text that isn't a document has no rows but in `project`, of nulls."""
    # Texts are made and parsed once, not again for each frame that is read.
    parsed = checkpointed(documents.select(key, F.from_json(document, PROJECT).alias("_d")))
    return _frames(parsed.select(key, "_d.*"), [key])


def project_documents(frames: dict[str, DataFrame], key: str = "project_id") -> DataFrame:
    """(key, document): the frames put together as one JSON text per project, all projects in parallel.

    Frames have the key, those but `project` also pos, the order within the document.  Absent columns and null values are left
    out, frames and rows that are absent give empty lists; a project without a row in `project` has no document.
    """
    head = frames["project"]
    summary = F.coalesce("story_summary", F.lit("")) if "story_summary" in head.columns else F.lit("")
    out = head.select(key, F.struct(*(c for c in head.columns if c not in (key, "story_summary"))).alias("project"), summary.alias("_summary"))
    lists = []
    for name, kind in _KINDS.items():
        if name in frames:
            rows = frames[name]
            known = T.DataType.fromDDL(kind).names
            lists.append(rows.select(key, F.struct("pos", F.to_json(F.struct(*(c for c in known if c in rows.columns))).alias("x")).alias(f"_{name}")))
    if lists:
        # The rows of all lists of a project meet in one shuffle, each in its own column.
        rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), lists)
        listed = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda p: p["x"]).alias(c)
        out = out.join(rows.groupBy(key).agg(*(listed(c) for c in rows.columns if c != key)), key, "left")
    out = out.withColumns({f"_{name}": F.lit(None).cast("array<string>") for name in _KINDS if name not in frames})
    texts = lambda name: F.concat(F.lit("["), F.array_join(F.coalesce(f"_{name}", F.array().cast("array<string>")), ","), F.lit("]"))
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    shown = F.to_json(F.struct(F.concat(F.coalesce(F.col("project.id"), F.lit("")), F.lit("-timeline")).alias("id"), F.lit(1).alias("version"), F.col("_summary").alias("story_summary")))
    timeline = F.concat(F.left(shown, F.length(shown) - 1), F.lit(","), field("items", texts("items")), F.lit("}"))
    parts = [field("project", F.to_json("project")), *(field(full, texts(name)) for name, full in _PARTS.items()), field("timeline", timeline)]
    return out.select(key, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("document"))


def flat_metrics(segments: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Metric maps as flat nullable columns."""
    return segments.withColumns({n: F.try_element_at("quality_metrics", F.lit(n)) for n in names})


def project_json(frames: dict[str, DataFrame]) -> str:
    """The frames of one project, without a key, as its document."""
    one = {name: rows.withColumn("_project", F.lit(0)) for name, rows in frames.items()}
    return project_documents(one, "_project").first()["document"]


def cached(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, pending): rows whose key the cache has, with its columns, and the rows still to be computed."""
    return rows.join(cache.dropDuplicates([key]), key), rows.join(cache.select(key).distinct(), key, "left_anti")


def cached_spans(spark: SparkSession, path: str) -> DataFrame:
    """asset_id, start_sec, end_sec, text of cached transcripts, blank texts dropped."""
    doc = spark.read.schema("asset_id string, spans array<struct<start_sec:double,end_sec:double,text:string>>").option("multiLine", True).json(path)
    return doc.select("asset_id", F.explode("spans").alias("s")).select("asset_id", "s.*").where(F.trim("text") != "")


def span_cache_key(path: Column, modified: Column, size: Column, model: Column) -> Column:
    return F.md5(F.concat_ws("|", path, modified.cast("string"), size.cast("string"), model))


def overrides(spark: SparkSession, path: str, project_id: str, segment_ids: DataFrame) -> DataFrame:
    """asset_id, override_segment of an override file; empty unless it is for this project and this very list of segments."""
    doc = spark.read.schema("project_id string, candidate_segment_ids array<string>, best_takes map<string,string>").option("multiLine", True).json(path)
    # Lists are compared by their length and two sums of hashes, so the segments' ids meet in no task.
    hashes = [lambda x: F.xxhash64(x).cast("decimal(38,0)"), lambda x: F.xxhash64(F.lit(1), x).cast("decimal(38,0)")]
    own = F.col(segment_ids.columns[0]).cast("string")
    there = segment_ids.agg(F.count(F.lit(1)).alias("_n"), *(F.coalesce(F.sum(h(own)), F.lit(0)).cast("decimal(38,0)").alias(f"_h{i}") for i, h in enumerate(hashes)))
    listed = lambda h: F.aggregate("candidate_segment_ids", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + h(x)).cast("decimal(38,0)"))
    same = F.size("candidate_segment_ids") == F.col("_n")
    for i, h in enumerate(hashes):
        same = same & (listed(h) == F.col(f"_h{i}"))
    good = doc.join(F.broadcast(there)).where((F.col("project_id") == project_id) & same)
    return good.select(F.explode("best_takes").alias("asset_id", "override_segment")).where("asset_id is not null")


def fixture_set(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Asset expectations of a named set as (name, category, expectations JSON); an unknown name raises with those there are."""
    # Read by Spark, as the path may be in a store that only Spark reaches.
    text = spark.read.option("wholetext", True).text(path).first()[0]
    sets = {s["name"]: s for s in json.loads(text)["fixture_sets"]}
    if name not in sets:
        raise ValueError(f"no fixture set {name}; there are {', '.join(sorted(sets))}")
    rows = [(a.get("name"), a.get("category"), json.dumps(a.get("expectations", {}), sort_keys=True)) for a in sets[name].get("asset_expectations", [])]
    return spark.createDataFrame(rows, "name string, category string, expectations string")


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a run history, one JSON object a line; blank and broken lines are dropped."""
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("x"))
    return rows.where("x is not null and x._corrupt is null").select("x.*").drop("_corrupt")


def summary_lines(row: dict[str, object]) -> list[str]:
    """key=value lines of a one-row summary, sorted; numbers with up to three decimals."""
    told = lambda v: f"{v:.3f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else "" if v is None else str(v)
    return [f"{k}={told(v)}" for k, v in sorted(row.items())]
