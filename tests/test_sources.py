"""Readers and writers, and the streaming forms."""

import json

from pyspark.sql import functions as F

from cliploom.config import capabilities, probe_runner
from cliploom.sources import documents, files, histories, timeline_xml
from cliploom.streaming import screening

PROJECT = {
    "project": {"id": "p", "name": "P", "story_prompt": "x", "status": "done", "media_roots": ["/m"]},
    "assets": [{"id": "a1", "name": "A", "source_path": "/m/a b.mov", "proxy_path": "/m/p.mov", "duration_sec": 9.0, "fps": 24.0, "width": 10, "height": 5, "has_speech": True, "interchange_reel_name": "R1"}],
    "candidate_segments": [{"id": "s1", "asset_id": "a1", "start_sec": 1.0, "end_sec": 4.0, "analysis_mode": "speech", "transcript_excerpt": "", "description": "", "quality_metrics": {"sharpness": 0.5}}],
    "take_recommendations": [{"id": "t1", "candidate_segment_id": "s1", "title": "T", "is_best_take": True, "selection_reason": "", "score_technical": 0.1, "score_semantic": 0.1, "score_story": 0.1, "score_total": 0.1}],
    "timeline": {"id": "p-timeline", "version": 1, "story_summary": "S", "items": [{"id": "i1", "take_recommendation_id": "t1", "order_index": 0, "trim_in_sec": 0.5, "trim_out_sec": 2.0, "label": "Opener", "notes": "", "source_asset_path": "/m/a b.mov", "source_reel": "R1"}]},
}


def test_project_round_trip(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps(PROJECT, indent=1))
    frames = documents.project(spark, str(path))
    asset = frames["assets"].first()
    assert asset.source_timecode == "00:00:00:00" and asset.has_proxy and asset.proxy_match_confidence == 1.0
    assert documents.flat_metrics(frames["segments"], ("sharpness", "stability")).select("sharpness", "stability").first() == (0.5, None)
    again = tmp_path / "q.json"
    again.write_text(documents.project_json(frames))
    other = documents.project(spark, str(again))
    for name in frames:
        assert frames[name].collect() == other[name].collect()


def test_documents_are_made_and_parsed_once(spark, sf_dir):
    """The lists of a project meet in one grouping; a text is parsed once for all frames, and the query's segments are made once."""
    from cliploom.plans.queries import QUERIES

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    heads = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p3")], "project_id int, id string")
    segments = spark.createDataFrame([(1, 2, "s2", None), (1, 1, "s1", 0.5), (2, 1, "s3", 1.5), (4, 1, "s4", 0.0)], "project_id int, pos int, id string, start_sec double")
    takes = spark.createDataFrame([(1, 1, "t1", "s1"), (3, 1, "t3", "s3")], "project_id int, pos long, id string, candidate_segment_id string")
    texts = documents.project_documents({"project": heads, "segments": segments, "takes": takes})
    assert plan(texts).count("Aggregate") == 1
    rest = lambda p: f'"timeline":{{"id":"{p}-timeline","version":1,"story_summary":"","items":[]}}'
    assert {r.project_id: r.document for r in texts.collect()} == {
        1: '{"project":{"id":"p1"},"assets":[],"candidate_segments":[{"id":"s1","start_sec":0.5},{"id":"s2"}],"take_recommendations":[{"id":"t1","candidate_segment_id":"s1"}],' + rest("p1") + "}",
        2: '{"project":{"id":"p2"},"assets":[],"candidate_segments":[{"id":"s3","start_sec":1.5}],"take_recommendations":[],' + rest("p2") + "}",
        3: '{"project":{"id":"p3"},"assets":[],"candidate_segments":[],"take_recommendations":[{"id":"t3","candidate_segment_id":"s3"}],' + rest("p3") + "}",
    }
    none = documents.project_documents({"project": heads}).where("project_id = 2").first().document
    assert none == '{"project":{"id":"p2"},"assets":[],"candidate_segments":[],"take_recommendations":[],' + rest("p2") + "}"
    found = documents.projects(texts.unionByName(spark.createDataFrame([(9, "no document")], "project_id int, document string")))
    assert not any("from_json" in plan(rows) for rows in found.values())
    assert sorted((r.project_id, r.id) for r in found["segments"].collect()) == [(1, "s1"), (1, "s2"), (2, "s3")]
    assert sorted((r.project_id, r.id or "") for r in found["project"].collect()) == [(1, "p1"), (2, "p2"), (3, "p3"), (9, "")]
    made = plan(QUERIES["project_documents"](spark, sf_dir))
    assert "l_orderkey" not in made and "from_json" not in made


def test_timeline_round_trip(spark):
    items = spark.createDataFrame([(1, "t1", 0, 0.5, 2.0, "Opener"), (1, "t2", 1, 0.0, 3.0, "Outro")], "scope int, take_id string, order_index int, trim_in_sec double, trim_out_sec double, label string")
    takes = spark.createDataFrame([("t1", "s1"), ("t2", "s2")], "take_id string, segment_id string")
    segments = spark.createDataFrame([("s1", "a", 1.0), ("s2", "a", 5.0)], "segment_id string, asset_id string, start_sec double")
    assets = spark.createDataFrame([("a", "A", "/m/a b.mov", "R1", "00:00:10:12", 24.0, 1920, 1080, 20.0)], "asset_id string, name string, source_path string, interchange_reel_name string, source_timecode string, fps double, width int, height int, duration_sec double")
    text = timeline_xml.export("cut", timeline_xml.clips(items, takes, segments, assets))
    rows = timeline_xml.parse(spark, text).orderBy("offset_sec").collect()
    assert [(r.name, r.asset_uid, r.offset_sec, r.start_sec, r.duration_sec) for r in rows] == [("Opener", "R1", 0.0, 12.0, 1.5), ("Outro", "R1", 1.5, 15.5, 3.0)]


def test_timeline_assets_are_joined_not_searched(spark):
    """No clip searches or carries its document's assets; of assets with one id the last counts."""
    n = 300
    rows = spark.range(n).select(F.lit(0).alias("scope"), F.col("id").alias("asset_id"), F.col("id").alias("order_index"), F.lit("x").alias("label"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("name"), F.lit("/m").alias("source_path"), F.lit("").alias("interchange_reel_name"), F.lit(24.0).alias("fps"), F.lit(4).alias("width"), F.lit(2).alias("height"), *(F.lit(1.0).alias(c) for c in ("duration_sec", "length_sec", "offset_sec", "source_start")))
    found = timeline_xml.parsed(timeline_xml.exported(rows, "cut"))
    assert sorted((r.pos, r.asset_uid) for r in found.collect()) == [(i, f"a{i}") for i in range(n)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("map_from_entries", "mapfromentries", "array_distinct", "element_at"))
    twice = '<fcpxml><resources><asset id="r2" uid="A"/><asset id="r2" uid="B"/></resources><library><event><project><sequence><spine><asset-clip name="n" ref="r2" offset="0s" start="0s" duration="1s"/></spine></sequence></project></event></library></fcpxml>'
    assert timeline_xml.parse(spark, twice).first().asset_uid == "B"


def test_json_repairs_reads_lines(spark, sf_dir):
    from cliploom.plans.queries import QUERIES

    lines = [r.k for r in QUERIES["json_repairs"](spark, sf_dir).where("event_id % 6 = 3").collect()]
    assert lines and all(k is not None and k.isdigit() for k in lines)


def test_parts_are_spread(spark, sf_dir):
    """A file that one task scans is dealt out before the work on its rows."""
    from cliploom.plans.queries import QUERIES

    assert QUERIES["hash_unit"](spark, sf_dir).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_media_listing(spark, tmp_path):
    for name in ("Originals/C1.MOV", "Proxy/C1_proxy.mp4", "Proxy/notes.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x")
    rows = {r.name: r for r in files.media_files(spark, [str(tmp_path), "/no/such/folder"]).collect()}
    assert set(rows) == {"C1.MOV", "C1_proxy.mp4"} and rows["C1_proxy.mp4"].role == "proxy" and {r.clip_key for r in rows.values()} == {"C1"}
    assert files.video_count(spark, "/no/such/folder") == 0


def test_probes(spark):
    stream = json.dumps({"streams": [{"codec_type": "audio"}, {"codec_type": "video", "avg_frame_rate": "25/1", "width": 4, "height": 3, "tags": {"timecode": "01:00:00:00"}}], "format": {"duration": "7.5"}})
    row = files.probed(spark.createDataFrame([(stream,)], "json string")).first()
    assert (row.duration_sec, row.fps, row.width, row.has_audio, row.timecode) == (7.5, 25.0, 4, True, "01:00:00:00")
    tags = json.dumps([{"Duration": "3", "FrameRate": "24", "ImageWidth": "8", "AudioChannels": "2"}])
    row = files.tag_probed(spark.createDataFrame([(tags,)], "json string")).first()
    assert (row.duration_sec, row.fps, row.width, row.height, row.has_audio) == (3.0, 24.0, 8, None, True)


def test_silence_log(spark):
    lines = ["silence_start: 1.5", "pts_time:0.5", "RMS_level=-20", "silence_end: 2.5", "pts_time:3", "RMS_level=-inf", "silence_start: 9"]
    log = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "asset_id int, line_no int, line string")
    silences, samples = files.silence_rows(log)
    assert sorted((r.start_sec, r.end_sec) for r in silences.collect()) == [(1.5, 2.5), (9.0, float("inf"))]
    assert sorted((r.t, round(r.rms, 6)) for r in samples.collect()) == [(0.5, 0.1), (3.0, 0.0)]
    # A start after a start takes its place, an end alone is none, a stamp has one level.
    lines = ["silence_end: 0.5", "silence_start: 1", "silence_start: 2", "silence_end: 3", "RMS_level=-6", "pts_time:1", "RMS_level=odd", "RMS_level=-20", "RMS_level=-40"]
    silences, samples = files.silence_rows(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "asset_id int, line_no int, line string"))
    assert [(r.start_sec, r.end_sec) for r in silences.collect()] == [(2.0, 3.0)] and [(r.t, round(r.rms, 6)) for r in samples.collect()] == [(1.0, 0.1)]


def test_capabilities():
    able = capabilities(lambda name: name == "exiftool" and "/bin/exiftool", lambda name: None if name == "fastapi" else name)
    assert able == {"ffprobe": False, "ffmpeg": False, "exiftool": True, "scenedetect": True, "faster_whisper": True, "fastapi": False}
    assert probe_runner(able) == "exiftool" and probe_runner({"ffprobe": True, "exiftool": True}) == "ffprobe" and probe_runner({}) is None


def test_cache_history_overrides(spark, tmp_path):
    rows = spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, v int")
    hits, pending = documents.cached(rows, spark.createDataFrame([("k1", "r")], "key string, result string"), "key")
    assert [r.result for r in hits.collect()] == ["r"] and [r.key for r in pending.collect()] == ["k2"]
    h = tmp_path / "h.jsonl"
    h.write_text('{"run_id": "a", "total": 1}\n\n{broken\n{"run_id": "b", "total": 2}\n')
    found = documents.history(spark, str(h), "run_id string, total int")
    assert sorted(r.run_id for r in found.collect()) == ["a", "b"]
    up = histories.upserted(found, spark.createDataFrame([("b", "ok")], "run_id string, evaluation string"))
    assert sorted((r.run_id, r.evaluation) for r in up.collect()) == [("a", None), ("b", "ok")]
    o = tmp_path / "o.json"
    o.write_text(json.dumps({"project_id": "p", "candidate_segment_ids": ["s2", "s1"], "best_takes": {"a1": "s2"}}))
    ids = spark.createDataFrame([("s1",), ("s2",)], "id string")
    assert [tuple(r) for r in documents.overrides(spark, str(o), "p", ids).collect()] == [("a1", "s2")]
    assert documents.overrides(spark, str(o), "other", ids).count() == 0
    # Another list of segments, of the same length or not, is not the one that was edited.
    assert documents.overrides(spark, str(o), "p", ids.limit(1)).count() == 0 and documents.overrides(spark, str(o), "p", ids.selectExpr(f"concat({ids.columns[0]}, 'x')")).count() == 0


def test_windowed_energy(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    q = screening.windowed_energy(stream).writeStream.outputMode("append").format("memory").queryName("energy").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM energy").first()[0] > 0


def test_streamed_turns(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(1, "2024-01-01 00:00:01", 1.0, 1.8), (1, "2024-01-01 00:00:02", 2.0, 3.1), (1, "2024-01-01 00:00:05", 5.0, 6.2)]
    spark.createDataFrame(rows, "asset_id int, t string, start_sec double, end_sec double").select("asset_id", F.to_timestamp("t").alias("ts"), "start_sec", "end_sec").write.parquet(str(source))
    stream = spark.readStream.schema("asset_id int, ts timestamp, start_sec double, end_sec double").parquet(str(source))
    q = screening.turns(stream).writeStream.outputMode("append").format("memory").queryName("streamed_turns").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert (1, 1.0, 3.1, 2) in [tuple(r) for r in spark.table("streamed_turns").collect()]
