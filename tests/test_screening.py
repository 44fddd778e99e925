"""The two stages of near duplicates in the screening plan, with vectors and without."""

import pytest

from cliploom.config import EngineConfig
from cliploom.plans import screening


@pytest.fixture(scope="module")
def found(spark):
    rows = [(1, f"s{i}", i, 2.0 * i, 2.0 * i + 1.5, s) for i, s in enumerate((0.9, 0.8, 0.7, 0.6, 0.5), 1)] + [(2, "t1", 1, 0.0, 2.0, 0.4)]
    return spark.createDataFrame(rows, "asset_id int, segment_id string, pos int, start_sec double, end_sec double, prefilter_score double")


@pytest.fixture(scope="module")
def given(spark):
    shades = {1: 0.1, 2: 0.1, 3: 0.5, 4: 0.7, 5: 0.9}
    frames = spark.createDataFrame([(1, 2.0 * i + 1, b, 0.5) for i, b in shades.items()] + [(2, 1.0, 0.1, 0.5)], "asset_id int, timestamp_sec double, brightness double, distinctiveness double")
    clips = spark.createDataFrame([(1, "a", 20.0, False), (2, "b", 8.0, False)], "asset_id int, asset_name string, duration_sec double, has_speech boolean")
    return {"assets": clips, "frames": frames, "audio": None, "spans": None}


CONFIG = EngineConfig(mode="fast", max_segments_per_asset=3)


def told(rows):
    return {r.segment_id: (r.deduplicated, r.dedup_group_id, r.shortlisted, r.stage) for r in rows.collect()}


def test_vectors_after_the_shortlist(spark, found, given):
    vectors = spark.createDataFrame([(1, "s1", [1.0, 0.0]), (1, "s3", [9.0, 0.5]), (1, "s4", [0.0, 2.0]), (1, "s5", [0.0, 1.0]), (2, "t1", [1.0, 0.0])], "asset_id int, segment_id string, vector array<double>")
    scores = spark.createDataFrame([("s1", 0.2), ("s3", 0.9), ("s5", 0.9)], "segment_id string, clip_score double")
    got = told(screening.flagged(found, screening.Inputs(**given, vectors=vectors, vector_scores=scores), CONFIG))
    # s2 goes by its histogram and leaves room for s4; s1 and s3 are alike, s3 has the better mean, and the place of s1 stays empty.
    assert got["s2"] == (True, 0, False, None) and got["s1"] == (True, 1, True, None) and got["s3"] == (False, 1, True, "target")
    assert got["s4"][0] is False and got["s4"][2:] == (True, "target") and got["s5"][2] is False and got["t1"] == (False, None, True, "target")


def test_without_vectors(found, given):
    got = told(screening.flagged(found, screening.Inputs(**given), CONFIG))
    assert {k for k, v in got.items() if v[0]} == {"s2"} and {k for k, v in got.items() if v[2]} == {"s1", "s3", "s4", "t1"}
    # The shortlisted ones are numbered anew; a clip of one segment has no group.
    assert (got["s1"][1], got["s3"][1], got["s4"][1], got["t1"][1]) == (0, 1, 2, None)


def test_switched_off(spark, found, given):
    got = told(screening.flagged(found, screening.Inputs(**given), EngineConfig(mode="fast", max_segments_per_asset=2, dedup=False)))
    assert not any(v[0] for v in got.values()) and {k for k, v in got.items() if v[2]} == {"s1", "s2", "t1"}
