"""Outside programs on the executors, with scripts in their place."""

import json
import sys

from cliploom.operators import signals
from cliploom.sources import files, programs

PROBE = {"streams": [{"codec_type": "video", "avg_frame_rate": "24/1", "width": 6, "height": 4}, {"codec_type": "audio"}], "format": {"duration": "9.5"}}


def script(code):
    return lambda row: (sys.executable, "-c", code, *(str(v) for v in row.values()))


def test_probes(spark):
    media = spark.createDataFrame([("a b.mov",), ("$(bad).mov",), ("slow.mov",)], "path string")
    code = f"import sys, time\np = sys.argv[1]\ntime.sleep(9 if 'slow' in p else 0)\nsys.exit(3) if 'bad' in p else print({json.dumps(PROBE)!r})"
    got = {r.path: r for r in programs.probes(media, "ffprobe", script(code), timeout=4).collect()}
    good = got["a b.mov"]
    assert (good.duration_sec, good.fps, good.width, good.has_audio, good.error) == (9.5, 24.0, 6, True, None)
    assert got["$(bad).mov"].error == "exit 3" and got["slow.mov"].error == "timeout" and got["slow.mov"].duration_sec is None
    gone = programs.probes(media, "ffprobe", lambda row: ("/no/such/program", row["path"])).collect()
    assert {r.error for r in gone} == {"missing"} and len(gone) == 3 and programs.probes(media.where("false"), "exiftool").count() == 0


def test_commands():
    assert programs.PROBES["exiftool"]({"path": "x y"}) == ("exiftool", "-j", "-n", "x y")
    assert "astats=length=0.500:" in programs.sound_command({"path": "p", "duration_sec": 10.0, "n_times": 10})[8] and "length=2.000" in programs.sound_command({"path": "p", "duration_sec": 900.0, "n_times": 4})[8]
    assert programs.frame_command(80)({"path": "p", "timestamp_sec": 1.23456})[4] == "1.235"


def test_sound_logs(spark):
    clips = spark.createDataFrame([(1, "a", 8.0, 4), (2, "bad", 8.0, 4)], "asset_id int, path string, duration_sec double, n_times int")
    code = "import sys\nif sys.argv[2] == 'bad': sys.exit(1)\nprint('silence_start: 1.5\\nsilence_end: 4', file=sys.stderr)\nprint('pts_time:0.5\\nlavfi.astats.Overall.RMS_level=-20\\npts_time:3\\nlavfi.astats.Overall.RMS_level=-inf')"
    silences, samples = files.silence_rows(programs.sound_logs(clips, command=script(code)))
    assert [tuple(r) for r in silences.collect()] == [(1, 1.5, 4.0)]
    assert sorted((r.asset_id, r.t, round(r.rms, 6)) for r in samples.collect()) == [(1, 0.5, 0.1), (1, 3.0, 0.0)]


def test_gray_frames(spark):
    times = spark.createDataFrame([(1, "a", 0.0), (1, "a", 1.0), (2, "short", 0.0)], "asset_id int, path string, timestamp_sec double")
    code = "import sys\nshade = 10 if sys.argv[3] == '0.0' else 200\nn = 3 if sys.argv[2] == 'short' else 12\nsys.stdout.buffer.write(b'P5 4 3 255\\n' + bytes([shade]) * n)"
    frames = programs.gray_frames(times, command=script(code))
    got = {r.timestamp_sec: r for r in signals.measured_signals(frames).collect()}
    # The short image does not decode; the second frame is measured against the first.
    assert set(got) == {0.0, 1.0} and got[0.0].motion_energy == 0.32 and got[1.0].motion_energy == 1.0 and got[0.0].contrast == 0.0
