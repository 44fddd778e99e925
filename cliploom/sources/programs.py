"""Outside programs run on the executors, a process per row: media probes, sound screening, gray frames.  S02-S04, S14, S15, S18.

`captured` runs a command for every row and keeps what it wrote; what the programs tell is read by `sources.files` and
`operators.signals`.  A row whose program is missing, fails or takes too long keeps its row with an error and no output, so
one bad file never stops a run.  Programs read their files where the executors do; arguments are passed as they are, never
through a shell.  A task that is run again runs its programs again, so commands must not change what they read.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import probe_runner
from ..operators.signals import decoded_frames
from .files import probed, tag_probed

Command = Callable[[dict], Sequence[str]]


def captured(rows: DataFrame, command: Command, timeout: float = 120.0) -> DataFrame:
    """The rows with stdout and stderr (binary) of their command, and error: null, missing, timeout or exit N (no stdout then)."""

    def one(row: dict) -> tuple[bytes | None, bytes | None, str | None]:
        try:
            done = subprocess.run(list(command(row)), check=False, capture_output=True, timeout=timeout)
        except FileNotFoundError:
            return None, None, "missing"
        except subprocess.TimeoutExpired:
            return None, None, "timeout"
        return (done.stdout, done.stderr, None) if done.returncode == 0 else (None, done.stderr, f"exit {done.returncode}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A row at a time: a program may write much.
            for i, row in enumerate(b.to_pylist()):
                out = [pa.array([v], k) for v, k in zip(one(row), (pa.binary(), pa.binary(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, *out], names=[*b.schema.names, "stdout", "stderr", "error"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "stdout binary", "stderr binary", "error string"])
    return rows.mapInArrow(run, schema)


#: Commands of the programs known; fixed options.
PROBES: dict[str, Command] = {
    "ffprobe": lambda row: ("ffprobe", "-v", "error", "-print_format", "json", "-show_streams", "-show_format", row["path"]),
    "exiftool": lambda row: ("exiftool", "-j", "-n", row["path"]),
}


def probes(media: DataFrame, runner: str | None = None, command: Command | None = None, timeout: float = 120.0) -> DataFrame:
    """The media (path) with duration_sec, fps, width, height, has_audio, timecode and error.

    The runner is ffprobe, else exiftool, by what the machine that plans has; without either all values are null.
    """
    name = probe_runner() if runner is None else runner
    if name is None and command is None:
        nothing = {"duration_sec": "double", "fps": "double", "width": "int", "height": "int", "has_audio": "boolean", "timecode": "string"}
        return media.withColumns({k: F.lit(None).cast(v) for k, v in nothing.items()} | {"error": F.lit("missing")})
    found = captured(media, command or PROBES[name], timeout).withColumn("_json", F.decode("stdout", "UTF-8")).drop("stdout", "stderr")
    return (tag_probed if name == "exiftool" else probed)(found, "_json").drop("_json")


def sound_command(row: dict) -> tuple[str, ...]:
    """One pass over a clip's sound (path, duration_sec, n_times): silences to stderr, levels of chunks of clamp(duration / 2n, .1, 2) s to stdout."""
    chunk = max(0.1, min(2.0, row["duration_sec"] / max(1, 2 * row["n_times"])))
    return ("ffmpeg", "-v", "info", "-i", row["path"], "-map", "0:a:0", "-af", f"silencedetect=noise=-35dB:duration=0.3,astats=length={chunk:.3f}:metadata=1:reset=1,ametadata=mode=print:file=-", "-f", "null", "-")


def sound_logs(clips: DataFrame, key: str = "asset_id", command: Command = sound_command, timeout: float = 600.0) -> DataFrame:
    """key, line_no, line of the clips' sound logs, silences before levels; clips whose program fails have no line."""
    found = captured(clips, command, timeout).where("error is null")
    lines: Column = F.concat(*(F.split(F.decode(c, "UTF-8"), "\r?\n") for c in ("stderr", "stdout")))
    return found.select(key, F.posexplode(lines).alias("line_no", "line")).where(F.length("line") > 0)


def frame_command(width: int = 160) -> Command:
    """A gray image of the clip at a time (path, timestamp_sec)."""
    return lambda row: ("ffmpeg", "-v", "error", "-ss", f"{row['timestamp_sec']:.3f}", "-i", row["path"], "-frames:v", "1", "-vf", f"scale={width}:-1,format=gray", "-f", "image2pipe", "-vcodec", "pgm", "-")


def gray_frames(times: DataFrame, width: int = 160, command: Command | None = None, timeout: float = 60.0) -> DataFrame:
    """asset_id, timestamp_sec, width, height, pixels of the frames at the times (asset_id, path, timestamp_sec) that decode."""
    found = captured(times, command or frame_command(width), timeout)
    return decoded_frames(found.where("error is null").select("asset_id", "timestamp_sec", F.col("stdout").alias("content")))
