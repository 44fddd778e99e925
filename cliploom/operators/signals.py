"""Frame and audio signals: measurement, hash fallback, per-segment aggregation.  P10-P12, J03, J04, J06, A01 of the survey."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import average, clamp, fixed3, hash_unit, rounded, sample_timestamps
from .intervals import points_in_ranges
from .scoring import signal_score

#: Field, column of the asset that seeds it, label, base and width; fixed values.
SEEDED = (
    ("sharpness", "id", "sharpness", 0.48, 0.42),
    ("contrast", "name", "contrast", 0.42, 0.42),
    ("brightness", "source_path", "brightness", 0.38, 0.36),
    ("motion_energy", "proxy_path", "motion", 0.25, 0.55),
    ("distinctiveness", "interchange_reel_name", "distinctive", 0.28, 0.58),
    ("center_focus", "id", "center", 0.40, 0.42),
)


def seeded_signals(assets: DataFrame) -> DataFrame:
    """asset_id, timestamp_sec and hash-seeded frame values at the sample times, with their score."""
    rows = assets.withColumn("timestamp_sec", F.explode(sample_timestamps(F.col("duration_sec"))))
    values = {name: rounded(base + width * hash_unit(F.concat_ws(":", F.col(key).cast("string"), fixed3(F.col("timestamp_sec")), F.lit(label))), 4) for name, key, label, base, width in SEEDED}
    rows = rows.select(F.col("id").alias("asset_id"), "timestamp_sec", *(x.alias(n) for n, x in values.items()))
    score = signal_score(F.col("sharpness"), F.col("contrast"), F.col("motion_energy"), F.col("distinctiveness"), F.col("center_focus"))
    return rows.withColumns({"score": rounded(score, 4), "source": F.lit("fallback")})


MEASURED = "timestamp_sec double, sharpness double, contrast double, brightness double, motion_energy double, distinctiveness double, center_focus double"


def _measures(g: np.ndarray, before: np.ndarray | None) -> tuple[float, ...]:
    """Values of a gray frame, out of whole sums; `before` is the frame before it, if of its size."""
    h, w = g.shape
    steps = int(np.abs(np.diff(g, axis=1)).sum() + np.abs(np.diff(g, axis=0)).sum())
    spread = lambda x: math.sqrt(x.size * int((x * x).sum()) - int(x.sum()) ** 2) / (255 * x.size)
    centre = g[h // 4 : max(h // 4 + 1, h - h // 4), w // 4 : max(w // 4 + 1, w - w // 4)]
    moved = None if before is None else int(np.abs(g - before).sum()) / (255 * g.size)
    values = (steps / (255 * max(h * (w - 1) + (h - 1) * w, 1)) * 3.2, spread(g) * 2.4, int(g.sum()) / (255 * g.size), 0.32 if moved is None else moved * 3.4, 0.32 if moved is None else moved * 3.0, spread(centre) * 2.0)
    return tuple(math.floor(min(1.0, max(0.0, v)) * 10_000 + 0.5) / 10_000 for v in values)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames by (asset, time) to their values; the last frame of a batch is the first one's predecessor in the next."""
    asset = previous = None
    for b in batches:
        out = []
        for name, t, w, h, pixels in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            g = np.frombuffer(pixels, np.uint8)[: w * h].reshape(h, w).astype(np.int64)
            before = previous if previous is not None and name == asset and previous.shape == g.shape else None
            out.append((t, *_measures(g, before)))
            asset, previous = name, g
        if out:
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.float64()) for c in zip(*out, strict=True))], names=["asset_id", *(f.split()[0] for f in MEASURED.split(", "))])


def measured_signals(frames: DataFrame) -> DataFrame:
    """Pixel statistics of gray frames (asset_id, timestamp_sec, width, height, pixels binary).

    The first frame of an asset, and one of another size than its predecessor, has motion and distinctiveness .32.  Frames
    stream in order, so a task holds a batch and the frame before it, however long the asset is.
    """
    kind = dict(frames.dtypes)["asset_id"]
    ordered = frames.select("asset_id", F.col("timestamp_sec").cast("double").alias("timestamp_sec"), "width", "height", "pixels").repartition("asset_id").sortWithinPartitions("asset_id", "timestamp_sec")
    rows = ordered.mapInArrow(_measured, f"asset_id {kind}, {MEASURED}")
    score = signal_score(F.col("sharpness"), F.col("contrast"), F.col("motion_energy"), F.col("distinctiveness"), F.col("center_focus"))
    return rows.withColumns({"score": rounded(score, 4), "source": F.lit("frames")})


def gray_frame(data: bytes | None) -> tuple[int, int, bytes] | None:
    """(width, height, pixels) of a binary P5 image with comments; None for short or odd data."""
    if not data or not data.startswith(b"P5"):
        return None
    fields, at = [], 2
    while len(fields) < 3 and at < len(data):
        if data[at : at + 1].isspace():
            at += 1
        elif data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
        else:
            end = at
            while end < len(data) and not data[end : end + 1].isspace():
                end += 1
            if not data[at:end].isdigit():
                return None
            fields.append(int(data[at:end]))
            at = end
    if len(fields) < 3 or fields[2] > 255:
        return None
    w, h, pixels = fields[0], fields[1], data[at + 1 :]
    return (w, h, pixels[: w * h]) if w * h and len(pixels) >= w * h else None


def decoded_frames(images: DataFrame) -> DataFrame:
    """asset_id, timestamp_sec, width, height, pixels of the images (asset_id, timestamp_sec, content) that decode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [gray_frame(c) for c in b.column(2).to_pylist()]
            whole = [i for i, f in enumerate(found) if f is not None]
            if whole:
                parts = zip(*(found[i] for i in whole), strict=True)
                arrays = [pa.array(c, k) for c, k in zip(parts, (pa.int32(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.select([0, 1]).take(pa.array(whole)).columns, *arrays], names=["asset_id", "timestamp_sec", "width", "height", "pixels"])

    kind = dict(images.dtypes)["asset_id"]
    return images.select("asset_id", F.col("timestamp_sec").cast("double").alias("timestamp_sec"), "content").mapInArrow(run, f"asset_id {kind}, timestamp_sec double, width int, height int, pixels binary")


def frame_aggregates(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Means, clarity, stability and the two best times of the frame signals matched to each segment."""
    clarity = 0.65 * F.col("center_focus") + 0.35 * F.col("contrast")
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("timestamp_sec").alias("t"))))
    mean = lambda c: rounded(average(F.round(c, 9)), 4)
    return matched.groupBy(*keys).agg(
        *(mean(F.col(c)).alias(f"mean_{c}") for c in ("score", "sharpness", "distinctiveness", "motion_energy", "brightness", "contrast")),
        mean(clarity).alias("subject_clarity"),
        F.when(F.count(F.lit(1)) > 1, rounded(clamp(1 - 1.6 * F.stddev_pop("motion_energy")), 4)).otherwise(F.lit(0.72)).alias("stability"),
        F.array_sort(F.collect_list("timestamp_sec")).alias("sampled_sec"),
        F.transform(F.slice(best, 1, 2), lambda x: x["t"]).alias("top_sec"),
    )


def audio_aggregates(matched: DataFrame, keys: list[str]) -> DataFrame:
    """keys, audio_energy, speech_ratio (the share of rows that are not silent)."""
    return matched.groupBy(*keys).agg(rounded(average(F.round("rms_energy", 9)), 4).alias("audio_energy"), rounded(F.count_if(~F.col("is_silent")) / F.count(F.lit(1)), 4).alias("speech_ratio"))


def silence_share(windows: DataFrame, silences: DataFrame, key: str, bin_width: float | None = None) -> DataFrame:
    """windows with is_silent: half or more of a window lies in silence intervals; empty windows are silent."""
    from .intervals import overlapping_ranges

    both = overlapping_ranges(windows.select(key, "window_id", "start_sec", "end_sec"), silences.select(key, F.col("start_sec").alias("_a"), F.col("end_sec").alias("_b")), [key], ("start_sec", "end_sec"), ("_a", "_b"), bin_width)
    overlap = F.greatest(F.lit(0.0), F.least("end_sec", "_b") - F.greatest("start_sec", "_a"))
    quiet = both.groupBy(key, "window_id").agg(F.sum(F.round(overlap, 6)).alias("_q"))
    width = F.col("end_sec") - F.col("start_sec")
    return windows.join(quiet, [key, "window_id"], "left").withColumn("is_silent", (width <= 0) | (F.coalesce("_q", F.lit(0.0)) >= 0.5 * width)).drop("_q")


def audio_rows(samples: DataFrame, silences: DataFrame, times: DataFrame, key: str = "asset_id") -> DataFrame:
    """key, t, rms_energy, peak_loudness, is_silent at given times: samples within half a step, and silence by `silence_share`.

    Where `times` has duration_sec, windows end with the clip, and the step is the duration over one more than the times.
    """
    order = Window.partitionBy(key).orderBy("t")
    half = F.coalesce((F.lead("t").over(order) - F.col("t")) / 2, (F.col("t") - F.lag("t").over(order)) / 2, F.lit(0.5))
    end = F.col("t") + half
    if "duration_sec" in times.columns:
        half = F.col("duration_sec") / (F.count(F.lit(1)).over(Window.partitionBy(key)) + 1) / 2
        end = F.least(F.col("duration_sec"), F.col("t") + half)
    windows = times.withColumns({"start_sec": F.greatest(F.lit(0.0), F.col("t") - half), "end_sec": end, "window_id": F.col("t")})
    found = points_in_ranges(samples.select(key, F.col("t").alias("_t"), "rms"), windows, [key], "_t", "start_sec", "end_sec", None)
    energy = found.groupBy(key, "window_id").agg(rounded(clamp(F.avg("rms")), 4).alias("rms_energy"), rounded(clamp(F.max("rms")), 4).alias("peak_loudness"))
    rows = silence_share(windows, silences, key).join(energy, [key, "window_id"], "left")
    return rows.select(key, "t", F.coalesce("rms_energy", F.lit(0.0)).alias("rms_energy"), F.coalesce("peak_loudness", F.lit(0.0)).alias("peak_loudness"), "is_silent")


def linear_from_db(db: Column) -> Column:
    """10 ** (dB / 20) within [0, 1]; not-a-number and infinities are 0."""
    x = F.pow(F.lit(10.0), db / 20)
    return F.when(x.isNull() | F.isnan(x) | (x == float("inf")), F.lit(0.0)).otherwise(clamp(x))
