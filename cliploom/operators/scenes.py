"""Scene cuts in series of frames, as a table function over each clip's frames.  S16, X01 and S17 of the survey.

A frame's change against the one before is compared with its neighbours': a cut is a change of `floor` or more that is also
`ratio` times the mean change of up to `reach` frames on either side, where the scene before and the rest of the clip both
last `least` seconds.  Changes are compared in whole ten-thousandths, so the result doesn't hang on the order of sums.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from .intervals import fallback_scenes

UNIT = 10_000
SCENES = "asset_id long, pos int, start_sec double, end_sec double"


def scene_cuts(floor: float = 0.3, ratio: float = 3.0, reach: int = 4, least: float = 1.0, asset: str = "long") -> UserDefinedTableFunction:
    """A table function of rows (asset_id, t, change, duration_sec), partitioned by asset and in order of t, to its scenes.

    It holds 2 x `reach` + 1 frames.  A clip without a cut has no row; a frame without a time or change is left out, as is
    the change of the first one.
    """
    smallest, times = math.floor(floor * UNIT + 0.5), math.floor(ratio * 100 + 0.5)

    class Cuts:
        def __init__(self) -> None:
            self.frames: deque = deque()
            self.at = 0
            self.start, self.pos = 0.0, 0
            self.asset = self.duration = None

        def _judged(self) -> Iterator[tuple]:
            """The scene that ends at the frame in the middle, if it is a cut; then the next frame is in the middle."""
            t, change = self.frames[self.at]
            beside = [c for i, (_, c) in enumerate(self.frames) if i != self.at]
            cut = change >= smallest and bool(beside) and change * len(beside) * 100 >= times * sum(beside)
            if cut and t - self.start >= least and self.duration - t >= least:
                yield self.asset, self.pos, self.start, t
                self.start, self.pos = t, self.pos + 1
            if self.at == reach:
                self.frames.popleft()
            else:
                self.at += 1

        def eval(self, row) -> Iterator[tuple]:  # noqa: ANN001
            first = self.asset is None
            self.asset, self.duration = row["asset_id"], row["duration_sec"]
            if row["t"] is not None and row["change"] is not None:
                # The first frame has none before it.
                self.frames.append((row["t"], 0 if first else math.floor(row["change"] * UNIT + 0.5)))
                if len(self.frames) > self.at + reach:
                    yield from self._judged()

        def terminate(self) -> Iterator[tuple]:
            while self.at < len(self.frames):
                yield from self._judged()
            if self.pos:
                yield self.asset, self.pos, self.start, self.duration

    return F.udtf(Cuts, returnType=SCENES.replace("asset_id long", f"asset_id {asset}"))


def registered(spark: SparkSession, name: str = "scene_cuts", **limits) -> None:  # noqa: ANN003
    """Names the table function for SQL: SELECT * FROM scene_cuts(TABLE(frames) PARTITION BY asset_id ORDER BY t)."""
    spark.udtf.register(name, scene_cuts(**limits))


def scenes(frames: DataFrame, assets: DataFrame, **limits) -> DataFrame:  # noqa: ANN003
    """asset_id, pos, start_sec, end_sec of all clips: scenes between cuts, or the fallback windows where there is no cut.

    Frames are (asset_id, t, change); a clip's frames stream through one task, whatever other clips are there.
    """
    kind = dict(assets.dtypes)["asset_id"]
    rows = frames.select("asset_id", "t", "change").join(assets.select("asset_id", "duration_sec"), "asset_id")
    found = scene_cuts(asset=kind, **limits)(rows.asTable().partitionBy("asset_id").orderBy("t", "change"))
    rest = assets.join(found.select("asset_id").distinct(), "asset_id", "left_anti")
    return found.unionByName(fallback_scenes(rest, "asset_id", "duration_sec"))
