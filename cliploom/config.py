"""Engine settings, from keywords, a mapping or the session's `spark.cliploom.*` settings."""

from __future__ import annotations

import importlib.util
import shutil
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


def _number(text: object, default: float, low: float, high: float) -> float:
    try:
        return min(high, max(low, float(str(text))))
    except ValueError:
        return default


def _switch(text: object) -> bool:
    return str(text).strip().lower() not in ("0", "false", "no", "off")


@dataclass(frozen=True)
class EngineConfig:
    """Values out of range are clamped; values that do not parse fall back to the default."""

    mode: str = "full"
    max_segments_per_asset: int = 99
    keyframes: int = 4
    keyframe_width: int = 960
    concurrency: int = 2
    cache: bool = True
    vector_gate: bool = True
    vector_min_score: float = 0.1
    budget_pct: float = 100.0
    boundary_refinement: bool = True
    legacy_fallback: bool = True
    semantic_validation: bool = True
    ambiguity_threshold: float = 0.6
    floor_threshold: float = 0.45
    min_targets: int = 1
    validation_budget_pct: float = 100.0
    validation_max: int = 2
    max_adjustment: float = 1.5
    dedup: bool = True
    dedup_threshold: float = 0.85
    top_windows: int = 3

    @classmethod
    def of(cls, values: Mapping[str, object]) -> EngineConfig:
        mode = str(values.get("mode", "full")).strip().lower()
        fast = mode == "fast"
        d = cls(mode="fast", max_segments_per_asset=1, keyframes=1, keyframe_width=448, top_windows=2) if fast else cls()
        n = lambda key, low, high: _number(values.get(key, getattr(d, key)), getattr(d, key), low, high)
        b = lambda key: _switch(values.get(key, getattr(d, key)))
        ambiguity = n("ambiguity_threshold", 0, 1)
        return cls(
            mode=d.mode,
            max_segments_per_asset=int(n("max_segments_per_asset", 1, 2**31)),
            keyframes=int(n("keyframes", 1, 2**31)),
            keyframe_width=int(n("keyframe_width", 160, 2**31)),
            concurrency=int(n("concurrency", 1, 2**31)),
            cache=b("cache"),
            vector_gate=b("vector_gate"),
            vector_min_score=n("vector_min_score", 0, 1),
            budget_pct=n("budget_pct", 0, 100),
            boundary_refinement=b("boundary_refinement"),
            legacy_fallback=b("legacy_fallback"),
            semantic_validation=b("semantic_validation"),
            ambiguity_threshold=ambiguity,
            floor_threshold=min(ambiguity, n("floor_threshold", 0, 1)),
            min_targets=int(n("min_targets", 0, 2**31)),
            validation_budget_pct=n("validation_budget_pct", 0, 100),
            validation_max=int(n("validation_max", 0, 2**31)),
            max_adjustment=n("max_adjustment", 0.25, 1e9),
            dedup=str(values.get("dedup", "true")).strip().lower() in ("true", "1", "yes"),
            dedup_threshold=n("dedup_threshold", 0, 1),
            top_windows=int(n("top_windows", 1, 2**31)),
        )

    @classmethod
    def from_session(cls, spark: SparkSession) -> EngineConfig:
        found = {f.name: spark.conf.get(f"spark.cliploom.{f.name}", None) for f in fields(cls)}
        return cls.of({k: v for k, v in found.items() if v is not None})


#: Programs and modules that sources outside the engine need; fixed names.
PROGRAMS, MODULES = ("ffprobe", "ffmpeg", "exiftool"), ("scenedetect", "faster_whisper", "fastapi")


def capabilities(found: Callable[[str], object] = shutil.which, known: Callable[[str], object] = importlib.util.find_spec) -> dict[str, bool]:
    """Which of the outside programs and modules are there, on the machine that asks."""
    return {name: bool(found(name)) for name in PROGRAMS} | {name: known(name) is not None for name in MODULES}


def probe_runner(able: Mapping[str, bool] | None = None) -> str | None:
    """The program that reads media: the first of ffprobe and exiftool that is there."""
    there = capabilities() if able is None else able
    return next((name for name in ("ffprobe", "exiftool") if there.get(name)), None)
