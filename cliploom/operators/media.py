"""Pairing source clips with proxies, and ids of matched assets.  J01, J02, P35, U01 of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import padded, rounded
from .views import numbered


def match_media(media: DataFrame) -> DataFrame:
    """source_path, proxy_path, confidence, reason: each source with its best proxy of the same clip key.

    `media` has path, role, clip_key, stem, ext and nullable duration_sec and fps.  Sources without proxy stand alone with 1.0;
    proxies of keys without a source stand for themselves with 0.45.
    """
    pick = lambda role, prefix: media.where(F.col("role") == role).select(F.col("clip_key").alias("key"), *(F.col(c).alias(f"{prefix}_{c}") for c in ("path", "stem", "ext", "duration_sec", "fps")))
    sources, proxies = pick("source", "s"), pick("proxy", "p")
    stem = F.contains(F.lower("p_stem"), F.lower("s_stem")) | F.contains(F.lower("s_stem"), F.lower("p_stem"))
    near = lambda c: F.coalesce(F.abs(F.col(f"s_{c}") - F.col(f"p_{c}")) < 0.2, F.lit(False))
    points = [(F.lit(True), 0.35), (stem, 0.10), (F.col("s_ext") == F.col("p_ext"), 0.05), (near("duration_sec"), 0.10), (near("fps"), 0.05)]
    score = F.lit(0.4)
    for test, gain in points:
        score = score + F.when(test, F.lit(gain)).otherwise(F.lit(0.0))
    # Files that score alike are one class: only classes meet, and of a class of proxies the first path stands for all.
    alike = lambda prefix: [f"{prefix}_{c}" for c in ("stem", "ext", "duration_sec", "fps")]
    source_classes = sources.select("key", *alike("s")).distinct()
    proxy_classes = proxies.groupBy("key", *alike("p")).agg(F.min("p_path").alias("p_path"))
    pairs = source_classes.join(proxy_classes, "key").withColumn("score", F.least(F.lit(1.0), score))
    first = pairs.groupBy("key", *alike("s")).agg(F.min(F.struct((-F.col("score")).alias("_less"), "p_path")).alias("_best"))
    first = first.toDF("_key", *(f"_{c}" for c in alike("s")), "_best")
    same = [F.col("key") == F.col("_key"), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alike("s"))]
    best = sources.join(first, same).groupBy("s_path").agg(F.min("_best").alias("_best")).select("s_path", F.col("_best.p_path").alias("p_path"), (-F.col("_best._less")).alias("score"))
    label = F.when(F.col("score") >= 0.85, "strong").when(F.col("score") >= 0.7, "likely").when(F.col("score") >= 0.55, "possible").otherwise("weak")
    matched = best.select(F.col("s_path").alias("source_path"), F.col("p_path").alias("proxy_path"), rounded(F.col("score"), 2).alias("confidence"), label.alias("reason"))
    alone = sources.join(best.select("s_path"), "s_path", "left_anti").select(F.col("s_path").alias("source_path"), F.lit(None).cast("string").alias("proxy_path"), F.lit(1.0).alias("confidence"), F.lit("source-only").alias("reason"))
    orphans = proxies.join(sources.select("key").distinct(), "key", "left_anti").select(F.col("p_path").alias("source_path"), F.col("p_path").alias("proxy_path"), F.lit(0.45).alias("confidence"), F.lit("proxy-only").alias("reason"))
    return matched.unionByName(alone).unionByName(orphans)


def with_asset_ids(matched: DataFrame) -> DataFrame:
    """asset-NNN in order of the source path."""
    rows = numbered(matched, [F.col("source_path")], "_n")
    return rows.withColumn("asset_id", F.concat(F.lit("asset-"), padded(F.col("_n"), 3))).drop("_n")
