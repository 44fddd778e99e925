"""Expectation checks and run history.  A06-A08, J15, S09-S11, U04, U05 of the survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.numeric import rounded
from ..functions.text import runtime_text
from .views import cache_activity, execution_context


def scalar_checks(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, expected, observed, passed: min, max and exact bounds (null: not asked); a missing observation fails."""
    rows = expected.join(observed, keys, "left")
    within = lambda test, bound: F.col(bound).isNull() | F.coalesce(test, F.lit(False))
    v = F.col("value")
    passed = within(v >= F.col("min"), "min") & within(v <= F.col("max"), "max") & within(v == F.col("exact"), "exact")
    return rows.select(*keys, "min", "max", "exact", "value", passed.alias("passed"))


def set_checks(required: Column, forbidden: Column, observed: Column) -> Column:
    """(missing, unwanted, passed)."""
    missing, unwanted = F.array_sort(F.array_except(required, observed)), F.array_sort(F.array_intersect(forbidden, observed))
    return F.struct(missing.alias("missing"), unwanted.alias("unwanted"), ((F.size(missing) == 0) & (F.size(unwanted) == 0)).alias("passed"))


def check_totals(checks: DataFrame, scope: str) -> DataFrame:
    return checks.groupBy(scope).agg(F.count(F.lit(1)).alias("checks"), F.count_if("passed").alias("passed"), F.bool_and("passed").alias("all_passed"))


def observed_state(items: DataFrame, scope: str) -> DataFrame:
    """scope, item_count, reels, roles, groups (sorted sets), opener_reel, closing_reel."""
    return items.groupBy(scope).agg(
        F.count(F.lit(1)).alias("item_count"),
        *(F.array_sort(F.collect_set(c)).alias(n) for c, n in (("source_reel", "reels"), ("sequence_role", "roles"), ("sequence_group", "groups"))),
        F.min_by("source_reel", "order_index").alias("opener_reel"),
        F.max_by("source_reel", "order_index").alias("closing_reel"),
    )


def dataset_fingerprint(tokens: DataFrame, token: str, scope: str) -> DataFrame:
    """scope, n, fingerprint: the first 12 hex digits of the MD5 of the sorted distinct tokens and their number."""
    rows = tokens.groupBy(scope).agg(F.array_sort(F.collect_set(token)).alias("t"))
    return rows.select(scope, F.size("t").alias("n"), F.substring(F.md5(F.concat_ws("|", F.array_join("t", "|"), F.size("t").cast("string"))), 1, 12).alias("fingerprint"))


def last_match(history: DataFrame, fingerprint: str, order: str, exclude: str | None = None, run: str = "run_id", fixture_set: str | None = None) -> DataFrame:
    """The latest history row of the dataset (any, for an empty fingerprint), without the excluded run; a top-1, no full sort.

    With `fixture_set` only rows whose evaluation was made with that set (column fixture_set).
    """
    if fixture_set is not None:
        history = history.where(F.col("fixture_set") == fixture_set)
    rows = history.where((F.lit(fingerprint) == "") | (F.col("dataset_fingerprint") == fingerprint))
    if exclude is not None:
        rows = rows.where(F.col(run) != exclude)
    return rows.orderBy(F.desc(order), F.desc(run)).limit(1)


def compared(runs: DataFrame, value: str, before: str) -> DataFrame:
    """Adds delta and delta_pct (1 place) against the earlier value; null without one."""
    delta = F.col(value) - F.col(before)
    return runs.withColumns({"delta": rounded(delta, 3), "delta_pct": rounded(F.try_divide(delta * 100, F.col(before)), 1)})


def differences(pairs: list[tuple[str, Column, Column]]) -> Column:
    """Names of the context fields that differ, in order."""
    return F.filter(F.array(*(F.when(~a.eqNullSafe(b), F.lit(n)) for n, a, b in pairs)), lambda x: x.isNotNull())


def runtime_record(counters: DataFrame, timings: dict[str, float], config: EngineConfig, provider: str) -> DataFrame:
    """A run's counters with its timings in seconds, its total, the seconds per asset and target, and how models ran."""
    total = float(sum(timings.values()))
    per = lambda n: rounded(F.try_divide(F.lit(total), F.col(n)), 3)
    context = execution_context(provider, config.concurrency)
    return counters.withColumns(
        {f"{k}_sec": F.lit(float(v)) for k, v in timings.items()}
        | {"total_runtime_sec": F.lit(total), "total_runtime": runtime_text(F.lit(total)), "sec_per_asset": per("asset_count"), "sec_per_target": per("vlm_target_count")}
        | {k: F.lit(v) for k, v in context.items()}
        | {"ai_cache_activity": cache_activity(F.lit(0), F.col("ai_live_segment_count")), "budget_pct": F.lit(config.budget_pct), "mode": F.lit(config.mode)}
    )
