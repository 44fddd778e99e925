"""Model results from outside: cache split, fallback, normalisation, and the extension points.  P38, P39, X01-X08 of the survey.

Models and detectors run outside the engine.  What they return is a table, or a function over Arrow batches that the caller
hands in; tasks run in parallel as Spark partitions, and `batches_of` keeps the rows of an asset together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import clamp, rounded
from ..functions.text import is_placeholder, key_values, repaired_json, whole_json
from ..sources.scratch import checkpointed

Analyzer = Callable[[pd.DataFrame], pd.DataFrame]


def batches_of(tasks: DataFrame, analyze: Analyzer, schema: str, key: str = "asset_id", concurrency: int | None = None) -> DataFrame:
    """analyze() over all tasks of an asset at once, as the analyzer protocol has it; at most `concurrency` assets at a time."""
    dealt = tasks.repartition(concurrency, key) if concurrency else tasks
    return dealt.groupBy(key).applyInPandas(analyze, schema)


def detected(assets: DataFrame, detect: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Ranges from a scene detector or spans from a transcriber: a function from a batch of assets to rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield detect(batch)

    return assets.mapInPandas(run, schema)


def attempted(rows: DataFrame, work: Analyzer, fields: str, key: str = "asset_id") -> tuple[DataFrame, DataFrame]:
    """(results, states): work() over each asset's rows at once, and per asset what came of it: n (rows) and error (null, or what was raised).

    `work` takes a pandas frame of one asset's rows and returns one of `fields`.  An asset whose work raises has no results and
    stops no other.  What is found is written to the shared folder, so results and states come from one run of the work.
    Columns of plain types travel for many assets at once, as a frame of its own for each costs more than little work does.
    """
    kind = dict(rows.dtypes)[key]
    names = [f.split()[0] for f in re.split(r",(?![^<]*>)", fields.replace(", ", ","))]
    out = f"{key} {kind}, _found boolean, _error string, {fields}"

    def tried(batch: pd.DataFrame) -> tuple[pd.DataFrame | None, str | None]:
        try:
            return work(batch)[names], None
        except Exception as failure:  # noqa: BLE001  (any failure is the asset's own)
            return None, f"{type(failure).__name__}: {failure}"

    def run(name: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        found, error = tried(batch)
        found = pd.DataFrame(columns=names) if found is None else found
        found = found.reset_index(drop=True).assign(**{key: name[0], "_found": True, "_error": None})
        # One more row tells of the asset itself.
        told = pd.DataFrame([{key: name[0], "_found": False, "_error": error} | dict.fromkeys(names)])
        return pd.concat([told, found.astype(object)])[[key, "_found", "_error", *names]]

    # Few bytes but much work each: a stated number of tasks isn't put together again by size.
    rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)
    schema = T.StructType.fromDDL(out)
    if {t for _, t in rows.dtypes} <= PLAIN and kind not in ("float", "double") and {f.dataType.simpleString() for f in schema} <= PLAIN:
        arrow = pa.schema([(f.name, getattr(pa, ARROW.get(f.dataType.simpleString(), f.dataType.simpleString()))()) for f in schema])

        def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frames in _by_key(batches, key):
                rows: list[list] = [[] for _ in arrow]
                for name, batch in frames:
                    found, error = tried(batch)
                    told = [[name], [False], [error], *([None] for _ in names)]
                    if found is not None:
                        n = len(found)
                        told = [[name] * (n + 1), [False] + [True] * n, [None] * (n + 1), *([None, *found[c].tolist()] for c in names)]
                    for column, values in zip(rows, told, strict=True):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type, from_pandas=True) for x, f in zip(rows, arrow, strict=True)], schema=arrow)

        every = checkpointed(rows.sortWithinPartitions(key).mapInArrow(runs, out))
    else:
        every = checkpointed(rows.groupBy(key).applyInPandas(run, out))
    states = every.groupBy(key).agg(F.count_if("_found").alias("n"), F.max("_error").alias("error"))
    return every.where("_found").drop("_found", "_error"), states


#: Types whose columns are the same in a frame of many assets as in one of each asset, as long as none is null.
PLAIN = {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "string"}
ARROW = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "boolean": "bool_"}


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[tuple[object, pd.DataFrame]]]:
    """Each key with its rows, of batches in the order of keys; lists of the keys that end in a batch."""

    def cut(table: pa.Table, bounds: list[int], names: list) -> list[tuple[object, pd.DataFrame]]:
        # A null in one asset's rows would change the types of all others' columns.
        whole = None if any(c.null_count for c in table.columns) else table.to_pandas()
        found = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            frame = table.slice(a, b - a).to_pandas() if whole is None else whole.iloc[a:b].reset_index(drop=True)
            found.append((names[a], frame))
        return found

    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(key).to_pylist()
        if kept and names[0] == last and names[-1] == last:
            kept.append(batch)
            continue
        table = pa.Table.from_batches([*kept, batch])
        names = [last] * (table.num_rows - batch.num_rows) + names
        bounds = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1])]
        last, tail = names[-1], bounds[-1]
        if len(bounds) > 1:
            yield cut(table, bounds, names)
        kept = table.slice(tail).to_batches()
    if kept:
        table = pa.Table.from_batches(kept)
        yield cut(table, [0, table.num_rows], [last])


SPANS = "start_sec double, end_sec double, text string"


def transcribed(clips: DataFrame, cache: DataFrame, transcribe: Analyzer, key: str = "asset_id", cache_key: str = "cache_key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, states, fresh) of clips (key, cache_key and what the transcriber needs, any number of rows each).

    Spans come from the cache (cache_key, spans) where it has the clip, else from `transcribe`; blank ones are dropped.  States
    tell per clip its status - cached, transcribed or failed -, n_spans and the error.  `fresh` are the cache rows of what was
    transcribed; failed clips get none, so they are tried again.
    """
    known = cache.groupBy(cache_key).agg(F.min("spans").alias("spans"))
    heads = clips.select(key, cache_key).distinct()
    hits = heads.join(known, cache_key)
    found, tried = attempted(clips.join(known.select(cache_key), cache_key, "left_anti"), transcribe, SPANS, key)
    spoken = F.trim(F.coalesce("text", F.lit(""))) != ""
    found = found.where(spoken)
    spans = hits.select(key, F.inline("spans")).where(spoken).select(key, "start_sec", "end_sec", "text").unionByName(found)
    status = hits.select(key, F.lit("cached").alias("status"), F.lit(None).cast("string").alias("error")).unionByName(tried.select(key, F.when(F.col("error").isNull(), "transcribed").otherwise("failed").alias("status"), "error"))
    states = status.join(spans.groupBy(key).agg(F.count(F.lit(1)).alias("n_spans")), key, "left").na.fill(0, ["n_spans"])
    listed = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_sec", "end_sec", "text"))).alias("spans"))
    done = tried.where("error is null").select(key).join(heads, key).join(listed, key, "left")
    return spans, states, done.select(cache_key, F.coalesce("spans", F.array().cast("array<struct<start_sec:double,end_sec:double,text:string>>")).alias("spans"))


def analyzed(tasks: DataFrame, analyze: Analyzer, result: str, fallback: Column, key: str = "asset_id", row: str = "segment_id") -> DataFrame:
    """The tasks with result, status (live or fallback) and detail: one call per asset, and the fallback for each row without an answer.

    `analyze` returns (row, result) for the rows that it answers, `result` being a type; detail is what was raised, or
    `omitted` for a row that a call left out.  The first of several answers for a row, by value, counts.
    """
    kind = dict(tasks.dtypes)[row]
    # Asked and answered: read twice.
    tasks = checkpointed(tasks)
    found, states = attempted(tasks, analyze, f"{row} {kind}, result {result}", key)
    rows = tasks.join(found.groupBy(row).agg(F.min("result").alias("_live")), row, "left").join(states.select(key, "error"), key, "left")
    live = F.col("_live").isNotNull()
    told = {"result": F.coalesce("_live", fallback), "status": F.when(live, "live").otherwise("fallback"), "detail": F.when(~live, F.coalesce("error", F.lit("omitted")))}
    return rows.withColumns(told).drop("_live", "error")


def resolved(tasks: DataFrame, cache: DataFrame, fresh: DataFrame, fallback: DataFrame, key: str = "cache_key") -> DataFrame:
    """Each task with its result and `status`: cached, live or fallback, in that order of preference.

    All three frames have (key, result) with results of one type.
    """
    rows = tasks
    for i, found in enumerate((cache, fresh, fallback)):
        rows = rows.join(found.dropDuplicates([key]).select(key, F.col("result").alias(f"_r{i}")), key, "left")
    status = F.when(F.col("_r0").isNotNull(), "cached").when(F.col("_r1").isNotNull(), "live").otherwise("fallback")
    return rows.withColumns({"result": F.coalesce("_r0", "_r1", "_r2"), "status": status}).drop("_r0", "_r1", "_r2")


def run_stats(resolved_rows: DataFrame) -> DataFrame:
    return resolved_rows.agg(*(F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("live", "cached", "fallback")), F.count(F.lit(1)).alias("requests"))


ANSWER = "summary string, subjects array<string>, actions array<string>, shot_type string, camera_motion string, mood string, story_roles array<string>, quality_findings array<string>, keep_label string, confidence string, rationale string, risk_flags array<string>"


def with_objects(rows: DataFrame, raw: str, name: str) -> DataFrame:
    """Adds the JSON object of each row's text, null where there is none.  Rows whose text is whole JSON never reach Python.

    Both kinds of rows read the input, so rows that are dear to compute should be written before.
    """
    kind = whole_json(raw)
    whole = rows.where(kind.isNotNull() | F.col(raw).isNull()).withColumn(name, F.when(kind == "object", F.col(raw)))
    return whole.unionByName(rows.where(kind.isNull() & F.col(raw).isNotNull()).withColumn(name, repaired_json(raw)))


BOUNDARY = "decision string, reason string, confidence double, suggested_start_sec double, suggested_end_sec double, split_point_sec double"


def boundary_payload(raw: Column, found: Column) -> Column:
    """The fields of a boundary answer out of its text's JSON object `found`, else out of the text's lines; null without either.

    Lines tell decision, reason and confidence only, as local models write them; other answers are never read that way.
    """

    def spoken(lines: Column) -> Column:
        return F.struct(
            F.coalesce(lines["decision"]["text"], lines["decision"]["number"].cast("string")).alias("decision"), lines["reason"]["text"].alias("reason"), lines["confidence"]["number"].alias("confidence"),
            *(F.lit(None).cast("double").alias(c) for c in ("suggested_start_sec", "suggested_end_sec", "split_point_sec")),
        )

    # As an item of an array the lines are read once, not anew for each field.
    lines = F.array(key_values(raw, ("decision", "reason", "confidence")))
    told = F.get(F.transform(lines, lambda x: F.when(x.isNotNull(), spoken(x))), 0)
    return F.when(found.isNotNull(), F.from_json(found, BOUNDARY)).otherwise(told)


def normalised(raw: Column, fallback: Column) -> Column:
    """A record from a model's text: its fields where they are usable, else those of the rule-based record.

    Placeholder texts, empty lists, unknown keep labels and numbers that do not parse are not usable.
    """
    text = lambda a, name: F.coalesce(F.when(~is_placeholder(a[name]), F.trim(a[name])), fallback[name])
    some = lambda items: F.get(F.filter(F.array(items), lambda x: F.size(x) > 0), 0)
    listed = lambda a, name: F.coalesce(some(F.filter(a[name], lambda x: ~is_placeholder(x))), fallback[name])

    def record(a: Column) -> Column:
        keep, sure = F.lower(a["keep_label"]), a["confidence"].try_cast("double")
        return F.struct(
            *(text(a, n).alias(n) for n in ("shot_type", "camera_motion", "mood")),
            *(listed(a, n).alias(n) for n in ("story_roles", "quality_findings", "risk_flags")),
            F.coalesce(F.when(keep.isin("keep", "maybe", "reject"), keep), fallback["keep_label"]).alias("keep_label"),
            F.coalesce(F.when(sure.isNotNull(), rounded(clamp(sure), 4)), fallback["confidence"]).alias("confidence"),
        )

    # As an item of an array the answer is parsed once; as an expression it would be anew for each use of a field.
    return F.get(F.transform(F.array(F.from_json(repaired_json(raw), ANSWER)), record), 0)


def normalised_boundary(decision: Column, confidence: Column, start: Column, end: Column, new_start: Column, new_end: Column, split_at: Column, local: bool = True, duration: Column | None = None) -> Column:
    """(decision, confidence, new_start, new_end, split_at) with defaults.

    Unknown decisions keep; a split of a local model under .85 keeps; trims and extensions without places move each end by
    clamp(.12 * length, .25, .75), a trim down to 1.5 seconds, an extension within the clip (the segment's end, if its
    duration is not given); splits without a place cut in the middle.
    """
    sure = rounded(clamp(confidence), 4)
    chosen = F.when(F.lower(F.trim(decision)).isin("keep", "trim", "extend", "split"), F.lower(F.trim(decision))).otherwise("keep")
    if local:
        chosen = F.when((chosen == "split") & (sure < 0.85), "keep").otherwise(chosen)
    delta = rounded(F.greatest(F.lit(0.25), F.least(F.lit(0.75), 0.12 * F.greatest(F.lit(0.0), end - start))), 3)
    trimmed = F.least(end - 1.5, start + delta)
    own_start = F.when(chosen == "trim", trimmed).when(chosen == "extend", F.greatest(F.lit(0.0), start - delta))
    own_end = F.when(chosen == "trim", F.greatest(trimmed + 1.5, end - delta)).when(chosen == "extend", F.least(end if duration is None else duration, end + delta))
    moves = chosen.isin("trim", "extend")
    return F.struct(
        chosen.alias("decision"),
        sure.alias("confidence"),
        rounded(F.when(moves, F.coalesce(new_start, own_start)), 3).alias("new_start"),
        rounded(F.when(moves, F.coalesce(new_end, own_end)), 3).alias("new_end"),
        rounded(F.when(chosen == "split", F.coalesce(split_at, (start + end) / 2)), 3).alias("split_at"),
    )
