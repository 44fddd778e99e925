"""Greedy suppression in an order, without a group in one row or task.  G01-G05 and G09 of the survey rest on it.

Going through a group in order, a row stays unless an earlier row that stays conflicts with it.  Two forms:

* `settled` takes the conflicts as edges.  A row is settled once all earlier ones that conflict with it are: groups of up to
  `TASK_EDGES` edges are settled as their edges stream through a task in order; of larger ones each round settles the rows
  that nothing undecided precedes, all at once, with the rows they suppress.  Where conflicts form long chains and rounds
  settle little, the next stretch of the order, of about `TASK_EDGES` edges, is settled in one go instead.
* `kept_apart` takes ranges that conflict by their overlap.  The first `FIRST_ROWS` of a group are folded, at once where no group is longer; of a longer group,
  those kept suppress among the others by a join on (key, cell), which leaves little where ranges are dense.  When that no
  longer halves the rows, ranges are sparse, and the conflicts among the rest are few enough to be edges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import overlap_ratio
from ..sources.scratch import dropped, is_written, written
from .ranges import overlapping_ranges
from .views import numbered

#: Edges that one task settles in order, and rows of a group that are folded at once.
TASK_EDGES, FIRST_ROWS = 1_000_000, 2_000


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges by (group, after) to the suppressed rows of each group; all earlier rows are settled when one comes."""
    group, out, now = None, set(), None
    for b in batches:
        found = []
        groups = b.column(0).dictionary_encode()
        names = groups.dictionary.to_pylist()
        for g, before, after in zip(groups.indices.to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if names[g] != group:
                group, out, now = names[g], set(), None
            if after != now and before not in out:
                # The first edge from a row that stays decides; later edges to this row change nothing.
                now = after
                out.add(after)
                found.append((g, after))
        if found:
            yield pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array([g for g, _ in found], pa.int32())), pa.array([p for _, p in found], b.column(2).type)], names=["group", "place"])


def _settled_in_tasks(edges: DataFrame) -> DataFrame:
    kinds = dict(edges.dtypes)
    return edges.repartition("group").sortWithinPartitions("group", "after", "before").mapInArrow(_in_order, f"group {kinds['group']}, place {kinds['after']}")


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges that still matter when the rows `gone` are suppressed: neither from nor to one of them."""
    left = edges.join(gone.select("group", F.col("place").alias("before")), ["group", "before"], "left_anti")
    return left.join(gone.select("group", F.col("place").alias("after")), ["group", "after"], "left_anti").select("group", "before", "after")


def settled(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(group, place): the suppressed rows.  Edges are (group, before, after) of places, before < after; groups are not null.

    Rows that no edge names, and rows named that are not returned, stay.
    """
    every = edges if is_written(edges) else written(edges.select("group", "before", "after"))
    large = written(every.groupBy("group").count().where(F.col("count") > task_edges).select("group"))
    if large.isEmpty():
        dropped(large)
        return _settled_in_tasks(every)
    out = _settled_in_tasks(every.join(large, "group", "left_anti"))
    left, n = written(every.join(large, "group")), None
    while (count := left.count()) > 0:
        if count <= task_edges:
            return out.unionByName(_settled_in_tasks(left))
        if n is None or 2 * count <= n:
            heads = left.select("group", F.col("before").alias("place")).distinct().join(left.select("group", F.col("after").alias("place")).distinct(), ["group", "place"], "left_anti")
            gone = written(left.join(heads.withColumnRenamed("place", "before"), ["group", "before"], "left_semi").select("group", F.col("after").alias("place")).distinct())
            rest = _without(left, gone)
        else:
            # Rounds no longer halve the edges: settle all rows up to a place, whose edges fit into a task.
            bound = left.approxQuantile("after", [task_edges / count], 0.01)[0]
            early = left.where(F.col("after") <= bound)
            gone = written(_settled_in_tasks(early))
            later = left.where(F.col("after") > bound)
            stay = later.where(F.col("before") <= bound).join(gone.withColumnRenamed("place", "before"), ["group", "before"], "left_anti")
            gone = gone.unionByName(written(stay.select("group", F.col("after").alias("place")).distinct()))
            rest = _without(later, gone).where(F.col("before") > bound)
        after = written(rest)
        dropped(left)
        out, left, n = out.unionByName(gone), after, count
    return out


def _fold(rows: DataFrame, key: str, order: Sequence[str], start: str, end: str, most: float, limit: int | None) -> DataFrame:
    """One key's few rows in order, each kept unless it overlaps a kept one by the ratio `most`."""
    rest = [c for c in rows.columns if c != key and c not in order]
    packed = F.struct(*(F.col(c) for c in [*order, *rest]))
    kind = f"array<{dict(rows.select(packed.alias('x')).dtypes)['x']}>"

    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda k: overlap_ratio(k[start], k[end], x[start], x[end]) >= most)
        if limit is not None:
            clash = clash | (F.size(acc) >= limit)
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(x)))

    folded = rows.groupBy(key).agg(F.array_sort(F.collect_list(packed)).alias("_all")).select(key, F.explode(F.aggregate("_all", F.array().cast(kind), step)).alias("_x"))
    return folded.select(key, *(F.col(f"_x.{c}").alias(c) for c in [*order, *rest])).select(*rows.columns)


def kept_apart(rows: DataFrame, key: str, order: Sequence[str], start: str, end: str, most: float, limit: int | None = None, cell: float = 8.0, first_rows: int = FIRST_ROWS, task_edges: int = TASK_EDGES) -> DataFrame:
    """The rows that overlap no earlier kept one of their key by the ratio `most`; with `limit`, the first so many of a key.

    `order` names columns that put a key's rows into a total order, ascending.  Ratio: overlap over the shorter length.
    The rows are written first: they are counted by key, and folded.
    """
    rows = written(rows)
    if rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > first_rows).isEmpty():
        return _fold(rows, key, order, start, end, most, limit)
    turn = Window.partitionBy(key).orderBy(*order)
    first = rows.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= first_rows)
    kept = _fold(first.drop("_turn"), key, order, start, end, most, limit)
    place = F.struct(*order)
    # Where a key's first rows end; most keys have no more.
    ends = first.where(F.col("_turn") == first_rows).select(F.col(key).alias("_key"), place.alias("_last"))
    rest = rows.join(ends, F.col(key) == F.col("_key")).where(place > F.col("_last")).drop("_key", "_last")
    if rest.isEmpty():
        return kept
    kept, rest = written(kept), written(rest)

    def clashing(early: DataFrame, late: DataFrame, columns: list[str]) -> DataFrame:
        """Pairs of an earlier and a later row of a key that overlap by the ratio."""
        one = early.select(key, place.alias("_p1"), F.col(start).alias("_s1"), F.col(end).alias("_e1"), *(F.col(c).alias(f"_early_{c}") for c in columns))
        two = late.select(key, place.alias("_p2"), F.col(start).alias("_s2"), F.col(end).alias("_e2"), *columns)
        pairs = overlapping_ranges(one, two, [key], ("_s1", "_e1"), ("_s2", "_e2"), cell)
        return pairs.where((F.col("_p1") < F.col("_p2")) & (overlap_ratio(F.col("_s1"), F.col("_e1"), F.col("_s2"), F.col("_e2")) >= most))

    new, n = kept, None
    while True:
        hit = clashing(new, rest, []).select(key, F.col("_p2").alias("_place")).distinct()
        left = rest.withColumn("_place", place).join(hit, [key, "_place"], "left_anti").select(*rows.columns)
        if limit is not None:
            left = left.join(kept.groupBy(key).count().where(F.col("count") >= limit).select(key), key, "left_anti").select(*rows.columns)
        left = written(left)
        dropped(rest)
        count = left.count()
        if count == 0:
            break
        if n is None or 2 * count <= n:
            some = left.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= first_rows).drop("_turn")
            new = written(_fold(some, key, order, start, end, most, limit))
            kept, n = kept.unionByName(new), count
            rest = written(left.join(new.select(key, *order), [key, *order], "left_anti").select(*rows.columns))
            dropped(left)
            continue
        # What is left is sparse: its conflicts are edges.
        placed = written(numbered(left, [F.col(c) for c in (key, *order)], "_n"))
        edges = clashing(placed, placed, ["_n"]).select(F.col(key).alias("group"), F.col("_early__n").alias("before"), F.col("_n").alias("after"))
        gone = settled(edges, task_edges).select(F.col("place").alias("_n"))
        kept = kept.unionByName(placed.join(gone, "_n", "left_anti").select(*rows.columns))
        break
    if limit is not None:
        kept = kept.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= limit).drop("_turn")
    return kept
