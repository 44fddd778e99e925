"""Near-duplicate segments by brightness histogram and by vector.  P67, J12, J13, G09, G10, P68 of the survey."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, dot, rounded
from ..sources.scratch import checkpointed, dropped, shares, written
from .graph import _forest, connected, least_reached
from .greedy import settled
from .views import numbered

BINS = 256


def histograms(signals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin, weight: brightness bins weighted by max(1, whole tenths of distinctiveness), scaled to 256 per signal, truncated."""
    slot = F.least(F.floor(clamp("brightness") * BINS), F.lit(BINS - 1)).cast("int")
    rows = signals.select(*keys, slot.alias("bin"), F.greatest(F.lit(1), F.floor(clamp("distinctiveness") * 10)).alias("w"))
    total = rows.groupBy(*keys).agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"))
    per = rows.groupBy(*keys, "bin").agg(F.sum("w").alias("w")).join(total, keys)
    return per.select(*keys, "bin", F.floor(F.col("w") * BINS * F.col("n") / F.col("total")).cast("long").alias("weight"))


def intersections(bins: DataFrame, group: str, item: str, threshold: float | None = None) -> DataFrame:
    """group, a, b, similarity for items of one group that share a bin: sum of minima over a's mass (so not symmetric).

    With a threshold over 0, pairs that reach it only, and no others are made on the way but a few: an item's bins are put
    into the order of how many items of the group hold them, rarest first.  What can be common lies in the bins up to the
    first shared one and the mass after it, so a pair needs a shared bin among a's first ones, those before a's remaining
    mass falls under threshold x mass; and at that bin both must still have so much mass ahead.  A bin that all items share
    comes last and makes pairs only where it alone holds enough.  The pairs left are summed over their bins.
    """
    mass = Window.partitionBy(group, item)
    if threshold is None or threshold <= 0:
        totals = bins.groupBy(group, item).agg(F.sum("weight").alias("mass")).withColumnRenamed(item, "a")
        left = bins.select(group, F.col(item).alias("a"), "bin", F.col("weight").alias("wa"))
        right = bins.select(group, F.col(item).alias("b"), "bin", F.col("weight").alias("wb"))
        shared = left.join(right, [group, "bin"]).where("a <> b").groupBy(group, "a", "b").agg(F.sum(F.least("wa", "wb")).alias("common"))
        return shared.join(totals, [group, "a"]).select(group, "a", "b", rounded(F.col("common") / F.col("mass"), 6).alias("similarity"))
    # A rounded similarity reaches the threshold from half a millionth under it.
    least = threshold - 1e-6
    held = bins.where("weight > 0").groupBy(group, "bin").agg(F.count(F.lit(1)).alias("_items"))
    rare = mass.orderBy("_items", "bin")
    ranked = bins.where("weight > 0").join(held, [group, "bin"]).withColumns({"_mass": F.sum("weight").over(mass), "_ahead": F.sum("weight").over(rare.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    ranked = checkpointed(ranked.select(group, item, "bin", "weight", "_mass", "_ahead"))
    left = ranked.where(F.col("_ahead") >= F.col("_mass") * least).select(group, "bin", F.col(item).alias("a"), F.col("_mass").alias("mass"), F.col("_ahead").alias("_a"))
    right = ranked.select(group, "bin", F.col(item).alias("b"), F.col("_mass").alias("_mb"), F.col("_ahead").alias("_b"))
    need = F.col("mass") * least
    met = left.join(right, [group, "bin"]).where((F.col("a") != F.col("b")) & (F.col("_mb") >= need) & (F.least("_a", "_b") >= need))
    pairs = met.select(group, "a", "b", "mass").distinct()
    one = ranked.select(group, F.col(item).alias("a"), "bin", F.col("weight").alias("wa"))
    two = ranked.select(group, F.col(item).alias("b"), "bin", F.col("weight").alias("wb"))
    common = pairs.join(one, [group, "a"]).join(two, [group, "b", "bin"]).groupBy(group, "a", "b", "mass").agg(F.sum(F.least("wa", "wb")).alias("common"))
    return common.select(group, "a", "b", rounded(F.col("common") / F.col("mass"), 6).alias("similarity")).where(F.col("similarity") >= threshold)


def compared(items: DataFrame, group: str, item: str, similarity: Callable[[Column, Column], Column]) -> DataFrame:
    """group, a, b, similarity of all pairs of a group's items by a function of two rows (structs), as `leaders` takes it.

    For groups of few items: there is no bound that could prune pairs of a function that isn't known.
    """
    row = F.struct(*(F.col(c) for c in items.columns))
    one, two = (items.select(group, F.col(item).alias(n), row.alias(f"_{n}")) for n in ("a", "b"))
    return one.join(two, group).where("a <> b").select(group, "a", "b", similarity(F.col("_a"), F.col("_b")).alias("similarity"))


def leaders(items: DataFrame, similar: DataFrame, group: str, item: str, score: str, threshold: float = 0.85) -> DataFrame:
    """group, item, leader, dedup_group, deduplicated: by score descending each unvisited item leads and absorbs what is similar to it.

    `similar` has (group, a, b, similarity) seen from a; groups are numbered from 0 in order of leaders, singletons too.
    An item's candidates are the items before it that would absorb it; it leads unless one of them leads.  Places, leaders and
    numbers come from range partitions and edges, so a group of any size spreads over tasks.
    """
    ranked = numbered(items.select(group, item, score), [F.col(group), F.desc(score), F.col(item)], "place").select(group, item, "place")
    a = ranked.select(group, F.col(item).alias("a"), F.col("place").alias("before"))
    b = ranked.select(group, F.col(item).alias("b"), F.col("place").alias("after"))
    edges = similar.where(F.col("similarity") >= threshold).join(a, [group, "a"]).join(b, [group, "b"]).where("before < after")
    edges = written(edges.select(F.col(group).alias("group"), "before", "after"))
    gone = settled(edges)
    # The earliest leader that absorbs an item, or the item itself.
    led = edges.join(gone.select("group", F.col("place").alias("before")), ["group", "before"], "left_anti").groupBy(F.col("after").alias("place")).agg(F.min("before").alias("_leader"))
    placed = checkpointed(ranked.join(led, "place", "left").withColumn("leader", F.coalesce("_leader", "place")).select(group, item, "place", "leader"))
    dropped(edges)
    heads = numbered(placed.where("leader = place").select(group, F.col(item).alias("_head"), "leader"), [F.col(group), F.col("leader")], "_n")
    first = heads.groupBy(group).agg(F.min("_n").alias("_first"))
    out = placed.join(heads, [group, "leader"]).join(first, group)
    return out.select(group, item, F.col("_head").alias("leader"), (F.col("_n") - F.col("_first")).cast("int").alias("dedup_group"), (F.col(item) != F.col("_head")).alias("deduplicated"))


#: Vectors per cell, about; cells at most (their centres go through the driver); vectors of a block within a cell.
CELL_VECTORS, MOST_CELLS, BLOCK_VECTORS = 1_000, 1_024, 4_000
#: Copies of vectors that a task makes at once, and pairs of a block's matrix that it looks at and hands on at once.
MOST_COPIES, MOST_PAIRS = 20_000, 250_000
#: Guests a vector on average, and blocks of a cell, up to which vectors are copied; vectors of a side of a task where they aren't.
MOST_GUESTS, MOST_BLOCKS, TASK_VECTORS = 2, 4, 16_000
#: Places that vectors are dealt to by a hash, for drawing a part of them.
PLACES = 1 << 20


def unit(vector: Column) -> Column:
    """The vector over its length as doubles; null where it has none."""
    v = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    # Within the inner function the length would be summed up anew for every element.
    scaled = F.transform(F.array(length), lambda n: F.transform(v, lambda x: x / n))
    return F.when(length > 0, scaled[0])


def _angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centres.T, -1, 1))


def _stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _slices(batch: pa.RecordBatch, centres: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few enough rows that a copy for every centre, the most there are at wide angles, is a small batch too."""
    step = max(1, MOST_COPIES // max(1, centres))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def _celled(centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the nearest centre and the angle to it."""
        for whole in batches:
            for b in _slices(whole, len(centres)):
                angles = _angles(_stacked(b.column(1)), centres)
                cell = angles.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])], names=["item", "v", "cell", "angle"])

    return run


def _away(b: pa.RecordBatch, centres: np.ndarray, radii: np.ndarray, most: float) -> np.ndarray:
    """For each vector and cell, whether the cell is an earlier one that may hold a partner, by two triangle bounds."""
    angles = _angles(_stacked(b.column(1)), centres)
    # A partner u of cell c has angle(u, c) <= radius, and is no nearer to this vector's centre than to its own.
    away = (angles <= radii + most) & (angles - b.column(3).to_numpy()[:, None] <= 2 * most)
    return away & (np.arange(len(centres)) < b.column(2).to_numpy()[:, None])


def _guest_counts(centres: np.ndarray, radii: np.ndarray, most: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many copies `_guests` would make."""
        for whole in batches:
            for b in _slices(whole, len(centres)):
                yield pa.RecordBatch.from_arrays([pa.array([int(_away(b, centres, radii, most).sum())])], names=["n"])

    return run


def _guests(centres: np.ndarray, radii: np.ndarray, most: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies of a vector for the earlier cells that may hold a partner."""
        for whole in batches:
            for b in _slices(whole, len(centres)):
                row, cell = np.nonzero(_away(b, centres, radii, most))
                if len(row):
                    copies = b.select(["item", "v"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*copies.columns, pa.array(cell.astype(np.int32))], names=["item", "v", "cell"])

    return run


def _near(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, sure) of the pairs that may reach the threshold, by strips of rows; `sure` are those that must.

    Products are of single precision; the slack covers what that and a rounding to six places can hide.
    """
    slack = 1e-5 + 2e-7 * left.shape[1]
    one, two = left.astype(np.float32), right.astype(np.float32)
    step = max(1, MOST_PAIRS // len(right))
    for k in range(0, len(left), step):
        product = one[k : k + step] @ two.T
        at, to = np.nonzero(product >= threshold - slack)
        if len(at):
            yield at + k, to, product[at, to] >= threshold + slack


def _cosines(left: np.ndarray, right: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The pairs' products, summed up in order."""
    parts = [(left[at[j : j + 10_000]] * right[to[j : j + 10_000]]).cumsum(1)[:, -1] for j in range(0, len(at), 10_000)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _pairs(one: pa.Array, left: np.ndarray, two: pa.Array, right: np.ndarray, same: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks: a matrix product finds those near the threshold, which are then summed up in order.

    Each strip's pairs leave at once: however many vectors are alike, a task holds the blocks and the pairs of a strip.
    """
    for at, to, _ in _near(left, right, threshold):
        if same:
            # Within one block each pair comes twice.
            at, to = at[at < to], to[at < to]
        if not len(at):
            continue
        a, b = one.take(pa.array(at)), two.take(pa.array(to))
        first = pc.less(a, b)
        yield pa.RecordBatch.from_arrays([pc.if_else(first, a, b), pc.if_else(first, b, a), pa.array(_cosines(left, right, at, to))], names=["a", "b", "cosine"])


def _block_pairs(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of two blocks of a cell, which come as rows of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        sides = [table.filter(pc.equal(table["block"], k)).combine_chunks() for k in (lo, hi)]
        if not all(t.num_rows for t in sides):
            return
        left, right = (_stacked(t["v"].combine_chunks()) for t in sides)
        one, two = (t["item"].combine_chunks() for t in sides)
        yield from _pairs(one, left, two, right, lo == hi, threshold)

    # Spark tells a function of streamed batches by its hints, which it must find as types.
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _one_block(keys: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        """A block's rows as one row: the keys, the items and the bytes of the vectors."""
        rows = rows.combine_chunks()
        items, vectors = rows["item"].combine_chunks(), _stacked(rows["v"].combine_chunks())
        listed = pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)
        return pa.table([*(rows[k].slice(0, 1) for k in keys), listed, pa.array([vectors.tobytes()], pa.binary())], names=[*keys, "items", "vectors"])

    run.__annotations__ = {"rows": pa.Table, "return": pa.Table}
    return run


def _packed(rows: DataFrame, keys: list[str], n: int, task_vectors: int = TASK_VECTORS) -> DataFrame:
    """(keys, items, vectors): a row for each block, whose number is the last key, in partitions of about `task_vectors` of the n rows (item, v, keys)."""
    kinds = rows.select(*keys, F.array("item").alias("items"), F.lit(b"").alias("vectors")).schema
    dealt = rows.select("item", "v", *keys).repartitionByRange(shares(n, task_vectors), *keys)
    return checkpointed(dealt.groupBy(*keys).applyInArrow(_one_block(keys), kinds))


def _met(left: DataFrame, right: DataFrame, meet: Column) -> DataFrame:
    """(one, left, two, right, same) of packed blocks (_x, _y: their numbers) that meet.

    Every partition of one side meets every partition of the other, which a task reads where it lies: no vector is copied or
    written again, however many blocks it meets, and a cell of any size spreads over tasks.
    """
    x = left.select(F.col("items").alias("one"), F.col("vectors").alias("left"), *(F.col(c).alias(f"_x_{c}") for c in left.columns[:-2]))
    y = right.select(F.col("items").alias("two"), F.col("vectors").alias("right"), *(F.col(c).alias(f"_y_{c}") for c in right.columns[:-2]))
    return x.hint("shuffle_replicate_nl").join(y, meet)


def _sides(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, bool]]:
    """The two blocks of each row of (one, left, two, right, same)."""
    for i in range(b.num_rows):
        one, two = b.column(0)[i].values, b.column(2)[i].values
        left, right = (np.frombuffer(b.column(c)[i].as_buffer()).reshape(len(items), -1) for c, items in ((1, one), (3, two)))
        yield one, left, two, right, b.column(4)[i].as_py()


def _met_pairs(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of the blocks that meet."""
        for b in batches:
            for sides in _sides(b):
                yield from _pairs(*sides, threshold)

    return run


def _met_links(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the pairs of blocks whose items are labels, edges that link the same labels: fewer than a task has labels."""
        held = []
        for batch in batches:
            for one, left, two, right, _ in _sides(batch):
                coded = pa.chunked_array([one, two]).combine_chunks().dictionary_encode()
                code, root = coded.indices.to_numpy().astype(np.int64), np.arange(len(coded.dictionary))
                here, there = code[: len(one)], code[len(one) :]
                for at, to, sure in _near(left, right, threshold):
                    new = root[here[at]] != root[there[to]]
                    at, to, sure = at[new], to[new], sure[new]
                    if not len(at):
                        continue
                    open_ = np.flatnonzero(~sure)
                    sure[open_] = np.floor(_cosines(left, right, at[open_], to[open_]) * 1e6 + 0.5) / 1e6 >= threshold
                    a, b = root[here[at[sure]]], root[there[to[sure]]]
                    root = least_reached(np.concatenate([np.arange(len(root)), a]), np.concatenate([root, b]), len(root))
                moved = np.flatnonzero(root != np.arange(len(root)))
                if len(moved):
                    held.append(pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(moved)), coded.dictionary.take(pa.array(root[moved]))], names=["u", "v"]))
        yield from _forest(iter(held))

    return run


def _unit_rows(vectors: DataFrame, item: str, vector: str) -> DataFrame:
    """(item, v) of the vectors that have a direction and a name."""
    return vectors.select(F.col(item).alias("item"), unit(F.col(vector)).alias("v")).where("item is not null and v is not null and not exists(v, x -> isnan(x))")


def vector_cells(vectors: DataFrame, item: str, vector: str, threshold: float, cell_vectors: int = CELL_VECTORS, most_guests: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(item, v, cell) of every vector, and (item, v, cell) of its copies for earlier cells that may hold a partner.

    Centres are vectors themselves, the first in the order of a hash.  With few enough vectors there is one cell and no copy.
    With `most_guests`, copies are counted first, and of more than so many a vector none are made: the second is None.
    """
    rows = checkpointed(_unit_rows(vectors, item, vector))
    n = rows.count()
    cells = min(MOST_CELLS, max(1, -(-n // cell_vectors)))
    kind = rows.schema["item"].dataType.simpleString()
    centres = np.array([r.v for r in rows.orderBy(F.xxhash64("item"), "item").limit(cells).select("v").collect()])
    if not len(centres):
        own = rows.withColumns({"cell": F.lit(0), "angle": F.lit(0.0)})
        return own.drop("angle"), own.drop("angle").where("false")
    own = checkpointed(rows.mapInArrow(_celled(centres), f"item {kind}, v array<double>, cell int, angle double"))
    radii = np.full(len(centres), -np.inf)
    for cell, radius in own.groupBy("cell").agg(F.max("angle")).collect():
        radii[cell] = radius
    # The slack covers what the rounding of an angle can hide.
    most = float(np.arccos(np.clip(threshold - 1e-5, -1, 1))) + 1e-6
    if most_guests is not None and len(centres) > 1:
        copies = own.mapInArrow(_guest_counts(centres, radii, most), "n long").agg(F.sum("n")).first()[0]
        if copies > most_guests * n:
            return own.drop("angle"), None
    return own.drop("angle"), own.mapInArrow(_guests(centres, radii, most), f"item {kind}, v array<double>, cell int")


def vector_pairs(vectors: DataFrame, item: str, vector: str, threshold: float = 0.95, scope: str | None = None, cell_vectors: int = CELL_VECTORS, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """(a, b, cosine), a < b, of vectors with a cosine of the threshold or more; with `scope` (an asset) within one only.

    Vectors are made unit vectors first; those of length 0 have no pairs.  Over all items each vector belongs to the cell of
    its nearest centre.  Two vectors within the threshold's angle lie in one cell or in cells that the triangle inequality
    leaves: the later cell's vector goes to the earlier cell as a guest, so every pair meets once, exactly, and cells that are
    far apart never meet.  Where that takes more than a few copies of a vector, as at wide angles, all vectors are one cell.
    A cell's residents and guests are cut into blocks that meet as matrices.  Few blocks are copied for each that they meet; of
    a cell with more, blocks are written once and read by the tasks, so what is written grows with the vectors and a task's
    memory is bounded, however many vectors a cell has.  The products grow with the square of a cell.
    """
    if scope:
        rows = vectors.select(F.col(item).alias("item"), unit(F.col(vector)).alias("v"), scope).where("v is not null")
        left, right = rows.select(scope, F.col("item").alias("a"), F.col("v").alias("va")), rows.select(scope, F.col("item").alias("b"), F.col("v").alias("vb"))
        return left.join(right, scope).where("a < b").select(scope, "a", "b", rounded(dot("va", "vb"), 6).alias("cosine")).where(F.col("cosine") >= threshold)
    own, guests = vector_cells(vectors, item, vector, threshold, cell_vectors, MOST_GUESTS)
    alone = own.withColumn("guest", F.lit(False))
    every = alone.withColumn("cell", F.lit(0)) if guests is None else checkpointed(alone.unionByName(guests.withColumn("guest", F.lit(True))))
    counts = every.groupBy("cell").agg(F.count_if(~F.col("guest")).alias("n"), F.count_if("guest").alias("g"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block_vectors)).cast("int")
    # Residents' blocks are 0 to n - 1, guests' n to n + g - 1; a block meets itself and later ones, guests never each other.
    counts = counts.select("cell", (F.col("n") + F.col("g")).alias("_rows"), blocks("n").alias("n"), F.when(F.col("g") > 0, blocks("g")).otherwise(0).alias("g"))
    counts = counts.withColumn("large", F.col("n") + F.col("g") > MOST_BLOCKS)
    dealt = every.join(F.broadcast(counts), "cell")
    dealt = dealt.withColumn("block", F.when(F.col("guest"), F.col("n") + F.pmod(F.xxhash64("item"), F.greatest("g", F.lit(1)))).otherwise(F.pmod(F.xxhash64("item"), F.col("n"))).cast("int"))
    kind = own.schema["item"].dataType.simpleString()
    large = counts.where("large").agg(F.sum("_rows")).first()[0] or 0
    small = dealt.where("not large").withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("guest"), F.col("n") - 1).otherwise(F.col("n") + F.col("g") - 1))))
    cells = small.select("item", "v", "cell", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    pairs = cells.groupBy("cell", "lo", "hi").applyInArrow(_block_pairs(threshold), f"a {kind}, b {kind}, cosine double")
    if large:
        packed = _packed(dealt.where("large"), ["cell", "guest", "block"], large, min(TASK_VECTORS, MOST_BLOCKS * block_vectors))
        x, y = F.col("_x_block"), F.col("_y_block")
        # Of two blocks of residents one is left where their numbers' sum is odd, the other where it is even: tasks get alike.
        turn = (x == y) | ((x < y) & ((x + y) % 2 == 1)) | ((x > y) & ((x + y) % 2 == 0))
        met = _met(packed, packed, (F.col("_x_cell") == F.col("_y_cell")) & ~F.col("_y_guest") & (F.col("_x_guest") | turn))
        met = met.select("one", "left", "two", "right", (x == y).alias("same"))
        pairs = pairs.unionByName(met.mapInArrow(_met_pairs(threshold), f"a {kind}, b {kind}, cosine double"))
    return pairs.where("a < b").select("a", "b", rounded("cosine", 6).alias("cosine")).where(F.col("cosine") >= threshold)


def vector_links(vectors: DataFrame, item: str, vector: str, threshold: float = 0.95, block_vectors: int = BLOCK_VECTORS, task_vectors: int = TASK_VECTORS) -> DataFrame:
    """(a, b): edges with the components of all pairs of `vector_pairs`, one at most for each vector.

    Pairs within a component link nothing new, so they are neither written nor sought.  A first part of the vectors, drawn by a
    hash, meets all vectors; a task hands on edges that span what it found.  What is then outside the largest component is drawn
    in parts four times as large each time, until nothing is left: each pair of vectors has met, or lies in that component.
    """
    place = F.pmod(F.xxhash64("item"), F.lit(PLACES))
    rows = checkpointed(_unit_rows(vectors, item, vector).withColumn("place", place))
    block = lambda n: F.pmod(F.xxhash64("item", "v"), F.lit(shares(n, block_vectors))).cast("int")
    kind = rows.schema["item"].dataType.simpleString()
    total, known, giant, upto, step = rows.count(), None, None, 0, task_vectors
    while True:
        here = rows.withColumn("label", F.col("item"))
        if known is not None:
            named = known.select(F.col("node").alias("item"), "component").hint("merge")
            here = rows.join(named, "item", "left").withColumn("label", F.coalesce("component", "item"))
        inside = F.lit(False) if giant is None else F.col("label") == F.lit(giant)
        left = here.where(~inside & (F.col("place") >= upto)).count()
        if not left:
            break
        to = min(PLACES, upto + -(-(PLACES - upto) * step // left))
        drawn = F.col("place").between(upto, to - 1)
        # A vector of an earlier part has met all, unless it lay in the largest component then, and so still does.
        sides = []
        for part, n in ((here.where(~inside & drawn), min(left, step)), (here.where(inside | (F.col("place") >= upto)), total)):
            sides.append(_packed(part.withColumn("block", block(n)).select(F.col("label").alias("item"), "v", "block"), ["block"], n, task_vectors))
        met = _met(*sides, F.lit(True)).select("one", "left", "two", "right", F.lit(False).alias("same"))
        edges = met.mapInArrow(_met_links(threshold), f"a {kind}, b {kind}").where("a <> b")
        before = known
        known = connected(edges if before is None else edges.union(before.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        dropped(before)
        if giant is None:
            largest = known.groupBy("component").count().orderBy(F.desc("count"), "component").first()
            giant = largest and largest.component
        else:
            giant = known.where(F.col("node") == F.lit(giant)).first().component
        upto, step = to, step * 4
    if known is None:
        return rows.select(F.col("item").alias("a"), F.col("item").alias("b")).where("false")
    return known.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")


def vector_groups(items: DataFrame, pairs: DataFrame, item: str, score: str) -> DataFrame:
    """item, component, vector_group, deduplicated: single linkage over the pairs; the best score stays, the first on ties.

    Only real groups are numbered, from 1; ids of this kind and of `leaders` are kept apart by name.
    """
    comps = connected(pairs.select("a", "b")).withColumnRenamed("node", item)
    order = Window.partitionBy("component").orderBy(F.desc(score), item)
    rows = items.join(comps, item).withColumn("_turn", F.row_number().over(order))
    numbers = numbered(comps.select("component").distinct(), [F.col("component")], "vector_group")
    return rows.join(numbers, "component").select(item, "component", F.col("vector_group").cast("int").alias("vector_group"), (F.col("_turn") > 1).alias("deduplicated"))


def prompt_similarity(positive: Column, negative: Column) -> Column:
    """clip((mean positive - half mean negative + .5) / 2, 0, 1) of arrays of similarities; .5 without positives."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.when(F.size(positive) > 0, clamp((mean(positive) - 0.5 * F.when(F.size(negative) > 0, mean(negative)).otherwise(F.lit(0.0)) + 0.5) / 2)).otherwise(F.lit(0.5))


def image_scores(images: DataFrame, vectors: DataFrame, positive: list[list[float]], negative: list[list[float]], image: str = "image") -> DataFrame:
    """The rows of `images` with clip_score: how well their image fits the prompts' vectors, .5 without a vector of it.

    An image is scored once however many rows show it.  Prompts are few and stand in the plan; `vectors` holds (image, vector),
    of an image that comes twice the least vector counts.
    """
    known = images.select(image).distinct().join(vectors.groupBy(image).agg(F.min("vector").alias("vector")), image)
    own = known.withColumn("_v", unit(F.col("vector")))
    fits = lambda prompts: F.array(*(dot(F.col("_v"), unit(F.array(*map(F.lit, map(float, p))))) for p in prompts)) if prompts else F.array().cast("array<double>")
    scored = own.where("_v is not null").select(image, rounded(prompt_similarity(fits(positive), fits(negative)), 4).alias("clip_score"))
    return images.join(scored, image, "left").withColumn("clip_score", F.coalesce("clip_score", F.lit(0.5)))
