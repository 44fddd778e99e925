"""N-gram Jaccard join by vertical partitioning, and the components of its links.

Texts with equal shingle sets form one class; only classes are compared.  The global n-gram order (rare before frequent)
is cut into fragments and each fragment is worked on by itself:

1. One pass hashes all texts: a class id per document, and a sketch of how often n-grams occur (`sketch_bits` counters of
   one byte after a logarithm, so what is broadcast has a fixed size).  The order of n-grams is (sketched count, hash).
2. A second pass sends each class's prefix - the first n - ceil(t n) + 1 n-grams of the order, of which linked classes
   share at least one - to the fragments, as binary arrays.  With each n-gram goes the largest partner that the class could
   link with if this were the first n-gram in common: what follows it must hold the whole overlap.  A fragment keeps the
   member lists of n-grams that two or more classes hold and could link by, once per distinct list.
3. For all links (`join`), all pairs of a list's members are verified: partial overlaps are counted in each fragment of the
   two sets and summed per pair.  The links between different classes come out whole, so a group of near copies costs in
   proportion to its pairs.
4. For components only (`digest`, `keep_one`), in turns, a list's heads of the turn are paired with the members that are in other
   components, and the pairs are verified.  Lists within one component are done.  Turns go on as long as each at least
   halves the pairs of a list's members in different components; what is left then is verified pair by pair.  Members
   of one component need no test, so a group of near copies costs in proportion to its size, and no link is lost that
   would join components.
5. Before sets are made and shuffled, pairs are left out whose sets can't overlap enough: each set's n-grams are counted in
   128 parts of the order, and in no part can a pair share more than the smaller count.
6. N-grams that the sketch gives to `hot_classes` classes or more are not gathered in a fragment: their lists are dealt by
   class to many tasks, and joins on lists are dealt anew by Spark where they are skewed.

Components are found by contraction within tasks and, where one task can't hold the links, star steps between them.  Each turn
only adds links between the components of the turn before.  Rows of the turns are small tables in the shared folder,
removed when the next turn has read them.

Edge cases: ids are integers, as the smallest one names a component; null, empty and blank texts have no n-grams and are linked with nothing; a text of fewer words than `k` is one
n-gram; rows that share a doc_id are one node, so they are in one component; rows with a null doc_id get a null
component and link with nothing; an empty table gives no rows.  Columns other than doc_id and text are not read by the
join and pass through `keep_one`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected
from ..operators.views import numbered
from .columns import checkpointed, dropped, partitions, written
from .shingles import mixed, set_id, shingle_sets, texts_of

#: Similarity as a fraction, so that comparisons are exact.
NUM, DEN = 75, 100
WORDS = 5
SKETCH_BITS, SKETCH_PARTS = 22, 16
#: Prefix n-grams that one fragment holds, about, and that a task gathers before it sends them.
FRAGMENT_NGRAMS, FLUSH_NGRAMS = 400_000, 1_000_000
VERIFY_FRAGMENTS = 4
#: Pairs left per document at which turns of star pairs end.
FEW_PAIRS = 0.25
#: Members that later turns pair with the rest.
HEADS = 16
#: Classes that hold an n-gram, by the sketch, from which on its list is dealt to many tasks.
HOT_CLASSES = 200_000
#: Parts of the n-gram order in which a set's n-grams are counted, and a count that stands for itself and more.
SET_PARTS, UNKNOWN = 128, 255
PART_SHIFT = np.uint64(57)
#: Bits of the fixed-size filter for the documents whose sets are made.
FILTER_BITS = 21


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-num * n // den) + 1


def _classes(k: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of kind 0: doc_id, n, class and n-grams by part; of kind 1: a part of this task's sketch."""
    schema = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros(1 << bits, np.uint32), False
        for batch in batches:
            ids, ns, names, parts = batch.column(0).to_pylist(), [], [], []
            held = []
            for tokens in shingle_sets(texts_of(batch), k):
                ns.append(len(tokens))
                names.append(set_id(tokens))
                parts.append(np.minimum(np.bincount((tokens >> PART_SHIFT).astype(np.int64), minlength=SET_PARTS), UNKNOWN).astype(np.uint8).tobytes())
                held.append((tokens >> np.uint64(64 - bits)).astype(np.int64))
                if len(held) >= 256:
                    np.add.at(counts, np.concatenate(held), 1)
                    held = []
            if held:
                np.add.at(counts, np.concatenate(held), 1)
            some = some or bool(ids)
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int8()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(names, pa.int64()), pa.nulls(n, pa.int32()), pa.array(parts, pa.binary())], schema=schema)
        if some:
            parts = np.minimum(counts, 65_535).astype(np.uint16).reshape(SKETCH_PARTS, -1)
            m = SKETCH_PARTS
            yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int8()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(range(m), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], schema=schema)

    return run


CLASS_SCHEMA = "kind tinyint, doc_id long, n long, class long, part int, counts binary"


def _rank(counts: np.ndarray) -> np.ndarray:
    """A count's logarithm in one byte."""
    return np.minimum(8 * np.log2(1 + counts), 255).astype(np.uint8)


def _sum_sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up parts as they stream by; gives each part's counters as logarithms of one byte."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, packed in zip(batch["part"], batch["counts"]):
            counts = np.frombuffer(zlib.decompress(packed), np.uint16)
            sums[part] = sums[part] + counts if part in sums else counts.astype(np.int64)
    for part, counts in sums.items():
        yield pd.DataFrame({"part": [part], "counts": [zlib.compress(_rank(counts).tobytes(), 1)]})


def _order(rows: DataFrame, bits: int) -> bytes:
    """The sketch: 2**bits bytes, whatever the input's size."""
    summed = rows.where("kind = 1").select("part", "counts").repartition(SKETCH_PARTS, "part").mapInPandas(_sum_sketch, "part int, counts binary")
    parts = {r.part: zlib.decompress(r.counts) for r in summed.collect()}
    blank = bytes((1 << bits) // SKETCH_PARTS)
    return b"".join(parts.get(i, blank) for i in range(SKETCH_PARTS))


def _postings(k: int, bits: int, sketch: object, n_fragments: int, num: int, den: int, hot_classes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("fragment", pa.int32()), ("tokens", pa.binary()), ("classes", pa.binary()), ("sizes", pa.binary()), ("bounds", pa.binary())])

    hot_rank = _rank(np.array([hot_classes]))[0]

    def flush(tokens: list, ranks: list, classes: list, sizes: list) -> pa.RecordBatch:
        t, hot = np.concatenate(tokens), np.concatenate(ranks) >= hot_rank
        lengths = [len(x) for x in tokens]
        c, s = np.repeat(np.array(classes, np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths)
        place = np.concatenate([np.arange(n) for n in lengths])
        b = ((s - place) * (num + den) // num - s).astype(np.int32)
        # The hash is the order within a count, so high bits of the mixed hash deal n-grams evenly.
        # An n-gram of very many classes is dealt by class, to fragments of negative numbers.
        f = np.where(hot, -1 - (c.view(np.uint64) % np.uint64(n_fragments)).astype(np.int64), (mixed(t) % np.uint64(n_fragments)).astype(np.int64)).astype(np.int32)
        by = np.argsort(f, kind="stable")
        t, c, s, b, f = t[by], c[by], s[by], b[by], f[by]
        names, at = np.unique(f, return_index=True)
        ends = np.append(at[1:], len(f))
        cut = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), cut(t), cut(c), cut(s), cut(b)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(sketch.value, np.uint8)
        seen: set[int] = set()
        tokens, ranks, classes, sizes, total = [], [], [], [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                for t in shingle_sets(texts_of(batch), k):
                    if not len(t) or (name := set_id(t)) in seen:
                        continue
                    seen.add(name)
                    p = prefix_length(len(t), num, den)
                    r = rank[(t >> np.uint64(64 - bits)).astype(np.int64)]
                    first = np.argsort(r, kind="stable")[:p]
                    tokens.append(t[first])
                    ranks.append(r[first])
                    classes.append(name)
                    sizes.append(len(t))
                    total += p
                    if total >= FLUSH_NGRAMS:
                        yield flush(tokens, ranks, classes, sizes)
                        tokens, ranks, classes, sizes, total = [], [], [], [], 0
            if tokens:
                yield flush(tokens, ranks, classes, sizes)

    return run


def _member_lists(num: int, den: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The member lists of a fragment's n-grams that two or more classes hold, once per distinct list: (list, class, size, bound).

    A member stays where another one's size is within its reach; of lists with the same members the largest bounds count.
    A fragment of hot n-grams holds a part of each list, which is named after its n-gram and passed on as it is.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        gather = lambda name, kind: np.frombuffer(b"".join(frame[name]), kind)
        t, c, s, b = gather("tokens", np.uint64), gather("classes", np.int64), gather("sizes", np.int32), gather("bounds", np.int32)
        if frame["fragment"].iat[0] < 0:
            return pd.DataFrame({"list": t.view(np.int64), "class": c, "size": s, "bound": b})
        by = np.lexsort((c, t))
        t, c, s, b = t[by], c[by], s[by], b[by]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        t, c, s, b = t[new], c[new], s[new].astype(np.int64), b[new].astype(np.int64)
        group = np.cumsum(np.append(True, t[1:] != t[:-1])) - 1 if len(t) else np.zeros(0, np.int64)
        by_size = np.sort((group << 32) + s)
        low = (group << 32) - (-num * s // den)
        others = np.searchsorted(by_size, (group << 32) + np.maximum(b, 0), "right") - np.searchsorted(by_size, low, "left") - (s <= b)
        stay = others > 0
        group, c, s, b = group[stay], c[stay], s[stay], b[stay]
        stay = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        group, c, s, b = group[stay], c[stay], s[stay], b[stay]
        if not len(group):
            return pd.DataFrame({"list": np.zeros(0, np.int64), "class": np.zeros(0, np.int64), "size": np.zeros(0, np.int32), "bound": np.zeros(0, np.int32)})
        at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        n = np.diff(np.append(at, len(group)))
        with np.errstate(over="ignore"):
            name = np.repeat(mixed(np.add.reduceat(mixed(c.view(np.uint64) + np.uint64(1)), at) + n.astype(np.uint64)), n)
        by = np.lexsort((c, name))
        name, c, s, b = name[by], c[by], s[by], b[by]
        at = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (c[1:] != c[:-1])))
        return pd.DataFrame({"list": name[at].view(np.int64), "class": c[at], "size": s[at].astype(np.int32), "bound": np.maximum.reduceat(b, at).astype(np.int32)})

    return run


def _sets(k: int, wanted: object, n_fragments: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(class, fragment, tokens) of the documents that the filter lets through."""
    schema = pa.schema([("class", pa.int64()), ("fragment", pa.int32()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(np.frombuffer(zlib.decompress(wanted.value), np.uint8))
        seen: set[int] = set()
        for batch in batches:
            texts = [t for i, t in zip(batch.column(0).to_pylist(), texts_of(batch)) if flags[i & ((1 << FILTER_BITS) - 1)]]
            names, fragments, slices, size = [], [], [], 0
            for t in shingle_sets(texts, k):
                if not len(t) or (name := set_id(t)) in seen:
                    continue
                seen.add(name)
                f = (mixed(t) % np.uint64(n_fragments)).astype(np.int32)
                for i in range(n_fragments):
                    if len(part := t[f == i]):
                        names.append(name)
                        fragments.append(i)
                        slices.append(part.view(np.int64))
                        size += len(part)
                if size >= FLUSH_NGRAMS:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(fragments, pa.int32()), pa.array(slices, pa.list_(pa.int64()))], schema=schema)
                    names, fragments, slices, size = [], [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(fragments, pa.int32()), pa.array(slices, pa.list_(pa.int64()))], schema=schema)

    return run


def _fits(a: str, b: str, num: int, den: int) -> Column:
    """Sizes that allow the similarity, each within the other's bound, for columns with the suffixes a and b."""
    size_a, size_b = F.col(f"size_{a}"), F.col(f"size_{b}")
    return (size_a * den >= size_b * num) & (size_b * den >= size_a * num) & (size_b <= F.col(f"bound_{a}")) & (size_a <= F.col(f"bound_{b}"))


_MEMBER = ("class", "size", "bound", "node", "component", "degree")
_PAIR = tuple(f"{c}_{x}" for c in ("class", "size", "node", "component") for x in "ab")


def _side(rows: DataFrame, x: str) -> DataFrame:
    return rows.select(F.col("list").alias(f"list_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in _MEMBER))


def _untried(rows: DataFrame, tried: list[DataFrame]) -> DataFrame:
    """The pairs, the smaller class first and each once, without those of `tried`."""
    swap = F.col("class_a") > F.col("class_b")
    pick = lambda c, x, y: F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}")
    rows = rows.select(*(pick(c, x, "b" if x == "a" else "a") for c in ("class", "size", "node", "component") for x in "ab"), F.lit(0).alias("old"))
    for done in tried:
        rows = rows.unionByName(done.withColumn("old", F.lit(1)))
    # Components change from turn to turn, so they are not part of the key.
    rows = rows.groupBy(*_PAIR[:6]).agg(F.max("old").alias("old"), *(F.min(c).alias(c) for c in _PAIR[6:]))
    return rows.where("old = 0").drop("old")


def _stars(placed: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Each list's heads of this turn with the members in other components: one head at first, then up to `HEADS`.

    Heads are the members that stand in the most lists: a class with few n-grams of its own is in the middle of its
    copies and links with most of them.  They are found with partial aggregation; lists that share members mostly share heads.
    """
    order = F.struct((-F.col("degree")).alias("d"), F.xxhash64("class", F.lit(turn)).alias("h"), *_MEMBER)
    slot = F.pmod(F.xxhash64("class", F.lit(-1 - turn)), F.lit(HEADS if turn else 1))
    heads = placed.groupBy("list", slot.alias("slot")).agg(F.min(order).alias("head")).select("list", *(F.col(f"head.{c}").alias(c) for c in _MEMBER))
    on = (F.col("list_a") == F.col("list_b")) & (F.col("class_a") != F.col("class_b")) & (F.col("component_a") != F.col("component_b")) & _fits("a", "b", num, den)
    return _side(heads, "a").join(_side(placed, "b"), on)


def _all_pairs(placed: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a list's members in different components."""
    on = (F.col("list_a") == F.col("list_b")) & (F.col("class_a") < F.col("class_b")) & (F.col("component_a") != F.col("component_b")) & _fits("a", "b", num, den)
    return _side(placed, "a").join(_side(placed, "b"), on)


def _open_lists(placed: DataFrame, comps: DataFrame) -> tuple[DataFrame, int]:
    """The lists whose members are in more than one component, and the pairs of members that this leaves at most."""
    moved = placed.join(comps.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left")
    moved = written(moved.select("list", "class", "size", "bound", "node", F.coalesce("_to", "component").alias("component"), "degree"))
    m = F.col("m")
    each = moved.groupBy("list", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("list").agg(((F.sum(m) * F.sum(m) - F.sum(m * m)) / 2).alias("pairs"))
    still = written(each.where("pairs > 0"))
    out = written(moved.join(still.select("list"), "list", "left_semi"))
    left = still.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    dropped(moved, still)
    return out, left


def _bound(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose overlap may be large enough: in no part can they share more than the smaller count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(f"parts_{x}").to_pylist()), np.uint8).reshape(-1, SET_PARTS) for x in "ab")
            size = batch.column("size_a").to_numpy().astype(np.int64) + batch.column("size_b").to_numpy()
            most = np.where((np.minimum(a, b) == UNKNOWN).any(1), size, np.minimum(a, b).sum(1, dtype=np.int64))
            yield batch.select(list(_PAIR)).filter(pa.array(most * den >= (size - most) * num))

    return run


def _promising(pairs: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs without those whose sets, counted by part, can't overlap enough."""
    side = lambda x: members.select(F.col("class").alias(f"class_{x}"), F.col("parts").alias(f"parts_{x}"))
    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in _PAIR)
    return pairs.join(side("a"), "class_a").join(side("b"), "class_b").mapInArrow(_bound(num, den), schema)


def _verified(pairs: DataFrame, named: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs that link: overlaps counted by fragment, summed by pair.

    Sets are made anew from each class's first document, only for classes in `pairs`.  The filter may let a few others
    through, which the join leaves out; a set that comes twice is counted once.
    """
    sets = named.mapInArrow(_sets(k, _filter_bytes(pairs), VERIFY_FRAGMENTS), "class long, fragment int, tokens array<long>")
    side = lambda x: sets.select(F.col("class").alias(f"class_{x}"), "fragment", F.col("tokens").alias(f"tokens_{x}"))
    pieces = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(VERIFY_FRAGMENTS - 1))))
    partial = pieces.join(side("a"), ["class_a", "fragment"]).join(side("b"), ["class_b", "fragment"]).select(*_PAIR, "fragment", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("common"))
    of_fragment = lambda i: F.coalesce(F.max(F.when(F.col("fragment") == i, F.col("common"))), F.lit(0))
    summed = partial.groupBy(*_PAIR).agg(reduce(Column.__add__, map(of_fragment, range(VERIFY_FRAGMENTS))).alias("common"))
    return summed.where(F.col("common") * den >= (F.col("size_a") + F.col("size_b") - F.col("common")) * num).drop("common")


def _filter_bytes(pairs: DataFrame) -> object:
    """A bit per first document of a class in `pairs`, modulo 2**FILTER_BITS; what is collected has at most that many rows."""
    slots = pairs.select(F.explode(F.array("node_a", "node_b")).alias("node")).select(F.col("node").bitwiseAND((1 << FILTER_BITS) - 1).cast("int").alias("slot")).distinct()
    flags = np.zeros(1 << FILTER_BITS, np.uint8)
    flags[slots.toArrow().column(0).to_numpy()] = 1
    return pairs.sparkSession.sparkContext.broadcast(zlib.compress(np.packbits(flags).tobytes(), 1))


def _connecting(placed: DataFrame, members: DataFrame, named: DataFrame, n_rows: int, k: int, num: int, den: int) -> list[DataFrame]:
    """Links that have the components of all links, by turn."""
    links, tried, turn, before = [], [], 0, math.inf

    def test(found: DataFrame) -> None:
        tried.append(written(_untried(found, tried)))
        pairs = written(_promising(tried[-1], members, num, den))
        links.append(written(_verified(pairs, named, k, num, den)))
        dropped(pairs)

    while True:
        test(_stars(placed, turn, num, den))
        comps = connected(links[-1].select(F.col("component_a").alias("a"), F.col("component_b").alias("b")))
        after, left = _open_lists(placed, comps)
        dropped(placed, comps)
        placed, turn = after, turn + 1
        # Turns go on as long as they do more than testing the pairs that are left would.
        if left <= FEW_PAIRS * n_rows or left * 2 > before:
            break
        before = left
    if left:
        test(_all_pairs(placed, num, den))
    dropped(placed, *tried)
    return links


def join(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN, sketch_bits: int = SKETCH_BITS, every_link: bool = True, hot_classes: int = HOT_CLASSES) -> tuple[DataFrame, DataFrame]:
    """(rows, links): doc_id, n_shingles, class and component_id per row; links (a, b) between class ids, each once.

    All links between different classes, or without `every_link` only some that connect the components.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = written(texts.mapInArrow(_classes(k, sketch_bits), CLASS_SCHEMA))
    rows = checkpointed(first.where("kind = 0").select("doc_id", "n", "class"))
    sketch = spark.sparkContext.broadcast(_order(first, sketch_bits))
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_fragments = max(partitions(spark), math.ceil(total * (den - num) / den / FRAGMENT_NGRAMS), 1)

    named = texts.where("doc_id is not null")
    sent = named.mapInArrow(_postings(k, sketch_bits, sketch, n_fragments, num, den, hot_classes), "fragment int, tokens binary, classes binary, sizes binary, bounds binary")
    lists = sent.groupBy("fragment").applyInPandas(_member_lists(num, den), "list long, class long, size int, bound int")
    with_words = rows.where("n > 0 and doc_id is not null")
    least = checkpointed(with_words.groupBy("class").agg(F.min("doc_id").alias("node")))
    # From here on a class's node is its first document, and its component the least node that it is known to reach.
    lists = lists.groupBy("list", "class", "size").agg(F.max("bound").alias("bound"))
    degree = F.count(F.lit(1)).over(Window.partitionBy("class")).alias("degree")
    lists = written(lists.join(least, "class").select("list", "class", "size", "bound", "node", F.col("node").alias("component"), degree))
    counted = first.where("kind = 0 and n > 0").select("class", F.col("doc_id").alias("node"), F.col("counts").alias("parts"))
    members = written(counted.join(lists.select("class", "node").distinct(), ["class", "node"], "left_semi").dropDuplicates(["class"]))
    dropped(first)
    if every_link:
        pairs = written(_promising(_untried(_all_pairs(lists, num, den), []), members, num, den))
        links = [written(_verified(pairs, named, k, num, den))]
        dropped(lists, pairs)
    else:
        links = _connecting(lists, members, named, n_rows, k, num, den)
    dropped(members)

    # Rows that share an id are one node.
    twice = with_words.select("doc_id", "class").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    shared = with_words.join(twice, "doc_id", "left_semi").join(least, "class").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    every = reduce(DataFrame.unionByName, links)
    comps = connected(every.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")).unionByName(shared))
    of_class = least.join(comps, "node", "left").select("class", F.coalesce("component", "node").alias("component"))
    out = rows.join(of_class, "class", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "class", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out, every.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))


def joined(docs: DataFrame, **options: object) -> tuple[DataFrame, DataFrame]:
    """`join` for ids of any type: ids that are not whole numbers are numbered in their order, so the least stays the least."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, T.IntegralType):
        return join(docs, **options)
    ids = checkpointed(numbered(docs.select("doc_id").where("doc_id is not null").distinct(), [F.col("doc_id")], "_join_no"))
    rows, links = join(docs.select("doc_id", "text").join(ids, "doc_id", "left").select(F.col("_join_no").alias("doc_id"), "text"), **options)
    of = lambda name: ids.select(F.col("_join_no").alias(f"_{name}"), F.col("doc_id").alias(name))
    rows = rows.withColumnsRenamed({"doc_id": "_doc_id", "component_id": "_component_id"}).join(of("doc_id"), "_doc_id", "left").join(of("component_id"), "_component_id", "left")
    return rows.select("doc_id", "n_shingles", "class", "component_id"), links


def digest(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return joined(docs, every_link=False, **options)[0].select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, **options: object) -> DataFrame:
    """The input without documents that are not the first of their component; of rows that share an id one stays (the least text hash).

    Rows with a null doc_id stay.
    """
    rows = joined(docs, every_link=False, **options)[0]
    stays = rows.where("doc_id = component_id").select(F.col("doc_id").alias("_join_id")).distinct()
    ids = F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else F.col("doc_id")
    kept = docs.join(stays, ids == F.col("_join_id"), "left_semi")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(F.coalesce("text", F.lit("")))))
    kept = kept.withColumn("_join_turn", turn).where("_join_turn = 1").drop("_join_turn")
    return kept.unionByName(docs.where(ids.isNull()))
