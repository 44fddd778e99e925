"""Source divergence audit: mergeable radix tries of terms with counters per source, merged by prefix range.

Every task counts the terms of its documents in byte tries, one per language: a leaf has a counter per source and one for
documents, which lie in number columns.  A trie that reaches `TRIE_LEAVES` leaves or half of `TRIE_COUNTERS` counters is
emptied as leaf rows in UTF-8 order; as tries can be merged, how often that happens does not matter.  Leaf rows are written once and dealt by ranges of (language, term), that
is by prefix, as balanced as Spark's range partitioning makes them whatever the prefixes are.  A range's rows stream in order
into a trie that sums them and is emptied, again in UTF-8 order, into blocks of kept terms.

Sources of a language are numbered in UTF-8 order and cut into tiles of `TILE`.  For each block and pair of tiles one group
computes the exact sums of all pairs of sources and the first terms of each source; sums of blocks add up, and the first
`top` terms of a source are among the first of its blocks.  So a language that holds most rows is many groups.

Numbers are exact: p = 1 + floor(1e9 * (count + 2) / (N + 2 V)) by long division in 64 bits, for totals up to 9e15.

Edge cases: null text, language and source are ''; a group without terms, or of a language that keeps none, has p from zero
counts and pairs of value 0; a language of one source has no pairs; an empty table gives no rows; rows that repeat are
documents of their own; ties of the value go by UTF-8 order of the item.  Other columns are left out of the plan.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import checkpointed, dropped, partitions, written

#: Documents of a language that a kept term is in at least, and terms listed per source.
MIN_DOCS, TOP_TERMS = 10, 10
#: Leaves and counters of a trie at most, bytes of text counted between two visits to it, terms of a block, sources of a tile.
TRIE_LEAVES, TRIE_COUNTERS, TEXT_BYTES, BLOCK_TERMS, TILE = 400_000, 4_000_000, 8_000_000, 20_000, 64

_LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LEAF = "lang string, term binary, docs long, sources array<string>, counts array<long>"
_FOUND = "lang string, part string, source string, item string, value long"
_ROWS = 10_000


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, A-Z in lower case."""
    return (text or b"").translate(_LETTERS).split()


class Trie:
    """A radix trie over byte strings: nodes are [label, children by first byte, number of the leaf or None].

    A leaf's counters, one per source and one (source number 0) for documents, lie in columns of (leaf, source, count).
    """

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.size = 0
        self.sources: dict[str | None, int] = {None: 0}
        self.columns: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.counters = 0

    def leaf(self, term: bytes) -> int:
        """The number of a term's leaf, made if it is new."""
        node, at, end = self.root, 0, len(term)
        while at < end:
            children = node[1]
            if children is None:
                children = node[1] = {}
            first = term[at]
            node = children.get(first)
            if node is None:
                node = children[first] = [term[at:], None, None]
                break
            label = node[0]
            if term.startswith(label, at):
                at += len(label)
                continue
            same = 1
            while at + same < end and same < len(label) and label[same] == term[at + same]:
                same += 1
            node[0] = label[same:]
            node = children[first] = [label[:same], {label[same]: node}, None]
            at += same
        if node[2] is None:
            node[2] = self.size
            self.size += 1
        return node[2]

    def add(self, leaves: np.ndarray, sources: np.ndarray, counts: np.ndarray) -> None:
        """Adds to counters given by leaf and source numbers."""
        self.columns.append((leaves.astype(np.int32), sources.astype(np.int32), counts.astype(np.int64)))
        self.counters += len(leaves)

    def source(self, name: str | None) -> int:
        return self.sources.setdefault(name, len(self.sources))

    def full(self) -> bool:
        if self.counters >= TRIE_COUNTERS:
            self.summed()
        return self.size >= TRIE_LEAVES or self.counters >= TRIE_COUNTERS // 2

    def summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The counters, each once, by leaf and then source."""
        if not self.columns:
            return (np.zeros(0, np.int64),) * 3
        leaf, source, count = (np.concatenate(c) for c in zip(*self.columns, strict=True))
        key = leaf.astype(np.int64) * len(self.sources) + source
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        self.columns = [(leaf[order][first], source[order][first], np.add.reduceat(count[order], first))]
        self.counters = len(first)
        return self.columns[0]

    def merge(self, other: Trie) -> None:
        leaves = np.zeros(other.size, np.int64)
        for term, number in other.leaves():
            leaves[number] = self.leaf(term)
        sources = np.array([self.source(name) for name in other.sources])
        leaf, source, count = other.summed()
        self.add(leaves[leaf], sources[source], count)

    def leaves(self) -> Iterator[tuple[bytes, int]]:
        """Terms with the numbers of their leaves, in UTF-8 order."""
        stack = [(b"", self.root)]
        while stack:
            prefix, (label, children, number) = stack.pop()
            prefix += label
            if number is not None:
                yield prefix, number
            if children:
                stack.extend((prefix, children[first]) for first in sorted(children, reverse=True))

    def rows(self, lang: str, least: int = 0) -> Iterator[pa.RecordBatch]:
        """Leaf rows in UTF-8 order, of leaves with `least` documents or more."""
        leaf, source, count = self.summed()
        docs = np.zeros(self.size, np.int64)
        docs[leaf[source == 0]] = count[source == 0]
        leaf, source, count = (c[source > 0] for c in (leaf, source, count))
        starts = np.searchsorted(leaf, np.arange(self.size + 1))
        names = pa.array([n or "" for n in self.sources], pa.string())
        found = [(term, number) for term, number in self.leaves() if docs[number] >= least]
        for i in range(0, len(found), _ROWS):
            some = found[i : i + _ROWS]
            number = np.array([n for _, n in some])
            sizes = starts[number + 1] - starts[number]
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            at = np.repeat(starts[number] - offsets[:-1], sizes) + np.arange(offsets[-1])
            lists = (names.take(pa.array(source[at])), pa.array(count[at], pa.int64()))
            arrays = [pa.array([lang] * len(some), pa.string()), pa.array([t for t, _ in some], pa.binary()), pa.array(docs[number]), *(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in lists)]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "term", "docs", "sources", "counts"])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, each once, and how often they come."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.diff(first, append=len(keys))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to leaf rows of this task's tries."""
    tries: dict[str, Trie] = defaultdict(Trie)
    waiting: dict[str, list[tuple[str, bytes]]] = defaultdict(list)
    size = 0

    def visit() -> None:
        """Counts the documents since the last visit and takes the sums to the leaves, one walk per term."""
        for lang, docs in waiting.items():
            trie = tries[lang]
            words = [pa.array(terms(text), pa.binary()) for _, text in docs]
            lengths = list(map(len, words))
            coded = pa.concat_arrays(words).dictionary_encode()
            code, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
            place = dict(zip(known, range(len(known)), strict=True))
            leaf = np.zeros(len(known), np.int64)
            # In order, neighbours share most of their walk.
            for term in sorted(known):
                leaf[place[term]] = trie.leaf(term)
            source = np.array([trie.source(name) for name, _ in docs], np.int64)
            # Each document with the term counts once.
            pairs, _ = _distinct(np.repeat(np.arange(len(docs)), lengths) * len(known) + code)
            trie.add(leaf, np.zeros(len(leaf)), np.bincount(pairs % max(1, len(known)), minlength=len(known)))
            key, count = _distinct(np.repeat(source, lengths) * len(known) + code)
            of, term = np.divmod(key, max(1, len(known)))
            trie.add(leaf[term], of, count)
        waiting.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
            waiting[lang].append((source, text or b""))
            size += len(text or b"")
            if size >= TEXT_BYTES:
                visit()
                size = 0
                for name in [n for n, t in tries.items() if t.full()]:
                    yield from tries.pop(name).rows(name)
    visit()
    for name, trie in tries.items():
        yield from trie.rows(name)


def _merged(min_docs: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaf rows in order of (lang, term) to kept terms, each with the block that it is in."""
        trie, lang, last = Trie(), None, None
        block, held = TaskContext.get().partitionId() << 32, 0

        def absorbed(b: pa.RecordBatch) -> None:
            nonlocal last
            coded = b.column(1).dictionary_encode()
            numbers = np.array([trie.leaf(t) for t in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            trie.add(numbers, np.zeros(b.num_rows), b.column(2).to_numpy())
            names = b.column(3).flatten().dictionary_encode()
            sources = np.array([trie.source(s) for s in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if len(names) else np.zeros(0)
            trie.add(np.repeat(numbers, b.column(3).value_lengths().to_numpy()), sources, b.column(4).flatten().to_numpy())
            last = b.column(1)[-1]

        def emptied() -> Iterator[pa.RecordBatch]:
            nonlocal trie, block, held
            for b in trie.rows(lang, min_docs):
                if held + b.num_rows > BLOCK_TERMS:
                    block, held = block + 1, 0
                held += b.num_rows
                yield b.append_column("block", pa.array(np.full(b.num_rows, block), pa.int64()))
            trie = Trie()

        for b in batches:
            runs = b.column(0).dictionary_encode()
            starts = np.flatnonzero(np.diff(runs.indices.to_numpy(), prepend=-1)).tolist() if b.num_rows else []
            for start, end in zip(starts, [*starts[1:], b.num_rows], strict=True):
                some = b.slice(start, end - start)
                if (name := some.column(0)[0].as_py()) != lang:
                    yield from emptied()
                    block, held, lang = block + 1, 0, name
                elif trie.full():
                    # Rows of the last term may go on.
                    same = pc.equal(some.column(1), last).to_numpy(zero_copy_only=False)
                    head = len(same) if same.all() else int(np.argmin(same))
                    if head:
                        absorbed(some.slice(0, head))
                    if head < len(same):
                        yield from emptied()
                    some = some.slice(head)
                if some.num_rows:
                    absorbed(some)
        yield from emptied()

    return run


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, docs, sources, counts, block: terms in at least `min_docs` documents of their language, with the counter of each source."""
    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source")), F.col("text").cast("string"))
    # Written once: the range partitioning samples the rows and reads them again.
    leaves = written(text.mapInArrow(_counted, _LEAF))
    ranges = leaves.repartitionByRange(partitions(docs.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    kept = checkpointed(ranges.mapInArrow(_merged(min_docs), f"{_LEAF}, block long"))
    dropped(leaves)
    return kept


def shares(counts: np.ndarray, totals: np.ndarray | int) -> np.ndarray:
    """1 + floor(1e9 * counts / totals) in 64 bits: three digits at a time."""
    whole, rest = np.divmod(counts, totals)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + digits
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _found(top: int):  # noqa: ANN202
    def run(key: tuple, terms_of: pa.Table, tiles: pa.Table) -> pa.Table:
        """Pairs and first terms of one block and pair of tiles, as far as the block's terms go."""
        out: list[tuple] = []
        tile = tiles.to_pylist()[0]
        lang, two = tile["lang"], tile["tile_b"] != tile["tile_a"]
        groups = tile["groups_a"] + (tile["groups_b"] if two else [])
        names, split = [g["source"] for g in groups], len(tile["groups_a"])
        terms_of = terms_of.combine_chunks().sort_by("term")
        n, v = terms_of.num_rows, tile["v"]
        count = np.zeros((n, len(names)), np.int64)
        if n:
            lists, values = (terms_of.column(c).combine_chunks() for c in ("sources", "counts"))
            place = pc.index_in(lists.flatten(), pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
            here = ~np.isnan(place.astype(float))
            count[row[here], place[here].astype(int)] = values.flatten().to_numpy()[here]
        p = shares(count + 2, np.array([g["n"] for g in groups], np.int64) + 2 * v) if n else count
        for i in range(split):
            first = split if two else i + 1
            sums = divergence(p[:, i : i + 1], p[:, first:]).sum(0).tolist()
            out += [("pair", names[i], other, x) for other, x in zip(names[first:], sums, strict=True)]
        if n and not two:
            total = np.zeros(n, np.int64)
            np.add.at(total, row, values.flatten().to_numpy())
            q = shares(total + 2, tile["n_lang"] + 2 * v)
            words = terms_of.column("term").to_pylist()
            for i, name in enumerate(names):
                at = np.flatnonzero((count[:, i] > 0) & (p[:, i] > q))
                value = divergence(p[at, i], q[at])
                # Terms are in UTF-8 order, and the sort keeps it within ties.
                for k in np.argsort(-value, kind="stable")[:top].tolist():
                    out.append(("term", name, words[at[k]].decode(), int(value[k])))
        part, source, item, value = zip(*out, strict=True) if out else ((),) * 4
        arrays = [pa.array([lang] * len(out), pa.string()), *(pa.array(c, pa.string()) for c in (part, source, item)), pa.array(value, pa.int64())]
        return pa.Table.from_arrays(arrays, names=["lang", "part", "source", "item", "value"])

    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by divergence (`pair`) and terms that mark a source (`term`)."""
    kept = kept_terms(docs, min_docs)
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = groups.join(each, ["lang", "source"], "left").na.fill(0, ["n"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    tiles = groups.withColumn("tile", F.floor(place / tile)).groupBy("lang", "tile").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"), F.sum("n").alias("n"))
    tiles = checkpointed(tiles)
    langs = tiles.groupBy("lang").agg(F.count(F.lit(1)).alias("tiles"), F.sum("n").alias("n_lang"))
    blocks = kept.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("v"))
    langs = langs.join(blocks.groupBy("lang").agg(F.sum("v").alias("v")), "lang", "left").na.fill(0, ["v"])
    pairs = langs.select("lang", "tiles", "n_lang", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile_a"))
    pairs = pairs.select("lang", "n_lang", "v", "tile_a", F.explode(F.sequence("tile_a", F.col("tiles") - 1)).alias("tile_b"))
    held = lambda side: tiles.select("lang", F.col("tile").alias(f"tile_{side}"), F.col("groups").alias(f"groups_{side}"))
    cells = pairs.join(held("a"), ["lang", "tile_a"]).join(held("b"), ["lang", "tile_b"])
    # A language that keeps no term still has a block, of none.
    cells = cells.join(blocks.select("lang", "block"), "lang", "left").na.fill(0, ["block"])
    rows = kept.join(pairs.select("lang", "tile_a", "tile_b"), "lang")
    keys = ["lang", "block", "tile_a", "tile_b"]
    # Both sides come from the same frames: aliases make their columns different ones.
    cells = cells.select(*(F.col(c).alias(c) for c in cells.columns))
    found = checkpointed(rows.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInArrow(_found(top), _FOUND))
    one = found.where("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    both = one.unionByName(one.select("lang", "part", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    def ranked(frame: DataFrame) -> DataFrame:
        rank: Column = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
        return frame.select("lang", "source", "part", "item", "value", rank.alias("rank"))

    return ranked(both).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= top))
