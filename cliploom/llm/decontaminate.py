"""Benchmark decontamination: an Aho-Corasick automaton over the items' word windows, one scan per text.

Items and texts are cut into words: A-Z in lower case, runs of 0-9, a-z and all beyond ASCII.  A window is `window`
consecutive words of an item; an item of fewer words, but not none, is one window.  The automaton's letters are words of the
benchmark; words that the benchmark lacks are one letter that no window holds.  Every occurrence of a window marks its
words as hit, and word positions are mapped back to code points of the original text for the spans.

The benchmark is broadcast, distinct windows of it in one automaton.  Its size is counted first; over `block_chars` characters
it is dealt into blocks of about that size.  Then each block is a job of its own, which broadcasts it, scans all texts
with its automaton, writes the hits of the texts that have any, and frees the broadcast; so neither the driver nor a
task ever holds more than one block, and the texts are read once per block.

Edge cases: null and empty texts have no words and are clean; items without words have no windows; a null item_id
counts as the empty string; items that share a window are all reported; repeated rows each get their result; an empty
benchmark leaves all texts clean.  Columns of the input besides doc_id and text are not read by `contamination`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import checkpointed
from .shingles import texts_of

WINDOW = 10
BLOCK_CHARS = 8_000_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

HITS = "array<struct<first:int,last:int,item:string>>"
_HITS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("item", pa.string())]))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Automaton:
    """Windows of the items as sequences of word numbers."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            own = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text))
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(own[i : i + window], set()).add(name)
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in owners.items():
            self.tree.add_word(key, (len(key), sorted(names)))
        self.any = bool(owners)
        if self.any:
            self.tree.make_automaton()

    def hits(self, own: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, last word, item) of each occurrence."""
        if not self.any or not own:
            return []
        get = self.numbers.get
        letters = tuple([get(w, 0) for w in own])
        return [(end - n + 1, end, name) for end, (n, names) in self.tree.iter(letters) for name in names]


    def any_hit(self, own: list[bytes]) -> bool:
        return self.any and bool(own) and next(self.tree.iter(tuple([self.numbers.get(w, 0) for w in own])), None) is not None


def _found(items: object, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, hash, hits) of the texts that have hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for batch in batches:
            automaton = automaton or Automaton(items.value, window)
            hits = [[{"first": a, "last": b, "item": c} for a, b, c in automaton.hits(words(t))] for t in texts_of(batch)]
            mask = pa.array([bool(h) for h in hits], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, _HITS)], names=["_hit_id", "_hit_hash", "hits"]).filter(mask)

    return run


def _passing(items: object, window: int, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows whose text, the column at `at`, has no hit; a scan ends at the first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for batch in batches:
            automaton = automaton or Automaton(items.value, window)
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([not automaton.any_hit(words(t)) for t in texts], pa.bool_()))

    return run


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (first, last) united where they touch."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _summed(batches: Iterator[pa.RecordBatch], all_hits: Callable[[pa.RecordBatch], list[list[dict] | None]]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    for batch in batches:
        n_words, n_hit, items, spans = [], [], [], []
        for text, hits in zip(texts_of(batch), all_hits(batch)):
            n_words.append(len(words(text)))
            ranges = merged([(h["first"], h["last"]) for h in hits or []])
            n_hit.append(sum(b - a + 1 for a, b in ranges))
            items.append(sorted({h["item"] for h in hits or []}))
            spans.append(_places(text, ranges) if ranges else [])
        counted = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, schema.field(2).type), pa.array(spans, schema.field(3).type)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counted], names=["doc_id", *schema.names])


def _of_automaton(items: object, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Automaton] = []

        def hits(batch: pa.RecordBatch) -> list[list[dict]]:
            if not held:
                held.append(Automaton(items.value, window))
            return [[{"first": a, "last": b, "item": c} for a, b, c in held[0].hits(words(t))] for t in texts_of(batch)]

        return _summed(batches, hits)

    return run


def _of_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _summed(batches, lambda batch: batch.column(batch.schema.get_field_index("hits")).to_pylist())


def _places(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as code point ranges of the text as it was."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, byte, point = [], 0, 0
    for a, b in ranges:
        start = point + len(text[byte : at[a][0]].decode())
        end = start + len(text[at[a][0] : at[b][1]].decode())
        byte, point = at[b][1], end
        out.append({"start": start, "end": end})
    return out


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[tuple[object, bool]]:
    """Each block of items as a broadcast, and whether it is the only one.  One block at a time is on the driver."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    n = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == i).select("name", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast([(r.name, r.text.encode()) for r in rows]), n == 1


def _hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _hits(docs: DataFrame, block: object, window: int) -> DataFrame:
    """_hit_id, _hit_hash and hits of the block, for texts that have any; written, so that the block can go."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", _hash().alias("hash"), "text").mapInArrow(_found(block, window), f"_hit_id {kind}, _hit_hash long, hits {HITS}")
    out = checkpointed(rows)
    block.destroy()
    return out


SUMMARY = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids, sorted as strings) and spans (start, end in code points); a row per document."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SUMMARY}"
    parts = []
    for block, only in _blocks(benchmark, block_chars):
        if only:
            return docs.select("doc_id", "text").mapInArrow(_of_automaton(block, window), schema)
        parts.append(_hits(docs, block, window))
    # Rows that share an id and a text have the same hits, so one of them stands for all.
    every = reduce(DataFrame.unionByName, (p.dropDuplicates(["_hit_id", "_hit_hash"]) for p in parts)).groupBy("_hit_id", "_hit_hash").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    rows = docs.select("doc_id", "text", _hash().alias("hash"))
    rows = rows.join(every, F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (F.col("hash") == F.col("_hit_hash")), "left")
    return rows.select("doc_id", "text", "hits").mapInArrow(_of_column, schema)


def digest(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = contamination(docs, benchmark, **options)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The input's rows, as they are, whose text holds no window."""
    own = [F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)]
    schema = ", ".join(f"own_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    back = [F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)]
    parts = []
    for block, only in _blocks(benchmark, block_chars):
        if only:
            return docs.select(*own).mapInArrow(_passing(block, window, docs.columns.index("text")), schema).select(*back)
        parts.append(_hits(docs, block, window).select("_hit_id", "_hit_hash"))
    hit = reduce(DataFrame.unionByName, parts).distinct()
    rows = docs.select(*own, _hash().alias("_hash"), F.col("doc_id").alias("_id"))
    return rows.join(hit, F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_hash") == F.col("_hit_hash")), "left_anti").select(*back)
