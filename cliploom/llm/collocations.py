"""Phrase collocations by PCY/DHP: hashed bucket counts of the next length thin out each pass, together with Apriori.

There is one pass over the texts per phrase length.  Pass n counts the phrases of n words that are left exactly and, in the
same pass, adds the phrases of n + 1 words that they make up to hashed buckets, one small saturating counter each.  Buckets
under the threshold become a bitmap that is broadcast; pass n + 1 takes a phrase only if its bucket reached the threshold and
both its parts of n words are frequent, which a second bitmap over the hashes of the exactly counted phrases tells.  Both
bitmaps may pass too much and never too little, and what they pass is counted exactly by its words, so the number of buckets
changes the work and no row.  Bitmaps have as many bits as the corpus has words, about an eighth of it, and 2^28 (32 MB) at
most; bucket counters are shuffled as sparse blocks, added up per block and packed, so the driver gets the packed bits only.

Everything is per language, which is part of every hash.  Phrases are added up within a task and again before the shuffle,
so a phrase that a third of all pieces hold is one row per task.

Edge cases: a null text is empty; a null language is `und`; a piece of fewer words than a phrase holds none of it; an empty
table gives no rows; repeated rows count as often as they come; ties go by count, then by UTF-8 order.  A text is cut between
pieces when it is long, so a task holds some megabytes of tokens whatever the text's length (one piece is held whole).
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import dropped, partitions, written
from .shingles import _ODD as ODD
from .shingles import mixed

#: Words of a phrase, occurrences of a candidate, share (in %) at which a longer one takes its place, rows per language.
MAX_WORDS, MIN_COUNT, COVERED, TOP = 4, 30, 80, 2000
#: Bits of a bucket number at least and at most; buckets of a block; bytes of text counted at once; phrases a task holds.
LEAST_BITS, MOST_BITS, BLOCK, CHUNK_BYTES, HELD_PHRASES = 16, 28, 4096, 4_000_000, 400_000

#: A-Z to lower case, tab to space, all that ends a piece to line feed.
_FOLD = bytes(c | 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_ROWS = "lang string, phrase binary, n long, block int, places binary, counts binary"
_SATURATED = 255


def _cut(texts: list[bytes]) -> Iterator[bytes]:
    """The texts' pieces in parts of about CHUNK_BYTES, folded."""
    data, at = b"\n".join(texts).translate(_FOLD), 0
    while len(data) - at > CHUNK_BYTES and (end := data.find(b"\n", at + CHUNK_BYTES)) >= 0:
        yield data[at:end]
        at = end
    yield data[at:]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, pieces), of several texts of the language together."""
    waiting: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            waiting[lang].append(text)
            size += len(text)
            if size >= CHUNK_BYTES:
                for name, texts in waiting.items():
                    yield from ((name, part) for part in _cut(texts))
                waiting.clear()
                size = 0
    for name, texts in waiting.items():
        yield from ((name, part) for part in _cut(texts))


class Tokens:
    """The words of one part as numbers, -1 between pieces, with their hashes; phrases are known by their first position."""

    def __init__(self, lang: str, part: bytes) -> None:
        coded = pa.array(part.replace(b"\n", b" \n ").split(b" "), pa.binary()).dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy().astype(np.int64)
        for mark, code in ((b"\n", -1), (b"", -2)):
            if mark in self.words:
                codes[codes == self.words.index(mark)] = code
        self.codes = codes[codes != -2]
        seed = pd.util.hash_array(np.array([lang.encode()], object))
        own = mixed(pd.util.hash_array(np.array([*self.words, b""], object), categorize=False) ^ seed)
        self.hashes = own[self.codes]

    def valid(self, n: int) -> np.ndarray:
        """Per position, whether n words of one piece start there."""
        whole = self.codes >= 0
        out = whole[: max(0, len(whole) - n + 1)].copy()
        for j in range(1, n):
            out &= whole[j : j + len(out)]
        return out

    def hashed(self, n: int) -> np.ndarray:
        """The hash of the n words from each position on."""
        out = self.hashes[: max(0, len(self.hashes) - n + 1)].copy()
        for j in range(1, n):
            out = mixed(out * ODD + self.hashes[j : j + len(out)])
        return out

    def counted(self, at: np.ndarray, n: int) -> Iterator[tuple[bytes, int]]:
        """The phrases of n words at the positions, each with how many of the positions it has.  Equal words, not hashes."""
        key = self.codes[at]
        for j in range(1, n):
            _, key = np.unique(key * len(self.words) + self.codes[at + j], return_inverse=True)
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        for i, count in zip(at[first].tolist(), counts.tolist(), strict=True):
            yield b" ".join([self.words[c] for c in self.codes[i : i + n].tolist()]), count


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _set(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> 3] >> (buckets & 7).astype(np.uint8) & 1).astype(bool)


def _rows(names: list, phrases: list, counts: list, blocks: list, places: list, sums: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((names, phrases, counts, blocks, places, sums), kinds, strict=True)], names=["lang", "phrase", "n", "block", "places", "counts"])


def _phrase_rows(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, found in held.items():
        rows = list(found.items())
        for i in range(0, len(rows), 50_000):
            some = rows[i : i + 50_000]
            none = [None] * len(some)
            yield _rows([lang] * len(some), [p for p, _ in some], [n for _, n in some], none, none, none)


def _block_rows(counters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counters that are not 0, as blocks of (place, count)."""
    at = np.flatnonzero(counters)
    starts = np.flatnonzero(np.diff(at // BLOCK, prepend=-1))
    for part in np.array_split(starts, max(1, len(starts) // 1000)):
        if len(part):
            after = np.searchsorted(starts, part, side="right")
            ends = [int(starts[k]) if k < len(starts) else len(at) for k in after.tolist()]
            spans = list(zip(part.tolist(), ends, strict=True))
            none = [None] * len(spans)
            yield _rows(none, none, none, [int(at[a] // BLOCK) for a, _ in spans], [(at[a:b] % BLOCK).astype(np.uint16).tobytes() for a, b in spans], [counters[at[a:b]].tobytes() for a, b in spans])


def _passed(n: int, bits: int, frequent, buckets, last: bool):  # noqa: ANN001, ANN202
    """Pass n over (lang, text): exact counts of the phrases left, and the buckets of the next length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        counters = np.zeros(0 if last else 1 << bits, np.uint8)
        maps = [np.frombuffer(m.value, np.uint8) for m in (frequent, buckets) if m is not None]
        with np.errstate(over="ignore"):
            for lang, part in _parts(batches):
                tokens = Tokens(lang, part)
                left = tokens.valid(n)
                if n > 1:
                    shorter = tokens.hashed(n - 1)
                    known = _set(maps[0], _bucket(shorter, bits))
                    at = np.flatnonzero(left & known[:-1] & known[1:]) if len(left) else np.zeros(0, np.int64)
                    own = mixed(shorter[at] * ODD + tokens.hashes[at + n - 1])
                    stays = _set(maps[1], _bucket(own, bits))
                    at, own = at[stays], own[stays]
                else:
                    at = np.flatnonzero(left)
                    own = tokens.hashes[at]
                found = held[lang]
                for phrase, count in tokens.counted(at, n):
                    found[phrase] += count
                if not last:
                    # The next length starts where a phrase is followed, one word on, by another that is left.
                    pair = np.flatnonzero(np.diff(at) == 1)
                    longer, times = np.unique(_bucket(mixed(own[pair] * ODD + tokens.hashes[at[pair] + n]), bits), return_counts=True)
                    counters[longer] = np.minimum(counters[longer] + times, _SATURATED)
                if sum(map(len, held.values())) >= HELD_PHRASES:
                    yield from _phrase_rows(held)
                    held.clear()
        yield from _phrase_rows(held)
        yield from _block_rows(counters)

    return run


def _hashed_phrases(n: int, bits: int):  # noqa: ANN202
    """(lang, phrase) of n words each to blocks of the buckets of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits, np.uint8)
        with np.errstate(over="ignore"):
            for lang, part in _parts(batches):
                tokens = Tokens(lang, part)
                counters[_bucket(tokens.hashed(n)[tokens.valid(n)], bits)] = 1
        yield from _block_rows(counters)

    return run


def _packed(least: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Block rows, all of a block in one task, to one bit per bucket."""
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, places, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own = sums.setdefault(block, np.zeros(BLOCK, np.uint8))
                at = np.frombuffer(places, np.uint16)
                own[at] = np.minimum(own[at].astype(np.int64) + np.frombuffer(counts, np.uint8), _SATURATED)
        if sums:
            packed = [np.packbits(s >= least, bitorder="little").tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], names=["block", "bits"])

    return run


def _bitmap(blocks: DataFrame, bits: int, least: int):  # noqa: ANN202
    """A broadcast bitmap of the buckets that reach `least`; 2^bits bits."""
    spark = blocks.sparkSession
    rows = blocks.select("block", "places", "counts").repartition(partitions(spark), "block").mapInArrow(_packed(least), "block int, bits binary").collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for block, packed in rows:
        out[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(packed, np.uint8)
    return spark.sparkContext.broadcast(out.tobytes())


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, most: int = MAX_WORDS, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of up to `most` words with `min_count` occurrences, and (lang, n) of all words."""
    if min_count > _SATURATED:
        raise ValueError(f"min_count is at most {_SATURATED}")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if bits is None:
        # A bucket for every eight words of some six bytes.
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(1 + size / 48))))
    frequent: list[DataFrame] = []
    totals = known = buckets = None
    for n in range(1, most + 1):
        rows = written(texts.mapInArrow(_passed(n, bits, known, buckets, n == most), _ROWS))
        phrases = rows.where("block is null")
        counted = phrases.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
        frequent.append(written(counted.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(n).alias("k"), "f")))
        if n == 1:
            totals = written(phrases.groupBy("lang").agg(F.sum("n").alias("n")))
        for used in (known, buckets):
            if used is not None:
                used.destroy()
        if n < most:
            buckets = _bitmap(rows.where("block is not null"), bits, min_count)
            known = _bitmap(frequent[-1].select("lang", "phrase").mapInArrow(_hashed_phrases(n, bits), _ROWS), bits, 1)
        dropped(rows)
    found = frequent[0]
    for more in frequent[1:]:
        found = found.unionByName(more)
    return found, totals


def _joined(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, cut, score of every phrase of two words or more, by the cut that scores least."""
    words = F.split("phrase", " ")
    pieces = frequent.where("k > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    pieces = pieces.select("lang", "phrase", "k", F.col("f").alias("a"), "cut", _joined(words, F.lit(1), F.col("cut")).alias("first"), _joined(words, F.col("cut") + 1, F.col("k")).alias("rest"))
    part = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = pieces.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "k", "a", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "x.k", "x.a", "x.l", "x.r", "x.cut", "x.score")


def uncovered(candidates: DataFrame, share: int = COVERED) -> DataFrame:
    """Candidates that no longer one holds `share` % of the time."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: _joined(words, i, m))))
    held = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    rows = candidates.join(held, ["lang", "phrase"], "left")
    return rows.where(~F.coalesce(F.col("longer") * 100 >= F.col("a") * share, F.lit(False))).drop("longer")


def mined(docs: DataFrame, min_count: int = MIN_COUNT, most: int = MAX_WORDS, share: int = COVERED, top: int = TOP, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each language."""
    frequent, totals = frequent_phrases(docs, min_count, most, bits)
    left = uncovered(scored(frequent), share)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # Ranked in shares first, so that a language's last task gets `top` rows of each share.
    some = left.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
