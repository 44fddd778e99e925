"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 in the order of (doc_id, size, CRC-32, hash of the text); the permutation of the numbers 0 to n - 1
is their shuffle.  Place p of the shuffle is slot p // shards of shard p % shards, so shard counts differ by one at most
(law `rows`), slots have no gaps, and both follow from (row number, n, shards, seed) alone: `row_at` and `shard_rows` go back
from a place to the row number without the table.

The Feistel network works on two halves of equal width over the least even number of bits that holds n; places from n on
are walked through the network again until they fall under n, which takes under four steps on average.

Numbering gathers nothing: sized rows are written without text, range-partitioned and sorted, and a range's rows are numbered
as they stream, on top of the counts of the ranges before (one number per range goes through the driver).  Equal rows (same id, same text) may be a third of the table, so a spread of
their own keeps them from being one key; they are interchangeable.

Edge cases: a null text has size 1 and CRC-32 0, as an empty one; a null doc_id comes first in the order and counts as any
other row; an empty table has no rows; fewer rows than shards leave shards empty.  Other columns are left out of the plan.
Equal texts are dealt as any rows: no law but `rows` is promised, and groups of copies spread over all shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import checkpointed, partitions

#: Shards, seed and rounds of the registered query.
SHARDS, SEED, ROUNDS = 16, 13, 6
#: Odd multipliers of the round function, which works modulo 2^32.
MULTIPLIERS = (0x85EBCA6B, 0xC2B2AE35)
_WORD = 2**32


def half_bits(n: int) -> int:
    """Bits of a half: twice as many hold the numbers under n."""
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [(seed * 0x9E3779B1 + (i + 1) * 0x7F4A7C15) % _WORD for i in range(rounds)]


def _scrambled(half: np.ndarray, key: int, mask: int) -> np.ndarray:
    x = (half + np.uint64(key)) % np.uint64(_WORD)
    x = x * np.uint64(MULTIPLIERS[0]) % np.uint64(_WORD)
    x ^= x >> np.uint64(15)
    x = x * np.uint64(MULTIPLIERS[1]) % np.uint64(_WORD)
    x ^= x >> np.uint64(13)
    return x & np.uint64(mask)


def _network(values: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = values >> np.uint64(bits), values & np.uint64(mask)
    for key in keys:
        left, right = right, left ^ _scrambled(right, key, mask)
    return left << np.uint64(bits) | right


def _network_back(values: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = values >> np.uint64(bits), values & np.uint64(mask)
    for key in reversed(keys):
        left, right = right ^ _scrambled(left, key, mask), left
    return left << np.uint64(bits) | right


def _walked(step: Callable[[np.ndarray, int, list[int]], np.ndarray], values: np.ndarray, n: int, seed: int) -> np.ndarray:
    bits, keys = half_bits(n), round_keys(seed)
    out = step(values.astype(np.uint64), bits, keys)
    while (over := np.flatnonzero(out >= n)).size:
        out[over] = step(out[over], bits, keys)
    return out.astype(np.int64)


def permuted(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The places of row numbers (0 to n - 1) in the shuffle."""
    return _walked(_network, rows, n, seed)


def row_at(places: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The row numbers that stand at the places: the inverse of `permuted`."""
    return _walked(_network_back, places, n, seed)


def shard_rows(spark: SparkSession, n: int, shard: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(slot, row) of one shard of n rows, computed without the table."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"slot": b["slot"], "row": row_at(b["slot"].to_numpy() * shards + shard, n, seed)})

    slots = max(0, -(-(n - shard) // shards))
    return spark.range(slots).withColumnRenamed("id", "slot").mapInPandas(rows, "slot long, row long")


def ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, part): all rows in global order, range by range, as a checkpoint."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    # Written once: the range partitioning samples the rows and reads them again.
    sized = checkpointed(sized.withColumn("_spread", F.xxhash64(F.monotonically_increasing_id())))
    order = ["doc_id", "size", "text_crc32", "_hash", "_spread"]
    ranges = sized.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return checkpointed(ranges.select("doc_id", "size", "text_crc32", F.spark_partition_id().alias("part")))


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row, place, shard, slot of every row."""
    rows = ordered(docs)
    # One count per range; a range's rows come in order, so a row's number is what lies before its range and its turn.
    counts = sorted(rows.groupBy("part").count().collect())
    starts = dict(zip((c[0] for c in counts), np.cumsum([0, *(c[1] for c in counts)]).tolist(), strict=False))
    n = sum(c[1] for c in counts)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            if b.num_rows:
                at = starts[b.column("part")[0].as_py()] if at is None else at
                row = np.arange(at, at + b.num_rows, dtype=np.int64)
                place = permuted(row, n, seed)
                at += b.num_rows
                made = (row, place, (place % shards).astype(np.int32), place // shards)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "size", "text_crc32")), *map(pa.array, made)], names=names)

    names = ["doc_id", "size", "text_crc32", "row", "place", "shard", "slot"]
    return rows.mapInArrow(dealt, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, size long, text_crc32 long, row long, place long, shard int, slot long")


def digest(docs: DataFrame) -> DataFrame:
    return sharded(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
