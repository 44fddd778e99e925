"""Word shingles as 64-bit hashes, computed for many texts at once with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_ODD, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes of text that are hashed at once; a longer text is a group of its own.
GROUP_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n - 1, 0), _ODD))])[: max(n, 1)]


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each run of other than blanks."""
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    at = np.flatnonzero(solid)
    heads = np.flatnonzero(first[at])
    lengths = np.diff(np.append(heads, len(at)))
    within = np.arange(len(at), dtype=np.int64) - np.repeat(heads, lengths)
    weighed = (data[at].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[within]
    return starts, mixed(np.add.reduceat(weighed, heads) + lengths.astype(np.uint64) * _MIX_B)


def _group(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    joined = b"\n".join(texts).translate(_LOWER)
    starts, words = _word_hashes(np.frombuffer(joined, np.uint8))
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(starts, ends)
    rolled = words[: max(len(words) - k + 1, 0)].copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            rolled = mixed(rolled * _ODD + words[j : j + len(rolled)])
    lo = 0
    for hi in last.tolist():
        if hi - lo >= k:
            yield np.unique(rolled[lo : hi - k + 1])
        elif hi > lo:
            with np.errstate(over="ignore"):
                h = words[lo : lo + 1] + np.uint64(hi - lo) * _MIX_A
                for j in range(lo + 1, hi):
                    h = mixed(h * _ODD + words[j : j + 1])
            yield h
        else:
            yield np.zeros(0, np.uint64)
        lo = hi


def shingle_sets(texts: Iterable[bytes | None], k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles: k words each, or the whole of a shorter text; none without words.

    A-Z count as lower case.  Null is empty.
    """
    group, size = [], 0
    with np.errstate(over="ignore"):
        for text in texts:
            group.append(text or b"")
            size += len(group[-1])
            if size >= GROUP_BYTES:
                yield from _group(group, k)
                group, size = [], 0
        if group:
            yield from _group(group, k)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def set_id(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)
