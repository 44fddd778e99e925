"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels.

A document is a bag of sentences.  A sentence scores p = sigmoid(bias + sum of its features' weights), 0 without a weighed
feature; the document scores 1 - prod(1 - p) over its witnesses, the sentences with p of `WITNESS` or more, so that length
adds nothing, however many sentences there are with slight or no evidence.  Weights are fitted on whole labelled texts by descent on the log loss of the document's
label through the noisy-or, so blame falls on the sentences that explain the label; `offending` returns them with places.

Features of a sentence are the words that it holds and their beginnings of 4 to 6 letters, so inflected and compounded
forms share evidence.  Only features count that `min_docs` or more training texts hold and that toxic ones hold more
often, by a log-likelihood ratio that about `chance` of all
features would reach by chance.  Training uses at most `max_train`
labelled texts of `max_bytes` together, whole ones with the smallest hashes of the id; the bounds keep the driver's memory
fixed.  All other texts are scored in a stream, each whole.

Edge cases: null and empty texts are a bag without sentences and score 0; unlabelled rows are scored as well; with no labels
or labels of one kind no feature has a weight and all score 0; rows with equal texts score equally; of a labelled id's
several texts the one with the least hash is learnt, and of its several labels the largest.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[^.!?…。！？\n]+")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
MAX_TRAIN, MAX_BYTES, MIN_DOCS, CHANCE, ROUNDS = 8_000, 64_000_000, 4, 1.0, 120
#: Evidence that a sentence needs to be a witness: much, as there are many sentences.
BIAS, WITNESS = -9.0, 0.02
#: Words whose evidence a worker remembers; when full it starts anew.
REMEMBERED, REMEMBERED_TRAIN = 500_000, 100_000
#: Hash slots, as a power of two, in which features are first counted.
SLOT_BITS = 22


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def sentences(text: str | None) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text or "")]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """Weights by feature."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.known: dict[str, tuple[tuple[str, float], ...]] = {}

    def evidence(self, word: str) -> tuple[tuple[str, float], ...]:
        if (found := self.known.get(word)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = tuple((f, w) for f in features(word) if (w := self.weights.get(f)))
        return found

    def sentence(self, text: str) -> float:
        """Of a text in lower case; 0 without evidence, so that length alone adds nothing."""
        held: dict[str, float] = {}
        for word in set(WORD.findall(text)):
            held.update(self.evidence(word))
        return float(1 / (1 + np.exp(-(self.bias + sum(held.values()))))) if held else 0.0

    def document(self, text: str | None) -> float:
        text = (text or "").lower()
        if not any(map(self.evidence, set(WORD.findall(text)))):
            return 0.0
        clean = 1.0
        for part in SENTENCE.findall(text):
            if (p := self.sentence(part)) >= WITNESS:
                clean *= 1 - p
        return 1 - clean


def _doc_features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text)) for f in features(w)}


def _ratio(toxic: np.ndarray, every: np.ndarray, base: float) -> np.ndarray:
    """Log-likelihood ratio of the toxic share against the base rate, 0 where it is not over that."""
    share = toxic / np.maximum(every, 1)
    part = lambda k, p, q: np.where(k > 0, k * np.log(np.maximum(p, 1e-12) / q), 0)
    return np.where(share > base, 2 * (part(toxic, share, base) + part(every - toxic, 1 - share, 1 - base)), 0)


def _telling(texts: list[str], y: np.ndarray, min_docs: int, chance: float) -> list[str]:
    """Features that toxic texts hold more often than chance; of the others about `chance` pass in all (log-likelihood ratio).

    Features are first counted in a fixed number of hash slots; then those of the slots that pass are counted by name.
    """
    mask = (1 << SLOT_BITS) - 1
    slot = lambda f: zlib.crc32(f.encode()) & mask
    every, toxic = np.zeros(mask + 1, np.int32), np.zeros(mask + 1, np.int32)
    for text, label in zip(texts, y):
        own = np.fromiter({slot(f) for f in _doc_features(text)}, np.int64)
        every[own] += 1
        if label:
            toxic[own] += 1
    tested = every >= min_docs
    least = 2 * np.log(max(int(tested.sum()), 2) / chance)
    passing = tested & (_ratio(toxic, every, y.mean()) >= least)
    named: dict[str, list[int]] = {}
    for text, label in zip(texts, y):
        for f in _doc_features(text):
            if passing[slot(f)]:
                count = named.setdefault(f, [0, 0])
                count[0] += 1
                count[1] += int(label)
    names = sorted(f for f, (n, _) in named.items() if n >= min_docs)
    counts = np.array([named[f] for f in names]).reshape(-1, 2)
    good = _ratio(counts[:, 1], counts[:, 0], y.mean()) >= least
    return [f for f, ok in zip(names, good) if ok]


def fit(texts: list[str | None], labels: list[int], min_docs: int = MIN_DOCS, chance: float = CHANCE, rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-3) -> Model:
    """Descent with per-weight step sizes (Adam) on the noisy-or log loss, classes weighed alike."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model({}, BIAS)
    lower = [(t or "").lower() for t in texts]
    names = _telling(lower, y, min_docs, chance)
    number = {f: i for i, f in enumerate(names)}
    known: dict[str, tuple[int, ...]] = {}
    cols, rows, owner = [], [], []
    for d, text in enumerate(lower):
        for part in SENTENCE.findall(text):
            own: set[int] = set()
            for word in WORD.findall(part):
                if (found := known.get(word)) is None:
                    if len(known) >= REMEMBERED_TRAIN:
                        known.clear()
                    found = known[word] = tuple(number[f] for f in features(word) if f in number)
                if found:
                    own.update(found)
            if own:
                cols.extend(own)
                rows.extend([len(owner)] * len(own))
                owner.append(d)
    col, row, doc = np.array(cols, np.int32), np.array(rows, np.int32), np.array(owner, np.int32)
    w, m, v = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    for t in range(1, rounds + 1):
        z = BIAS + np.bincount(row, w[col], len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        big = 1 - np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        # d loss / d z of a sentence: p for a clean text, -(1 - P) / P * p for a toxic one.
        slope = share * np.where(y == 1, -(1 - big) / np.maximum(big, 1e-12), 1.0)
        g = np.bincount(col, (slope[doc] * p)[row], len(names)) / len(y) + decay * w / max(len(names), 1)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 0.05)}, BIAS)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES, **options: object) -> Model:
    """Fits on labelled rows that are not held out, at most `max_train` of them and `max_bytes` of text, chosen by hash of the id.

    A text over a sixteenth of `max_bytes` is passed over, so no single one can use up the bound.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = known.orderBy(order, "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = rows.withColumn("_tox_size", F.coalesce(F.octet_length("text"), F.lit(0))).where(F.col("_tox_size") <= max_bytes // 16)
    # At most `max_train` rows: one window over them is small.
    so_far = F.sum("_tox_size").over(Window.orderBy(order, "doc_id"))
    rows = rows.withColumn("_tox_bytes", so_far).where(F.col("_tox_bytes") <= max_bytes).orderBy(order, "doc_id").select("text", "toxic").toArrow()
    return fit(rows.column("text").to_pylist(), [int(x) for x in rows.column("toxic").to_pylist()], **options)


def _score(model: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([own.document(t) for t in batch.column(2).to_pylist()], pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score(shared), f"doc_id {kind}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _offending(model: object, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*model.value)
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                scored = [(a, b, own.sentence(text[a:b].lower())) for a, b in sentences(text)]
                found.append([{"start": a, "end": b, "score": s} for a, b, s in scored if s >= least])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, schema)], names=["doc_id", "sentences"])

    return run


def offending(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """doc_id and its sentences with a score of `least` or more: (start, end, score), in code points."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_offending(shared, least), f"doc_id {kind}, sentences array<struct<start:int,end:int,score:double>>")


def digest(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, train(docs, labels, **options))
