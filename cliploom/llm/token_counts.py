"""Token counts that survive edits: a segment tree over each text's pre-tokens, kept between calls.

A text is cut into pre-tokens, each encoded by itself.  Leaves of the tree are blocks of some pre-tokens; nodes hold the sums
of code points and of tokens below, and the root is the text's count.  `grow` makes the trees; their leaves are stored as
(chars, tokens, pieces) per block, some hundredths of the text.  `recount` takes stored trees and edits: it finds the block
of an edit by descending the sums, cuts and encodes anew only from that block's start to the first old block boundary after
the edit at which a new pre-token ends (the pattern looks at most `AHEAD` characters past a match), and updates the sums
on the way up.  From there on pre-tokens depend on unchanged text only.  An edit costs a few blocks, however long the
text is; without one, nothing is encoded again.

The vocabulary is a tiktoken rank file; its path is a parameter, the driver reads it and executors get its bytes (a
vocabulary has a fixed size).  Token counts of pre-tokens are remembered up to a fixed number per worker.

Edge cases: null and empty texts have no tokens; an edit beyond the text's end is cut to it; edits of one text may touch but
not overlap (overlaps raise ValueError); edits with a null place are left out; repeated rows each get their result; a tree
belongs to a doc_id and its text's hash; without a stored tree, rows with edits get one made and rows without edits get
nulls; one very long text is one tree, whose
memory is in proportion to its blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import checkpointed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern of that vocabulary, a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
AHEAD, BLOCK, REMEMBERED = 3, 64, 500_000


class Counter:
    """Tokens of a pre-token."""

    def __init__(self, ranks: bytes) -> None:
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.encoding = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def tokens(self, piece: str) -> int:
        if (n := self.known.get(piece)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def count(self, text: str | None) -> tuple[int, int]:
        """(tokens, pre-tokens)."""
        pieces = self.pattern.findall(text or "")
        known = self.known
        total = 0
        for piece in pieces:
            n = known.get(piece)
            total += self.tokens(piece) if n is None else n
        return total, len(pieces)


def leaves_of(counter: Counter, text: str | None) -> list[tuple[int, int, int]]:
    """(chars, tokens, pieces) of the blocks of a text, without the tree above."""
    pieces = counter.pattern.findall(text or "")
    tokens = [counter.known.get(p) or counter.tokens(p) for p in pieces]
    return [(sum(map(len, pieces[i : i + BLOCK])), sum(tokens[i : i + BLOCK]), min(BLOCK, len(pieces) - i)) for i in range(0, len(pieces), BLOCK)]


class Tree:
    """A text in blocks of pre-tokens, and the sums of (characters, tokens) over them.

    With `leaves`, the stored (chars, tokens, pieces) of the blocks, nothing is encoded.
    """

    def __init__(self, counter: Counter, text: str | None, leaves: list[tuple[int, int, int]] | None = None) -> None:
        self.counter, self.encoded, text = counter, 0, text or ""
        if leaves is None:
            self.parts, self.counts = self._cut([(p, counter.tokens(p)) for p in counter.pattern.findall(text)])
        else:
            self.counts = [(tokens, pieces) for _, tokens, pieces in leaves] or [(0, 0)]
            ends = list(accumulate(chars for chars, _, _ in leaves))
            self.parts = [text[a:b] for a, b in zip([0, *ends], ends)] or [""]
        self._grow()

    @staticmethod
    def _cut(pieces: list[tuple[str, int]], blocks: int = 0) -> tuple[list[str], list[tuple[int, int]]]:
        """Texts and (tokens, pieces) of the blocks that the pieces make, of `BLOCK` pieces or in a given number."""
        step = -(-len(pieces) // blocks) if blocks else BLOCK
        cut = [pieces[i : i + step] for i in range(0, len(pieces), max(step, 1))]
        cut += [[]] * (max(blocks, 1) - len(cut))
        return ["".join(p for p, _ in c) for c in cut], [(sum(t for _, t in c), len(c)) for c in cut]

    def _grow(self) -> None:
        n = len(self.parts)
        self.width = 1 << (n - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        self.chars[self.width : self.width + n] = map(len, self.parts)
        self.tokens[self.width : self.width + n] = (t for t, _ in self.counts)
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        for sums in (self.chars, self.tokens):
            sums[node] = sums[2 * node] + sums[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def pieces(self) -> int:
        return sum(p for _, p in self.counts)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    @property
    def leaves(self) -> list[tuple[int, int, int]]:
        return [(len(p), t, n) for p, (t, n) in zip(self.parts, self.counts) if p]

    def _block_at(self, place: int) -> tuple[int, int]:
        """The block that holds the character and the characters before that block."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if place >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return min(node - self.width, len(self.parts) - 1), before

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end]."""
        start, end = min(start, self.chars[1]), min(max(start, end), self.chars[1])
        first, at = self._block_at(max(0, start - AHEAD))
        last, last_at = self._block_at(max(start, end - 1))
        # The text from the first block on, and the places in it at which an old block ends after the edit.
        held = "".join(self.parts[first : last + 1])
        held = held[: start - at] + new + held[end - at :]
        ends, place, fresh = {len(held): last + 1}, 0, []
        following = last + 1
        while True:
            match = self.counter.pattern.match(held, place) if place < len(held) else None
            if following < len(self.parts) and (match.end() if match else place) + AHEAD > len(held):
                held += self.parts[following]
                following += 1
                ends[len(held)] = following
                if place in ends and place and match is None:
                    break
                continue
            if match is None:
                break
            place = match.end()
            fresh.append((match[0], self.counter.tokens(match[0])))
            self.encoded += 1
            if place in ends:
                break
        stop = ends.get(place, following)
        blocks = stop - first
        keep = len(fresh) <= 2 * BLOCK * blocks
        parts, counts = self._cut(fresh, blocks if keep else 0)
        self.parts[first:stop], self.counts[first:stop] = parts, counts
        if not keep:
            return self._grow()
        touched = set()
        for i in range(first, stop):
            self.chars[self.width + i], self.tokens[self.width + i] = len(self.parts[i]), self.counts[i][0]
            touched.add((self.width + i) // 2)
        while touched - {0}:
            for node in touched:
                if node:
                    self._sum(node)
            touched = {node // 2 for node in touched if node}


def apply_edits(tree: Tree, edits: list[tuple[int, int, str]]) -> None:
    """Edits in places of the text as it was; the last one first, so that places hold."""
    length = tree.chars[1]
    reached = length + 1
    for start, end, new in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
        if min(end, length) > reached:
            raise ValueError(f"edits overlap at {start}:{end}")
        tree.edit(start, end, new)
        reached = start


EDITS = "array<struct<start:int,end:int,new:string>>"
LEAVES = "array<struct<chars:int,tokens:int,pieces:int>>"
_LEAVES = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32()), ("pieces", pa.int32())]))
_FIELDS = ("n_tokens", "n_pretokens", "n_edits", "n_tokens_after", "n_reencoded")


def _ranks(docs: DataFrame, vocabulary: str) -> object:
    with open(vocabulary, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _column(trees: list[list[tuple[int, int, int]] | None]) -> pa.Array:
    """Lists of leaves as an Arrow column."""
    offsets = pa.array([0, *accumulate(len(t or ()) for t in trees)], pa.int32())
    flat = [leaf for t in trees for leaf in t or ()]
    leaves = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.int32()) for i in range(3)], fields=list(_LEAVES.value_type))
    return pa.ListArray.from_arrays(offsets, leaves, mask=pa.array([t is None for t in trees], pa.bool_()))


def _growing(ranks: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(ranks.value)
            trees = _column([leaves_of(counter, t) for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), trees, *batch.columns[3:]], names=["doc_id", "text_hash", "tree", *batch.schema.names[3:]])

    return run


def _hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def grow(docs: DataFrame, vocabulary: str = VOCABULARY, **flags: Column) -> DataFrame:
    """doc_id, text_hash and tree (its leaves) of every row, and boolean columns of the given names; to be stored for later edits."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, tree {LEAVES}" + "".join(f", {name} boolean" for name in flags)
    return docs.select("doc_id", _hash().alias("text_hash"), "text", *(x.alias(name) for name, x in flags.items())).mapInArrow(_growing(_ranks(docs, vocabulary)), schema)


def _recounting(ranks: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            rows, after = [], []
            for text, edits, leaves in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                own = [(e["start"], e["end"], e["new"] or "") for e in edits or [] if e and e["start"] is not None and e["end"] is not None]
                stored = None if leaves is None else [(x["chars"], x["tokens"], x["pieces"]) for x in leaves]
                if stored is not None and not own:
                    n = sum(t for _, t, _ in stored)
                    rows.append((n, sum(p for _, _, p in stored), 0, n, 0))
                    after.append(stored)
                    continue
                if stored is None and not own:
                    rows.append((None,) * len(_FIELDS))
                    after.append(None)
                    continue
                counter = counter or Counter(ranks.value)
                tree = Tree(counter, text, stored)
                n, pieces = tree.total, tree.pieces
                apply_edits(tree, own)
                rows.append((n, pieces, len(own), tree.total, tree.encoded))
                after.append(tree.leaves)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_FIELDS))), _column(after)], names=["doc_id", *_FIELDS, "tree"])

    return run


def recount(docs: DataFrame, trees: DataFrame, edits: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_edits, n_tokens_after, n_reencoded (pre-tokens) and the tree after the edits, for every row.

    `trees` are those of `grow`, or of an earlier `recount` with the hashes of its texts.  `edits` is an expression over
    `docs`: an array of (start, end, new), places in code points.  Only texts with edits are read again.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    stored = trees.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("_tok_id"), F.col("text_hash").alias("_tok_h"), F.col("tree").alias("_tok_tree"))
    rows = docs.select("doc_id", "text", _hash().alias("_tok_hash"), edits.cast(EDITS).alias("_tok_edits"))
    # A text goes through the join only where it is needed.
    rows = rows.withColumn("_tok_text", F.when(F.size("_tok_edits") > 0, F.col("text"))).drop("text")
    rows = rows.join(stored, F.col("doc_id").eqNullSafe(F.col("_tok_id")) & (F.col("_tok_hash") == F.col("_tok_h")), "left")
    return rows.select("doc_id", "_tok_text", "_tok_edits", "_tok_tree").mapInArrow(_recounting(_ranks(docs, vocabulary)), f"doc_id {kind}, " + ", ".join(f"{f} long" for f in _FIELDS) + f", tree {LEAVES}")


def counts(trees: DataFrame) -> DataFrame:
    """The columns of `recount` for rows without edits, from their stored trees alone."""
    total = lambda field: F.aggregate(F.col(f"tree.{field}"), F.lit(0).cast("long"), lambda s, x: s + x)
    n = total("tokens")
    zero = F.lit(0).cast("long")
    return trees.select("doc_id", n.alias("n_tokens"), total("pieces").alias("n_pretokens"), zero.alias("n_edits"), n.alias("n_tokens_after"), zero.alias("n_reencoded"), "tree")


def digest(docs: DataFrame, found: Column, new: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts before and after all `found` spans are replaced by `new`: the trees are made and stored, and those with edits edited.

    Rows without edits are counted from their trees alone; only texts with edits are read again and joined with theirs.
    """
    some = F.size(found) > 0
    trees = checkpointed(grow(docs, vocabulary, _tok_edited=some))
    edits = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(new).alias("new")))
    edited = recount(docs.where(some), trees.where("_tok_edited"), edits, vocabulary)
    return counts(trees.where("not _tok_edited")).unionByName(edited).drop("tree")
