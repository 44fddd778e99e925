"""Quality rules, line first: lines that fail punctuation, navigation or boilerplate rules go, then texts that lose too much.

Line rules (a line without words never fails):
- navigation: two or more `|`, `>` or bullet separators that stand alone as words, and at least a fifth of the words are such;
- symbols: ten times the characters of `[#*$%&|<>]` exceed the line's word characters;
- shouting: eight or more words, and as many exclamation marks as words;
- punctuation: `min_unpunctuated` or more words and none of `.!?;:` or their wide and ellipsis forms in the line;
- boilerplate: at most `max_boilerplate` words and a phrase of licence, cookie, rights or subscription notices.

A text is rejected if it fails the base rules (fewer than `min_words` words, or more than half of its words in 3-word
windows that occur twice or more) or if failing lines hold more than `max_lost` percent of its words.  `clean` removes
failing lines from the texts that stay.

Edge cases: null and empty texts have no words and fail; very long lines and texts are worked on whole; repeated rows
each get their result; other columns of the input pass through `clean` (n_chars is counted anew where present).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MAX_REPEATED, MAX_LOST = 50, 50, 50
MIN_UNPUNCTUATED, MAX_BOILERPLATE = 12, 30
BLANKS, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
SEPARATORS = frozenset((b"|", b">", b">>", "·".encode(), "»".encode(), "•".encode(), "→".encode()))
PUNCTUATION = re.compile("[.!?;:…。！？；：।؟]")
#: Fixed phrases of notices.
NOTICES = re.compile(
    r"licensed under|all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|we use cookies"
    r"|subscribe to our|sign up for our|click here to|share this (?:post|page|article)|copyright (?:©|\(c\))|powered by",
    re.IGNORECASE | re.ASCII,
)


def n_repeated(words: list[bytes], width: int = 3) -> int:
    """Words in windows found twice or more, first ones included."""
    windows = list(zip(*(words[i:] for i in range(width))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + width - max(i, covered)
            covered = i + width
    return total


def line_fails(line: str, words: list[bytes]) -> bool:
    n = len(words)
    if not n:
        return False
    separators = sum(w in SEPARATORS for w in words)
    if separators >= 2 and 5 * separators >= n:
        return True
    symbols = sum(map(line.count, SYMBOLS))
    if 10 * symbols > len(line) - sum(map(line.count, BLANKS)):
        return True
    if n >= 8 and line.count("!") >= n:
        return True
    if n >= MIN_UNPUNCTUATED and not PUNCTUATION.search(line):
        return True
    return n <= MAX_BOILERPLATE and NOTICES.search(line) is not None


def judged(text: str | None, max_lost: int = MAX_LOST) -> tuple[dict[str, object], str]:
    """The counts and verdict of a text, and the text without its failing lines."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    lines, seen, dup, lost, stay = text.split("\n"), set(), 0, 0, []
    for line in lines:
        own = line.encode().split()
        if own:
            dup += line in seen
            seen.add(line)
        if line_fails(line, own):
            lost += len(own)
        else:
            stay.append(line)
    repeated = n_repeated(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    row = {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, BLANKS)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": repeated,
        "n_lost_words": lost,
        "base_failed": failed,
        "kept": not failed and 100 * lost <= max_lost * n,
    }
    return row, "\n".join(stay)


_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_lost_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]


def _judge(max_lost: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judged(t, max_lost)[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in _FIELDS)], names=["doc_id", *(k for k, _ in _FIELDS)])

    return run


def judge(docs: DataFrame, max_lost: int = MAX_LOST) -> DataFrame:
    """doc_id, the counts and the verdict of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_judge(max_lost), f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lost_words long, base_failed boolean, kept boolean")


def _clean(max_lost: int, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [judged(t, max_lost) for t in batch.column(at).to_pylist()]
            out = batch.set_column(at, batch.schema.field(at), pa.array([text for _, text in verdicts], batch.schema.field(at).type))
            yield out.filter(pa.array([bool(row["kept"]) for row, _ in verdicts], pa.bool_()))

    return run


def clean(docs: DataFrame, max_lost: int = MAX_LOST) -> DataFrame:
    """The input's kept rows, with their failing lines removed."""
    own = [F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)]
    schema = ", ".join(f"own_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    rows = docs.select(*own).mapInArrow(_clean(max_lost, docs.columns.index("text")), schema)
    rows = rows.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)))
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def digest(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words."""
    return judge(docs, **options)
