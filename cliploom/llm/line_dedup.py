"""Line dedup: range-partitioned line hashes in a secondary sort by document and position, kept as bitmaps.

Lines leave the documents as (hash, document, position) only.  They are range-partitioned on hash and document with
positions in order, so a line that a third of all documents hold spreads over many partitions.  Over the sorted partitions
the first occurrence of a line in each document is streamed; first occurrences are counted per hash, pre-aggregated before
they meet.  The result per document is its keep bitmap, compressed: words of 64 lines in order, of which those that keep all
lines are left out.  It is never text; `apply` reads it against the document's own lines.

Lines that hold over a hundred-thousandth of all occurrences of common lines are hot: there are at most 100,000 of them,
so they are broadcast with their share counts, and their rows are joined in shares of about `SHARE_ROWS` documents.

Modes of `line_bitmaps`: "all" drops every line of a key found in at least `min_docs` documents; "first" keeps such a
key's first line in the order of documents and positions.

Edge cases: null and empty texts are one empty line; the empty key is never dropped; rows with equal doc_id and text
are one document and all are cleaned alike, rows with equal doc_id and other text are documents of their own; a null
doc_id counts as an id; lines repeated within one document count once.  Other columns of the input pass through `apply`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import ascii_lower, checkpointed, partitions, strip_blanks, text_of

#: Names of the work columns; a table that has one of these is refused by Spark as ambiguous, so they are unusual.
DOC, TEXT, KEEP = "_line_doc", "_line_text_hash", "_line_keep"
#: Hot lines at most, and documents of a hot line that are joined in one share.
HOT_LINES, SHARE_ROWS = 100_000, 2_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(strip_blanks(line))


def _identity(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").alias(DOC), F.xxhash64(text_of()).alias(TEXT)]


def first_places(each: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """The first position of each line in each document, streamed: the window has the partitioning and the order of the rows."""
    ordered = each.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "pos")
    return ordered.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).where("turn = 1").drop("turn")


def line_bitmaps(docs: DataFrame, min_docs: int = 10, mode: str = "all", min_chars: int = 1) -> DataFrame:
    """One row per document that loses lines: its identity and the compressed keep bitmap, as (word, bits) where bits are missing."""
    if mode not in ("all", "first"):
        raise ValueError(f"mode must be all or first, not {mode}")
    each = docs.select(*_identity(docs), F.posexplode(lines_of(text_of())).alias("pos", "line"))
    each = each.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    # Two hashes of other seeds make 128 bits: keys that differ do not meet.
    each = each.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), "key").alias("h2"), DOC, TEXT, "pos")
    keys = ["h1", "h2", DOC, TEXT]
    # Written once, without text: the range partitioning samples it and the join reads it.
    each = checkpointed(each)
    firsts = first_places(each, keys, partitions(docs.sparkSession))
    place = F.struct(DOC, TEXT, "pos")
    counted = [F.count(F.lit(1)).alias("n_docs"), *([F.min(place).alias("first")] if mode == "first" else [])]
    common = checkpointed(firsts.groupBy("h1", "h2").agg(*counted).where(F.col("n_docs") >= min_docs))
    total = common.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    shares = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / SHARE_ROWS)).cast("int")
    hot = common.where((F.col("n_docs") * HOT_LINES > total) & (F.col("n_docs") > SHARE_ROWS)).select("h1", "h2", shares.alias("shares"))
    salted = each.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("salt", F.pmod(F.hash(DOC, TEXT), F.coalesce("shares", F.lit(1)))).drop("shares")
    dealt = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when((F.col("n_docs") * HOT_LINES > total) & (F.col("n_docs") > SHARE_ROWS), shares - 1).otherwise(0))))
    hit = salted.join(dealt, ["h1", "h2", "salt"], "inner")
    if mode == "first":
        hit = hit.where(~(F.col("first")[DOC].eqNullSafe(F.col(DOC)) & (F.col("first")[TEXT] == F.col(TEXT)) & (F.col("first")["pos"] == F.col("pos"))))
    words = hit.groupBy(DOC, TEXT, F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits"))
    return words.groupBy(DOC, TEXT).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias(KEEP))


def _dense(keep: Column) -> Column:
    """The words as an array indexed by word number, up to the last one that misses a bit."""
    by_word = F.map_from_entries(keep)
    return F.transform(F.sequence(F.lit(0), F.element_at(keep, -1)["word"]), lambda w: F.coalesce(F.try_element_at(by_word, w), F.lit(-1).cast("long")))


def apply(docs: DataFrame, bitmaps: DataFrame, counts: bool = True) -> DataFrame:
    """The input's rows and columns, text without its dropped lines; with `counts` also n_lines and n_dropped.

    A text that loses nothing is passed on as it is (null stays null).  Counts take the place of input columns of their name.
    """
    doc, text = _identity(docs)
    kept = bitmaps.select(F.col(DOC).alias("_line_d"), F.col(TEXT).alias("_line_t"), KEEP)
    marked = docs.select("*", doc, text)
    marked = marked.join(kept, F.col(DOC).eqNullSafe(F.col("_line_d")) & (F.col(TEXT) == F.col("_line_t")), "left").withColumn("_line_dense", F.when(F.col(KEEP).isNotNull(), _dense(F.col(KEEP))))
    lines = lines_of(text_of())
    dropped = F.aggregate(F.col(KEEP), F.lit(0), lambda n, w: n + 64 - F.bit_count(w["bits"]))
    stays = F.filter(
        lines,
        lambda _, i: F.coalesce(F.get(F.col("_line_dense"), F.floor(i / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)), F.lit(1).cast("long")) != 0,
    )
    added = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(dropped, F.lit(0)).cast("long")} if counts else {}
    text_kept = F.when(F.col(KEEP).isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("text")
    return marked.select(*(text_kept if c == "text" else F.col(c) for c in docs.columns if c not in added), *(x.alias(n) for n, x in added.items()))
