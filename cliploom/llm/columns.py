"""Column helpers shared by the operators: word rules, ASCII case, and code point positions of regex matches.

Everything here is a DataFrame expression; no Python runs on the executors.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed, dropped, shares, written  # noqa: F401

#: A word, and the white space it excludes.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"

#: Characters that mark places in a copy of the text.  A text's own ones become line feeds, which no pattern takes.
MARK, SPACE_MARK, HYPHEN_MARK = "\ue000", "\ue001", "\ue002"

SPAN = "struct<start:int,end:int,text:string>"
_CHUNK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def unmarked(text: Column) -> Column:
    """The text with none of the mark characters; as many code points as before."""
    return reduce(lambda t, m: F.replace(t, F.lit(m), F.lit("\n")), (MARK, SPACE_MARK, HYPHEN_MARK), text)


def segments(text: Column, pattern: str) -> Column:
    """The text cut around each leftmost non-overlapping match: even elements lie between matches, odd ones are matches.

    The text must be free of MARK (see `unmarked`).
    """
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def spans(cut: Column) -> Column:
    """Start, end (exclusive) and text of each match in what `segments` returned, in code points.

    Lengths are added up within chunks of 256 pieces and then over chunks, so a text with very many matches costs
    in proportion to their number.
    """
    empty = F.array().cast(f"array<{SPAN}>")

    def add(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        found = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), piece.alias("text")))
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), F.when(acc["odd"], F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    def chunk(k: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), empty.alias("out"))
        return F.aggregate(F.slice(cut, k * _CHUNK + 1, F.lit(_CHUNK)), start, add)

    def gather(acc: Column, part: Column) -> Column:
        moved = F.transform(
            part["out"],
            lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["text"].alias("text")),
        )
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(cut) - 1) / _CHUNK).cast("int")), chunk)
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    return F.when(F.size(cut) > 1, F.flatten(F.aggregate(chunks, nothing, gather, lambda acc: acc["out"]))).otherwise(empty)


def named(found: Column, order: int, kind: str) -> Column:
    """Spans as (order, kind, start, end) structs."""
    return F.transform(
        found,
        lambda x: F.struct(F.lit(order).alias("kind_no"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )


NAMED = "struct<kind_no:int,kind:string,start:int,end:int>"


def joined(found: Column, by_kind: bool) -> Column:
    """kind:start:end, comma-joined; by kind then start, or by start then kind."""
    keys = ("kind_no", "start") if by_kind else ("start", "kind_no")
    rows = F.array_sort(F.transform(found, lambda x: F.struct(*(x[k].alias(f"k{i}") for i, k in enumerate(keys)), x["end"].alias("end"), x["start"].alias("start"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
