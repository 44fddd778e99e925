"""Secret scans: fixed formats, and sliding-window Shannon entropy per character class over candidate strings.

Fixed formats: assignments to secret-like names, access key ids and long lower-case hex.  Beside them, each run of
`min_len` or more characters of `[A-Za-z0-9+/_-]` is a candidate.  Its class (hex, alphanumeric, base64-like) sets an
entropy threshold; a window slides over it, and sum(c * log2 c) is updated by the counts of the character that enters and
the one that leaves.  The span reaches from the first to the last window over the threshold.

A span is reported if it holds `min_digits` digits, or one less, one of them before a letter, and letters of both cases: of
random keys of 20 letters and digits some 3 in 100 hold no digit and are missed, while numbered names in mixed case stay clean.  Allow-list suppression: spans that
match one of `allow` (pure words, pure numbers, placeholders, runs of the alphabet or of digits), candidates in UUID form and
candidates that touch a span of a fixed format are not reported; an allowed word elsewhere in the candidate is no reason.
The spans of fixed formats get their highest window entropy as well, of all characters where they are shorter.

Edge cases: a null text is empty; empty texts have no spans; very long candidates cost in proportion to their length;
repeated rows each get their result; private-use characters U+E000 to U+E002 in a text count as line feeds, which no
pattern holds, so positions stay those of the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import NAMED, joined, named, segments, spans, text_of, unmarked

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The limits on length are within the pattern where that gives the same matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Bits per character that a window must reach, by class.
THRESHOLDS = {"hex": 2.9, "alnum": 3.5, "base64": 3.7}
WINDOW, MIN_LEN, MIN_DIGITS = 16, 20, 2
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ALLOW = (
    r"^[A-Za-z/_+-]*$",
    r"^[0-9/_+-]*$",
    r"(?i)example|placeholder|changeme|your[-_]?(key|token|secret)|xxxxxx",
    r"(?i)abcdefgh|0123456789|1234567890",
)


def candidate_pattern(min_len: int) -> str:
    return r"[A-Za-z0-9+/_-]{%d,}" % min_len


def _clogc(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def hot_range(candidate: Column, threshold: Column, window: int = WINDOW) -> Column:
    """(lo, hi, top): the range that the windows over the threshold cover, in characters, lo > hi where there is none, and the
    highest entropy of a window."""
    codes = F.transform(F.regexp_extract_all(candidate, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("last"), F.lit(2**30).alias("lo"), F.lit(-1).alias("hi"), F.lit(0.0).alias("top"))
    held = lambda last, code: F.size(F.filter(last, lambda c: c == code))

    def step(acc: Column, code: Column) -> Column:
        # The window as it was, without the character that leaves, and with the one that enters.
        full = acc["at"] >= window
        out = F.get(acc["last"], 0)
        n_out, n_in = held(acc["last"], out), held(acc["last"], code) - F.when(full & (out == code), 1).otherwise(0)
        s = acc["s"] - F.when(full, _clogc(n_out) - _clogc(n_out - 1)).otherwise(F.lit(0.0)) + _clogc(n_in + 1) - _clogc(n_in)
        last = F.concat(F.when(full, F.slice(acc["last"], 2, window - 1)).otherwise(acc["last"]), F.array(code))
        at = acc["at"] + 1
        n = F.least(at, F.lit(window))
        entropy = F.log2(n) - s / n
        hot = (at >= window) & (entropy >= threshold)
        return F.struct(
            s.alias("s"), at.alias("at"), last.alias("last"),
            F.when(hot, F.least(acc["lo"], at - window)).otherwise(acc["lo"]).alias("lo"), F.when(hot, at).otherwise(acc["hi"]).alias("hi"),
            F.when(at <= window, entropy).otherwise(F.greatest(acc["top"], entropy)).alias("top"),
        )

    return F.aggregate(codes, start, step, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi"), acc["top"].alias("top")))


def _threshold(candidate: Column, thresholds: dict[str, float]) -> Column:
    return (
        F.when(candidate.rlike("^[0-9a-fA-F]+$"), F.lit(thresholds["hex"]))
        .when(candidate.rlike("^[0-9A-Za-z]+$"), F.lit(thresholds["alnum"]))
        .otherwise(F.lit(thresholds["base64"]))
    )


def _suspect(span: Column, allow: tuple[str, ...], min_digits: int) -> Column:
    digits = F.length(F.regexp_replace(span, "[^0-9]", ""))
    ok = (digits >= min_digits) | ((digits >= min_digits - 1) & span.rlike("[a-z]") & span.rlike("[A-Z]") & span.rlike("[0-9][A-Za-z]"))
    for pattern in allow:
        ok = ok & ~span.rlike(pattern)
    return ok


def scan(docs: DataFrame, window: int = WINDOW, min_len: int = MIN_LEN, min_digits: int = MIN_DIGITS, thresholds: dict[str, float] | None = None, allow: tuple[str, ...] = ALLOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, base and secrets: arrays of (kind_no, kind, start, end), base kinds first, and base_entropy; one row per document."""
    limits = THRESHOLDS | (thresholds or {})
    cut = docs.select(*keep, unmarked(text_of()).alias("_scan_text"))
    cut = cut.select(
        *keep,
        segments(F.col("_scan_text"), ASSIGN).alias("_a"),
        segments(F.col("_scan_text"), ACCESS).alias("_k"),
        segments(F.col("_scan_text"), HEX).alias("_h"),
        segments(F.col("_scan_text"), candidate_pattern(min_len)).alias("_c"),
    )
    long_enough = lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 1)) >= 6
    found = cut.select(
        *keep,
        F.concat(named(F.filter(spans(F.col("_a")), long_enough), 0, KINDS[0]), named(spans(F.col("_k")), 1, KINDS[1]), named(spans(F.col("_h")), 2, KINDS[2])).alias("_base"),
        F.concat(F.filter(spans(F.col("_a")), long_enough), spans(F.col("_k")), spans(F.col("_h"))).alias("_texts"),
        F.filter(spans(F.col("_c")), lambda x: x["text"].rlike("[0-9]") & ~x["text"].rlike(UUID)).alias("_cand"),
    )
    apart = lambda x: ~F.exists(F.col("_base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    hot = F.transform(
        F.filter(F.col("_cand"), apart),
        lambda x: F.struct(x["start"].alias("start"), x["text"].alias("text"), hot_range(x["text"], _threshold(x["text"], limits), window).alias("r")),
    )
    cut_out = lambda x: F.substring(x["text"], x["r"]["lo"] + 1, x["r"]["hi"] - x["r"]["lo"])
    extra = F.transform(
        F.filter(hot, lambda x: F.when(x["r"]["hi"] > x["r"]["lo"], _suspect(cut_out(x), allow, min_digits)).otherwise(F.lit(False))),
        lambda x: F.struct(F.lit(3).alias("kind_no"), F.lit(KINDS[3]).alias("kind"), (x["start"] + x["r"]["lo"]).alias("start"), (x["start"] + x["r"]["hi"]).alias("end")),
    )
    tops = F.transform("_texts", lambda x: hot_range(x["text"], F.lit(99.0), window)["top"])
    return found.select(*keep, F.col("_base").cast(f"array<{NAMED}>").alias("base"), F.concat(F.col("_base"), extra).cast(f"array<{NAMED}>").alias("secrets"), F.array_max(tops).alias("base_entropy"))


def digest(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, counts per base kind, hash of the base spans, all spans by start and then kind, n_entropy (spans of the windows)
    and base_entropy (the highest window entropy of the base spans, null without any)."""
    rows = scan(docs, **options)
    count = lambda no: F.size(F.filter("base", lambda x: x["kind_no"] == no)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base"), by_kind=False), 256).alias("base_sha256"),
        joined(F.col("secrets"), by_kind=False).alias("spans"),
        (F.size("secrets") - F.size("base")).cast("long").alias("n_entropy"),
        (F.floor(F.col("base_entropy") * 1000 + 0.5) / 1000).alias("base_entropy"),
    )
