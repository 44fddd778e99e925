"""Text column functions: names, keys, labels, questions, time codes and tolerant JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import col, padded

# Fixed values.
VIDEO_EXTENSIONS = ("mp4", "mov", "mxf", "m4v", "avi", "mkv", "webm")
STORY_STOPWORDS = ("about", "after", "before", "build", "from", "into", "make", "moment", "move", "rough", "short", "story", "that", "then", "this", "through", "with")
QUESTION_WORDS = ("how", "what", "when", "where", "which", "who", "why", "can", "could", "did", "do", "does", "is", "are", "should", "will", "would")
PLACEHOLDERS = ("short label", "short sentence", "item1", "item2", "item 1", "item 2", "label", "sentence", "n/a", "none", "null", "placeholder")


def slugify(text: Column | str) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("project"))


def human_join(items: Column) -> Column:
    """Oxford comma; an empty list reads 'overall balance'."""
    n = F.size(items)
    return (
        F.when(n == 0, F.lit("overall balance"))
        .when(n == 1, F.get(items, 0))
        .when(n == 2, F.concat(F.get(items, 0), F.lit(" and "), F.get(items, 1)))
        .otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(items, -1)))
    )


def dedupe_labels(labels: Column) -> Column:
    """Distinct in order, blanks dropped."""
    return F.array_distinct(F.filter(labels, lambda x: F.trim(x) != ""))


def humanize_stem(stem: Column | str) -> Column:
    """Separators become spaces, each run of letters is capitalised (also after digits and apostrophes); a blank one stays as it is."""
    bare = F.trim(F.regexp_replace(col(stem), "[_-]+", " "))
    runs = F.regexp_extract_all(bare, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    titled = F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")
    return F.when(bare == "", col(stem)).otherwise(titled)


def clip_key(stem: Column | str) -> Column:
    """Upper case without a delimited proxy marker and without other than letters and digits."""
    bare = F.regexp_replace(F.upper(col(stem)), r"(?:^|[_\-. ])(?:PROXY|PROX|OPTIMIZED|OPT)(?:$|[_\-. ])", "_")
    return F.regexp_replace(bare, "[^A-Z0-9]+", "")


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def media_role(path: Column | str) -> Column:
    """proxy by folder (proxy, proxies, optimized) or by a delimited marker in the stem, else source."""
    folder = F.lower(col(path)).rlike("proxy|proxies|optimized")
    marked = F.lower(file_stem(path)).rlike(r"(?:^|[_\-. ])(?:proxy|prox|optimized|opt)(?:$|[_\-. ])")
    return F.when(folder | marked, F.lit("proxy")).otherwise(F.lit("source"))


def is_video(path: Column | str) -> Column:
    return file_extension(path).isin(*VIDEO_EXTENSIONS)


def story_keywords(prompt: Column | str) -> Column:
    """Distinct tokens of four or more characters that are no stop words, sorted."""
    tokens = F.filter(F.regexp_extract_all(F.lower(F.coalesce(col(prompt), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 4)
    return F.array_sort(F.array_except(tokens, F.array(*map(F.lit, STORY_STOPWORDS))))


def searchable(excerpt: Column, description: Column, roles: Column, subjects: Column, actions: Column, summary: Column) -> Column:
    """What prompt keywords are looked for in: texts and lists of a segment, joined by spaces."""
    parts = [excerpt, description, *(F.array_join(x, " ") for x in (roles, subjects, actions)), summary]
    return F.concat_ws(" ", *(F.nullif(x, F.lit("")) for x in parts))


def prompt_terms(keywords: Column, text: Column | str) -> Column:
    """Keywords that the text contains as substrings, sorted."""
    return F.array_sort(F.filter(keywords, lambda k: F.contains(F.lower(col(text)), k)))


def prompt_score(terms: Column) -> Column:
    return F.least(F.lit(0.08), F.lit(0.02) * F.size(terms))


def is_question(text: Column | str) -> Column:
    """Holds a question mark or starts with a question word."""
    bare = F.lower(F.trim(F.coalesce(col(text), F.lit(""))))
    return F.contains(bare, F.lit("?")) | F.regexp_extract(bare, "[a-z0-9']+", 0).isin(*QUESTION_WORDS)


def detects_text(text: Column | str) -> Column:
    """Eight or more letters and two or more words."""
    bare = F.coalesce(col(text), F.lit(""))
    letters = F.length(F.regexp_replace(bare, "[^A-Za-zÀ-ÖØ-öø-ÿ]", ""))
    return (letters >= 8) & (F.size(F.split(F.trim(bare), r"\s+")) >= 2)


def is_placeholder(text: Column | str, placeholders: tuple[str, ...] = PLACEHOLDERS) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(col(text), F.lit("")))), r"\s+", " ")
    return (bare == "") | bare.isin(*placeholders) | bare.startswith("short ") | bare.rlike(r"^item\s*\d+$")


def distinct_ignoring_case(items: Column) -> Column:
    """The first spelling of each item, blanks dropped."""
    seen = lambda acc, x: F.exists(acc, lambda y: F.lower(y) == F.lower(x))
    return F.aggregate(items, F.array().cast("array<string>"), lambda acc, x: F.when((F.trim(x) == "") | seen(acc, x), acc).otherwise(F.concat(acc, F.array(x))))


def model_matches(asked: Column | str, offered: Column | str) -> Column:
    a, b = F.lower(F.trim(col(asked))), F.lower(F.trim(col(offered)))
    return (a == b) | F.contains(b, a) | F.contains(a, b)


def model_slug(model_id: Column | str) -> Column:
    """A model id as a folder name."""
    return F.replace(F.replace(F.trim(col(model_id)), F.lit("/"), F.lit("--")), F.lit(":"), F.lit("-"))


def model_key(model_id: Column | str, revision: Column | str) -> Column:
    """The name of a prepared model: its folder name and revision."""
    return F.concat(model_slug(model_id), F.lit("@"), F.coalesce(F.nullif(col(revision), F.lit("")), F.lit("default")))


def timecode_of(text: Column | str) -> Column:
    """The clock part of an ISO or EXIF date-time as HH:MM:SS:00, in its own offset."""
    clock = F.regexp_extract(col(text), r"^\d{4}[-:]\d{2}[-:]\d{2}[T ](\d{2}:\d{2}:\d{2})", 1)
    return F.when(clock != "", F.concat(clock, F.lit(":00")))


def full_timecode(text: Column | str) -> Column:
    return F.when(F.trim(col(text)).rlike(r"^\d{2}:\d{2}:\d{2}:\d{2}$"), F.trim(col(text)))


def timecode_seconds(code: Column | str, fps: Column | str) -> Column:
    """HH:MM:SS:FF in seconds; malformed codes are 0."""
    parts = F.transform(F.split(col(code), ":"), lambda p: p.try_cast("double"))
    seconds = F.get(parts, 0) * 3600 + F.get(parts, 1) * 60 + F.get(parts, 2) + F.coalesce(F.try_divide(F.get(parts, 3), col(fps)), F.lit(0.0))
    return F.when(F.size(parts) == 4, F.coalesce(seconds, F.lit(0.0))).otherwise(F.lit(0.0))


def clock(seconds: Column | str) -> Column:
    """MM:SS, or HH:MM:SS from an hour on."""
    s = F.greatest(F.floor(col(seconds)), F.lit(0)).cast("long")
    two = lambda x: padded(x, 2)
    short = F.concat_ws(":", two(F.floor(s / 60)), two(s % 60))
    return F.when(s < 3600, short).otherwise(F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60)))


@F.pandas_udf(T.StringType())
def _best_rational(micros: pd.Series) -> pd.Series:
    """The fraction of seconds nearest to whole microseconds with a denominator up to 24000."""

    def told(x: float) -> str | None:
        if x is None or x != x:
            return None
        f = Fraction(int(x), 1_000_000).limit_denominator(24000)
        return f"{f.numerator}/{f.denominator}s"

    return micros.map(told)


def rational_time(seconds: Column | str) -> Column:
    """n/ds with the denominator up to 24000, as the timeline format writes times; under 0 is 0.

    Whole microseconds whose fraction is that short, such as all milliseconds, are told by division alone; only the others
    reach Python, which finds the nearest one.
    """
    micros = F.floor(F.greatest(col(seconds), F.lit(0.0)) * 1e6 + 0.5).cast("long")
    power = lambda base, most: F.greatest(*(F.when(micros % base**k == 0, F.lit(base**k)).otherwise(F.lit(1)) for k in range(1, most + 1)))
    common = power(2, 6) * power(5, 6)
    short = common >= F.lit(-(-1_000_000 // 24_000))
    whole = F.concat(F.floor(micros / common).cast("long").cast("string"), F.lit("/"), F.floor(F.lit(1_000_000) / common).cast("long").cast("string"), F.lit("s"))
    valid = col(seconds).isNotNull() & ~F.isnan(col(seconds).cast("double"))
    return F.when(valid, F.coalesce(F.when(short, whole), _best_rational(F.when(~short & valid, micros))))


def rational_seconds(text: Column | str) -> Column:
    parts = F.split(F.rtrim(col(text), F.lit("s")), "/")
    return F.coalesce(F.try_divide(F.get(parts, 0).try_cast("double"), F.coalesce(F.get(parts, 1).try_cast("double"), F.lit(1.0))), F.lit(0.0))


def _cuts(text: str) -> list[tuple[int, str]]:
    """Where a text can be cut, the last place first: each comma with what then closes the text before it."""
    found, closers, quoted, skip = [], [], False, False
    for i, c in enumerate(text):
        if c == ",":
            found.append((i, '"' * quoted + "".join(reversed(closers))))
        if quoted:
            skip, quoted = c == "\\" and not skip, skip or c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            closers.append("}" if c == "{" else "]")
        elif closers and c == closers[-1]:
            closers.pop()
    return found[::-1]


def _repaired(raw: str | None) -> str | None:
    """The first of these that is JSON decides, and is null unless it is an object: the text, its outermost braces (else what
    follows the first brace), and that cut at each comma from the last on, with what is open closed."""
    if raw is None:
        return None
    start, end = raw.find("{"), raw.rfind("}")
    inner = "" if start < 0 else raw[start : end + 1] if end > start else raw[start:].rstrip()

    def candidates() -> Iterator[str]:
        yield raw
        if inner:
            yield inner
            yield from (inner[:i].rstrip() + closing for i, closing in _cuts(inner))

    for candidate in candidates():
        try:
            found = json.loads(candidate)
        except (ValueError, RecursionError):
            continue
        return json.dumps(found, sort_keys=True, ensure_ascii=False) if isinstance(found, dict) else None
    return None


@F.pandas_udf(T.StringType())
def _repaired_json(raw: pd.Series) -> pd.Series:
    return raw.map(_repaired)


def whole_json(raw: Column | str) -> Column:
    """`object` for a text that is a JSON object, `other` for other JSON, null for a text that is none.

    Texts that begin as no JSON does aren't parsed: a parse that fails costs many times one that doesn't.
    """
    kind = F.schema_of_variant(F.try_parse_json(F.when(col(raw).rlike(r'^[ \t\r\n]*[\[{"0-9tfn-]'), col(raw))))
    return F.when(kind.startswith("OBJECT"), "object").when(kind.isNotNull(), "other")


def repaired_json(raw: Column | str) -> Column:
    """A JSON object out of model output (see `_repaired`); null where there is none.

    Python sees only texts that aren't JSON and have a brace.  Where many rows are whole, `operators.model.with_objects`
    keeps them out of Python's batches altogether.
    """
    braced = F.when(F.contains(col(raw), F.lit("{")), col(raw))
    kind = whole_json(braced)
    # Python's result is null for what is JSON, so only then the kind is asked for once more.
    return F.coalesce(_repaired_json(F.when(kind.isNull(), braced)), F.when(kind == "object", braced))


_NUMBER = r"^[+-]?((\d[\d_]*\.?[\d_]*|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))$"


def key_values(raw: Column | str, allowed: Sequence[str]) -> Column:
    """A struct of the allowed keys out of 'key: value' lines, each (text, number), or null without any of them.

    Keys are compared in lower case with underscores for blanks; of repeated ones the last counts.  A value in quotes is text
    without them, `null` is nothing, a number is a number, anything else is text.
    """
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    lines = F.filter(F.split(F.coalesce(col(raw), F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.replace(F.lower(bare(F.substring_index(x, ":", 1))), F.lit(" "), F.lit("_")).alias("key"), bare(F.substr(x, F.instr(x, ":") + 1)).alias("value")))

    # Items of arrays are found once; as expressions they would be anew for each use.
    once = lambda x, use: F.get(F.transform(F.array(x), use), 0)

    def told(value: Column) -> Column:
        quoted = value.startswith('"') & value.endswith('"') & (F.length(value) >= 2)
        number = ~quoted & value.rlike(_NUMBER)
        text = F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).when(~number & (F.lower(value) != "null"), value)
        return F.struct(text.alias("text"), F.when(number, F.replace(value, F.lit("_"), F.lit("")).try_cast("double")).alias("number"))

    def read(pairs: Column, key: str) -> Column:
        return once(F.try_element_at(F.transform(F.filter(pairs, lambda p: p["key"] == key), lambda p: p["value"]), F.lit(-1)), told)

    some = lambda pairs: F.exists(pairs, lambda p: p["key"].isin(*allowed))
    return once(pairs, lambda found: F.when(some(found), F.struct(*(read(found, k).alias(k) for k in allowed))))


def told_number(x: Column) -> Column:
    """A number as text, a whole one without decimals."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def row_key(*columns: Column | str, method: str = "sha1") -> Column:
    """A hash of the columns as canonical JSON; stable within this engine."""
    text = F.to_json(F.struct(*(col(c) for c in columns)))
    return F.sha1(text) if method == "sha1" else F.md5(text)


def runtime_text(seconds: Column) -> Column:
    """A runtime as a clock and in seconds."""
    some = F.greatest(seconds, F.lit(0.0))
    return F.concat(clock(some), F.format_string(" (%.2fs)", some))


def delta_text(delta: Column, pct: Column) -> Column:
    """How a runtime compares with the one before."""
    way = F.when(delta > 0, "slower").when(delta < 0, "faster").otherwise("unchanged")
    return F.concat(F.format_string("%.2fs ", F.abs(delta)), F.when(pct.isNull(), "").otherwise(F.format_string("(%.1f%%) ", F.abs(pct))), way)
