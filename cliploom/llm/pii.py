"""PII: fixed formats as protected entities, and terms that reveal them, found from corpus co-occurrence.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers found by pattern.  A term (a whole word of
`min_letters` or more letters, lower-cased, outside e-mail addresses) co-occurs with an entity where both stand in one
document.  Over the whole corpus

    disclosure(term, entity) = p(entity | term) = c s / (c + 1)

is how sure the term makes of the entity: s is the share of the term's documents in which both stand together and c the
number of different contexts of the entity in these, so evidence from few of them counts for less.  A context is what stands
within `AROUND` code points of the entity; exact copies and most near copies of a text have the same one.  A term discloses
an entity if its disclosure is `threshold` or more - at 0.6 under three quarters of a bit of the entity is left - if at least
`MIN_CONTEXTS` contexts show it, and if it at least doubles the entity's share of all documents.  None of this
depends on how many other documents there are, but that an entity in a third of them or more needs more of a term.  Terms
that disclose become spans of kind `term` wherever they stand in any document; `sanitise` generalises the entities to their
kind and removes or generalises the terms.

A term's documents are counted over the corpus only where they can matter.  An entity of one context has no terms.  A term
stands in no fewer documents than in those with entities, and in at most the entity's number of documents over the
threshold.  So terms that stand in too many of the documents with entities go before terms and entities meet, and pairs that
fall short on these counts go before the corpus is read for the terms of the rest.  When it is, the `COMMON_TERMS` most
frequent of the terms that are in no pair left are left out by a broadcast of that size, which spares most of the shuffle.
No term that discloses is lost by it.

Rows meet by (term, entity) and by term, always as counts that were pre-aggregated before the shuffle.  Spans are only cut from documents that hold a
revealing term: where a document holds few, by a pattern of its own terms, else by a join of its words with them.

Edge cases: a null text is empty and gives no spans; repeated rows and rows that share a doc_id are told apart by their
text's hash and all get their result; overlapping spans are all reported; the work columns' names start with `_pii`.
Private-use characters U+E000 to U+E002 count as line feeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import HYPHEN_MARK, NAMED, SPACE_MARK, checkpointed, joined, named, segments, spans, text_of, unmarked

KINDS = ("email", "ip", "card", "phone", "term")
#: Ruled-out terms, and documents with revealing terms, that are broadcast at most.
COMMON_TERMS, BROADCAST_ROWS = 100_000, 100_000
#: Contexts that must show a term with an entity, and how far a context reaches, in code points.
MIN_CONTEXTS, AROUND = 2, 16
#: Revealing terms of a document up to which one pattern finds them.
PATTERN_TERMS = 500


def _email_segments(text: Column) -> Column:
    """Dots that no domain character follows end a domain; they are marked first, so the pattern needs no nested repeat."""
    marked = F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", SPACE_MARK)
    local = rf"[A-Za-z0-9._%+{SPACE_MARK}-]"
    return segments(marked, rf"(?:\G|(?<!{local})){local}++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++")


def _ip_segments(text: Column) -> Column:
    return segments(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")


def _card_segments(text: Column) -> Column:
    """Single blanks and hyphens between digits are marked first; a run of digits and marks is then one match."""
    marked = F.regexp_replace(F.regexp_replace(text, r"(?<=[0-9])\x20(?=[0-9])", SPACE_MARK), r"(?<=[0-9])-(?=[0-9])", HYPHEN_MARK)
    return segments(marked, rf"[0-9][0-9{SPACE_MARK}{HYPHEN_MARK}]{{12,}}")


def _phone_segments(text: Column) -> Column:
    return segments(text, r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _ip_ok(text: Column) -> Column:
    small = lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3
    return F.forall(F.split(text, r"\."), lambda part: small(part) & (F.coalesce(F.substring(F.ltrim(part, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _card_ok(text: Column) -> Column:
    n = F.length(_digits(text))
    return F.when((n >= 13) & (n <= 19), luhn(_digits(text))).otherwise(F.lit(False))


def _phone_ok(text: Column) -> Column:
    return F.length(_digits(text)).between(9, 15)


def entities(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, base: an array of (kind_no, kind, start, end), and values: the entity of each, in order."""
    t = F.col("_pii_text")
    cut = docs.select(*keep, unmarked(text_of()).alias("_pii_text"))
    # Most texts lack what a pattern needs, and are not searched for it.
    cut = cut.withColumn("_pii_digits", t.rlike("[0-9]"))
    digits, nothing = F.col("_pii_digits"), F.array(t)
    need = (F.contains(t, F.lit("@")), digits & F.contains(t, F.lit(".")), digits, digits & F.contains(t, F.lit("+")))
    found = (_email_segments(t), _ip_segments(t), _card_segments(t), _phone_segments(t))
    cut = cut.select(*keep, *(F.when(has, x).otherwise(nothing).alias(f"_pii_{i}") for i, (has, x) in enumerate(zip(need, found))))
    ok = (lambda x: F.lit(True), _ip_ok, _card_ok, _phone_ok)
    value = (lambda x: F.lower(F.replace(x, F.lit(SPACE_MARK), F.lit("."))), lambda x: x, _digits, _digits)

    def passing(i: int) -> Column:
        return F.filter(spans(F.col(f"_pii_{i}")), lambda x: ok[i](x["text"])).alias(f"_pii_{i}")

    def entity(i: int) -> Column:
        return F.transform(f"_pii_{i}", lambda x: F.concat(F.lit(f"{KINDS[i]}:"), value[i](x["text"])))

    found = cut.select(*keep, *map(passing, range(4)))
    return found.select(
        *keep,
        F.concat(*(named(F.col(f"_pii_{i}"), i, KINDS[i]) for i in range(4))).cast(f"array<{NAMED}>").alias("base"),
        F.concat(*map(entity, range(4))).alias("values"),
    )


def _terms_pattern(min_letters: int) -> str:
    """Whole words of letters."""
    return r"(?<![\p{L}\p{N}_])\p{L}{%d,}+(?![\p{L}\p{N}_])" % min_letters


def _prose(text: Column) -> Column:
    """The text with zeros for the characters of e-mail addresses; as many code points as before."""
    plain = unmarked(text)
    masked = F.array_join(F.transform(_email_segments(plain), lambda x, i: F.when(i % 2 == 1, F.repeat(F.lit("0"), F.length(x))).otherwise(x)), "")
    return F.when(F.contains(plain, F.lit("@")), masked).otherwise(plain)


def _terms(text: Column, min_letters: int) -> Column:
    """The text's distinct terms."""
    words = F.array_distinct(F.regexp_extract_all(_prose(text), F.lit(_terms_pattern(min_letters)), F.lit(0)))
    return F.array_distinct(F.transform(words, lambda x: F.lower(x)))


def _placed_values(text: Column) -> Column:
    """The entities of a text, each with the least of the contexts that it stands in: `AROUND` code points on either side."""

    def context(x: Column) -> Column:
        before = F.substring(text, F.greatest(x["start"] - AROUND, F.lit(0)) + 1, F.least(x["start"], F.lit(AROUND)))
        return F.concat(before, F.lit("\n"), F.substring(text, x["end"] + 1, F.lit(AROUND)))

    return F.zip_with("base", "values", lambda x, v: F.struct(v.alias("entity"), context(x).alias("context")))


def _mentions(docs: DataFrame, min_letters: int) -> DataFrame:
    """Documents with their spans, entities with their contexts and, where they have any, distinct terms."""
    rows = entities(docs.select("doc_id", "text", F.xxhash64(text_of()).alias("_pii_hash")), keep=("doc_id", "_pii_hash", "text"))
    terms = F.when(F.size("values") > 0, _terms(text_of(), min_letters)).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", "_pii_hash", "base", F.array_distinct(_placed_values(text_of())).alias("values"), terms.alias("terms"))


def _disclosure(pair_docs: Column, term_docs: Column, entity_docs: Column, contexts: Column, n: int) -> Column:
    """p(entity | term), or 0 where too few contexts show both or the entity is no likelier by it."""
    sure = contexts * F.least(pair_docs / term_docs, F.lit(1.0)) / (contexts + 1)
    return F.when((contexts >= MIN_CONTEXTS) & (sure * n >= 2 * entity_docs), sure).otherwise(F.lit(0.0))


def candidate_pairs(mentions: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, seen): term, entity, entity_docs, pair_docs, contexts - counts of documents, and of different contexts, over
    whole documents - of all pairs that can disclose, and some that term counts over the corpus will show not to; and
    term, seen_docs of all terms of the documents with entities.
    """
    texts = mentions.where(F.size("values") > 0).groupBy("_pii_hash").agg(F.count(F.lit(1)).alias("copies"), F.first("values").alias("values"), F.first("terms").alias("terms"))
    texts = checkpointed(texts)
    placed = texts.select("_pii_hash", "copies", F.inline("values")).groupBy("_pii_hash", "copies", "entity").agg(F.min("context").alias("context"))
    counted = placed.groupBy("entity").agg(F.sum("copies").alias("entity_docs"), F.countDistinct("context").alias("contexts"))
    # The documents that a term may stand in at most to disclose the entity, a rounding error aside.
    most = F.col("entity_docs").cast("double") / (threshold * (1 - 1e-9))
    stand = checkpointed(placed.select("_pii_hash", "entity", "context").join(counted.where(F.col("contexts") >= MIN_CONTEXTS).select("entity", "entity_docs"), "entity").withColumn("most", most))

    each = texts.select("_pii_hash", "copies", F.explode("terms").alias("term"))
    seen = checkpointed(each.groupBy("term").agg(F.sum("copies").alias("seen_docs")))
    most_of_all = stand.agg(F.max("most")).first()[0] or 0.0
    most_of_text = stand.groupBy("_pii_hash").agg(F.max("most").alias("text_most"))
    rare = each.join(most_of_text, "_pii_hash").join(seen.where(F.col("seen_docs") <= most_of_all), "term").where("seen_docs <= text_most")
    pairs = rare.select("_pii_hash", "copies", "term", "seen_docs").join(stand, "_pii_hash").where("seen_docs <= most")
    pairs = pairs.groupBy("term", "entity", "entity_docs", "seen_docs", "context").agg(F.sum("copies").alias("copies"))
    pairs = pairs.groupBy("term", "entity", "entity_docs", "seen_docs").agg(F.sum("copies").alias("pair_docs"), F.count(F.lit(1)).alias("contexts"))
    may = _disclosure(F.col("pair_docs"), F.col("seen_docs"), F.col("entity_docs"), F.col("contexts"), n) >= threshold - 1e-9
    return pairs.where(may).drop("seen_docs"), seen


def _bounded(rows: DataFrame) -> DataFrame:
    """The rows, to be broadcast if they were counted to be few."""
    rows = checkpointed(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def holders(docs: DataFrame, terms: DataFrame, ruled_out: DataFrame, min_letters: int) -> DataFrame:
    """_pii_h, term: for each document, copies as well, its text's hash and the given terms that it holds."""
    each = docs.select(F.xxhash64(text_of()).alias("_pii_h"), F.explode(_terms(text_of(), min_letters)).alias("term"))
    return each.join(F.broadcast(ruled_out), "term", "left_anti").join(_bounded(terms), "term", "left_semi")


def disclosing_terms(pairs: DataFrame, held: DataFrame, n: int, threshold: float) -> DataFrame:
    """(term, entity, disclosure) at or over the threshold."""
    scored = pairs.join(held.groupBy("term").agg(F.count(F.lit(1)).alias("term_docs")), "term")
    score = _disclosure(F.col("pair_docs"), F.col("term_docs"), F.col("entity_docs"), F.col("contexts"), n)
    return scored.select("term", "entity", score.alias("disclosure")).where(F.col("disclosure") >= threshold)


def _term_spans(docs: DataFrame, held: DataFrame, terms: DataFrame, min_letters: int) -> DataFrame:
    """_pii_doc, _pii_h, found: the spans of the given terms in every document that holds one.

    A text is known by its hash here: texts that share one would share their lists of terms, and only those are marked that
    stand in the text.
    """
    own = checkpointed(held.join(terms, "term", "left_semi").distinct())
    marks = own.groupBy(F.col("_pii_h").alias("h")).agg(F.collect_set("term").alias("terms"))
    rows = docs.select(F.col("doc_id").alias("_pii_doc"), F.xxhash64(text_of()).alias("_pii_h"), "text").join(_bounded(marks), F.col("_pii_h") == F.col("h"))
    rows = rows.select("_pii_doc", "_pii_h", "terms", _prose(text_of()).alias("prose"))

    few = rows.where(F.size("terms") <= PATTERN_TERMS)
    words = F.array_distinct(F.regexp_extract_all("prose", F.lit(_terms_pattern(min_letters)), F.lit(0)))
    few = few.withColumn("_spelled", F.filter(words, lambda w: F.array_contains(F.col("terms"), F.lower(w))))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), F.array_join("_spelled", "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    few = few.withColumn("_cut", segments(F.col("prose"), pattern)).select("_pii_doc", "_pii_h", F.explode(spans(F.col("_cut"))).alias("t"))

    many = rows.where(F.size("terms") > PATTERN_TERMS).withColumn("_cut", segments(F.col("prose"), _terms_pattern(min_letters)))
    many = many.select("_pii_doc", "_pii_h", F.explode(spans(F.col("_cut"))).alias("t")).withColumn("_term", F.lower("t.text"))
    mine = own.select(F.col("_pii_h").alias("h"), "term")
    many = many.join(mine, (F.col("_pii_h") == F.col("h")) & (F.col("_term") == F.col("term")), "left_semi").drop("_term")

    found = F.struct(F.lit(4).alias("kind_no"), F.lit(KINDS[4]).alias("kind"), F.col("t.start").alias("start"), F.col("t.end").alias("end"))
    return few.unionByName(many).groupBy("_pii_doc", "_pii_h").agg(F.collect_set(found).alias("found"))


def disclosures(docs: DataFrame, min_letters: int = 1, threshold: float = 0.6) -> DataFrame:
    """doc_id, _pii_hash, base and private: all spans, as arrays of (kind_no, kind, start, end); one row per document."""
    mentions = checkpointed(_mentions(docs, min_letters))
    n = mentions.count()
    pairs, seen = candidate_pairs(mentions, n, threshold)
    pairs = checkpointed(pairs)
    terms = checkpointed(pairs.select("term").distinct())
    # Which of equals are in the list changes what is shuffled, not what is found.
    ruled_out = seen.join(terms, "term", "left_anti").orderBy(F.desc("seen_docs")).limit(COMMON_TERMS).select("term")
    held = checkpointed(holders(docs, terms, ruled_out, min_letters))
    revealing = disclosing_terms(pairs, held, n, threshold).select("term").distinct()
    hits = _term_spans(docs, held, revealing, min_letters)
    rows = mentions.join(hits, F.col("doc_id").eqNullSafe(F.col("_pii_doc")) & (F.col("_pii_hash") == F.col("_pii_h")), "left")
    return rows.select("doc_id", "_pii_hash", "base", F.concat("base", F.coalesce("found", F.array().cast(f"array<{NAMED}>"))).alias("private"))


def sanitise(docs: DataFrame, generalise_terms: bool = True, **options: object) -> DataFrame:
    """The input with text sanitised: entities become [EMAIL], [IP], [CARD] or [PHONE], revealing terms [TERM] or nothing.

    Overlapping spans are replaced once, by what starts first.  Null texts stay null.
    """
    found = disclosures(docs, **options).select(F.col("doc_id").alias("_pii_doc"), F.col("_pii_hash").alias("_pii_h"), F.array_sort(F.transform("private", lambda x: F.struct(x["start"], x["end"], x["kind"]))).alias("_pii_spans")).dropDuplicates(["_pii_doc", "_pii_h"])
    rows = docs.withColumn("_pii_hash", F.xxhash64(text_of())).join(found, F.col("doc_id").eqNullSafe(F.col("_pii_doc")) & (F.col("_pii_hash") == F.col("_pii_h")), "left")
    label = lambda kind: F.when((kind == KINDS[4]) & F.lit(not generalise_terms), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))
    text = F.col("text")
    done = F.aggregate(
        F.col("_pii_spans"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(
            x["start"] >= acc["at"],
            F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), label(x["kind"])).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return rows.select(*(F.coalesce(done, text).alias("text") if c == "text" else F.col(c) for c in docs.columns))


def digest(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, counts per base kind, hash of the base spans, and all spans, by kind and then start; n_base and n_terms."""
    rows = disclosures(docs, **options)
    count = lambda no: F.size(F.filter("base", lambda x: x["kind_no"] == no)).cast("long")
    return rows.select(
        "doc_id",
        *(count(i).alias(f"n_{KINDS[i]}") for i in range(4)),
        F.sha2(joined(F.col("base"), by_kind=True), 256).alias("base_sha256"),
        joined(F.col("private"), by_kind=True).alias("spans"),
        F.size("base").cast("long").alias("n_base"),
        (F.size("private") - F.size("base")).cast("long").alias("n_terms"),
    )
