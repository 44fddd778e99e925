"""Mixing sources to target weights: Efraimidis-Spirakis keys, complete epochs first, then a fractional epoch.

Every document gets an exponential key -ln(u) / quality, u from a hash of its id and the seed.  A source's budget is
spent on whole epochs (each takes every document once) and what is left on documents in key order: their sizes are
prefix-summed and the document on the budget's edge is taken in part, so that a source takes its target to the word.

Prefix sums are two-level, so that no task gets a whole source however large it is: keys are cut into ranges of their
logarithm, bucket totals are prefix-summed (some ten thousand rows per source), and rows are ordered only within one
(source, bucket).  A quality weight only shifts the logarithm, so no bucket holds more than some 0.15 % of the documents of
one quality, whatever the qualities are.

Edge cases: a null text has size 0; a null source is a source of its own, sorted last; an empty table gives no rows;
rows with equal doc_id tie on the key and are ordered by size and text hash, so equal rows are interchangeable; a source
whose documents are all empty has target 0.  Columns of the input other than doc_id, text and source are left out of the
plan unless `keep` names them; results never clash with them, as work columns start with `_mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import checkpointed, text_of, word_count

#: Weights dealt to sources in code point order, repeating.
WEIGHTS = (5, 2, 1)


def quality_weight(text: Column, size: Column) -> Column:
    """In (0, 1]: one more than the words, over that plus the markup symbols."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return (F.lit(1.0) + size) / (F.lit(1.0) + size + symbols)


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    token = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(token), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """One row per source: source, source_size, target.

    The total of all sizes times `share` is split by weight; a target stops at `most` times its source's size and the
    excess is reshared by weight.  That is water filling: sources in order of cap / weight are capped as long as the
    level that the rest would get exceeds theirs.  Works on one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("_mix_rows").alias("_mix_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("_mix_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int")))
    per = per.withColumn("_mix_cap", F.lit(float(most)) * F.col("source_size")).withColumn("_mix_level", F.col("_mix_cap") / F.col("_mix_w"))
    every = Window.orderBy("_mix_level", F.col("source").asc_nulls_last())
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = (
        per.withColumn("_mix_cap_before", F.coalesce(F.sum("_mix_cap").over(before), F.lit(0.0)))
        .withColumn("_mix_w_before", F.coalesce(F.sum("_mix_w").over(before), F.lit(0.0)))
        .withColumn("_mix_budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("_mix_w_all", F.sum("_mix_w").over(whole))
        .withColumn("_mix_fill", (F.col("_mix_budget") - F.col("_mix_cap_before")) / (F.col("_mix_w_all") - F.col("_mix_w_before")))
        # Every source below the first uncapped one is capped; the level is the fill at that source.
        .withColumn("_mix_level_all", F.min(F.when(F.col("_mix_fill") <= F.col("_mix_level"), F.struct("_mix_level", "_mix_fill"))).over(whole)["_mix_fill"])
    )
    target = F.least(F.col("_mix_cap"), F.coalesce(F.col("_mix_level_all") * F.col("_mix_w"), F.col("_mix_cap")))
    return per.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = 3.0, seed: int = 7, per_fold: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (complete ones), taken (words, repeats counted), and `keep`."""
    text = text_of()
    sized = docs.select("doc_id", "source", *(F.col(c).alias(f"_mix_keep_{c}") for c in keep), F.xxhash64(text).alias("_mix_hash"), text.alias("_mix_text"))
    sized = sized.withColumn("size", word_count(F.col("_mix_text"))).withColumn("_mix_quality", quality_weight(F.col("_mix_text"), F.col("size"))).drop("_mix_text")
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.col("_mix_quality")
    sized = sized.withColumn("_mix_key", key)
    # A key is over 0, so its logarithm is never null; a bucket that could be null would be computed once more to filter it.
    sized = sized.withColumn("_mix_bucket", F.coalesce(F.floor(F.log(F.col("_mix_key")) * per_fold).cast("int"), F.lit(0)))
    if not keep:
        # Read by the totals and by the rows: without texts it is small enough to be written once.
        sized = checkpointed(sized)
    totals = sized.groupBy("source", "_mix_bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("_mix_rows"))
    goal = targets(totals, weights, share, most)
    earlier = Window.partitionBy("source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("source", "_mix_bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("_mix_base"))
    plan = base.join(goal.withColumnRenamed("source", "_mix_source"), F.col("source").eqNullSafe(F.col("_mix_source")), "inner").drop("_mix_source")
    plan = plan.select(F.col("source").alias("_mix_source"), F.col("_mix_bucket").alias("_mix_b"), "_mix_base", "source_size", "target")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_bucket") == F.col("_mix_b")), "inner")
    within = Window.partitionBy("source", "_mix_bucket").orderBy("_mix_key", "doc_id", "size", "_mix_hash").rowsBetween(Window.unboundedPreceding, -1)
    goal_words = F.floor(F.col("target") + 0.5)
    rows = rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(goal_words / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    left = goal_words - F.col("epochs") * F.col("source_size")
    ahead = F.col("_mix_base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - ahead))
    return rows.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long")).select(
        "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "epochs", "taken", *(F.col(f"_mix_keep_{c}").alias(c) for c in keep)
    )
