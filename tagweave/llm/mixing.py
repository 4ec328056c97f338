"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A source takes whole epochs of its documents while its target allows, then a weighted sample for the
rest: every document draws an exponential key -ln(u)/quality, where u is a hash of its id (of its text, if it has
none), and the smallest keys win until the budget is spent. The last document taken is cut after a word.

Keys are never sorted over a whole source. A source's keys are cut into buckets by their logarithm, BUCKETS for
each doubling; sums by bucket show in which one the budget ends, and only that one is sorted. The logarithm of an
exponential key lies in any one bucket with a probability of at most ln 2 / (e BUCKETS), 0.1 %, whatever the quality, which
only shifts it. So a source that holds a third of all rows is no longer than others in any task.

Sizes are words; null and empty texts have size 0 and take no words. A null source is a source of
its own, last in order. Ties of keys go by id, size and hash of the text; repeated rows are documents of their own. A
quality that is null counts as 1, and one below 1e-9 as that. An empty
table gives an empty result. Extra columns of documents pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import WORD, materialize

#: Parts into which the keys from one number to its double are cut.
BUCKETS = 256
#: ASCII punctuation and digits.
SYMBOLS = r"[!-@\[-`{-~]"


def text_quality(text: Column) -> Column:
    """In (0, 1]: less the larger the share of symbols and digits."""
    share = F.regexp_count(text, F.lit(SYMBOLS)) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(1.0 / (1.0 + 8.0 * share), F.lit(1.0))


KEYED = ("_mix_size", "_mix_key", "_mix_bucket", "_mix_hash")


def keyed(docs: DataFrame, seed: str = "", quality: Column | None = None) -> DataFrame:
    """docs with each document's size, sampling key, key bucket and hash of the text."""
    text = F.col("text")
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), text, F.lit(""))).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(2**52)
    weight = text_quality(text) if quality is None else F.greatest(F.coalesce(quality, F.lit(1.0)), F.lit(1e-9))
    return (
        docs.withColumn("_mix_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
        .withColumn("_mix_key", -F.log(u) / weight)
        .withColumn("_mix_bucket", F.floor(F.lit(BUCKETS) * F.log2("_mix_key")).cast("int"))
        .withColumn("_mix_hash", F.xxhash64(text))
    )


def bucket_sums(rows: DataFrame) -> DataFrame:
    """The words in each bucket of each source; rows as keyed() gives them."""
    return rows.groupBy("source", "_mix_bucket").agg(F.sum("_mix_size").alias("_size"))


def targets(sums: DataFrame, weights: tuple[int, ...], share: float, most_epochs: int) -> DataFrame:
    """A row for each source: its size and target. A capped source's excess goes to the others by weight.

    Sources in order of most_epochs * size / weight are capped from the front: with the first m
    capped, the rest share what is left; the first m at which none of the rest is above its cap holds.
    """
    ranked = (
        sums.groupBy("source")
        .agg(F.sum("_size").alias("source_size"))
        .withColumn("_at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % len(weights) + 1).cast("int")))
        .withColumn("_cap", most_epochs * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    )
    order = Window.orderBy("_ratio", "_at")
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_weight").over(on)
    filled = ranked.withColumn("_level", level)
    found = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_at", "_level"))).over(Window.partitionBy())
    return filled.withColumn("_water", found["_level"]).select(
        "source", "source_size", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_weight") * F.col("_water"), F.col("_cap").cast("double"))).alias("target")
    )


def budgets(sums: DataFrame, weights: tuple[int, ...], share: float, most_epochs: int) -> DataFrame:
    """targets() with whole epochs, the words beyond them, and the bucket in which those are reached."""
    goal = F.round("target").cast("long")
    per_source = targets(sums, weights, share, most_epochs).withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
    per_source = per_source.withColumn("_rest", goal - F.col("_epochs") * F.col("source_size"))
    order = Window.partitionBy("source").orderBy("_mix_bucket")
    sums = sums.withColumn("_upto", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumnRenamed("source", "_source")
    hit = (
        sums.join(per_source, F.col("_source").eqNullSafe(F.col("source")))
        .where((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_size") < F.col("_rest")))
        .select("_source", F.col("_mix_bucket").alias("_cut"), (F.col("_rest") - (F.col("_upto") - F.col("_size"))).alias("_left"))
    )
    found = per_source.join(hit, F.col("source").eqNullSafe(F.col("_source")), "left")
    return materialize(found.select(F.col("source").alias("_mix_source"), "source_size", "target", "_epochs", F.coalesce("_cut", F.lit(-(2**31))).alias("_cut"), F.coalesce("_left", F.lit(0)).alias("_left")), "budgets", narrow=True)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most_epochs: int = 3) -> DataFrame:
    """docs, as keyed() gives them (materialized, as they are read three times), with source_size, target and taken: words that the mix takes, repeats counted.

    Clashing columns of docs named source_size, target or taken are replaced; mixed_documents() keeps them.
    """
    docs = docs.drop("source_size", "target", "taken")
    rows = docs.join(budgets(bucket_sums(docs), weights, share, most_epochs), F.col("source").eqNullSafe(F.col("_mix_source")))
    order = Window.partitionBy("source").orderBy("_mix_key", "doc_id", "_mix_size", "_mix_hash").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = rows.where(F.col("_mix_bucket") == F.col("_cut")).withColumn("_prior", F.coalesce(F.sum("_mix_size").over(order), F.lit(0)))
    others = rows.where(F.col("_mix_bucket") != F.col("_cut")).withColumn("_prior", F.lit(0).cast("long"))
    size, at = F.col("_mix_size"), F.col("_mix_bucket")
    part = F.when(at < F.col("_cut"), size).when(at == F.col("_cut"), F.greatest(F.lit(0), F.least(size, F.col("_left") - F.col("_prior")))).otherwise(0)
    return others.unionByName(at_cut).withColumn("taken", F.col("_epochs") * size + part).drop("_mix_source", "_epochs", "_cut", "_left", "_prior")


def first_words(text: Column, n: Column) -> Column:
    """A text to the end of its n-th word, with the white space that stands before each."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*+{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, seed: str = "", **how) -> DataFrame:
    """The rows of the mix itself: a document as often as it is taken, the last copy cut to the words that are left."""
    names = docs.columns
    own = docs.select(F.struct(*(docs[c] for c in names)).alias("_row"), "doc_id", "text", "source")
    taken = mix(materialize(keyed(own, seed), "keyed"), **how)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("_mix_size"))))
    copies = taken.where(F.col("taken") > 0).select("_row", "text", "_mix_size", "taken", copy.alias("_copy"))
    words = F.least(F.col("_mix_size"), F.col("taken") - (F.col("_copy") - 1) * F.col("_mix_size"))
    copies = copies.select("_row", F.when(words == F.col("_mix_size"), F.col("text")).otherwise(first_words(F.col("text"), words)).alias("_text"))
    changed = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return copies.select(*(changed[c].alias(c) if c in changed else F.col("_row")[c].alias(c) for c in names))
