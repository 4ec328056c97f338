"""Document fingerprints by SpotSigs, in DataFrame functions only.

A spot signature is an anchor and the chain of the next CHAIN content words after it: anchors
are common words of several languages, and content words are the others. A document's fingerprint is the
set of its hashed signatures, which follow its running text and little else. Two fingerprints are
compared by Jaccard similarity of the sets. Where only similar pairs are wanted (similar_pairs()), sets are partitioned by
size, so that only neighbouring partitions can hold partners, and a set's signatures are met from the
one that fewest sets have on, for as long as a partner can still be similar enough.

Where FREE words in a row hold no anchor, the first counts as one, so other languages and lists have
signatures too. A text without any takes every word as an anchor, and a text of CHAIN words or fewer
is one signature of all its words. Null and
empty texts have an empty fingerprint; two of those are alike (1), one is unlike anything else (0).
Equal texts have equal fingerprints. Documents go by id, null first, then by text. Repeated rows are
documents of their own. An empty table gives an empty result. Columns other than the id and text are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import materialize

#: Content words in a chain; words without an anchor among them at whose first a chain may start anyway.
CHAIN, FREE = 2, 8
#: Bytes of text in a range of ids, and ranges at most.
RANGE_BYTES, MOST_RANGES = 2 << 20, 1 << 16
#: Common words that open a chain. Fixed values.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which will with "
    "au aux ce ces dans de des du elle en est et il je la le les leur ne nous on ou par pas plus pour qui que se ses son sur un une vous "
    "aus bei das dass dem den der die durch ein eine einer es für ich ist mit nicht sich sie sind und von war wir wird zu zum "
    "al con del el ella los las lo más no o para pero por su sus también y"
).split()
_W = r"[\p{L}\p{N}]+"


def either(words: list[str]) -> str:
    """A pattern for any of the words, which parts where their letters do, so that few are tried at a place."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by.setdefault(w[:1], []).append(w[1:])
    parts = [head + (either(rest) if any(rest) else "") for head, rest in by.items() if head]
    out = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return f"(?:{out})?" if "" in by else out


def signatures(text: Column) -> Column:
    """array<long>: the sorted hashes of a text's spot signatures.

    Words in lower case stand between single spaces, anchors with a stroke before them. A pattern reads each run of
    anchors and looks ahead to the words that follow it; anchors in between are then dropped, and each anchor
    of the run opens the chain that is left.
    """
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    plain = F.regexp_replace(plain, "^ +| +$", " ")
    marked = F.regexp_replace(plain, rf"(?<= )({either(ANCHORS)})(?= )", "|$1")
    run = rf"\|{_W}(?: \|{_W})*+"
    spot = rf"(?=({run}(?:(?: \|{_W})*+ {_W}){{{CHAIN}}}) ){run}"

    def opened(c: Column) -> Column:
        content = F.regexp_replace(c, rf"\|{_W} ", "")
        anchors = F.regexp_extract_all(F.regexp_extract(c, rf"^{run}", 0), F.lit(_W), F.lit(0))
        many = bind(content, lambda words: F.transform(anchors, lambda a: F.concat(a, F.lit(" "), words)))
        return F.when(F.instr(F.substring(c, F.lit(2), F.length(c)), "|") == 0, F.array(F.substring(c, F.lit(2), F.length(c)))).otherwise(many)

    anchored = F.flatten(F.transform(F.regexp_extract_all(marked, F.lit(spot), F.lit(1)), opened))
    free = F.regexp_extract_all(marked, F.lit(rf"(?<= )(?=({_W}(?: {_W}){{{CHAIN}}})(?: {_W}){{{FREE - CHAIN - 1}}} )"), F.lit(1))
    each = F.regexp_extract_all(plain, F.lit(rf"(?<= )(?=({_W}(?: {_W}){{{CHAIN}}}) )"), F.lit(1))
    words = F.trim(plain)
    whole = F.when(words != "", F.array(words)).otherwise(F.array().cast("array<string>"))
    hashed = lambda chains: F.array_sort(F.array_distinct(F.transform(chains, lambda c: F.xxhash64(c))))
    return bind(F.concat(anchored, free), lambda found: hashed(F.when(F.size(found) > 0, found).otherwise(F.when(F.size(each) > 0, each).otherwise(whole))))


def bind(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def printed(hashes: Column) -> Column:
    """A fingerprint as text: sixteen hexadecimal digits a signature."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _part(doc_id: Column, bounds: list[float]) -> Column:
    """How many bounds lie under the id: first by blocks of bounds, then within a block."""
    if not bounds:
        return F.lit(0)
    side = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    under = lambda values: F.size(F.filter(values, lambda b: b < doc_id))
    block = under(F.array(*(F.lit(b[-1]) for b in blocks)))
    inside = F.coalesce(under(F.get(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), block)), F.lit(0))
    return block * side + F.greatest(inside, F.lit(0))


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text (never null) and its signatures, with next_text and next_signatures: those of the next document, after the last of the first.

    Ids are cut to ranges of about range_bytes at quantiles, so texts are shuffled once; the next document comes by a window
    within the range, and for a range's last one it is the head of the next range. Rows of one id, or without any, are in one range.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = min(MOST_RANGES, max(1, (docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // range_bytes))
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    docs = docs.withColumn("_part", _part(F.col("doc_id"), bounds))
    order = Window.partitionBy("_part").orderBy("doc_id", "text")
    rows = docs.repartition("_part").withColumn("signatures", signatures(F.col("text")))
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_signatures", F.lead("signatures").over(order))

    lowest = docs.groupBy("_part").agg(F.min(F.struct("doc_id"))["doc_id"].alias("_lowest"))
    ring = Window.orderBy("_part")  # a row a range
    lowest = lowest.withColumn("_of", F.coalesce(F.lag("_part").over(ring), F.max("_part").over(Window.partitionBy())))
    head = docs.join(F.broadcast(lowest.drop("_part")), F.col("doc_id").eqNullSafe(F.col("_lowest")))  # a row a range
    head = head.groupBy("_of").agg(F.min("text").alias("_head")).withColumn("_head_signatures", signatures(F.col("_head")))
    last = F.col("next_text").isNull()
    found = rows.join(head, rows["_part"] == head["_of"], "left")
    return found.select("doc_id", "text", "signatures", F.when(last, F.col("_head")).otherwise(F.col("next_text")).alias("next_text"), F.when(last, F.col("_head_signatures")).otherwise(F.col("next_signatures")).alias("next_signatures"))


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last quarter (in code points, rounded down) replaced by as much of the next text's beginning."""
    tail = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - tail), F.substring(next_text, F.lit(1), tail))


#: Sets that share a signature and are compared by one task.
BLOCK = 2000


def similar_pairs(docs: DataFrame, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Near copies: class_id of each document (equal fingerprints), and pairs (a, b, likeness) of classes alike by at least num / den.

    class_id is the smallest doc_id; a class without any has null. Sets are partitioned by size so that partners lie in the same
    or the next partition, and meet by the first signatures of each set, rarest among all classes first: as many as a
    partner must share one of. Sizes prune before sets are compared, and a signature of many sets is met in blocks.
    """
    sets = docs.select("doc_id", signatures(F.col("text")).alias("sigs"))
    sets = materialize(sets.withColumn("_key", F.sha2(printed(F.col("sigs")).cast("binary"), 256)), "spot-sets")
    classes = materialize(sets.groupBy("_key").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs")), "spots")
    members = sets.select("doc_id", "_key").join(classes.select("_key", "class_id"), "_key").select("doc_id", "class_id")
    each = classes.where(F.size("sigs") > 0).select("_key", F.size("sigs").alias("n"), F.explode("sigs").alias("h"))
    common = each.groupBy("h").agg(F.count("*").alias("sets")).where("sets > 1")
    rank = F.row_number().over(Window.partitionBy("_key").orderBy("sets", "h"))
    band = F.floor(F.log("n") / math.log(den / num)).cast("int")
    # signatures of one set only can't be shared, but take their places in the order
    ranked = each.join(common, "h", "left").withColumn("sets", F.coalesce("sets", F.lit(1))).withColumn("rank", rank)
    own = materialize(ranked.where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1) & (F.col("sets") > 1)).select("_key", "n", band.alias("band"), "h"), "spot-prefixes")
    blocks = own.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    held = own.join(blocks, "h")
    x = held.withColumn("block", F.pmod(F.xxhash64("_key"), F.col("blocks")).cast("int")).alias("x")
    y = held.withColumn("band", F.explode(F.array("band", F.col("band") + 1))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    at = (F.col("x.h") == F.col("y.h")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.block") == F.col("y.block")) & (F.col("x._key") != F.col("y._key")) & (F.col("y.n") * den >= num * F.col("x.n")) & (F.col("x.n") * den >= num * F.col("y.n"))
    pairs = x.join(y, at).select(F.least("x._key", "y._key").alias("ka"), F.greatest("x._key", "y._key").alias("kb")).distinct()
    left, right = (classes.select(F.col("_key").alias(f"k{c}"), F.col("class_id").alias(c), F.col("sigs").alias(f"s{c}")) for c in "ab")
    alike = pairs.join(left, "ka").join(right, "kb").withColumn("likeness", likeness(F.col("sa"), F.col("sb"))).where(F.col("likeness") * den >= num)
    return members, alike.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
