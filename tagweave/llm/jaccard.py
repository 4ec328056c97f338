"""N-gram Jaccard join by PartEnum signatures, and the components that its links form.

A document's set holds the hashes of its distinct word shingles. Sets of similar size share a size
band; every set takes part in its own band and the next, so that all pairs whose sizes allow the
wanted similarity meet in the band of the larger. There the similarity bounds the sets' symmetric
difference by k. The shingle domain is hashed to parts, more than k / 2 of them, and each part to
SUBPARTS subparts. Two such sets differ in at most one shingle in some part, so there they agree on
one of the part's subsets of SUBPARTS - 1 subparts at least. Every subset is enumerated, and its
content is one signature.

Subsets of fewer than `thick` shingles give no signature, since texts that share a passage alone would
agree on those. A set is safe if more of its parts are thick throughout than can differ in two
shingles; two sets of which either is safe share a signature. A set that is not takes part in another
partition of the domain, and so on for SEEDS partitions; one that is safe in none also emits the first
shingles of its sorted set (prefix filter), by which two such sets meet. So no linked pair is missed.

Sets that are equal are one class from the start, so copies cost nothing. Pairs with a common
signature are checked exactly on the sets: first, in every signature's group, the member that meets
most others anywhere with each other member, which is linear and links copies to what they were
copied from; then, once those links have been closed to components, only pairs
that are still in different components and whose parity sketches allow the similarity. A signature
of many classes is compared in blocks of BLOCK classes. all_links() leaves no pair out.

Null or empty texts have no set, size 0, and are a component of their own. A text with fewer words
than a shingle is one shingle. Repeated rows link like copies. An empty table gives an empty result.
Columns other than the id and text are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm import textkit
from tagweave.llm.common import drop, materialize, prepare

#: Rows of two or three numbers that are broadcast at most (some 25 MB in memory).
MOST_BROADCAST = 500_000
#: Edges that one task joins to components at most (some 200 MB in memory); more are joined in rounds over all tasks.
MOST_IN_A_TASK = 1_000_000
#: Second-level parts of a part, of which all but one make a signature; partitions of the domain that are tried.
SUBPARTS, SEEDS = 3, 3
#: Classes of one signature that a task compares with the others.
BLOCK = 2000
_NO_ID = -(2**63)
SKETCH = [f"s{i}" for i in range(16)]
WIDE = 4096


class Bands:
    """Size bands for a similarity of at least num / den, and the parts to which each band hashes shingles."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low, lows, highs = 1, [], []
        while low < 2**40:
            lows.append(low)
            highs.append(low * den // num)
            low = highs[-1] + 1
        self.low, self.high = np.array(lows), np.array(highs)
        self.differing = self.most_differing(self.high, self.high)
        self.parts = np.where(self.differing > 0, self.differing // 2 + 1 + self.differing // 14, 0)
        subset = (SUBPARTS - 1) / SUBPARTS * (self.low + self.high) / 2 / np.maximum(self.parts, 1)
        self.thick = np.select([subset >= 7, subset >= 3.5], [3, 2], 1)

    def most_differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of similar sets of sizes a and b."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    w = textkit.words(texts, lower=True)
    at, run = w.runs(n)
    edge = np.searchsorted(at, w.first)
    out = []
    for i in range(len(texts)):
        count = w.first[i + 1] - w.first[i]
        if count >= n:
            out.append(np.unique(run[edge[i] : edge[i + 1]]))
        else:
            out.append(textkit.run_hash(w.hash[w.first[i] : w.first[i + 1]], int(count)) if count else np.empty(0, np.uint64))
    return out


def fingerprint(shingles: np.ndarray) -> int:
    """A hash of a sorted set, as a signed 64-bit number."""
    return int(textkit.run_hash(shingles, len(shingles)).view(np.int64)[0]) if len(shingles) else 0


def enumerated(sets: list[np.ndarray], band: np.ndarray, bands: Bands, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets in one partition of the domain, the set that each belongs to, and for each set its parts with a thin subset."""
    size, parts = np.array([len(s) for s in sets]), bands.parts[band]
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    first = np.concatenate([[0], np.cumsum(parts)])
    salt = textkit.mixed(band.astype(np.uint64) + np.uint64((seed + 1) << 32))
    scattered = textkit.mixed(flat ^ salt[of])
    part = (scattered >> np.uint64(32)) % parts[of].astype(np.uint64)
    slot = (first[of] + part.astype(np.int64)) * SUBPARTS + (scattered % np.uint64(SUBPARTS)).astype(np.int64)
    content = np.zeros(first[-1] * SUBPARTS, np.uint64)
    np.add.at(content, slot, scattered)
    content, count = content.reshape(-1, SUBPARTS), np.bincount(slot, minlength=len(content)).reshape(-1, SUBPARTS)
    owner = np.repeat(np.arange(len(sets)), parts)
    held = count.sum(1, keepdims=True) - count >= bands.thick[band[owner]][:, None]
    number = ((np.arange(first[-1]) - first[owner])[:, None] * SUBPARTS + np.arange(SUBPARTS)).astype(np.uint64)
    sigs = textkit.mixed(content.sum(1, keepdims=True, dtype=np.uint64) - content + textkit.mixed(number ^ salt[owner][:, None]))
    return sigs[held], np.repeat(owner, SUBPARTS).reshape(-1, SUBPARTS)[held], np.bincount(owner[~held.all(1)], minlength=len(sets))


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and the set that each belongs to."""
    size = np.array([len(s) for s in sets])
    sigs, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for step in (0, 1):
        band = bands.of(np.maximum(size, 1)) + step
        partner = np.minimum(bands.high[band], size * bands.den // bands.num)
        most = bands.most_differing(size, partner) // 2  # parts that may differ in two shingles
        left = np.flatnonzero((size > 0) & (bands.parts[band] > 0))
        for seed in range(SEEDS):
            if len(left):
                found, of, thin = enumerated([sets[i] for i in left], band[left], bands, seed)
                sigs.append(found)
                owners.append(left[of])
                left = left[thin >= bands.parts[band[left]] - most[left]]
        for i in left:
            head = sets[i][: size[i] + (-size[i] * bands.num // bands.den) + 1]
            sigs.append(textkit.mixed(head + textkit.mixed(np.uint64([band[i]]))))
            owners.append(np.full(len(head), i))
    return np.concatenate(sigs), np.concatenate(owners)


def _over_texts(docs: DataFrame, make, schema: str, *more: str) -> DataFrame:
    """make(state, texts as bytes, ids, *more columns) gives a batch's columns, for blocks of documents; state lives as long as a task."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), *(b.column(2 + i).to_pylist() for i in range(len(more))), strict=True))
            for block, texts in textkit.blocks(keys, (x.as_py() for x in b.column(1))):
                columns = make(state, texts, *zip(*block, strict=True))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more).mapInArrow(run, schema)


def text_hash() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Each bit's parity among the shingles that hash to it, 64 bits a number. Two sets' sketches differ in no more bits than the sets in shingles."""
    odd = [np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64) for s in sets]
    return np.array(odd, np.int64).reshape(-1, bits // 64)


def classes_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, hash of the text, set size, set fingerprint (0: no set) and sketch of each document."""

    def make(state, texts, ids, hashes):
        sets = shingle_sets(texts, n)
        sketch = sketches(sets, 64 * len(SKETCH))
        return [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), *(sketch[:, i] for i in range(len(SKETCH)))]

    hashed = docs.select("doc_id", "text", text_hash().alias("_hash"))
    return _over_texts(hashed, make, "doc_id long, text_hash long, n_shingles long, fp long, " + ", ".join(f"{c} long" for c in SKETCH), "_hash")


def signature_rows(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """sig and fp. A task gives each class of equal sets once, however many copies it reads."""
    bands = Bands(num, den)

    def make(state, texts, ids):
        seen = state.setdefault("seen", set())
        fresh = {}
        for s in shingle_sets(texts, n):
            if (fp := fingerprint(s)) not in seen:
                seen.add(fp)
                fresh[fp] = s
        if not fresh:
            return [np.empty(0, np.int64), np.empty(0, np.int64)]
        sigs, owners = signatures(list(fresh.values()), bands)
        return [sigs.view(np.int64), np.array(list(fresh), np.int64)[owners]]

    return _over_texts(docs, make, "sig long, fp long")


def sets_of(docs: DataFrame, members: DataFrame, n: int, wide: bool = False) -> DataFrame:
    """fp, size n and set of members (fp, _who, _text), from the text of document _who whose hash is _text; or, if wide, a sketch of WIDE bits for the set."""
    texts = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_who"), text_hash().alias("_text"))

    def make(state, texts, ids, expected):
        seen = state.setdefault("seen", set())
        fresh = [i for i, fp in enumerate(expected) if not (fp in seen or seen.add(fp))]
        found = [(expected[i], s) for i, s in zip(fresh, shingle_sets([texts[i] for i in fresh], n), strict=True) if fingerprint(s) == expected[i]]
        given = sketches([s for _, s in found], WIDE) if wide else [s.view(np.int64) for _, s in found]
        return [pa.array([fp for fp, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array(list(given), pa.list_(pa.int64()))]

    return _over_texts(texts.join(few(members.select("_who", "_text", "fp")), ["_who", "_text"]), make, "fp long, n long, shingles array<long>", "fp")


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to one for each node that isn't the smallest of its component: the node and that smallest."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((top(x), top(y)))
            up[high] = low
    nodes = [x for x in up if top(x) != x]
    for i in range(0, len(nodes), 1 << 16):
        some = nodes[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([up[x] for x in some], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, most_in_a_task: int = MOST_IN_A_TASK) -> DataFrame:
    """node and root (the smallest node) for each node of edges (a, b).

    Up to most_in_a_task edges go to one task. More are made forests in each task and then joined by alternating
    large and small stars.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges", narrow=True)
    count = edges.count()
    if count <= most_in_a_task:
        found = materialize(edges.coalesce(1).mapInArrow(forest, "a long, b long"), "forest")
        drop(edges)
        return found.select(F.col("a").alias("node"), F.col("b").alias("root"))
    own = materialize(edges.mapInArrow(forest, "a long, b long").distinct(), "edges", narrow=True)
    drop(edges)
    edges, before = own, None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        lowest = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = large.join(lowest, F.col("a") == F.col("u"))
        small = joined.select("a", F.col("m").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))
        after = materialize(small.where("a != b").distinct(), "edges", narrow=True)
        drop(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few enough rows of a few numbers; else Spark shuffles."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _compared(pairs: DataFrame, lists: DataFrame, good) -> DataFrame:
    """The pairs (a, b) for which good(size of a, of b, list of a, of b) holds."""
    left = lists.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("la"))
    right = lists.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("lb"))
    return pairs.join(left, "a").join(right, "b").where(good(F.col("na"), F.col("nb"), F.col("la"), F.col("lb"))).select("a", "b")


def _checked(pairs: DataFrame, docs: DataFrame, members: DataFrame, wide: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: first by wide sketches, then exactly."""

    def by_sketch(na, nb, la, lb):
        bits = F.aggregate(F.zip_with(la, lb, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
        return bits * (den + num) <= (den - num) * (na + nb)

    def by_set(na, nb, la, lb):
        both = F.size(F.array_intersect(la, lb))
        return den * both >= num * (na + nb - both)

    likely = materialize(_compared(pairs, wide, by_sketch), "likely", narrow=True)
    needed = likely.select(F.col("a").alias("fp")).union(likely.select(F.col("b").alias("fp"))).distinct()
    needed = materialize(members.select("fp", "_who", "_text").join(needed, "fp", "left_semi"), "needed", narrow=True)
    sets = materialize(sets_of(docs, needed, n), "sets")
    out = materialize(_compared(likely, sets, by_set), "links", narrow=True)
    drop(likely, needed, sets)
    return out


def _similar_sketches(num: int, den: int):
    """Whether sizes and sketches of rows x and y allow the similarity: sketches differ in at most as many bits as the sets in shingles."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    bits = reduce(operator.add, [F.bit_count(x(c).bitwiseXOR(y(c))) for c in SKETCH])
    sizes = den * F.least(x("n"), y("n")) >= num * F.greatest(x("n"), y("n"))
    return sizes & (bits * (den + num) <= (den - num) * (x("n") + y("n")))


def meeting(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """sig and fp of the classes of each signature that more than one class has. Of signatures that the same classes have, one stands for all."""
    rows = signature_rows(docs, n, num, den).repartition("sig")
    shared = rows.groupBy("sig").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high").select("sig")
    every = materialize(rows.join(shared.hint("shuffle_hash"), "sig").select("sig", "fp").distinct(), "every")
    held = every.groupBy("sig").agg(F.bit_xor(F.xxhash64("fp")).alias("who"), F.sum(F.xxhash64("fp", F.lit(1)).cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n"))
    met = materialize(every.join(held.groupBy("who", "sum", "n").agg(F.min("sig").alias("sig")), "sig").select("sig", "fp"), "met")
    drop(every)
    return met


def _pairs(opened: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of rows (sig, fp, n, root, sketch) with one signature, in different components, whose sizes and sketches allow the similarity."""
    sizes = opened.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = opened.join(sizes, "sig")
    x = placed.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).alias("x")
    y = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    across = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.root") != F.col("y.root")) & _similar_sketches(num, den)
    return x.join(y, across).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def linked(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, text_hash, n_shingles and fp of each document; links (a, b) between the fps of classes.

    The links are enough to connect every pair of classes that the join links; a pair in one component
    may be left unchecked. With every, all pairs are checked.
    """
    documents = materialize(classes_of(docs, n), "classes")
    met = meeting(docs, n, num, den)
    who = F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_who"), F.col("text_hash").alias("_text"))).alias("who")
    classes = documents.where("fp != 0").groupBy("fp").agg(who, F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in SKETCH)).select("fp", "who.*", "n", *SKETCH)
    members = materialize(classes.join(met.select("fp").distinct(), "fp", "left_semi"), "members", narrow=True)
    wide = materialize(sets_of(docs, members, n, wide=True), "wide")
    described = members.select("fp", "n", *SKETCH)

    if every:
        pairs = materialize(_pairs(met.join(described, "fp").withColumn("root", F.col("fp")), num, den), "pairs", narrow=True)
        links = _checked(pairs, docs, members, wide, n, num, den)
        drop(met, members, wide, pairs)
        return documents, links

    meets = met.join(met.groupBy("sig").agg(F.count("*").alias("met")), "sig").groupBy("fp").agg(F.sum("met").alias("meets"))
    hubs = met.join(meets, "fp").groupBy("sig").agg(F.max(F.struct("meets", "fp"))["fp"].alias("hub"))
    ends = met.join(hubs, "sig").where("fp != hub").select("hub", "fp").distinct().alias("p")
    stars = ends.join(described.alias("x"), F.col("p.hub") == F.col("x.fp")).join(described.alias("y"), F.col("p.fp") == F.col("y.fp"))
    stars = materialize(stars.where(_similar_sketches(num, den)).select(F.col("p.hub").alias("a"), F.col("p.fp").alias("b")), "stars", narrow=True)
    first = _checked(stars, docs, members, wide, n, num, den)

    roots = components(first)
    placed = met.join(described, "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = placed.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("sig")
    opened = materialize(placed.join(mixed, "sig", "left_semi").select("sig", "fp", "n", "root", *SKETCH), "opened")
    pairs = materialize(_pairs(opened, num, den).join(stars, ["a", "b"], "left_anti"), "pairs", narrow=True)
    second = _checked(pairs, docs, members, wide, n, num, den)
    links = materialize(first.union(second), "links", narrow=True)
    drop(met, members, wide, stars, first, opened, pairs, second)
    return documents, links


def all_links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """The whole join. Membership: doc_id, n_shingles, class_id and n_links, the other documents that a document is linked with, copies included. Pairs: class_a, class_b."""
    documents, links = linked(docs, n, num, den, every=True)
    classes = materialize(documents.where("fp != 0").groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "link-classes", narrow=True)
    other = classes.select(F.col("fp").alias("b"), "copies")
    near = links.select("a", "b").union(links.select("b", "a")).join(other, "b").groupBy("a").agg(F.sum("copies").alias("near"))
    sized = classes.join(near, F.col("fp") == F.col("a"), "left").select("fp", "class_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    members = documents.select("doc_id", "n_shingles", "fp").join(sized, "fp", "left")
    members = members.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    of = lambda c: classes.select(F.col("fp").alias(c), F.col("class_id").alias(f"class_{c}"))
    return members, links.join(of("a"), "a").join(of("b"), "b").select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"))


def _classes(documents: DataFrame, links: DataFrame) -> DataFrame:
    """fp, class_id and component_id of each class."""
    roots = components(links)
    lowest = documents.where("fp != 0").groupBy("fp").agg(F.min("doc_id").alias("class_id"))
    classes = lowest.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    found = materialize(classes, "roots", narrow=True)
    drop(links)
    tops = found.groupBy("root").agg(F.min("class_id").alias("component_id"))
    return found.join(tops, "root").select("fp", "root", "class_id", "component_id")


def join_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Each document with its set's size, its class's id and the smallest doc_id that its links reach."""
    documents, links = linked(docs, n, num, den)
    out = documents.join(_classes(documents, links).drop("root"), "fp", "left")
    alone = F.when(F.col("fp") == 0, F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", alone).alias("component_id"), F.coalesce("class_id", alone).alias("class_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each component the row with the smallest doc_id (then hash of the text; null ids last), and all rows without words.

    Of rows equal in id and text, one stays.
    """
    documents, links = linked(docs, n, num, den)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    rows = documents.join(_classes(documents, links).select("fp", "root"), "fp").select("root", F.struct(F.col("doc_id").isNull().alias("no_id"), key.alias("_id"), "text_hash").alias("row"))
    first = rows.groupBy("root").agg(F.min("row").alias("first"))
    other = materialize(rows.join(first, "root").where("row != first").select("row._id", "row.text_hash").distinct(), "not-kept", narrow=True)
    again = materialize(documents.groupBy(key.alias("_id"), "text_hash").agg(F.count("*").alias("n"), F.max("fp").alias("fp")).where("n > 1 AND fp != 0").select("_id", "text_hash"), "repeated", narrow=True)
    id_, hash_ = F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)), F.xxhash64(docs["text"].cast("string"))
    at = lambda right: (id_ == right["_id"]) & (hash_ == right["text_hash"])
    other, again = few(other), few(again)
    kept = docs.join(other, at(other), "left_anti")
    return kept.join(again, at(again), "left_anti").unionByName(kept.join(again, at(again), "left_semi").dropDuplicates(["doc_id", "text"]))
