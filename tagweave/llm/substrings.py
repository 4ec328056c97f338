"""Substring dedup by prefix-partitioned suffix trees: words covered by a window of WINDOW words that also starts elsewhere.

The windows are the suffixes of all texts, of which only the first WINDOW words matter. Suffixes are
partitioned by prefixes of variable length, so that a group of them fits in memory:

1. A window's prefix is the one of its SEED-word runs with the least hash, wherever in the window it
   stands. Windows that follow each other mostly share it and form a stretch, of which a text has one in
   about fourteen words; equal windows have equal prefixes at equal places. Prefixes are counted over all
   texts. One that occurs once is a leaf, and so are all windows under it; most of the input ends here.
2. Stretches under one prefix that are equal in all their words are one kind. If no kind is alone, all of
   the prefix's windows are repeats, and no tree is needed.
3. The other prefixes branch. Those of up to GROUP kinds are dealt to groups of about TREE stretches. A
   group is one task's work: it sorts the suffixes of its stretches, takes the length of the common prefix
   of each two neighbours, and so has the suffix tree's inner nodes; those of depth WINDOW or more are
   the repeats.
4. A prefix of more kinds is lengthened to the whole window, one of its suffixes each. What shares that
   prefix is a deep node as it stands, whose leaves are counted, combined before they are shuffled, and
   never gathered, however many there are.

So no repeat is missed. Equality of kinds and of lengthened prefixes is that of 128 bits of hashes beside the
prefix's own 64; in trees, that of 64 bits for each word. Copies of a text are one class from the start,
whose windows are all repeated; classes go by 64 bits of a digest, which is salted anew until no
two different digests share them.

Null or empty texts have no words; texts shorter than a window keep all. Rows that repeat are copies
of each other. An empty table gives an empty result. Columns other than the id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm import textkit
from tagweave.llm.common import drop, materialize, prepare

WINDOW, SEED = 35, 8
#: Kinds under one prefix, at most, for a tree; stretches in a group of trees, on average (some 60 MB in memory).
GROUP, TREE = 2000, 6000
_NO_ID = -(2**63)
_OTHER = np.uint64(0x5851F42D4C957F2D)


def text_key(words: list[bytes], salt: int = 0) -> int:
    """A hash of a text's words in order, as a signed 64-bit number."""
    return int.from_bytes(hashlib.sha256(b" ".join([str(salt).encode(), *words])).digest()[:8], "little", signed=True)


def _batches(docs: DataFrame, make, schema: str, *more: str) -> DataFrame:
    """make(state, texts as bytes, ids, *lists of more columns) gives the columns of a batch, for blocks of documents; state lives as long as a task."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), *(b.column(2 + i).to_pylist() for i in range(len(more))), strict=True))
            for block, texts in textkit.blocks(keys, (t.as_py() for t in b.column(1))):
                columns = make(state, texts, *zip(*block, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more).mapInArrow(run, schema)


def _long(values) -> pa.Array:
    return pa.array(values, pa.int64())


def text_classes(docs: DataFrame, salt: int = 0) -> DataFrame:
    """doc_id, hash of the text as it is, key (equal for texts of equal words), n_words and the digest of all words."""

    def make(state, texts, ids, hashes):
        joined = [t.split() for t in texts]
        return [_long(ids), _long(hashes), _long([text_key(x, salt) for x in joined]), _long([len(x) for x in joined]), pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in joined], pa.string())]

    hashed = docs.select("doc_id", "text", F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    return _batches(hashed, make, "doc_id long, text_hash long, key long, n_words long, all_sha256 string", "_hash")


def sound_classes(docs: DataFrame) -> tuple[DataFrame, int]:
    """text_classes() with a salt for which no two different texts share a key, and that salt."""
    salt = 0
    while True:
        documents = materialize(text_classes(docs, salt), "text-classes")
        if documents.groupBy("key").agg(F.min("all_sha256").alias("a"), F.max("all_sha256").alias("b")).where("a != b").isEmpty():
            return documents, salt
        drop(documents)
        salt += 1


def stretches_of(w: textkit.Words, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """For each stretch: its text, its first and last window (place in its text), prefix hash and two hashes of all its words."""
    none = np.empty(0, np.int64)
    n = len(w.hash)
    if n < window:
        return (none,) * 6
    runs = textkit.run_hash(w.hash, seed)
    least = np.empty(n - window + 1, np.int64)
    for i in range(0, len(least), textkit.CHUNK):
        some = runs[i : i + textkit.CHUNK + window - seed]
        least[i : i + textkit.CHUNK] = np.lib.stride_tricks.sliding_window_view(some, window - seed + 1).argmin(axis=1)
    inside = np.flatnonzero(w.of[: n - window + 1] == w.of[window - 1 :])
    if not len(inside):
        return (none,) * 6
    at = inside + least[inside]  # where each window's prefix is
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)]))
    first, last = inside[head], inside[np.append(head[1:], len(inside)) - 1]
    place = (at[head] - first).astype(np.uint64)
    whole = textkit.mixed(textkit.spans_hash(w.hash, first, last + window) + place)
    other = textkit.mixed(textkit.spans_hash(textkit.mixed(w.hash ^ _OTHER), first, last + window) + place)
    text = w.of[first]
    base = w.first[text]
    return text, first - base, last - base, runs[at[head]].view(np.int64), whole.view(np.int64), other.view(np.int64)


def stretches(docs: DataFrame, window: int, seed: int, salt: int = 0) -> DataFrame:
    """prefix, whole, other, key, first, last. A task gives each class of equal texts once, however many copies it reads."""

    def make(state, texts, ids):
        fresh = _fresh(state, texts, salt)
        text, first, last, *hashes = stretches_of(textkit.words([texts[i] for i in fresh]), window, seed)
        key = np.array(list(fresh.values()), np.int64)[text]
        return [*hashes, key, first.astype(np.int32), last.astype(np.int32)]

    return _batches(docs, make, "prefix long, whole long, other long, key long, first int, last int")


def _fresh(state: dict, texts: list[bytes], salt: int, wanted: list[int] | None = None) -> dict[int, int]:
    """Places and keys of texts (with the wanted key) that the task sees for the first time."""
    seen, out = state.setdefault("seen", set()), {}
    for i, t in enumerate(texts):
        key = text_key(t.split(), salt)
        if key not in seen and (wanted is None or key == wanted[i]):
            seen.add(key)
            out[i] = key
    return out


def _with_text(docs: DataFrame, who: DataFrame) -> DataFrame:
    """Rows of who (_doc, _hash, ...) with their documents' texts."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_hash"), F.col("doc_id"), F.col("text"))
    return texts.join(who, ["_doc", "_hash"])


def suffixes(texts: DataFrame, window: int, salt: int = 0) -> DataFrame:
    """The suffixes in parts (array of prefix, first, last, long) of texts with that key.

    A part is a row with its words' hashes; one whose prefix is to be lengthened is a row for each window, with two hashes of it.
    """
    kind = pa.list_(pa.int64())

    def make(state, texts, ids, expected, parts):
        fresh = _fresh(state, texts, salt, expected)
        w = textkit.words([texts[i] for i in fresh])
        rows, lists, places, flat = [], [], [], []
        for n, (i, key) in enumerate(fresh.items()):
            base = w.first[n]
            for p in parts[i]:
                if not p["long"]:
                    rows.append((p["prefix"], key, p["first"]))
                    lists.append(w.hash[base + p["first"] : base + p["last"] + window].view(np.int64))
                    continue
                places.append(np.arange(p["first"], p["last"] + 1))
                flat.append((p["prefix"], key, base, len(places[-1])))
        prefix, key, first = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ((), (), ())))
        counts = [x[3] for x in flat]
        at = np.concatenate(places) if places else np.empty(0, np.int64)
        where = at + np.repeat(np.array([x[2] for x in flat], np.int64), counts)
        hashes = [textkit.spans_hash(h, where, where + window).view(np.int64) if len(where) else np.empty(0, np.int64) for h in ((w.hash, textkit.mixed(w.hash ^ _OTHER)) if len(where) else (None, None))]
        no = pa.nulls(len(rows), pa.int64())
        return [
            np.concatenate([prefix, np.repeat(np.array([x[0] for x in flat], np.int64), counts)]),
            np.concatenate([key, np.repeat(np.array([x[1] for x in flat], np.int64), counts)]),
            np.concatenate([first, at]).astype(np.int32),
            pa.array([*lists, *[None] * len(at)], kind),
            *(pa.concat_arrays([no, pa.array(h)]) for h in hashes),
        ]

    return _batches(texts, make, "prefix long, key long, first int, words array<long>, h long, h2 long", "key", "parts")


def deep_nodes(words: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each list of words, which of its suffixes of window words or more lie under a node of that depth: the tree of all lists' suffixes, as sorted suffixes and common prefixes of neighbours."""
    flat = np.concatenate(words)
    length = np.array([len(x) for x in words])
    count = length - window + 1
    start = np.repeat(np.cumsum(length) - length - np.cumsum(count) + count, count) + np.arange(count.sum())
    rows = np.ascontiguousarray(flat[start[:, None] + np.arange(window)])
    order = np.argsort(rows.view(f"V{8 * window}").ravel(), kind="stable")
    same = rows[order[1:]] == rows[order[:-1]]
    common = np.where(same.all(1), window, same.argmin(1))  # words that a suffix shares with the one before it
    deep = np.zeros(len(order), bool)
    deep[order[1:]] = common >= window
    deep[order[:-1]] |= common >= window
    return np.split(deep, np.cumsum(count)[:-1])


def trees(rows: DataFrame, window: int, groups: int) -> DataFrame:
    """key, first and end of what lies under deep nodes, from rows (prefix, key, first, words), in groups of whole prefixes."""
    schema = pa.schema([("key", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])

    def subtrees(group: pa.Table) -> pa.Table:
        lists = [x.values.to_numpy().view(np.uint64) for c in group["words"].chunks for x in c]
        out = []
        for key, first, deep in zip(group["key"].to_pylist(), group["first"].to_pylist(), deep_nodes(lists, window), strict=True):
            edge = np.flatnonzero(np.diff(deep, prepend=False, append=False)).reshape(-1, 2)
            out += [(key, first + a, first + b - 1 + window) for a, b in edge.tolist()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), schema.types, strict=True)], schema=schema)

    tree = F.pmod(F.xxhash64("prefix"), F.lit(groups)).alias("tree")
    return rows.select(tree, "key", "first", "words").groupBy("tree").applyInArrow(subtrees, "key long, first int, end int")


def cut_texts(texts: DataFrame, with_text: bool, salt: int = 0) -> DataFrame:
    """key, n_removed and the digest of kept words (and those words), for texts with repeats (array of first, end)."""

    def make(state, texts, ids, expected, parts):
        removed, digests, kept, keys = [], [], [], []
        for i, key in _fresh(state, texts, salt, expected).items():
            found = texts[i].split()
            edge = np.zeros(len(found) + 1, np.int64)
            np.add.at(edge, [s["first"] for s in parts[i]], 1)
            np.add.at(edge, [s["end"] for s in parts[i]], -1)
            covered = np.cumsum(edge[:-1]) > 0
            left = b" ".join([x for x, c in zip(found, covered.tolist(), strict=True) if not c])
            keys.append(key)
            removed.append(int(covered.sum()))
            digests.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode())
        return [_long(keys), _long(removed), pa.array(digests, pa.string()), *([pa.array(kept, pa.string())] if with_text else [])]

    return _batches(texts, make, "key long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text, "key", "parts")


def repeats(docs: DataFrame, classes: DataFrame, salt: int, window: int, seed: int, group: int, tree: int) -> DataFrame:
    """key, first and end (places of words) of all that is repeated; the spans of a text may overlap."""
    rows = materialize(stretches(docs, window, seed, salt), "stretches")
    twice = materialize(rows.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix"), "prefixes")
    live = materialize(rows.join(twice, "prefix"), "live")
    drop(rows, twice)
    kinds = materialize(live.groupBy("prefix", "whole", "other").agg(F.count("*").alias("times"), F.min(F.struct("key", "first", "last")).alias("one")), "kinds")
    alike = materialize(live.join(kinds.where("times > 1").select("prefix", "whole", "other"), ["prefix", "whole", "other"]).select("key", "first", (F.col("last") + window).alias("end")), "alike")
    drop(live)
    branching = kinds.groupBy("prefix").agg(F.count("*").alias("kinds"), F.min("times").alias("fewest")).where("fewest = 1")
    branching = materialize(branching.select("prefix", (F.col("kinds") > group).alias("long")), "branching")
    opened = kinds.join(branching, "prefix").select("one.key", F.struct("prefix", "one.first", "one.last", "long").alias("part"))
    to_open = opened.groupBy("key").agg(F.collect_list("part").alias("parts")).join(classes, "key").select("_doc", "_hash", "key", "parts")
    found = materialize(suffixes(_with_text(docs, to_open), window, salt), "suffixes")
    drop(kinds, branching)
    short, windows = found.where("words IS NOT NULL"), found.where("words IS NULL").select("prefix", "key", "first", "h", "h2")
    within = materialize(trees(short, window, max(1, -(-short.count() // tree))), "nodes")
    counted = materialize(windows.groupBy("prefix", "h", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "deep")
    deep = materialize(windows.join(counted, ["prefix", "h", "h2"]).select("key", "first", (F.col("first") + window).alias("end")), "leaves")
    drop(found, counted)
    return alike.union(within).union(deep)


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, with_text: bool = False, group: int = GROUP, tree: int = TREE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each document; with_text adds the kept words (null: all are)."""
    documents, salt = sound_classes(docs)
    who = F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_doc"), F.col("text_hash").alias("_hash"))).alias("who")
    classes = materialize(documents.groupBy("key").agg(F.count("*").alias("copies"), who).select("key", "copies", "who.*"), "key-classes", narrow=True)
    parts = repeats(docs, classes, salt, window, seed, group, tree).groupBy("key").agg(F.collect_list(F.struct("first", "end")).alias("parts"))
    single = classes.where("copies = 1").join(parts, "key").select("_doc", "_hash", "key", "parts")
    done = cut_texts(_with_text(docs, single), with_text, salt)
    of_class = classes.select("key", "copies").join(done, "key", "left")
    out = documents.join(of_class, "key", "left")
    gone = (F.col("copies") > 1) & (F.col("n_words") >= window)
    columns = [
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return out.select("doc_id", "n_words", *columns)
