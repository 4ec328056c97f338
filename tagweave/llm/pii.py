"""Personal data: candidate spans, boosted trees and calibrated thresholds, in DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers by fixed patterns and checks.
Further generators propose spans with high recall, which may overlap each other and base spans: digit
groups, long tokens of letters and digits, written-out addresses, each of any length. Boosted trees score
each by its format and by the text around it, which reaches back to the match before it. Candidates on base
spans and assignments (token = "...") are the positives. An assignment is told by two of the features, so
half of the fitted rows have those hidden, and thresholds are set with them hidden everywhere: the trees
must tell by format what a cue would tell. Per kind, the threshold is the lowest score at which the
candidates of all documents are right often enough, by a histogram of their scores; a kind that never is, or
has no positive, takes the score at which the trees are as sure. A candidate's score is the larger of those
with and without its cues. Spans that pass and overlap no base span are added, the best first, where they
overlap none that is added already. Trees are fitted on the driver from the candidates of SAMPLE documents
and run as expressions.

Positions are code points, end exclusive. Base patterns are rewritten so that each scan is linear in
the text, however long its runs; spans are found from each other by blocks, so that many in one text cost
little more than in many. Null texts are empty; texts without a span give empty strings. Ties
of scores go to the earlier span. Repeated rows are found alike. An empty table gives an empty result.
Columns other than the id and text are ignored, or passed on where rows are rewritten.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents whose candidates the trees are fitted on, at most, and candidates of them.
SAMPLE, SAMPLE_SPANS = 4000, 20000
#: Thresholds are multiples of 1 / STEPS, a power of two so that they are exact.
STEPS = 64
KINDS = ("email", "ip", "card", "phone", "number", "secret", "address")
BASE = KINDS[:4]
#: Stands for a separator inside a run; text that holds it already gets another private character.
MARK, OTHER = "", ""

_LOCAL = f"A-Za-z0-9._%+{MARK}-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@(?=[A-Za-z0-9-]++{MARK})[A-Za-z0-9{MARK}-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"(?<![0-9{MARK}])[0-9](?:{MARK}?[0-9]){{11,18}}(?![0-9{MARK}])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Groups of digits that end before a letter don't count; what has fewer than 7 digits then goes.
NUMBER = r"(?<![0-9A-Za-z])(?=[0-9](?:[ ./-]?[0-9]){6})[0-9]++(?![A-Za-z])(?:[ ./-][0-9]++(?![A-Za-z]))*+"
SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+"
ADDRESS = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++ ?(?:[\[(]dot[\])]|\.) ?[A-Za-z]{2,}+"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Matches summed at once on the way to a match's position; characters of a text that are cut at once.
BLOCK, PIECE = 256, 4096
#: Characters before a candidate that the trees see.
CONTEXT = 24


def bind(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def matches(text: Column, pattern: str, context: bool = False) -> Column:
    """array<struct<start int, end int, s string>>: the pattern's leftmost non-overlapping matches; with context, also the text before and after each.

    A match starts after the texts between matches and the matches so far. Their lengths are summed
    by blocks, then within a block. Whatever a lambda needs is bound, or it would be computed anew for each match.
    """
    more = ", before: string, after: string" if context else ""
    none = F.array().cast(f"array<struct<start:int,end:int,s:string{more.replace(': ', ':').replace(', ', ',')}>>")

    def place(v: Column) -> Column:
        found, between, steps, before = v["found"], v["between"], v["steps"], v["before"]

        def one(s: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = F.get(before, block) + _total(F.slice(steps, block * BLOCK + 1, i - block * BLOCK)) + F.length(F.get(between, i))
            fields = [start.alias("start"), (start + F.length(s)).alias("end"), s.alias("s")]
            if context:
                fields.append(F.right(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(between, i)), F.lit(CONTEXT)).alias("before"))
                fields.append(F.left(F.concat(F.get(between, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), F.lit(1)).alias("after"))
            return F.struct(*fields)

        return F.transform(found, one)

    def with_sums(v: Column) -> Column:
        before = F.transform(v["sums"], lambda _, b: _total(F.slice(v["sums"], F.lit(1), b)))
        return bind(F.struct(v["found"].alias("found"), v["between"].alias("between"), v["steps"].alias("steps"), before.alias("before")), place)

    def with_steps(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v["steps"]) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: _total(F.slice(v["steps"], b * BLOCK + 1, F.lit(BLOCK))))
        return bind(F.struct(v["found"].alias("found"), v["between"].alias("between"), v["steps"].alias("steps"), sums.alias("sums")), with_sums)

    def with_pieces(v: Column) -> Column:
        steps = F.transform(v["found"], lambda s, i: F.length(s) + F.length(F.get(v["between"], i)))
        return bind(F.struct(v["found"].alias("found"), v["between"].alias("between"), steps.alias("steps")), with_steps)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bind(found, lambda m: F.when(F.size(m) == 0, none).otherwise(bind(F.struct(m.alias("found"), F.split(text, pattern, -1).alias("between")), with_pieces)))


def in_blocks(spans: Column, kind: str) -> Column:
    """Spans in order of their starts, of the given struct type, cut to blocks of about the root of their number, each with its lowest start and highest end."""

    def cut(v: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v["spans"]) / v["n"]).cast("int") - 1), lambda b: F.slice(v["spans"], b * v["n"] + 1, v["n"]))
        return F.transform(each, lambda x: F.struct(x[0]["start"].alias("low"), F.array_max(F.transform(x, lambda y: y["end"])).alias("high"), x.alias("spans")))

    none = F.array().cast(f"array<struct<low:int,high:int,spans:array<{kind}>>>")
    n = lambda x: F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(x))).cast("int"))
    return bind(spans, lambda x: F.when(F.size(x) == 0, none).otherwise(bind(F.struct(x.alias("spans"), n(x).alias("n")), cut)))


def overlapped(blocks: Column, c: Column, other=lambda d: F.lit(True)) -> Column:
    """Whether a span in blocks, of those for which other() holds, overlaps c."""
    meets = lambda d: (d["start"] < c["end"]) & (d["end"] > c["start"]) & other(d)
    return F.exists(blocks, lambda b: (b["low"] < c["end"]) & (b["high"] > c["start"]) & F.exists(b["spans"], meets))


def luhn(digits: Column) -> Column:
    def add(sum_: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return sum_ + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _kind(spans: Column, kind: str, *more: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), x["end"].alias("end"), *(x[c].alias(c) for c in ("s", *more))))


@functools.cache
def _base_of_text() -> Column:
    """_base of a row with _text and _has. Made once: the expression is large, and each part of it costs a call to the JVM."""
    digits = lambda s: F.regexp_replace(s, "[^0-9]", "")
    plain = F.translate("_text", MARK, OTHER)
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    chained = F.regexp_replace(plain, r"(?<=[0-9])[ -](?=[0-9])", MARK)
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    email = F.when(F.contains("_text", F.lit("@")), matches(dotted, EMAIL)).otherwise(none)
    ip = F.filter(matches(F.col("_text"), IP), lambda x: x["s"].rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"))
    card = F.filter(matches(chained, CARD), lambda x: luhn(digits(x["s"])))
    phone = F.when(F.contains("_text", F.lit("+")), F.filter(matches(F.col("_text"), PHONE), lambda x: F.length(digits(x["s"])).between(9, 15))).otherwise(none)
    found = {k: F.when(F.col("_has"), x).otherwise(none) if k != "email" else x for k, x in zip(BASE, (email, ip, card, phone), strict=True)}
    return F.array_sort(F.concat(*(_kind(x, k) for k, x in found.items())))


def with_base(docs: DataFrame) -> DataFrame:
    """docs with _text (never null) and _base: array of (start, k, end, s), in order."""
    docs = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn("_has", F.col("_text").rlike("[0-9]")).withColumn("_base", _base_of_text())


_CUES = r"token|key|secret|passw|auth|card|account|acct|iban|ssn|phone|tel|mobile|fax|call|e-?mail|contact"
#: What the trees see of a candidate: its kind, its format, the text before and after it.
FEATURES = ("kind", "length", "digits", "letters", "upper", "separators", "groups", "assigned", "cue", "signed", "opened", "closed", "hex")


@functools.cache
def _candidates_of_text() -> Column:
    """_more of a row with _text, _has and _base."""
    text, around = F.col("_text"), ("before", "after")
    none = F.array().cast("array<struct<start:int,end:int,s:string,before:string,after:string>>")
    number = F.filter(matches(text, NUMBER, context=True), lambda x: F.regexp_count(x["s"], F.lit("[0-9]")) >= 7)
    of = [_kind(F.when(F.col("_has"), x).otherwise(none), k, *around) for k, x in (("number", number), ("secret", matches(text, SECRET, context=True)))]
    of.append(_kind(F.when(text.rlike(r"[\[(]at[\])]"), matches(text, ADDRESS, context=True)).otherwise(none), "address", *around))

    def described(x: Column, blocks: Column) -> Column:
        before, after = F.lower(x["before"]), x["after"]
        count = lambda p: F.regexp_count(x["s"], F.lit(p))
        number = {
            "kind": x["k"],
            "length": x["end"] - x["start"],
            "digits": count("[0-9]"),
            "letters": count("[A-Za-z]"),
            "upper": count("[A-Z]"),
            "separators": count("[^A-Za-z0-9]"),
            "groups": count("[A-Za-z0-9]+"),
            "assigned": before.rlike(r"[=:] ?[\"']?$").cast("int"),
            "cue": before.rlike(_CUES).cast("int"),
            "signed": before.rlike(r"[+(#$€£] ?$").cast("int"),
            "opened": before.rlike(r"(^|\s|[\"'(])$").cast("int"),
            "closed": after.rlike(r"^($|\s|[\"'),.;:!?])").cast("int"),
            "hex": x["s"].rlike("^[0-9a-fA-F]+$").cast("int"),
        }
        return F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), overlapped(blocks, x).alias("base"), F.array(*(number[f].cast("double") for f in FEATURES)).alias("f"))

    plain = F.transform("_base", lambda b: F.struct(b["start"], b["end"]))
    both = F.struct(F.concat(*of).alias("found"), in_blocks(plain, "struct<start:int,end:int>").alias("blocks"))
    return bind(both, lambda v: F.transform(v["found"], lambda x: described(x, v["blocks"])))


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds _more: generated spans with their features, and base: whether a base span overlaps."""
    return docs.withColumn("_more", _candidates_of_text())


@dataclass
class Trees:
    """trees: nested (feature, at most, left, right) or a leaf's value; thresholds: by kind, of the summed score."""

    trees: list = field(default_factory=list)
    start: float = 0.0
    thresholds: dict[int, float] = field(default_factory=dict)

    def table(self, without: tuple[str, ...] = ()) -> Column:
        """array<struct<at, most, leaf>>: each tree filled up to the same depth, its nodes level by level. A node that asks for a feature of without sees 0."""
        deep = lambda node: 0 if isinstance(node, float) else 1 + max(deep(node[2]), deep(node[3]))
        depth = max([1, *map(deep, self.trees)])

        def filled(tree) -> Column:
            level, at, most = [tree], [], []
            for _ in range(depth):
                below = []
                for node in level:
                    j, cut, left, right = (0, math.inf, node, node) if isinstance(node, float) else node
                    if FEATURES[j] in without:
                        j, cut, right = 0, math.inf, (left if cut >= 0 else right)
                        left = right
                    at.append(j)
                    most.append(cut)
                    below += [left, right]
                level = below
            return F.struct(F.array(*map(F.lit, at)).alias("at"), F.array(*map(F.lit, most)).alias("most"), F.array(*map(F.lit, level)).alias("leaf"))

        return F.array(*map(filled, self.trees)) if self.trees else F.array().cast("array<struct<at:array<int>,most:array<double>,leaf:array<double>>>")

    def score(self, f: Column, without: tuple[str, ...] = ()) -> Column:
        """The summed score of a candidate's features: a walk down each tree, so the expression is small however many there are."""

        def leaf(tree: Column) -> Column:
            deep = lambda node: 0 if isinstance(node, float) else 1 + max(deep(node[2]), deep(node[3]))
            levels = F.sequence(F.lit(1), F.lit(max([1, *map(deep, self.trees)])))
            down = lambda i, _: 2 * i + F.when(F.get(f, F.get(tree["at"], i)) <= F.get(tree["most"], i), 1).otherwise(2)
            return bind(F.aggregate(levels, F.lit(0), down), lambda i: F.get(tree["leaf"], i - F.size(tree["at"])))

        return F.aggregate(self.table(without), F.lit(self.start), lambda total, tree: total + leaf(tree))

    def score_rows(self, x: np.ndarray) -> np.ndarray:
        def of(node, rows: np.ndarray, out: np.ndarray) -> None:
            if isinstance(node, float):
                out[rows] += node
            elif len(rows):
                low = x[rows, node[0]] <= node[1]
                of(node[2], rows[low], out)
                of(node[3], rows[~low], out)

        out = np.full(len(x), self.start)
        for tree in self.trees:
            of(tree, np.arange(len(x)), out)
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, penalty: float = 1.0) -> Trees:
    """Gradient boosting of regression trees on the logistic loss, with second-order gains."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(start=math.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[:-1])) for j in range(x.shape[1])]
    z = np.full(len(y), model.start)

    def grow(rows: np.ndarray, left: int):
        g, h = gradient[rows], hessian[rows]
        value = lambda a, b: a * a / (b + penalty)
        best = (1e-6, None)
        for j in range(x.shape[1]) if left else ():
            for cut in cuts[j]:
                low = x[rows, j] <= cut
                if 0 < low.sum() < len(rows):
                    gain = value(g[low].sum(), h[low].sum()) + value(g[~low].sum(), h[~low].sum()) - value(g.sum(), h.sum())
                    if gain > best[0]:
                        best = (gain, (j, float(cut), low))
        if best[1] is None:
            return float(-rate * g.sum() / (h.sum() + penalty))
        j, cut, low = best[1]
        return j, cut, grow(rows[low], left - 1), grow(rows[~low], left - 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        gradient, hessian = p - y, p * (1 - p)
        model.trees.append(grow(np.arange(len(y)), depth))
        z = model.score_rows(x)
    return model


#: Features that tell an assignment, and so a positive.
TELLING = ("assigned", "cue")


def calibrated(model: Trees, docs: DataFrame, precision: float) -> Trees:
    """For each kind, the lowest score from which on the candidates of all docs are right often enough, cues hidden.

    Scores are counted in steps of 1 / STEPS. A kind that never is, or has no positive, gets the score at which the trees
    hold a candidate to be right with probability precision.
    """

    def cell(c: Column) -> Column:
        return F.struct(c["k"].alias("k"), F.floor(model.score(c["f"], TELLING) * STEPS).cast("int").alias("step"), (c["base"] | _assigned(c["f"])).cast("long").alias("right"))

    cells = with_candidates(with_base(docs.select("text"))).select(F.explode_outer(F.transform("_more", cell)).alias("x")).where("x IS NOT NULL")
    counts = cells.groupBy("x.k", "x.step").agg(F.count("*").alias("n"), F.sum("x.right").alias("right")).collect()
    for k in {r.k for r in counts}:
        of = sorted((r for r in counts if r.k == k), key=lambda r: -r.step)
        right, n = np.cumsum([r.right for r in of]), np.cumsum([r.n for r in of])
        good = np.flatnonzero(right >= precision * n)
        model.thresholds[k] = of[good[-1]].step / STEPS if right[-1] and len(good) else math.log(precision / (1 - precision))
    return model


def _assigned(f: Column) -> Column:
    return f[FEATURES.index("assigned")] * f[FEATURES.index("cue")] > 0


def fit(docs: DataFrame, precision: float = 0.9, sample: int = SAMPLE) -> Trees:
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` ids
    # explode() would have Spark test all documents for candidates before the join
    spans = with_candidates(with_base(texts)).select("doc_id", F.explode_outer("_more").alias("x")).where("x IS NOT NULL").select("doc_id", "x.*")
    hide = (F.xxhash64("start", "doc_id", "k") % 2 == 0).alias("hide")
    rows = spans.orderBy(F.xxhash64("doc_id", "start", "k"), "doc_id", "start", "k").limit(SAMPLE_SPANS).select("f", (F.col("base") | _assigned(F.col("f"))).alias("y"), hide).collect()
    x = np.array([r.f for r in rows], float).reshape(len(rows), len(FEATURES))
    x[np.ix_([r.hide for r in rows], [f in TELLING for f in FEATURES])] = 0
    y = np.array([r.y for r in rows] or [0], float)
    model = boost(x, y) if y.min() < y.max() else Trees(start=math.log(999) * (1 if y.max() else -1))
    return calibrated(model, docs, precision)


_SCORED = "struct<z:double,start:int,k:int,end:int>"


def _best(passed: Column) -> Column:
    """Of spans (z, start, k, end), those with the largest z (held negative) that overlap none that is taken. What overlaps nothing is taken at once."""
    none = F.array().cast(f"array<{_SCORED}>")
    free = lambda kept, c: ~F.exists(kept, lambda d: (d["start"] < c["end"]) & (d["end"] > c["start"]))

    def chosen(v: Column) -> Column:
        crowded = lambda c: overlapped(v["blocks"], c, lambda d: (d["start"] != c["start"]) | (d["k"] != c["k"]))
        marked = F.transform(v["passed"], lambda c: F.struct(c.alias("c"), crowded(c).alias("crowded")))

        def split(m: Column) -> Column:
            alone = F.transform(F.filter(m, lambda x: ~x["crowded"]), lambda x: x["c"])
            crowd = F.array_sort(F.transform(F.filter(m, lambda x: x["crowded"]), lambda x: x["c"]))
            return F.concat(alone, F.aggregate(crowd, none, lambda kept, c: F.when(free(kept, c), F.concat(kept, F.array(c))).otherwise(kept)))

        return bind(marked, split)

    in_order = lambda p: F.transform(F.array_sort(F.transform(p, lambda c: F.struct(c["start"], c["k"], c["end"]))), lambda c: F.struct(c["start"], c["k"], c["end"]))
    kind = "struct<start:int,k:int,end:int>"
    return bind(passed, lambda p: F.when(F.size(p) < 2, p).otherwise(bind(F.struct(p.alias("passed"), in_blocks(in_order(p), kind).alias("blocks")), chosen)))


def with_spans(docs: DataFrame, model: Trees) -> DataFrame:
    """docs with _text, _base and _spans: base spans and those that the model adds, in order."""
    found = with_candidates(with_base(docs))
    if not model.thresholds:
        return found.withColumn("_spans", F.transform("_base", lambda b: F.struct(b["start"], b["k"], b["end"]))).drop("_more", "_has")
    open_ = F.filter("_more", lambda c: ~c["base"])
    z = lambda f: F.greatest(model.score(f), model.score(f, TELLING))
    scored = F.transform(open_, lambda c: F.struct((-z(c["f"])).alias("z"), c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end")))
    passed = F.filter(scored, lambda c: -c["z"] >= _case(c["k"], model.thresholds))
    both = F.concat(*(F.transform(a, lambda b: F.struct(b["start"].alias("start"), b["k"].alias("k"), b["end"].alias("end"))) for a in (F.col("_base"), _best(passed))))
    return found.withColumn("_spans", F.array_sort(both)).drop("_more", "_has")


def _case(k: Column, values: dict[int, float]) -> Column:
    out = F.lit(math.inf)
    for key, value in values.items():
        out = F.when(k == key, F.lit(value)).otherwise(out)
    return out


def is_kind(kind: str):
    return lambda span: span["k"] == KINDS.index(kind)


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Characters from start to end of a text in pieces of PIECE characters."""
    a, b = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    inner = F.array_join(F.slice(pieces, a + 2, F.greatest(F.lit(0), b - a - 1)), "")
    parts = F.concat(F.substring(piece(a), start - a * PIECE + 1, F.lit(PIECE)), inner, F.left(piece(b), end - b * PIECE))
    return F.when(a == b, F.substring(piece(a), start - a * PIECE + 1, end - start)).otherwise(parts)


def _tagged(text: Column, spans: Column) -> Column:
    """A text with each of its spans, one at least, replaced by its kind in brackets."""
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    part = lambda a, s: F.struct(a.alias("a"), s["start"].alias("b"), s["k"].alias("k"))
    none = F.array().cast("array<struct<a:int,b:int,k:int>>")

    def step(state: Column, s: Column) -> Column:
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], F.array(part(state["at"], s)))).otherwise(state["out"])
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), out.alias("out"))

    def apart(x: Column) -> Column:
        return F.struct(x[F.size(x) - 1]["end"].alias("at"), F.transform(x, lambda s, i: part(F.coalesce(F.get(x, i - 1)["end"], F.lit(0)), s)).alias("out"))

    def done(v: Column) -> Column:
        kept = F.transform(v["cuts"]["out"], lambda o: F.concat(_cut(v["pieces"], o["a"], o["b"]), F.get(tags, o["k"])))
        return F.concat(F.array_join(kept, ""), _cut(v["pieces"], v["cuts"]["at"], v["n"]))

    meet = lambda x: F.exists(F.transform(x, lambda s, i: s["start"] < F.coalesce(F.get(x, i - 1)["end"], F.lit(0))), lambda y: y)
    cuts = bind(spans, lambda x: F.when(meet(x), F.aggregate(x, F.struct(F.lit(0).alias("at"), none.alias("out")), step)).otherwise(apart(x)))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return bind(F.struct(pieces.alias("pieces"), cuts.alias("cuts"), F.length(text).alias("n")), done)


def redacted(docs: DataFrame, model: Trees) -> DataFrame:
    """The documents, all columns, with each span of text replaced by its kind in brackets. Of overlapping spans the first names the tag."""
    names = docs.columns
    found = with_spans(docs.select(F.struct(*(docs[c] for c in names)).alias("_row"), F.col("text")), model)
    found = found.select("_row", F.size("_spans").alias("_n"), F.when(F.size("_spans") > 0, _tagged(F.col("_text"), F.col("_spans"))).alias("_new"))
    changed = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return found.select(*(F.when(F.col("_n") > 0, changed[c]).otherwise(F.col("_row")[c]).alias(c) if c in changed else F.col("_row")[c].alias(c) for c in names))
