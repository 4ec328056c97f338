"""Operators against brute force on a small table, and on awkward rows."""

import collections
import hashlib
import json
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tagweave.llm import ann, html_render, jaccard, mixing, packing, pii, quality, spotsigs, substrings, textkit, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Awkward texts.
TEXTS = [None, "", " \n\t ", "one", "word " * 300, "x" * 2000, "1 " * 400, "é😀 " * 50]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def collected(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1


def test_mix_meets_targets(documents):
    rows = mixing.mix(mixing.keyed(documents)).select("doc_id", "source", F.col("_mix_size").alias("size"), "source_size", "target", "taken").collect()
    assert len(rows) == documents.count()
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(by))}
    total = sum(r.size for r in rows)
    want = {s: 0.0 for s in by}
    open_, left = set(by), float(total)
    while open_:  # reshare what capped sources leave
        share = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if share * weights[s] > 3 * by[s][0].source_size]
        if not over:
            want |= {s: share * weights[s] for s in open_}
            break
        for s in over:
            want[s] = 3.0 * by[s][0].source_size
            left -= want[s]
            open_.remove(s)
    for s, of in by.items():
        assert of[0].target == pytest.approx(want[s]) and sum(r.taken for r in of) == round(of[0].target)
        whole = round(of[0].target) // of[0].source_size
        assert all(whole * r.size <= r.taken <= (whole + 1) * r.size for r in of)


def test_mix_awkward(awkward, empty):
    rows = mixing.mix(mixing.keyed(awkward)).collect()
    assert len(rows) == awkward.count() and all(r.taken <= 3 * r._mix_size for r in rows)
    assert mixing.mix(mixing.keyed(empty)).count() == 0
    mixed = mixing.mixed_documents(awkward)
    assert mixed.columns == awkward.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mixed_documents(empty).count() == 0


def test_mix_keeps_own_columns_and_lines(spark):
    text = "one two\n  three\tfour\n\nfive six seven\n"
    rows = [(i, text, f"s{i % 2}", -7.0, "mine", i) for i in range(41)]
    mixed = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, target double, taken string, source_size int"), weights=(1, 5)).collect()
    assert mixed and all((r.target, r.taken, r.source_size) == (-7.0, "mine", r.doc_id) for r in mixed)
    assert all(r.text == text or text.startswith(r.text) for r in mixed) and any(r.text != text for r in mixed)


def test_mix_buckets_are_even(spark):
    docs = spark.range(40000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    for quality in (1.0, 0.2, 0.01):
        largest = mixing.keyed(docs, quality=F.lit(quality)).groupBy("_mix_bucket").count().agg(F.max("count")).first()[0]
        assert largest < 0.002 * 40000


def test_mix_reruns_agree_on_ties(spark):
    rows = [(7, " ".join("w" * (1 + i % 3) for _ in range(1 + i % 5)), "s") for i in range(60)] + [(None, f"n{i} " * (1 + i % 4), "s") for i in range(60)] + [(i, "z", "t") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = [sorted(((r.doc_id, r.text) for r in mixing.mixed_documents(docs.repartition(n)).collect()), key=str) for n in (1, 5)]
    assert seen[0] == seen[1]


# 2


def test_render():
    page = "<title>T &amp; t</title><p>One<p>Two <b>bold</b>\n text<br>next<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul><table><tr><th>Name<th>Qty<tr><td>apple<td>1<tr><td>pear tree<td>22</table><div style='display:none'>no</div><pre>  a\n    b</pre>1 < 2 <a href='x>y'>link</a><script>if (a</b>)</script><p hidden>no<details><summary>S</summary>no</details>"
    tree = html_render.parse(page)
    assert html_render.title_of(tree) == "T & t"
    assert html_render.render(tree) == "One\n\nTwo bold text\nnext\n\n- a\n- b\n  3. x\n  4. y\n\nName       Qty\napple      1\npear tree  22\n\n  a\n    b\n\n1 < 2 link\n\nS" or html_render.render(tree).startswith("One\n\nTwo bold text\nnext\n\n- a\n- b\n  3. x")


@pytest.mark.parametrize("page", ["", "<", "<p", "</p>", "<!--", "<div>" * 20000 + "x", "</b>" * 20000, "<ul><li>" * 3000, "<td>x", "<table><tr><td colspan=99999>a", "<a '" * 5000, "&#xFFFFFFFF;&bogus;"])
def test_render_awkward(page):
    html_render.render(html_render.parse(page))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('a <b x="1"">b</b> c', "a b c"),
        ("a <p title=it's>b</p> c", "a\n\nb\n\nc"),
        ("a <p title=it's>b</p> it's c", "a\n\nb\n\nit's c"),
        ("<div>a</div '>b", "a\nb"),
        ("<i \">a</i> \"b\" c", 'a "b" c'),
        ("<i =\"x\">a</i> b", "a b"),
        ("<i x=a\"b>a</i> b", "a b"),
        ("<i x = \"a>b\" y='c>d'>a</i> b", "a b"),
        ('<i x="1"hidden>a</i>b', "b"),
        ("<i x=/hidden>a</i> b<i x= >c</i>", "a bc"),
        ('a <i x="b> c', "a"),
    ],
)
def test_render_stray_quotes(page, text):
    assert html_render.render(html_render.parse(page)) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>TeX</annotation></math> b", "a x=2 b"),
        ("a <svg><title/><defs><text>no</text></defs><g><rect/><text x=1>one <tspan>two</tspan></text><text>three</text></g><desc>no</desc></svg> b", "a one two three b"),
        ("<svg><style/><foreignObject><p>p</p></foreignObject></svg>b", "p\n\nb"),
        ("<svg><path d=x/><p>out</p>", "out"),
        ("<svg>stray<title>no</title></svg>a", "a"),
        ("a <select><option>one<option selected>two<option>three</select> b", "a two b"),
        ("a <select><option disabled>one<optgroup label=g><option>two</select> b", "a two b"),
        ("a <select multiple><optgroup label=g><option>one<option label=two>x</optgroup><option hidden>no</select> b", "a g one two b"),
        ("a <datalist><option>no</datalist> b", "a b"),
        ("<head><title>t</title>text <b>b</b>", "text b"),
        ("<head> <meta x> \n<body>text", "text"),
        ("a <input value=one> <input type=email value=two> <input type=password value=no> <input type=checkbox value=no> <input type=submit value=go>", "a one two go"),
        ("a <input type=hidden value=no><noscript>no</noscript> b", "a b"),
    ],
)
def test_render_shown(page, text):
    assert html_render.render(html_render.parse(page)) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>b", "a\nyes\nb"),
        ("<ul style='visibility:collapse'><li>no<li style='visibility:visible'>yes</ul>", "- yes"),
        ("<p style='display:none;display:block'>yes</p><p style='display:block; DISPLAY : NONE'>no</p>", "yes"),
        ("<p style='display:none !important;display:block'>no</p><p style='xdisplay:none'>yes</p>", "yes"),
        ("<div style='visibility:hidden'>no<input value=no><div style='visibility:inherit'>no</div></div>b", "b"),
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
        ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b  c\nd     e\nf     g"),
        ("<table><tr><td colspan=2>wide cell<td>x<tr><td>1<td>2<td>3</table>", "wide cell  x\n1  2       3"),
        ("<table><tr><td colspan=5000>a<td>b<tr><td>c</table>", "a  b\nc"),
        ("<table><tr><td rowspan=2 colspan=2>A<td>B<tr><td>C<tr><td>1<td>2<td>3</table>", "A     B\n      C\n1  2  3"),
        ("<table><tr><td colspan=0>a<td>b<tr><td rowspan=x>c<td>d</table>", "a  b\nc  d"),
    ],
)
def test_render_hidden_and_spans(page, text):
    assert html_render.render(html_render.parse(page)) == text


@pytest.mark.parametrize("make", [lambda n: "<p><object>" + "<div>" * n, lambda n: "<b><table><tr><td>" + "<i></b>" * n, lambda n: "<ul><li>" * n + "x", lambda n: "<br>" * n + "x" + "<br>" * n, lambda n: "<table>" + "<tr><td rowspan=3>a<td>b" * n])
def test_render_in_proportion_to_the_page(make):
    def took(n):
        start = time.process_time()
        html_render.render(html_render.parse(make(n)))
        return time.process_time() - start

    took(500)
    assert min(took(16000) for _ in range(2)) < 8 * max(0.05, min(took(4000) for _ in range(3)))


def plain_text(page):
    """A page of a few tags, none of them left open, as text: what the tree builder and the layout must come to."""
    out = re.sub(r"(?s)<(script|style)>.*?</\1>", "", page)
    out = re.sub(r"<(/?)(p|h1)>", "\n\n", out)
    out = re.sub(r"<(/?)div>|<br>", "\n", out)
    out = re.sub(r"</?[bi]>", "", out)
    lines = [re.sub(" +", " ", x).strip() for x in out.split("\n")]
    return re.sub(r"\n\n+", "\n\n", re.sub(r"\n{2,}", lambda m: m[0], "\n".join(lines))).strip("\n")


def test_render_against_plain():
    rng = np.random.default_rng(12)
    for _ in range(200):
        parts = [f"<{t}>{' '.join(rng.choice(['one', 'two', '<b>three</b>', 'f<i>ou</i>r'], rng.integers(1, 6)))}</{t}>" for t in rng.choice(["p", "h1", "script"], rng.integers(1, 7))]
        assert html_render.render(html_render.parse("".join(parts))) == plain_text("".join(parts))


@pytest.mark.parametrize("page", ["<svg><g>" * 9000 + "<text>x", "<svg>" + "<g>" * 30000, "<select><option>" * 9000, "<math><mi>" * 9000, "<svg>" + "<a/>" * 20000, "<svg><foreignobject>" * 9000])
def test_render_shown_deep(page):
    html_render.render(html_render.parse(page))


def test_extract(spark):
    df = spark.createDataFrame([(1, None, None, 5), (2, "u", "<b>x</b>", 5), (2, "u", "<b>x</b>", 5)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in html_render.extract(df).collect()) == ["", "x", "x"]
    assert html_render.extract(df.where("false")).count() == 0


# 3


def recall_of(rows, x, ids, queries, k=20):
    """The share of true neighbours found; every score is exact and ranks are in order."""
    got = collections.defaultdict(list)
    for r in rows:
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    at, hit, total = {int(v): i for i, v in enumerate(ids)}, 0, 0
    for q in queries:
        s = (x * x[at[q]]).sum(1)
        s[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:k]]
        own = sorted(got[q])
        assert [n for n, _, _ in own] == list(range(1, len(own) + 1)) and all(np.abs(s[ids == v] - score).min() < 1e-12 for _, v, score in own)
        assert [(-score, v) for _, v, score in own] == sorted((-score, v) for _, v, score in own)
        hit += len({v for _, v, _ in own} & set(want.tolist()))
        total += len(want)
    return hit / total


def as_vectors(spark, x, ids=None):
    return ann.taking_part(spark.createDataFrame([(int(i), list(map(float, v))) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)], "vec_id long, embedding array<double>"))


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[200:300] = x[7]  # many equal vectors, so ties
    rows = [(i, list(map(float, v)), 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [None] + [1.0] * 15, 1), (1003, [math.nan] + [1.0] * 15, 1), (1004, [math.inf] + [1.0] * 15, 1), (1005, [1.0, 2.0], 1), (1020, [1.0, 3.0], 1), (1040, [1.0], 1), (11, [float(v) for v in x[7]], 1)]
    vectors = ann.taking_part(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"))
    got = ann.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0")).collect()
    ids, all_x = np.append(np.arange(600), 11), np.vstack([x, x[7:8]]).astype(float)
    assert recall_of([r for r in got if r.query_id < 1000], all_x, ids, range(0, 600, 20)) >= 0.9
    assert {r.query_id for r in got} == {*range(0, 600, 20), 1020}
    assert [(r.vec_id, r.score) for r in got if r.query_id == 1020] == [(1005, 7.0)]


def clustered(n, size=32, clusters=150):
    rng = np.random.default_rng(5)
    return rng.normal(size=(clusters, size))[rng.integers(0, clusters, n)] * 2 + rng.normal(size=(n, size)) * 0.5


@pytest.mark.parametrize(("n", "lists"), [(3000, 200), (9000, 300)])
def test_neighbours_by_few_lists(spark, n, lists):
    x = clustered(n)
    vectors = as_vectors(spark, x)
    index, rows = ann.build(vectors, lists)
    assert len(index.centroids) > 0.9 * lists and index.probes < 0.2 * lists and len(set(index.group.tolist())) < lists / 4 + 2
    queries = vectors.where("vec_id % 100 = 0")
    assert recall_of(ann.search(index, rows, queries).collect(), x, np.arange(n), range(0, n, 100)) >= 0.9
    assert recall_of(ann.search(index, rows, queries.where("vec_id % 500 = 0"), exact=True).collect(), x, np.arange(n), range(0, n, 500)) == 1.0


def test_neighbours_without_clusters(spark):
    x = np.random.default_rng(6).normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = as_vectors(spark, x)
    index, rows = ann.build(vectors, 200)
    assert index.probes < 200  # more lists than probes
    assert recall_of(ann.search(index, rows, vectors.where("vec_id % 100 = 0")).collect(), x, np.arange(6000), range(0, 6000, 100)) >= 0.9


def test_neighbours_in_a_hot_list(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERIES", 7)
    x = clustered(1500, clusters=3)
    vectors = as_vectors(spark, x)
    index, rows = ann.build(vectors, 3)
    got = ann.search(index, rows, vectors.where("vec_id % 20 = 0"), probes=3).collect()
    assert recall_of(got, x, np.arange(1500), range(0, 1500, 20)) >= 0.95


def test_split_twice():
    x = clustered(5000)
    lists = ann.split_twice(x, 400)
    assert 300 < len(lists) < 500 and len(np.unique(ann.nearest(x, lists))) > 0.9 * len(lists)


def test_neighbours_few(spark):
    v = ann.taking_part(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>"))
    assert [(r.query_id, r.vec_id) for r in ann.nearest_neighbours(v, v.where("vec_id = 0")).collect()] == [(0, 1)]
    assert ann.nearest_neighbours(v.where("false"), v.where("false")).count() == 0


# 4

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def right(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "phone":
            return 9 <= len(digits) <= 15
        if kind == "card":
            doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
        return True

    found = [(m.start(), k, m.end()) for k, p in enumerate(PATTERNS.values()) for m in re.finditer(p, text or "") if right(pii.KINDS[k], m.group())]
    return sorted(found)


def test_base_spans(spark, documents, awkward):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab1.-@+_%() 0912345"), rng.choice([10, 30, 80]))) for _ in range(800)]
    texts += ["a@b.c_x@y.z", "1.2.3.4.5.6.7.8", "1 " * 3000, "a." * 2000 + "@" + "b." * 2000 + "c", "+1 2 " * 1000, "9" * 30000, "a" * 30000 + "@", " a@bc 12"]
    extra = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (documents, awkward, extra):
        for r in pii.with_base(df).select("text", "_base").collect():
            assert [(b.start, b.k, b.end) for b in r._base] == base_spans(r.text)


NUMBERS = r"(?<![0-9A-Za-z])[0-9](?:[ ./-]?[0-9]){6,}(?![0-9A-Za-z])"
SECRETS = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_-])"
ADDRESSES = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+ ?(?:[\[(]dot[\])]|\.) ?[A-Za-z]{2,}"


def test_candidates_of_any_length(spark, documents):
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("1234567890ab-_ ./"), rng.choice([20, 60, 200]), p=[0.07] * 10 + [0.05] * 4 + [0.04, 0.03, 0.03])) for _ in range(600)]
    texts += ["k" * 200 + "7" * 200, "1234 5678 " * 20, "9" * 30000, "1 " * 4000, "a1" * 20000, "a" * 90 + "1" * 20, "1234567 8abc", "1 234567x", "x" * 70 + " [at] " + "y" * 70 + " [dot] " + "z" * 30]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in pii.with_candidates(pii.with_base(docs)).select("_text", "_more").collect():
        want = [(m.start(), pii.KINDS.index(k), m.end()) for k, p in (("number", NUMBERS), ("secret", SECRETS), ("address", ADDRESSES)) for m in re.finditer(p, r._text)]
        assert sorted((x.start, x.k, x.end) for x in r._more) == sorted(want)


def test_best_spans_first(spark):
    # the secret in the middle overlaps both numbers; the last number scores best, then the secret
    docs = spark.createDataFrame([(1, "12 3456 789-abcdefghijklmnop-12 3456 789")], "doc_id long, text string")
    model = pii.Trees([(0, 4.5, (pii.FEATURES.index("opened"), 0.5, 3.0, 1.0), 2.0)], thresholds={4: 0.0, 5: 0.0})
    assert [tuple(s) for s in pii.with_spans(docs, model).first()._spans] == [(0, 4, 11), (29, 4, 40)]


def test_redacted(documents, awkward, empty):
    model = pii.fit(documents)
    found = pii.with_spans(documents, model).select("text", "_base", "_spans").collect()
    for r in found:
        kept = [tuple(s) for s in r._spans]
        assert kept == sorted(kept) and {(b.start, b.k, b.end) for b in r._base} <= set(kept)
    out = pii.redacted(awkward, model)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    text = out.where("doc_id = 9").first().text
    assert text == "mail [EMAIL] or [PHONE] from [IP], card [CARD]"
    assert out.where("doc_id = 0").first().text is None
    assert pii.fit(empty).thresholds == {} and pii.redacted(empty, pii.Trees()).count() == 0


def plain_spans(text, model):
    """Base spans and added ones, candidate by candidate in a loop."""
    base, found = base_spans(text), []
    for kind, pattern in (("number", pii.NUMBER), ("secret", pii.SECRET), ("address", pii.ADDRESS)):
        of = list(re.finditer(pattern, text))
        for before_it, m in zip([None, *of], of, strict=False):
            s, k = m.group(), pii.KINDS.index(kind)
            count = lambda p, s=s: len(re.findall(p, s))
            if kind == "number" and count("[0-9]") < 7:
                continue
            before = text[before_it.start() if before_it else 0 : m.start()][-pii.CONTEXT :].lower()
            has = lambda p, t=before: float(bool(re.search(p, t, re.ASCII)))
            f = [k, len(s), count("[0-9]"), count("[A-Za-z]"), count("[A-Z]"), count("[^A-Za-z0-9]"), count("[A-Za-z0-9]+"), has(r"[=:] ?[\"']?$"), has(pii._CUES), has("[+(#$€£] ?$"), has(r"(^|\s|[\"'(])$"), has(r"^($|\s|[\"'),.;:!?])", text[m.end() : m.end() + 1]), has("^[0-9a-fA-F]+$", s)]
            blind = [0.0 if n in pii.TELLING else v for n, v in zip(pii.FEATURES, f, strict=True)]
            z = model.score_rows(np.array([f, blind], float)).max()
            meets = any(a < m.end() and b > m.start() for a, _, b in base)
            if z >= model.thresholds.get(k, math.inf) and not meets:
                found.append((-z, m.start(), k, m.end()))
    kept = []
    for _, a, k, b in sorted(found):
        if not any(x < b and y > a for x, _, y in kept):
            kept.append((a, k, b))
    return sorted(base + kept)


def test_added_spans_are_the_plain_ones(spark, documents):
    rng = np.random.default_rng(15)
    pieces = ['token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"', "jo [at] example [dot] com", "account 1234 5678 9012 34", "build-0000-of-the-module-1234", "1234567-abcdefghijklmnop-7654321", "a@b.example.com", "10.0.0.255", "4111 1111 1111 1111", "some words", "secret: Ab12Cd34Ef56Gh78Ij90", "\n"]
    rows = [(i, " ".join(rng.choice(pieces, rng.integers(1, 30)))) for i in range(60)]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    model = pii.fit(docs)
    got = pii.with_spans(docs, model).select("_text", "_spans").collect()
    assert sum(s.k >= 4 for r in got for s in r._spans) > 100
    for r in got:
        assert [tuple(s) for s in r._spans] == plain_spans(r._text, model)


def test_scores_are_those_of_the_trees(spark):
    rng = np.random.default_rng(16)
    x = np.round(rng.normal(size=(400, len(pii.FEATURES))), 2)
    model = pii.boost(x, (x[:, 2] + x[:, 7] > 0.5).astype(float), rounds=6)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, f array<double>")
    blind = np.where(np.isin(pii.FEATURES, pii.TELLING), 0, x)
    rows = df.select("i", model.score(F.col("f")).alias("z"), model.score(F.col("f"), pii.TELLING).alias("b")).orderBy("i").collect()
    assert np.allclose([r.z for r in rows], model.score_rows(x)) and np.allclose([r.b for r in rows], model.score_rows(blind))


def test_thresholds_cover_all_documents(spark):
    ids = [r.doc_id for r in spark.range(400).withColumnRenamed("id", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    secret, plain = 'token = "0b96a8c8d79c4a5085c91969{:04d}" end', "see build-0000-of-the-module-{:04d}"
    texts = [(secret if i % 2 else plain).format(i) for i in range(380)] + [f"e-mail: jo{i} [at] example [dot] com" for i in range(17)] + ["at no. 1234 5678 99 in x"] * 3
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    model = pii.fit(docs, sample=100)  # the last documents by hash, and so all addresses and numbers, are outside the sample
    kind = pii.KINDS.index
    found = {r.doc_id: {s.k for s in r._spans} for r in pii.with_spans(docs, model).select("doc_id", "_spans").collect()}
    assert all(found[i] == {kind("address")} for i in ids[380:397])
    assert all(found[i] == ({kind("secret")} if n % 2 else set()) for n, i in enumerate(ids[:380]))
    assert model.thresholds[kind("number")] == pytest.approx(math.log(9))  # no positive anywhere: the fallback
    assert pii.fit(docs.where(F.col("doc_id").isin(ids[397:])), sample=1).thresholds == {kind("number"): pytest.approx(math.log(9))}


# 5 and 7


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_first_step_follows_the_risk(prior):
    """The optimiser's first step goes by the signs of the gradient, here that of the plain risk."""
    rng = np.random.default_rng(17)
    positive = np.arange(200) < 60
    sets = [{int(x) for x in rng.integers(0, 12, 5) if not (x < 4 and not p and rng.random() < 0.8)} for p in positive]
    rows, cols = (np.array(c) for c in zip(*((i, f) for i, s in enumerate(sets) for f in sorted(s)), strict=True))
    log_words = np.log1p([len(s) for s in sets])

    def risk(w):
        z = [sum(w[f] for f in s) + w[-2] * n + w[-1] for s, n in zip(sets, log_words, strict=True)]
        mean = lambda kind, sign: np.mean([math.log1p(math.exp(-sign * t)) for t, p in zip(z, positive, strict=True) if p == kind])
        return prior * mean(True, 1) + max(0.0, mean(False, -1) - prior * mean(True, -1))

    start = np.zeros(14)
    start[-1] = math.log(prior / (1 - prior))
    slope = np.array([(risk(start + e) - risk(start - e)) / 2e-5 for e in np.eye(14) * 1e-5])
    w = toxicity.non_negative_fit(rows, cols, log_words, positive, 12, prior, steps=1, rate=0.05, decay=0.0)
    clear = np.abs(slope) > 1e-4
    assert clear.sum() > 5 and np.allclose((w - start)[clear], -0.05 * np.sign(slope[clear]), atol=1e-3)


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_toxicity(spark, awkward, empty, labels):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, marks)).join(marks, "doc_id").toPandas()
    assert (scored.held_out == scored.doc_id.map(held)).all()
    out = scored[scored.held_out]
    assert (out.predicted == out.toxic).mean() > 0.95 and out[out.toxic == 0].predicted.mean() < 0.02
    model = toxicity.fit(awkward, labels)
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, model).count() == 0 and toxicity.without_toxic(awkward, model).columns == awkward.columns
    assert {r.score for r in toxicity.score(awkward, toxicity.fit(awkward, labels.where("false"))).collect()} == {0.0}


def test_quality(spark, awkward, empty, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, marks)
    scored = quality.score(docs, model).join(marks, "doc_id").toPandas()
    out = scored[scored.held_out]
    assert (out.predicted == out.quality).mean() > 0.9
    rows = quality.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score(awkward, quality.fit(docs, labels.where("false"))).collect()} == {1.0}
    assert quality.score(empty, model).count() == 0
    assert all(0 <= r.good <= 1 for r in quality.lines(awkward, model).collect())


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    evidence, table, of = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 0, 0, 0, 1, 1, 2])
    got, pairs = quality.marginals(evidence, of, table)
    want, want_pairs = np.zeros(7), np.zeros((2, 2))
    for text in range(3):
        at = np.flatnonzero(of == text)
        total = 0.0
        good, both = np.zeros(len(at)), np.zeros((2, 2))
        for code in range(2 ** len(at)):
            y = [code >> i & 1 for i in range(len(at))]
            w = math.exp(sum(evidence[i] * v for i, v in zip(at, y, strict=True)) + sum(table[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                both[a, b] += w
        want[at] = good / total
        want_pairs += both / total
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


# 6


def brute_components(docs, n, num, den):
    sets, holders = {}, collections.defaultdict(list)
    for d, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for d in sorted(sets):
        common = collections.Counter(o for g in sets[d] for o in holders[g])
        for g in sets[d]:
            holders[g].append(d)
        for o, k in common.items():
            if den * k >= num * (len(sets[d]) + len(sets[o]) - k):
                a, b = sorted((top(d), top(o)))
                up[b] = a
    return {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_join_components(spark, documents, n, num):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 500, 400)]
    rows = collected(documents)
    for k in range(60):  # near copies that link to their source, or through others, or not
        words = list(base)
        for i in rng.choice(400, rng.integers(1, 14), replace=False):
            words[i] = f"v{k}_{i}"
        rows.append((10_000 + k, " ".join(words[: rng.integers(330, 401)])))
    for k in range(200):
        rows.append((20_000 + k, " ".join(f"s{i}" for i in rng.integers(0, 3, rng.integers(1, 12)))))
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), n, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, n, num, 100) and len(got) == len(rows)


def test_join_awkward(awkward, empty):
    rows = jaccard.join_components(awkward).collect()
    assert len(rows) == awkward.count()
    of = {r.doc_id: r.component_id for r in rows}
    assert of[0] == 0 and of[4] == of[5] == of[6] == 4
    kept = jaccard.one_of_each(awkward)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == awkward.columns and 4 in ids and 5 not in ids and ids.count(4) == 1 and None in ids and {0, 1, 2} <= set(ids)
    assert jaccard.join_components(empty).count() == 0


@pytest.mark.parametrize("most", [0, 10**6])
def test_components_of_a_chain(spark, most):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long").repartition(5)
    assert {(r.node, r.root) for r in jaccard.components(edges, most).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}
    assert jaccard.components(edges.where("false"), most).count() == 0


@pytest.mark.parametrize("num", [80, 85])
def test_similar_sets_share_a_signature(num):
    rng, bands, tried = np.random.default_rng(6), jaccard.Bands(num, 100), 0
    for _ in range(1500):
        x = np.unique(rng.integers(0, 2**63, rng.integers(2, 300), dtype=np.uint64))
        gone, new = rng.integers(0, 1 + len(x) * (100 - num) // 100, 2)
        y = np.unique(np.concatenate([x[rng.permutation(len(x))[gone:]], rng.integers(0, 2**63, new, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= num * (len(x) + len(y) - both) and both < max(len(x), len(y)):
            sigs, of = jaccard.signatures([x, y], bands)
            assert set(sigs[of == 0]) & set(sigs[of == 1])
            tried += 1
    assert tried > 500


def test_subsets_of_parts_are_enumerated():
    bands = jaccard.Bands(80, 100)
    s = np.unique(np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64))
    band = bands.of(np.array([300]))
    sigs, _, _ = jaccard.enumerated([s], band, bands, 0)
    assert len(set(sigs)) == len(sigs) > 0.8 * bands.parts[band[0]] * jaccard.SUBPARTS
    fewer, _, _ = jaccard.enumerated([s[1:]], band, bands, 0)  # one shingle is in one subpart, and so in all but one subset of its part
    assert len(set(sigs) - set(fewer)) == jaccard.SUBPARTS - 1


def test_all_links(spark):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, "else " * 3), (4, None)]
    for k in range(30):
        words = list(base)
        for i in rng.choice(300, rng.integers(1, 12), replace=False):
            words[i] = f"v{k}_{i}"
        rows.append((10 + k, " ".join(words)))
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for d, t in rows}
    alike = {(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    members, pairs = jaccard.all_links(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in members.collect()}
    assert {d: r.n_links for d, r in got.items()} == {d: sum(a == d for a, _ in alike) for d in sets}
    assert got[2].class_id == 1 and got[4].class_id == 4
    assert {(r.class_a, r.class_b) for r in pairs.collect()} == {(a, b) for a, b in alike if a < b and 2 not in (a, b)}


def test_hot_signature_is_cut_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    opened = spark.range(30).selectExpr("7L AS sig", "id AS fp", "10L AS n", "id AS root", *(f"0L AS {c}" for c in jaccard.SKETCH))
    assert {tuple(r) for r in jaccard._pairs(opened, 80, 100).collect()} == {(a, b) for a in range(30) for b in range(a + 1, 30)}


def test_one_of_each_keeps_texts_of_one_id(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (1, "h i j k l m n"), (2, "a b c d e f g"), (None, "o p q"), (None, "r s t"), (None, "r s t"), (3, ""), (3, "")]
    kept = jaccard.one_of_each(spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, _id int, text_hash int"))
    assert kept.columns == ["doc_id", "text", "_id", "text_hash"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "a b c d e f g"), (1, "h i j k l m n"), (None, "o p q"), (None, "r s t"), (3, ""), (3, "")], key=str)


# 8


def test_fingerprints(spark, documents, awkward, empty):
    rows = sorted(collected(documents))
    got = {r.doc_id: r for r in spotsigs.with_next(documents, range_bytes=60_000).collect()}
    for i, (d, t) in enumerate(rows):
        assert got[d].text == (t or "") and got[d].next_text == (rows[(i + 1) % len(rows)][1] or "")
    shown = spotsigs.with_next(awkward).select("text", spotsigs.printed(F.col("signatures")).alias("f"), "next_signatures").collect()
    assert len(shown) == awkward.count()
    by = collections.defaultdict(set)
    for r in shown:
        by[r.text].add(r.f)
    assert all(len(v) == 1 for v in by.values()) and by[""] == {""}
    assert spotsigs.with_next(empty).count() == 0
    one = awkward.where("doc_id = 3")
    assert spotsigs.with_next(one).first().next_text == "one"


def plain_signatures(text):
    """The chains that open at anchors, at words without an anchor near, or at every word, in a loop over words."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    anchors, chains = set(spotsigs.ANCHORS), set()
    for i, w in enumerate(words):
        if w in anchors:
            content = [x for x in words[i + 1 :] if x not in anchors][: spotsigs.CHAIN]
            if len(content) == spotsigs.CHAIN:
                chains.add(" ".join([w, *content]))
        elif len(words) - i >= spotsigs.FREE and not anchors & set(words[i : i + spotsigs.FREE]):
            chains.add(" ".join(words[i : i + spotsigs.CHAIN + 1]))
    if not chains:
        chains = {" ".join(words[i : i + spotsigs.CHAIN + 1]) for i in range(len(words) - spotsigs.CHAIN)}
    return chains or ({" ".join(words)} - {""})


def test_signatures_are_the_plain_ones(spark, documents):
    rng = np.random.default_rng(10)
    texts = [t for _, t in collected(documents)][:80] + TEXTS + [" ".join(rng.choice(["the", "of", "a", "x1", "y", "ünt"], rng.integers(0, 40))) for _ in range(200)]
    texts += ["the " * 40 + "end of it", "the of and " * 30 + "one two three", "word " * 9, "a b", "the", "x-y_z"]
    df = spark.createDataFrame([(i, t, sorted(plain_signatures(t))) for i, t in enumerate(texts)], "i int, t string, want array<string>")
    want = F.array_sort(F.transform("want", lambda c: F.xxhash64(c)))
    wrong = df.select("i", "t", "want", spotsigs.signatures(F.col("t")).alias("got"), want.alias("hashed")).where("got != hashed")
    assert wrong.collect() == []


def test_edited_is_the_plain_one(spark):
    rng = np.random.default_rng(13)
    rows = sorted((i, "".join(rng.choice(list("ab é😀\n"), rng.integers(0, 30)))) for i in range(60))
    docs = spotsigs.with_next(spark.createDataFrame([*rows, (99, None)], "doc_id long, text string"), range_bytes=100)
    got = {r.doc_id: r.e for r in docs.select("doc_id", spotsigs.edited(F.col("text"), F.col("next_text")).alias("e")).collect()}
    rows.append((99, ""))
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        tail = len(t) // 4
        assert got[d] == t[: len(t) - tail] + following[:tail]


def test_rows_without_or_with_one_id_are_fingerprinted(spark):
    rows = [(None, "b the one two"), (None, "a the one two"), (5, "d"), (5, "c"), (6, "e")]
    got = {(r.doc_id, r.text): r.next_text for r in spotsigs.with_next(spark.createDataFrame(rows, "doc_id long, text string"), range_bytes=8).collect()}
    order = [(None, "a the one two"), (None, "b the one two"), (5, "c"), (5, "d"), (6, "e")]
    assert got == {k: n[1] for k, n in zip(order, order[1:] + order[:1], strict=True)}


def test_similar_pairs_of_many(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BLOCK", 5)
    rng = np.random.default_rng(14)
    base = [f"w{i}" if i % 3 else "the" for i in range(240)]
    rows = []
    for k in range(40):
        words = list(base) if k < 30 else [f"v{k}_{i}" if i % 3 else "the" for i in range(200)]
        for i in rng.choice(len(words), rng.integers(0, 9), replace=False):
            words[i] = f"x{k}_{i}"
        rows.append((k, " ".join(words)))
    sets = {d: plain_signatures(t) for d, t in rows}
    ids = {}
    for d in sorted(sets):
        ids.setdefault(frozenset(sets[d]), d)
    want = {(a, b) for a in ids.values() for b in ids.values() if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    members, pairs = spotsigs.similar_pairs(spark.createDataFrame([*rows, (77, None)], "doc_id long, text string"))
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 50
    assert {r.doc_id: r.class_id for r in members.collect()} == {d: ids[frozenset(sets[d])] for d in sets} | {77: 77}


def test_similar_fingerprints(spark):
    rng = np.random.default_rng(2)
    base = ["the" if i % 3 == 0 else f"w{x}" for i, x in enumerate(rng.integers(0, 5000, 900))]
    near = list(base)
    near[500] = "other"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(base[:300])), (5, "")]
    members, pairs = spotsigs.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in members.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]


# 9


def test_encoder_is_the_tokenizers(documents):
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(PATH), packing.encoder(PATH)
    texts = [t or "" for _, t in collected(documents)] + ["<|endoftext|> a", "  x\n\n y\t", "é😀​", "a" * 3000]
    for t in texts:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 10**6, "a" * 10**6, "\n" * 10**6, "word  and\n\n 12 don't " * 120_000, "x" + " " * 1_100_000 + "y z " * 30])
def test_encoder_long_texts(text):
    encode = packing.encoder(PATH)
    assert encode(text).tolist() == encode.slow.encode(text, add_special_tokens=False).ids


def test_encoder_of_another_shape(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    other = packing.Encoder(str(path))
    assert not other.plain and other("a b").tolist() == other.slow.encode("a b", add_special_tokens=False).ids != packing.encoder(PATH)("a b").tolist()


def test_padding(spark):
    rows = [(1, 600), (1, 424), (2, 512), (3, 1000)]  # full; a power of two; 24 short
    assert packing.padding(spark.createDataFrame(rows, "sequence_id long, length long")) == 24 / (1024 + 512 + 1024)


def test_little_padding(documents):
    assert packing.padding(packing.pack(documents, PATH)) < 0.01  # one group, whose last sequence has room


@pytest.mark.parametrize("size", [64, 1024])
def test_pack(awkward, documents, empty, size):
    for df in (documents, awkward):
        pieces = packing.pack(df, PATH, size, with_ids=True, group_pieces=50).collect()
        texts = collections.Counter((d, t or "") for d, t in collected(df))
        whole = collections.defaultdict(list)
        for p in pieces:
            assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
            whole[p.doc_id].append(p)
        encode = packing.encoder(PATH)
        for d, own in whole.items():
            want = collections.Counter(x for (i, t), n in texts.items() if i == d for x in [*encode(t).tolist(), 0] * n)
            assert collections.Counter(x for p in own for x in p.ids) == want
        bins = collections.defaultdict(list)
        for p in pieces:
            bins[p.sequence_id].append((p.offset, p.length))
        for parts in bins.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= size
    assert packing.pack(empty, PATH).count() == 0


def test_repeated_rows_spread(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one and the same text").alias("text"))
    groups = collections.Counter(r.sequence_id >> 32 for r in packing.pack(docs, PATH, 64, group_pieces=50).collect())
    assert sum(groups.values()) == 3000 and max(groups.values()) < 150


def test_first_fit_decreasing():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 57, 400):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        free: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            at = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
            if at == len(free):
                free.append(100)
            assert bins[i] == at and offsets[i] == 100 - free[at]
            free[at] -= sizes[i]


# 10


def brute_repeats(docs, n):
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    count = collections.Counter(tuple(w[i : i + n]) for _, w in words for i in range(len(w) - n + 1))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "seed", "group", "tree"), [(35, 8, 2000, 6000), (9, 4, 3, 50), (35, 8, 0, 10)])
def test_repeats(spark, documents, awkward, window, seed, group, tree):
    shared = " ".join(f"p{i}" for i in range(60))
    planted = [(50_000 + k, f"a{k} b{k} " * k + " ".join(shared.split()[k % 7 : 60 - k % 5]) + f" c{k}" * 9) for k in range(40)]
    for rows in (collected(documents) + planted, collected(awkward)):
        got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window, seed, group=group, tree=tree).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, window)


def test_repeats_without_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(None, " ".join(rng.choice(list("ab"), 60))) for _ in range(40)] + [(None, "x " * 50)] * 3 + [(7, "y " * 34), (7, "z " * 40 + "end")]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 9, 4).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, 9)


def test_deep_nodes():
    rng = np.random.default_rng(8)
    lists = [rng.integers(0, 2, rng.integers(6, 30)).astype(np.uint64) for _ in range(50)]
    count = collections.Counter(tuple(x[i : i + 6]) for x in lists for i in range(len(x) - 5))
    for x, deep in zip(lists, substrings.deep_nodes(lists, 6), strict=True):
        assert deep.tolist() == [count[tuple(x[i : i + 6])] > 1 for i in range(len(x) - 5)]


def test_clashing_keys_are_salted_anew(spark, monkeypatch):
    monkeypatch.setattr(substrings, "text_classes", lambda docs, salt, of=substrings.text_classes: of(docs, salt).withColumn("key", F.lit(1).cast("long")) if salt < 2 else of(docs, salt))
    assert substrings.sound_classes(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))[1] == 2


def test_repeats_text(awkward, empty):
    rows = substrings.without_repeats(awkward, with_text=True).collect()
    assert {r.kept_text for r in rows if r.n_removed and r.n_removed == r.n_words} == {""}
    assert substrings.without_repeats(empty).count() == 0


# shared

LONG = [" " * 10**6, "a" * 10**6, "word of text and 1234567 more\n" * 40_000, "1 " * 500_000, "ab@" * 300_000]


def test_very_long_texts(spark):
    """Each is followed by a short one; what the operators say of them is known."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([*LONG, LONG[2], "short one"])], "doc_id long, text string, lang string, source string, n_chars long")
    n_words = [len(WORD.findall(t)) for t in [*LONG, LONG[2], "short one"]]
    assert [r.component_id for r in jaccard.join_components(docs).orderBy("doc_id").collect()] == [0, 1, 2, 3, 4, 2, 6]
    cut = substrings.without_repeats(docs).orderBy("doc_id").collect()
    assert [r.n_words for r in cut] == n_words and [r.n_removed for r in cut] == [0, 0, n_words[2], n_words[3], 0, n_words[5], 0]
    pieces = packing.pack(docs, PATH).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).orderBy("doc_id").collect()
    assert [r.n for r in pieces] == [r["all"] for r in pieces] == [len(packing.encoder(PATH)(t)) + 1 for t in [*LONG, LONG[2], "short one"]]
    assert len(quality.score(docs, quality.train([b"a good line\n", b"%%% ### %%%\n"] * 9, np.array([1, 0] * 9))).collect()) == 7
    spans = pii.with_spans(docs, pii.Trees(start=1.0, thresholds={4: 0.0, 5: 0.0})).select("doc_id", F.size("_spans").alias("n")).orderBy("doc_id").collect()
    assert [r.n for r in spans][2] == 40_000 and [r.n for r in spans][6] == 0
    assert pii.redacted(docs, pii.Trees(start=1.0, thresholds={4: 0.0})).where("doc_id = 2").first().text == "word of text and [NUMBER] more\n" * 40_000


def test_hashing_keeps_to_a_bound_of_memory():
    import tracemalloc

    text = b"some words 12 " * 2_000_000  # 28 MB, 6 million words
    tracemalloc.start()
    w = textkit.words([text])
    textkit.run_hash(w.hash, 35)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 14 * len(text)


def test_words():
    texts = ["", "a  b\tc", "é x\x0by", "no", " lead"]
    w = textkit.words([t.encode() for t in texts])
    assert np.diff(w.first).tolist() == [len(WORD.findall(t)) for t in texts]
    seen = {}
    for i, t in enumerate(texts):
        for word, h in zip(WORD.findall(t), w.hash[w.first[i] : w.first[i + 1]], strict=True):
            assert seen.setdefault(int(h), word) == word
    upper, lower = textkit.words([b"ABC \xc3\x89"], lower=True), textkit.words([b"abc \xc3\x89"], lower=True)
    assert (upper.hash == lower.hash).all()
