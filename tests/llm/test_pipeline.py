import collections
import itertools
import re

import duckdb
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tagweave.llm import packing, pii, queries, toxicity
from tagweave.llm.common import WORD

FOLDER = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        docs.write.mode("overwrite").parquet(path := f"{spark.sparkContext.getCheckpointDir()}/test-{name}")
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0
    assert "@" not in "".join(r.text for r in docs.collect() if "example.com" in r.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(packed.columns) and packed.count() >= docs.count()


def plain_groups(docs):
    """The ids that stay: of each component of near copies the smallest."""
    sets, up = {}, {}
    for d, t in docs:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d], up[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} - {()}, d
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and up[a] != up[b]:
            low, high = sorted((up[a], up[b]))
            up = {d: low if u == high else u for d, u in up.items()}
    return {d for d, u in up.items() if d == u}


def plain_redacted(text, spans):
    out, at = [], 0
    for start, k, end in spans:
        if start >= at:
            out += [text[at:start], f"[{pii.KINDS[k].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_run_against_plain_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))).collect() if r.score >= 0.5}
    kept = plain_groups([(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic])
    docs = docs.where(F.col("doc_id").isin(list(kept)))
    rows = [(r.doc_id, plain_redacted(r._text, r._spans), r.source) for r in pii.with_spans(docs, pii.fit(docs)).collect()]
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    con.register("documents", frame)
    taken = {d: (n, size) for d, size, _, _, n in con.sql(queries.OP1_SQL).fetchall()}
    encode, want = packing.encoder(public_tokenizers.path("byte_bpe_50k.json")), collections.Counter()
    for d, text, _ in rows:
        n, size = taken[d]
        texts = [text] * (n // size) + ["".join(re.findall(rf"[\x20\x09-\x0D]*{WORD}", text)[: n % size])] * (n % size > 0) if n else []
        for ids in ([*encode(t).tolist(), 0] for t in texts):
            want.update((d, i, tuple(ids[i : i + 1024])) for i in range(0, len(ids), 1024))
    packed = corpus_pipeline.run(spark, FOLDER)
    got = packed.collect()
    assert collections.Counter((r.doc_id, r.start, tuple(r.ids)) for r in got) == want
    parts = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == len(parts[r.sequence_id])
        parts[r.sequence_id] += r.ids
    assert max(map(len, parts.values())) <= 1024
    path = f"{spark.sparkContext.getCheckpointDir()}/test-packed"
    spark.createDataFrame(got, packed.schema).write.mode("overwrite").parquet(path)
    assert {r.sequence_id: r.ids for r in packing.sequences(spark.read.parquet(path)).collect()} == parts


def test_registered(spark):
    known = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in known) for n in range(1, 11)) and "pipeline" in known


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    want = con.sql(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    key = list(got.columns)
    assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()
