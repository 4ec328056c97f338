"""Approximate nearest neighbours by inner product: inverted lists, product-quantised residuals, exact reranking.

Coarse centroids and the codebooks of residuals are fitted by k-means in one task on a bounded sample
(by a hash of the ids, SAMPLE vectors or PER_LIST for each list, and no more than SAMPLE_BYTES); every vector is
indexed. Lists grow as the root of the vectors. Many lists are split in two steps, first to regions.

A query probes the lists whose centroids have the largest inner product with it. How many, is measured on the
sample: as many as hold the share `recall` of the true neighbours, among the sample, of some of its vectors. Clustered
vectors need few lists, and vectors without clusters need most of them. In what it probes, a query scans the
codes with its own distance tables, keeps the best RERANK by that estimate and all that the codes can't tell
from the best, and ranks those by the exact inner product. search() with exact ranks all vectors instead.

Lists that lie by each other are put together to groups of about BLOCK vectors, and a query is sent to a group
once, whatever number of its lists it probes. A list of more vectors is a group of its own and cut to blocks,
and a group's queries are cut to blocks of QUERIES, so that a list that holds a third of all vectors, even of
equal ones, is many tasks of bounded memory. Estimates that tie are kept by smaller id.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of each length are
searched among each other. Repeated rows are candidates of their own, but a query's own id
is none. With few vectors there is one list and all are found. An empty table gives an empty result.
Columns other than the id and vector are ignored.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import materialize, prepare

#: Vectors that centroids and codebooks are fitted on: the least, those for each list, and their bytes at most.
SAMPLE, PER_LIST, SAMPLE_BYTES = 16384, 16, 64 << 20
#: Sample vectors whose neighbours tell how many lists to probe.
ASKED = 256
BLOCK, QUERIES, RERANK = 4096, 4096, 200
#: Standard errors of an estimate, along the query, up to which a vector behind the RERANK best is ranked too.
DOUBT = 3.0
CODES, SUBSPACE = 256, 4
#: Lists from which on they are split in two steps.
MANY = 1024


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Up to k centroids. An empty cluster takes the point that is farthest from its own."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centroids = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        of = nearest(x, centroids)
        count = np.bincount(of, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        far = np.argsort(-((x - centroids[of]) ** 2).sum(1), kind="stable")
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
        empty = np.flatnonzero(count == 0)
        centroids[empty] = x[far[: len(empty)]]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centroids**2).sum(1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (half - x[i : i + 4096] @ centroids.T).argmin(1)
    return out


def split_twice(x: np.ndarray, k: int) -> np.ndarray:
    """About k centroids in order of the region that they are in: regions first, then each region by its share of x."""
    regions = k_means(x, max(1, round(math.sqrt(k))))
    of = nearest(x, regions)
    return np.concatenate([k_means(x[of == i], max(1, round(k * (of == i).mean()))) for i in range(len(regions)) if (of == i).any()])


def chained(centroids: np.ndarray) -> np.ndarray:
    """Centroids in an order in which neighbours are near: each is followed by the nearest of those left."""
    left, out = list(range(1, len(centroids))), [0] if len(centroids) else []
    while left:
        i = int(((centroids[left] - centroids[out[-1]]) ** 2).sum(1).argmin())
        out.append(left.pop(i))
    return centroids[out]


@dataclass
class Index:
    """group: the group of each list; probes: lists that a query probes."""

    centroids: np.ndarray
    codebooks: list[np.ndarray]
    group: np.ndarray
    probes: int

    @property
    def size(self) -> int:
        return self.centroids.shape[1]

    def cuts(self) -> list[slice]:
        return [slice(i, i + SUBSPACE) for i in range(0, self.size, SUBSPACE)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's list and the codes of its residual."""
        of = nearest(x, self.centroids)
        rest = x - self.centroids[of]
        return of, np.column_stack([nearest(rest[:, cut], book) for cut, book in zip(self.cuts(), self.codebooks, strict=True)]).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each subspace, the inner products of queries with its codes."""
        return [q[:, cut] @ book.T for cut, book in zip(self.cuts(), self.codebooks, strict=True)]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centroids=self.centroids, group=self.group, probes=self.probes, **{f"b{i}": b for i, b in enumerate(self.codebooks)})
        return out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> Index:
        got = np.load(io.BytesIO(raw))
        return Index(got["centroids"], [got[f"b{i}"] for i in range(len(got.files) - 3)], got["group"], int(got["probes"]))


def fitted(x: np.ndarray, lists: int, total: int, k: int, recall: float) -> Index:
    """An index for total vectors of which x are a sample."""
    centroids = split_twice(x, lists) if lists > MANY else chained(k_means(x, lists))
    of = nearest(x, centroids)
    rest = (x - centroids[of])[:SAMPLE]
    index = Index(centroids, [], np.zeros(len(centroids), np.int64), len(centroids))
    index.codebooks = [k_means(rest[:, cut], CODES) for cut in index.cuts()]
    held = np.bincount(of, minlength=len(centroids)) * (total / len(x))
    group, room = -1, 0.0
    for i, n in enumerate(held):
        if group < 0 or n > room:
            group, room = group + 1, max(float(BLOCK), n)
        index.group[i], room = group, room - n
    asked = x[:ASKED]
    score = asked @ x.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)  # of each list, for each asked
    if near.size:
        index.probes = 1 + int(np.quantile(np.take_along_axis(place, of[near], 1), recall, method="higher"))
    return index


def taking_part(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """vec_id and vector (array<double>) of those that take part."""
    v = F.col("vector")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), F.col(name).cast("array<double>").alias("vector")).where(v.isNotNull() & F.col("vec_id").isNotNull() & sound)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build(vectors: DataFrame, lists: int | None = None, k: int = 20, recall: float = 0.95) -> tuple[Index, DataFrame]:
    """The index of vectors of one length, one at least, and its rows: list, place (group and block), vec_id, code, vector."""
    spark = prepare(vectors.sparkSession)
    total, size = vectors.agg(F.count("*"), F.first(F.size("vector"))).first()
    lists = lists or max(1, round(math.sqrt(total)) // 2)
    most = max(1, SAMPLE_BYTES // (8 * size))
    lists = min(lists, max(1, most // PER_LIST))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(min(most, max(SAMPLE, PER_LIST * lists)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([_matrix(b.column(0)) for b in batches if len(b)])
        yield pa.RecordBatch.from_arrays([pa.array([fitted(x, lists, total, k, recall).to_bytes()], pa.binary())], names=["index"])

    index = Index.from_bytes(sample.select("vector").coalesce(1).mapInArrow(fit, "index binary").first()["index"])
    shared = spark.sparkContext.broadcast(index)  # SAMPLE_BYTES / PER_LIST of centroids at most, and CODES codes a subspace

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                of, codes = shared.value.encode(_matrix(b.column(1)))
                group = shared.value.group[of].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(of.astype(np.int32)), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1)], names=["group", "list", "vec_id", "code", "vector"])

    return index, materialize(vectors.mapInArrow(encoded, "group int, list int, vec_id long, code binary, vector array<double>"), "ann-index")


def _first(estimate: np.ndarray, n: int) -> np.ndarray:
    """The n largest, of equal ones those that come first."""
    if len(estimate) <= n:
        return np.arange(len(estimate))
    least = np.partition(estimate, len(estimate) - n)[len(estimate) - n]
    above = np.flatnonzero(estimate > least)
    return np.concatenate([above, np.flatnonzero(estimate == least)[: n - len(above)]])


def _first_copies(x: np.ndarray, n: int) -> np.ndarray:
    """Rows in order, without those of which n equal ones come before: they can't be among the n nearest."""
    _, of = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_inverse=True)
    order = np.argsort(of, kind="stable")
    nth = np.arange(len(of)) - np.searchsorted(of[order], of[order])
    return np.sort(order[nth < n])


def search(index: Index, rows: DataFrame, queries: DataFrame, k: int = 20, probes: int | None = None, rerank: int = RERANK, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, vector), its own id left out.

    probes: lists that a query probes; as measured, if None. More are probed until 4 * k vectors are in them. exact: all lists,
    and every vector is ranked.
    """
    spark = queries.sparkSession
    counts = np.zeros(len(index.centroids), np.int64)
    for r in rows.groupBy("list").count().collect():  # a row a list
        counts[r.list] = r["count"]
    least = len(index.centroids) if exact else index.probes if probes is None else probes
    shared = spark.sparkContext.broadcast((index, counts))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = shared.value
        for b in batches:
            for i in range(0, len(b), 256):
                some = b.slice(i, 256)
                order = np.argsort(-(_matrix(some.column(1)) @ own.centroids.T), axis=1, kind="stable")
                before = np.cumsum(held[order], axis=1) - held[order]
                at, place = np.nonzero(((np.arange(len(own.centroids)) < least) | (before < 4 * k)) & (held[order] > 0))
                lists = order[at, place]
                by = np.lexsort((lists, own.group[lists], at))
                at, lists = at[by], lists[by]
                head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own.group[lists[1:]] != own.group[lists[:-1]])])) if len(at) else at
                each = pa.ListArray.from_arrays(pa.array(np.append(head, len(at)).astype(np.int32)), pa.array(lists.astype(np.int32)))
                who = pa.array(at[head])
                yield pa.RecordBatch.from_arrays([pa.array(own.group[lists[head]].astype(np.int32)), some.column(0).take(who), some.column(1).take(who), each], names=["group", "query_id", "query", "lists"])

    wanted = materialize(queries.select("vec_id", "vector").mapInArrow(probed, "group int, query_id long, query array<double>, lists array<int>"), "ann-queries")
    asked = {r.group: r["count"] for r in wanted.groupBy("group").count().collect()}  # a row a group
    held = np.bincount(index.group, counts)
    parts = [(i, max(1, -(-int(n) // (2 * BLOCK))), max(1, -(-asked.get(i, 0) // QUERIES))) for i, n in enumerate(held)]
    shape = F.broadcast(spark.createDataFrame(parts, "group int, blocks int, query_blocks int"))  # a row a group
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    left = rows.join(shape, "group").select("group", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int").alias("block"), each("query_blocks", "query_block"), "list", "vec_id", "code", "vector")
    right = wanted.join(shape, "group").select("group", each("blocks", "block"), F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("query_block"), "query_id", "query", "lists")
    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def scan(own: pa.Table, asking: pa.Table) -> pa.Table:
        if not len(own) or not len(asking):
            return found.empty_table()
        index = shared.value[0]
        own = own.sort_by("vec_id")
        own = own.take(_first_copies(_matrix(own["vector"]), k + 1))
        ids, of, x, q = own["vec_id"].to_numpy(), own["list"].to_numpy(), _matrix(own["vector"]), _matrix(asking["query"])
        query_ids, lists = asking["query_id"].to_numpy(), asking["lists"].combine_chunks()
        which, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        codes = np.frombuffer(b"".join(own["code"].to_pylist()), np.uint8).reshape(len(own), -1)
        lost = ((x - index.centroids[of]) ** 2).sum(1) if not index.codebooks else sum(((x[:, cut] - index.centroids[of, cut] - book[codes[:, j]]) ** 2).sum(1) for j, (cut, book) in enumerate(zip(index.cuts(), index.codebooks, strict=True)))
        doubt = DOUBT * np.sqrt(lost / index.size)
        here, place = np.unique(of, return_inverse=True)
        out_q, out_v, out_s = [], [], []
        step = max(1, 1_000_000 // len(own))
        for i in range(0, len(q), step):
            some = q[i : i + step]
            asks = np.zeros((len(some), len(here)), bool)
            for n in range(len(some)):
                asks[n] = np.isin(here, which[ends[i + n] - ends[0] : ends[i + n + 1] - ends[0]])
            on = np.flatnonzero(asks.any(0)[place])  # vectors of lists that any of these queries probes
            if exact:
                estimate = some @ x[on].T
            else:
                estimate = (some @ index.centroids[here].T)[:, place[on]]
                for j, table in enumerate(index.tables(some)):
                    estimate += table[:, codes[on, j]]
            estimate[~asks[:, place[on]]] = -np.inf
            for row, query, self_id in zip(estimate, some, query_ids[i : i + step], strict=True):
                best = np.flatnonzero(row > -np.inf) if exact else _first(row, rerank + 1)
                if len(best) < len(row) and not exact:
                    reach = row + doubt[on] * np.sqrt(query @ query)
                    best = np.union1d(best, np.flatnonzero(reach >= np.partition(row, -k - 1)[-k - 1]))
                best = on[best[row[best] > -np.inf]]
                best = best[ids[best] != self_id]
                score = (x[best] * query).sum(axis=1)
                top = np.lexsort((ids[best], -score))[:k]
                out_q.append(np.full(len(top), self_id))
                out_v.append(ids[best[top]])
                out_s.append(score[top])
        return pa.table([np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)], schema=found)

    keys = ["group", "block", "query_block"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95, **how) -> DataFrame:
    """search() of queries among vectors, both as taking_part() gives them; queries with repeated ids count once."""
    queries = queries.dropDuplicates(["vec_id"])
    lengths = [r.n for r in vectors.groupBy(F.size("vector").alias("n")).count().orderBy("n").collect()]  # a row a length
    of = lambda df, n: df.where(F.size("vector") == n)
    found = [search(*build(of(vectors, n), k=k, recall=recall), of(queries, n), k, **how) for n in lengths]
    return reduce(DataFrame.unionAll, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
