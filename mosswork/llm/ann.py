"""Approximate nearest neighbours by collision-counting hashing.

Vectors are dealt into shards of bounded size. In a shard each of `projections` random lines has
one array of the shard's projected values, sorted. For a query, a window around its own value is opened on every
line and widened step by step (virtual rehashing: no second table is ever built). Each vector counts the lines on which
it has fallen into the window; vectors that have reached the threshold are candidates, and widening
ends once there are enough of them. All candidates are verified by exact inner products.

Largest inner product is made a distance by one more component, which brings all vectors of a shard
to one length; the order by that distance is the order by inner product. Lines are drawn from a
fixed seed, so a task that runs again gives the same rows. Every vector is indexed; a query block
meets every shard once, and only its best `k` of each shard travel, to be merged in groups.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids;
rows of one id are one vector, the least; a vector meets only vectors of its own dimension; with fewer than `k`
candidates all are returned; ties go to the smaller id; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, only

#: Vectors of a shard, queries of a block.
SHARD, BLOCK = 8192, 8192
PROJECTIONS = 65
#: Share of the lines that make a candidate; widening ends at that share of a shard's vectors, and so many for each neighbour sought.
THRESHOLD, ENOUGH, EACH = 0.75, 0.04, 15
#: Vectors of a shard that tell where its windows open.
PROBES = 32
#: Half widths of windows, as multiples of the typical distance between projections.
WIDTHS = tuple(0.15 * 1.12**i for i in range(36))
TOP = "array<struct<score:double,vec_id:bigint>>"


def rotations(d: int, lines: int) -> np.ndarray:
    """Random lines, orthogonal in groups of d: together they tell more than independent ones."""
    draw = np.random.RandomState(d)
    turned = [np.linalg.qr(draw.standard_normal((d, d)))[0] * math.sqrt(d) for _ in range(-(-lines // d))]
    return np.concatenate(turned)[:lines]


class Shard:
    """Sorted projections of vectors x (n by d) with ids in ascending order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        norms = (x**2).sum(1)
        self.extra = np.sqrt(np.maximum(norms.max() - norms, 0))
        self.lines = rotations(x.shape[1] + 1, PROJECTIONS)
        self.values = self.lines[:, :-1] @ x.T + self.lines[:, -1:] * self.extra
        self.order = np.argsort(self.values, 1, kind="stable")
        self.values = np.take_along_axis(self.values, self.order, 1)
        self.longest = math.sqrt(norms.max())

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """Windows open two steps below what the shard's own first vectors need in the median, so no query's result depends on another's."""
        n, least = len(self.ids), max(1, math.ceil(THRESHOLD * PROJECTIONS))
        enough = min(n, EACH * k + 1 + math.ceil(ENOUGH * n))
        probes = self.x[:PROBES]
        needed = [t for _, _, t in self._windows(np.arange(len(probes)), probes, least, enough, 0)]
        first = max(0, int(np.median(needed)) - 2)
        for i, found, _ in self._windows(np.arange(len(query_ids)), queries, least, enough, first):
            yield query_ids[i], *self._verified(found, query_ids[i], queries[i], k)

    def _windows(self, numbers: np.ndarray, queries: np.ndarray, least: int, enough: int, first: int):
        """number, candidates and last step of each query."""
        scale = self.longest / np.sqrt((queries**2).sum(1, keepdims=True))
        centres = self.lines[:, :-1] @ (queries * scale).T
        typical = self.longest * math.sqrt(2)
        for c in range(0, len(queries), 256):
            mid = centres[:, c : c + 256]
            edges = np.array([[np.searchsorted(v, m + w, side) for v, m in zip(self.values, mid, strict=True)] for w, side in ((s * w * typical, side) for w in WIDTHS for s, side in ((-1, "left"), (1, "right")))])
            for i in range(mid.shape[1]):
                yield numbers[c + i], *self._widened(edges[:, :, i].tolist(), least, enough, first)

    def _widened(self, edges: list, least: int, enough: int, first: int):
        counts, n, lo, hi = None, len(self.ids), None, None
        for t in range(first, len(WIDTHS)):
            a, b = edges[2 * t], edges[2 * t + 1]
            if lo is None:
                parts = [o[x:y] for o, x, y in zip(self.order, a, b, strict=True)]
            else:
                parts = [o[x:y] for o, x, y in zip(self.order, a, lo, strict=True)] + [o[x:y] for o, x, y in zip(self.order, hi, b, strict=True)]
            new = np.bincount(np.concatenate(parts), minlength=n)
            counts = new if counts is None else counts + new
            lo, hi = a, b
            if np.count_nonzero(counts >= least) >= enough:
                return np.flatnonzero(counts >= least), t
        return np.arange(n), len(WIDTHS)  # windows that hold all

    def _verified(self, found: np.ndarray, own: int, q: np.ndarray, k: int):
        """The k largest exact products; every candidate that could be among them by the rounded ones is summed exactly."""
        found = found[self.ids[found] != own]
        score = self.x[found] @ q
        if len(found) > k:
            kth = np.partition(score, len(found) - k)[len(found) - k]
            found = found[score >= kth - 1e-9 * max(1.0, abs(kth))]
        exact = sorted((-math.fsum(self.x[j] * q), int(self.ids[j])) for j in found)[:k]
        return [-s for s, _ in exact], [j for _, j in exact]


def usable(embeddings: DataFrame, vec_id="vec_id", embedding="embedding") -> DataFrame:
    e = only(embeddings, vec_id=vec_id, e=embedding).select(F.col("vec_id").cast("long"), F.col("e").cast("array<double>").alias("e"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    e = e.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", number) & F.exists("e", lambda x: x != 0))
    return e.groupBy("vec_id").agg(F.min("e").alias("e"))


def search(embeddings: DataFrame, is_query: Column, k: int = 20, vec_id="vec_id", embedding="embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score. is_query: a condition on vec_id."""
    vectors = durable(usable(embeddings, vec_id, embedding), "vectors")
    n, nq = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-nq // BLOCK))
    deal = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dim = F.size("e").alias("dim")
    rows = vectors.select("vec_id", "e", dim, deal(shards).alias("shard"), every(blocks).alias("block"))
    queries = vectors.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"), dim, deal(blocks).alias("block"), every(shards).alias("shard"))
    schema = pa.schema([("query_id", pa.int64()), ("shard", pa.int32()), ("top", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))])

    def matrix(t: pa.Table, i: str, e: str) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column(i).to_numpy()
        x = t.column(e).combine_chunks()
        x = (x if isinstance(x, pa.ListArray) else x.chunk(0)).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        return ids[order], x[order]

    def task(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            for q, scores, ids in Shard(*matrix(left, "vec_id", "e")).search(*matrix(right, "query_id", "q"), k):
                out.append((int(q), key[0].as_py(), [{"score": s, "vec_id": j} for s, j in zip(scores, ids, strict=True)]))
        return pa.Table.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(schema.types)], schema=schema)

    keys = ["shard", "block", "dim"]
    tops = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(task, f"query_id long, shard int, top {TOP}")
    while True:  # merge 64 shards at a time
        tops = tops.withColumn("shard", F.floor(F.col("shard") / 64).cast("int")).groupBy("query_id", "shard").agg(F.flatten(F.collect_list("top")).alias("top"))
        order = lambda a, b: F.when(a.score > b.score, -1).when(a.score < b.score, 1).when(a.vec_id < b.vec_id, -1).otherwise(1)
        tops = tops.withColumn("top", F.slice(F.array_sort("top", order), 1, k))
        shards = -(-shards // 64)
        if shards == 1:
            break
    ranked = tops.select("query_id", F.posexplode("top").alias("rank", "t"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")
