"""Exact search by inner product over metric blocks.

Pivots divide the vectors into cells, and distances to the pivot divide a cell into rings. By the triangle inequality the products of a query with all vectors of a ring
have an upper bound that follows from the query's distance to the pivot alone; a ring whose bound lies below what the query has found already, or below a threshold, is never
joined. What is known about the rings has a fixed size (CELLS times RINGS rows), and rings of more than BLOCK vectors are dealt in parts, so no task holds more than a block of
vectors and GROUP queries, however many vectors are alike. Bounds hold for vectors of any length, not only for unit vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

#: Vectors of a block, queries of a group; cells and rings of a cell at most; vectors of a cell that are aimed at.
BLOCK, GROUP, CELLS, RINGS, AIM = 4096, 4096, 512, 32, 4096
#: A search takes blocks and groups up to so many times as large (for the k best, and for all pairs), while at least MANY blocks are left to be dealt out: each vector moves once a group.
WIDE, WIDE_PAIRS, MANY = 4, 8, 8
#: Queries of a product at a time, so that a task holds a few matrices of SLICE times BLOCK.
SLICE = 512
#: What rounding can add to a bound, in parts of the product of lengths.
SLACK = 1e-6
#: Scores are compared to so many places, so that the order of a product's sums does not break ties.
PLACES = 12
_TARGET = "qid long, q {}, grp long, cell int, ring int, part int, theta double"
_FOUND = "query_id long, id long, score double"


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(np.float64)


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((v * v).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * v @ pivots.T, 0))


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n vectors of the sample, each the one farthest from those before it."""
    chosen, least = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < n and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


@dataclass
class Metric:
    """An index over (id, e): where each vector belongs, and what bounds each ring."""

    index: DataFrame
    pivots: np.ndarray
    rings: np.ndarray  # a row for each ring: cell, ring, vectors, least and largest distance, largest length, parts
    wide: int = 1

    @classmethod
    def of(cls, vectors: DataFrame, wide: int = 1) -> Metric | None:
        """None if there is no vector. Null vectors take no part. wide: so many times BLOCK and GROUP at most."""
        vectors = vectors.select(F.col("id").cast("long").alias("id"), "e").filter("e is not null")  # in their own type, to be moved as small as they are
        kind = vectors.schema["e"].dataType.simpleString()
        n = vectors.count()
        if not n:
            return None
        wide = max(1, min(wide, n // (MANY * BLOCK)))
        size = wide * BLOCK
        cells = max(1, min(CELLS, n // (wide * AIM)))
        sample = vectors.orderBy(F.xxhash64("id"), "id").limit(8 * cells).collect()  # 8 * CELLS at most
        pivots = _spread(np.array([r.e for r in sample]), cells)

        def assign(edges: dict[int, np.ndarray], parts: dict[tuple[int, int], int]):
            def run(it):
                for b in it:
                    v = _matrix(b["e"])
                    cell = _distances(v, pivots).argmin(1) if len(b) else np.zeros(0, int)
                    d = np.linalg.norm(v - pivots[cell], axis=1)
                    ring = np.array([np.searchsorted(edges[c], x) if c in edges else 0 for c, x in zip(cell.tolist(), d.tolist(), strict=True)], np.int64)
                    part = np.array([i % parts.get((c, r), 1) for i, c, r in zip(b["h"].tolist(), cell.tolist(), ring.tolist(), strict=True)], np.int64)
                    yield pd.DataFrame({"id": b["id"], "e": b["e"], "cell": cell, "ring": ring, "part": part, "d": d, "length": np.linalg.norm(v, axis=1)})

            hashed = vectors.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
            return hashed.mapInPandas(run, f"id long, e {kind}, cell int, ring int, part int, d double, length double")

        grid = [k / RINGS for k in range(1, RINGS)]
        seen = assign({}, {}).groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("d", grid, 2000).alias("at")).collect()  # CELLS rows
        edges = {}
        for r in seen:
            m = min(RINGS, -(-r.n // size))
            edges[r.cell] = np.unique([r["at"][RINGS * k // m - 1] for k in range(1, m)])
        told = assign(edges, {}).groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("length").alias("length")).sort("cell", "ring").collect()
        rings = np.array([(r.cell, r.ring, r.n, r.lo, r.hi, r.length, -(-r.n // size)) for r in told])
        parts = {(r.cell, r.ring): -(-r.n // size) for r in told}
        return cls(assign(edges, parts).select("id", "e", "cell", "ring", "part"), pivots, rings, wide)

    def _targets(self, queries: DataFrame, k: int | None, rest: bool) -> DataFrame:
        """Rows (qid, q, theta) with each part of each ring that they have to meet: the best rings by bound that hold more than k vectors, or (rest) the others that can
        reach theta, or without k all that can reach theta."""
        pivots, rings = self.pivots, self.rings
        cell = rings[:, 0].astype(int)

        def own_cells(it):
            for b in it:
                yield pd.DataFrame({"cell": _distances(_matrix(b["q"]), pivots).argmin(1) if len(b) else []}, dtype=int)

        busy = {r.cell: -(-r["count"] // (self.wide * GROUP)) for r in queries.select("q").mapInPandas(own_cells, "cell int").groupBy("cell").count().collect()}

        def run(it):
            for big in it:
                for at in range(0, len(big), 256):
                    b = big.iloc[at : at + 256]
                    q = _matrix(b["q"])
                    d, length, product = _distances(q, pivots), np.linalg.norm(q, axis=1)[:, None], q @ pivots.T
                    own = d.argmin(1)
                    gap = np.maximum(0, np.maximum(d[:, cell] - rings[:, 4], rings[:, 3] - d[:, cell]))
                    bound = np.minimum(product[:, cell] + length * rings[:, 4], (length**2 + rings[:, 5] ** 2 - gap**2) / 2) + SLACK * (1 + length * rings[:, 5])
                    wanted = bound >= b["theta"].to_numpy()[:, None]
                    if k is not None:
                        order = np.argsort(-bound, 1, kind="stable")
                        held = np.cumsum(rings[order, 2], 1)
                        first = np.zeros_like(wanted)
                        np.put_along_axis(first, order, (held - rings[order, 2]) <= k, 1)
                        wanted = wanted & ~first if rest else first
                    i, j = np.nonzero(wanted)
                    parts = rings[j, 6].astype(int)
                    i, j = np.repeat(i, parts), np.repeat(j, parts)
                    part = np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)
                    group = (own.astype(np.int64) << 32) + b["h"].to_numpy() % np.array([busy.get(c, 1) for c in own.tolist()])
                    yield pd.DataFrame({"qid": b["qid"].to_numpy()[i], "q": b["q"].to_numpy()[i], "grp": group[i], "cell": cell[j], "ring": rings[j, 1].astype(int), "part": part, "theta": b["theta"].to_numpy()[i]})

        return queries.withColumn("h", F.pmod(F.xxhash64("qid"), F.lit(1 << 31))).mapInPandas(run, _TARGET.format(queries.schema["q"].dataType.simpleString()))

    def met(self, targets: DataFrame) -> tuple[int, int]:
        """Pairs of blocks and groups of queries that meet, and pairs that there are."""
        groups = targets.select("grp").distinct().count()
        return targets.select("cell", "ring", "part", "grp").distinct().count(), groups * int(self.rings[:, 6].sum())

    def _searched(self, targets: DataFrame, k: int | None) -> DataFrame:
        """The k best, or without k all, of each block for each query that meets it, theta at least."""
        key, wide = ["cell", "ring", "part"], self.wide
        pairs = targets.select(*(F.col(c).alias(f"_{c}") for c in (*key, "grp"))).distinct()
        left = self.index.join(pairs, [F.col(c) == F.col(f"_{c}") for c in key]).select("id", "e", *(F.col(f"_{c}").alias(f"x_{c}") for c in (*key, "grp")))

        def slices(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if not len(x) or not len(y):
                return
            x = x.sort_values("id")
            ids, vectors = x["id"].to_numpy(), _matrix(x["e"]).T
            step = max(1, SLICE // wide)  # a matrix has the same size for all blocks
            for at in range(0, len(y), step):
                yield best(ids, vectors, y.iloc[at : at + step])

        def task(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            return pd.concat(list(slices(x, y)) or [pd.DataFrame({"query_id": [], "id": [], "score": []})])

        def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            both = pd.concat(list(batches))  # a block and a group
            yield from slices(both[both["theta"].isna()].rename(columns={"v": "e"}), both[both["theta"].notna()].rename(columns={"id": "qid", "v": "q"}))

        def best(ids: np.ndarray, vectors: np.ndarray, y: pd.DataFrame) -> pd.DataFrame:
            own = y["qid"].to_numpy()
            scores = np.round(_matrix(y["q"]) @ vectors, PLACES)
            scores[own[:, None] == ids[None, :]] = -np.inf
            floor = np.round(y["theta"].to_numpy(), PLACES)
            if k is not None and k < len(ids):
                floor = np.maximum(floor, np.partition(scores, len(ids) - k, 1)[:, len(ids) - k])
            i, j = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
            if k is not None and len(i):
                order = np.lexsort((j, -scores[i, j], i))  # ids ascend, so j breaks ties
                i, j = i[order], j[order]
                starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                nth = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
                i, j = i[nth < k], j[nth < k]
            return pd.DataFrame({"query_id": own[i], "id": ids[j], "score": scores[i, j]})

        if k is None:  # any number of pairs may be found, so they leave the task a slice at a time
            met = [F.col(f"x_{c}") for c in (*key, "grp")]
            asked = targets.select(F.col("qid").alias("id"), F.col("q").alias("v"), *(F.col(c).alias(f"x_{c}") for c in (*key, "grp")), "theta")
            return left.select("id", F.col("e").alias("v"), *met, F.lit(None).cast("double").alias("theta")).unionByName(asked).groupBy(*met).applyInPandas(streamed, _FOUND)
        return left.groupBy(*(f"x_{c}" for c in (*key, "grp"))).cogroup(targets.groupBy(*key, "grp")).applyInPandas(task, _FOUND)

    def _queries(self, queries: DataFrame, least: float | None) -> DataFrame:
        theta = F.lit(float("-inf") if least is None else float(least))
        return queries.select(F.col("id").cast("long").alias("qid"), F.col("e").alias("q"), theta.alias("theta")).filter("q is not null")

    def topk_targets(self, queries: DataFrame, k: int, least: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What is found in each query's best rings, what these were, and the rings that can still hold one of its k best."""
        asked = self._queries(queries, least)
        first = self._targets(asked, k, rest=False)
        found = stored(self._searched(first, k))
        kth = found.groupBy(F.col("query_id").alias("qid")).agg(F.sort_array(F.collect_list("score"), False).alias("s")).select("qid", F.get("s", k - 1).alias("kth"))
        again = asked.join(kth, "qid", "left").withColumn("theta", F.greatest("theta", F.coalesce("kth", F.lit(float("-inf"))))).drop("kth")
        return found, first, self._targets(again, k, rest=True)

    def topk(self, queries: DataFrame, k: int, least: float | None = None) -> DataFrame:
        """query_id, rank, id, score: the k largest products, ties to the smaller id; a query's own id takes no part."""
        found, _, more = self.topk_targets(queries, k, least)
        every = found.unionByName(self._searched(more, k))
        if least is not None:
            every = every.filter(F.col("score") >= least)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def pairs(self, queries: DataFrame, least: float) -> DataFrame:
        """query_id, id, score of all products of `least` at least, which is a number."""
        return self._searched(self._targets(self._queries(queries, least), None, rest=False), None)
