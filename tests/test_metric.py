"""Exact search over metric blocks against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosswork.operators import metric, vector
from mosswork.operators.metric import Metric


def frame(spark, v):
    return spark.createDataFrame([(i, None if x is None else [float(y) for y in x]) for i, x in enumerate(v)], "id long, e array<double>").repartition(5)


def clustered(n, dim, clusters, seed=1):
    r = np.random.RandomState(seed)
    centres = r.randn(clusters, dim)
    v = centres[r.randint(0, clusters, n)] + 0.05 * r.randn(n, dim)
    return v / np.linalg.norm(v, axis=1)[:, None]


def plain(v, k, least=-np.inf):
    s = np.round(v @ v.T, 12)
    np.fill_diagonal(s, -np.inf)
    out = {}
    for i, row in enumerate(s):
        best = sorted(((-x, j) for j, x in enumerate(row) if np.isfinite(x) and x >= least))[:k]
        out[i] = [j for _, j in best]
    return {i: x for i, x in out.items() if x}


def listed(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(metric, "BLOCK", 64)
    monkeypatch.setattr(metric, "GROUP", 50)
    monkeypatch.setattr(metric, "AIM", 40)
    monkeypatch.setattr(metric, "SLICE", 20)


def test_clusters_are_not_joined(spark, small):
    v = clustered(1500, 16, 20)
    e = frame(spark, v)
    made = Metric.of(e)
    assert listed(made.topk(e, 5).collect()) == plain(v, 5)
    _, first, more = made.topk_targets(e, 5)
    met, all_ = made.met(first.unionByName(more))
    assert met < 0.25 * all_, (met, all_)
    near = {(r.query_id, r.id) for r in made.pairs(e, 0.95).collect()}
    s = v @ v.T
    np.fill_diagonal(s, 0)
    assert near == {(int(i), int(j)) for i, j in zip(*np.nonzero(s >= 0.95))} and len(near) > 10_000
    met, all_ = made.met(made._targets(made._queries(e, 0.95), None, rest=False))
    assert met < 0.15 * all_, (met, all_)


def test_hot_and_odd_vectors(spark, small):
    """A third of all vectors are one; lengths differ; some are zero or null; one query has no vector near."""
    r = np.random.RandomState(4)
    v = r.randn(400, 6) * r.choice([0.1, 1, 30], 400)[:, None]
    v[50:190] = v[50]
    v[200:203] = 0
    e = frame(spark, [*v, None])
    assert listed(vector.topk(e, e, 7).collect()) == plain(v, 7)
    assert listed(vector.topk(e, e, 3, least=50.0).collect()) == plain(v, 3, 50.0)
    few = frame(spark, v[:3])
    assert listed(vector.topk(few, few, 7).collect()) == plain(v[:3], 7)
    assert vector.topk(few, few.limit(0), 7).count() == vector.similar(few.limit(0), few, 0.1).count() == 0
    groups = Metric.of(e)
    sizes = groups.index.groupBy("cell", "ring", "part").count().agg(F.max("count")).first()[0]
    assert sizes <= 2 * metric.BLOCK


def test_batch_rule(spark, small):
    v = clustered(300, 8, 5, seed=3)
    v[250] = v[3]
    got = {r.position: (r.best_score, r.duplicate_of) for r in vector.in_batch(frame(spark, v).withColumnRenamed("id", "position"), 0.9).collect()}
    s = np.round(v @ v.T, 12)
    np.fill_diagonal(s, -np.inf)
    for i, row in enumerate(s):
        j = int(row.argmax())
        assert abs(got[i][0] - max(row[j], 0)) < 1e-9 and got[i][1] == (j if row[j] >= 0.9 and j < i else None)


def test_all_pairs_take_wide_blocks(spark, small, monkeypatch):
    """Each vector moves once a group, so groups grow with the vectors; a third of them are one, of which all pairs are found."""
    made, of = [], Metric.of
    monkeypatch.setattr(Metric, "of", classmethod(lambda cls, *a: made.append(of(*a)) or made[-1]))
    monkeypatch.setattr(metric, "BLOCK", 16)
    monkeypatch.setattr(metric, "GROUP", 16)
    v = clustered(600, 8, 3, seed=7)
    v[100:300] = v[100]
    e = frame(spark, [*v, None])
    found = [(r.query_id, r.id) for r in vector.similar(e, e, 0.9).collect()]
    s = np.round(v @ v.T, 12)
    np.fill_diagonal(s, 0)
    assert sorted(found) == [(int(i), int(j)) for i, j in zip(*np.nonzero(s >= 0.9))] and len(found) > 40_000
    assert made[0].wide == 600 // (metric.MANY * 16) > 1
