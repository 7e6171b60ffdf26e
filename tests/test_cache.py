"""The cache's log against a plain dictionary, in one go and as a stream."""

import random

import pytest

from mosswork.operators import cache


def log(seed, n=900):
    r = random.Random(seed)
    ts, out = 0.0, []
    for i in range(n):
        ts += r.choice([0.0, 1.0, 3.0, 40.0])
        key = "hot" if r.random() < 0.33 else f"k{r.randrange(60)}"
        out.append((i, ts, r.choice(["get", "get", "set", "set", "delete"]), r.choice(["search", "pages"]), key, f"v{i}"))
    return out


def plain(ops, shard_of, ttl, share):
    """Each shard a dictionary: what was used longest ago goes first."""
    caches, out = {}, {}
    for i, ts, op, ns, key, value in ops:
        c = caches.setdefault(shard_of[ns, key], {})
        at = ns, key
        if at in c and ts - c[at][1] > ttl:
            del c[at]
        if op == "get":
            out[i] = (at in c, c[at][0] if at in c else None, 0)
            if at in c:
                c[at] = c.pop(at)
        elif op == "delete":
            out[i] = (c.pop(at, None) is not None, None, 0)
        else:
            gone = 0
            if at not in c and len(c) >= share:
                gone = max(1, share // 10)
                for k in list(c)[:gone]:
                    del c[k]
            c.pop(at, None)
            c[at] = (value, ts)
            out[i] = (True, None, gone)
    return out


def shown(rows):
    return {r.ordinal: (r.hit, r.value, r.evicted) for r in rows}


@pytest.mark.parametrize("capacity,ttl", [(40, 300.0), (4, 1e9), (400, 20.0)])
def test_log_and_stream_are_the_dictionary(spark, tmp_path, capacity, ttl):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ops = log(capacity)
    df = spark.createDataFrame(ops, cache.OPS)
    shard_of = {(r.namespace, r.key): r.shard for r in cache.sharded(df, 4).select("namespace", "key", "shard").distinct().collect()}
    want = plain(ops, shard_of, ttl, max(1, capacity // 4))
    assert shown(cache.answers(df.repartition(5), ttl, capacity, 4).collect()) == want
    kinds = [(h, e > 0) for h, _, e in want.values()]
    assert any(h for h, _ in kinds) and any(not h for h, _ in kinds) and any(e for _, e in kinds) == (capacity < 400)
    if capacity == 40:
        where = tmp_path / "in"
        where.mkdir()
        for part in (ops[:300], ops[300:310], ops[310:]):
            spark.createDataFrame(part, cache.OPS).coalesce(1).write.mode("append").parquet(str(where))
            out = cache.stream(spark.readStream.schema(cache.OPS).parquet(str(where)), ttl, capacity, 4)
            out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(180)
        assert shown(spark.read.schema(cache.TOLD).parquet(str(tmp_path / "out")).collect()) == want


def test_empty_log(spark):
    assert cache.answers(spark.createDataFrame([], cache.OPS), 10.0, 10).count() == 0
