"""Retries as a stream with timers against the batch query and a plain fold."""

import random

import pytest

from mosswork.operators import queue
from mosswork.streaming import queue as stream

DELAY = {"base": 5.0, "backoff": 2.0, "cap": 30.0}


def log(seed, keys=12, n=160):
    """Events of many rows; one row has a third of all."""
    r = random.Random(seed)
    out, ts = [], 0.0
    for i in range(n):
        ts += r.choice([0.0, 1.0, 4.0, 9.0, 25.0])
        k = 0 if r.random() < 0.33 else r.randrange(keys)
        out.append((i, ts, r.choice(["error", "error", "claim", "done", "enqueue"]), f"s{k}", k % 3, None, None))
    return out


def plain(events, most, delay):
    """What the queue does, one event after another."""
    count, waiting, out = {}, {}, []
    for _, ts, event, subject, hop, *_ in events:
        key = subject, hop
        if key in waiting:
            n, failed, due = waiting.pop(key)
            out.append((*key, n, failed, round(due, 6), "superseded" if ts <= due else "retry"))
        if event == "error":
            count[key] = count.get(key, 0) + 1
            if count[key] < most:
                waiting[key] = (count[key], ts, ts + delay(count[key]))
            elif count[key] == most:
                out.append((*key, most, ts, None, "failed"))
    return sorted([*out, *((*k, n, f, round(d, 6), "retry") for k, (n, f, d) in waiting.items())], key=str)


def shown(df):
    return sorted(((r.subject, r.hop, r.retry, r.failed_at, None if r.due_at is None or r.due_at != r.due_at else round(r.due_at, 6), r.outcome) for r in df.collect()), key=str)


def delay(n):
    return min(5.0 * 2.0 ** (n - 1), 30.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_is_the_fold(spark, seed):
    events = log(seed)
    assert shown(queue.retries(spark.createDataFrame(events, stream.EVENTS).repartition(3), 4, **DELAY)) == plain(events, 4, delay)
    assert queue.retries(spark.createDataFrame([], stream.EVENTS), 4).count() == 0


def test_stream_is_the_batch(spark, tmp_path):
    """Time is moved by the events themselves: a later file fires the timers of those before it, and not sooner."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = log(3)
    where, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    end = [(10_000 + k, 1e6 + k, "enqueue", "clock", 9, None, None) for k in range(2)]
    rows = stream.retry_rows(stream.events(spark, where, files=1), 4, **DELAY, jitter=0.2, wall_clock=False)
    seen = []
    for part in (events[:50], events[50:100], events[100:], end[:1], end[1:]):
        spark.createDataFrame(part, stream.EVENTS).coalesce(1).write.mode("append").parquet(where)
        stream.start_retries(rows, str(tmp_path / "ck"), out).awaitTermination(180)
        got = shown(spark.read.schema(stream.RETRIES).parquet(out))
        now = part[-1][1]
        assert all(x[5] == "superseded" or x[4] is None or x[4] <= now for x in got)
        seen.append(len(got))
    want = shown(queue.retries(spark.createDataFrame(events, stream.EVENTS), 4, **DELAY, jitter=0.2))
    assert got == want and seen == sorted(seen) and 0 < seen[0] < seen[-1]
    assert {x[5] for x in got} == {"retry", "superseded", "failed"}
    # the draws are not all alike, and stay within a fifth
    parts = {round((x[4] - x[3]) / delay(x[2]), 3) for x in got if x[4] is not None}
    assert len(parts) > 10 and all(0.8 <= p <= 1.2 for p in parts)


def test_timers_follow_the_clock(spark, tmp_path):
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    now = time.time()
    spark.createDataFrame([(1, now - 60, "error", "a", 0, None, None), (2, now, "error", "b", 0, None, None)], stream.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = stream.retry_rows(stream.events(spark, str(tmp_path / "in")), 3, base=50.0)
    q = rows.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        ends = time.time() + 90
        got = []
        while not got and time.time() < ends:
            time.sleep(1)
            if any((tmp_path / "out").glob("*.parquet")):
                got = shown(spark.read.schema(stream.RETRIES).parquet(str(tmp_path / "out")))
    finally:
        q.stop()
    assert [x[0] for x in got] == ["a"] and got[0][5] == "retry"
