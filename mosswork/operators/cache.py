"""A cache with lifetimes as a fold over its log: get, set, delete, and eviction of what was used longest ago.

Keys are dealt into shards by hash, each a cache of its own with its share of the capacity, as the order of use decides what is evicted. The same fold runs over a stored log,
where a shard's operations stream through one task that holds no more than its entries, and as a stream, where the entries are the shard's state."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: ordinal, ts in seconds, op (get, set or delete), namespace, key, value.
OPS = "ordinal long, ts double, op string, namespace string, key string, value string"
#: hit: a get that found something, a delete that removed something; a set is always one. evicted: how many entries went for a set.
TOLD = "ordinal long, op string, namespace string, key string, hit boolean, value string, evicted int"


@dataclass
class Shard:
    """Entries (namespace, key) -> (value, written, used), `capacity` at most. A full cache drops its tenth that was used longest ago, so that a set costs little in the mean."""

    capacity: int
    ttl: float
    entries: dict[tuple, tuple] = field(default_factory=dict)
    changed: set = field(default_factory=set)

    def apply(self, ordinal: int, ts: float, op: str, namespace: str, key: str, value: str | None) -> tuple:
        at, evicted, hit, found = (namespace, key), 0, False, None
        entry = self.entries.get(at)
        if entry and ts - entry[1] > self.ttl:  # its time is over
            self._drop(at)
            entry = None
        if op == "get" and entry:
            hit, found = True, entry[0]
            self._put(at, (entry[0], entry[1], ordinal))
        elif op == "delete" and entry:
            hit = True
            self._drop(at)
        elif op == "set":
            if not entry and len(self.entries) >= self.capacity:
                oldest = sorted(self.entries, key=lambda k: self.entries[k][2])[: max(1, self.capacity // 10)]
                evicted = len(oldest)
                for k in oldest:
                    self._drop(k)
            hit = True
            self._put(at, (value, ts, ordinal))
        return ordinal, op, namespace, key, hit, found, evicted

    def _put(self, at: tuple, entry: tuple) -> None:
        self.entries[at] = entry
        self.changed.add(at)

    def _drop(self, at: tuple) -> None:
        del self.entries[at]
        self.changed.add(at)


_COLUMNS = ["ordinal", "op", "namespace", "key", "hit", "value", "evicted"]


def sharded(ops: DataFrame, shards: int) -> DataFrame:
    return ops.select(F.pmod(F.xxhash64("namespace", "key"), F.lit(shards)).cast("int").alias("shard"), "ordinal", "ts", "op", "namespace", "key", "value")


def _frame(told: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(told, columns=_COLUMNS).astype({"ordinal": "int64", "hit": "bool", "evicted": "int32"})


def answers(ops: DataFrame, ttl_seconds: float, capacity: int, shards: int = 64) -> DataFrame:
    """What each operation of a log gave, in the log's order. capacity: entries of all shards together."""
    share = max(1, capacity // shards)

    def fold(it):
        shard, cache = None, None
        for b in it:
            told = []
            for row in b.itertuples(index=False, name=None):
                if row[0] != shard:
                    shard, cache = row[0], Shard(share, ttl_seconds)
                told.append(cache.apply(*row[1:]))
                cache.changed.clear()
            if told:
                yield _frame(told)

    return sharded(ops, shards).repartition("shard").sortWithinPartitions("shard", "ordinal").mapInPandas(fold, TOLD)


class CacheState(StatefulProcessor):
    """A shard's entries as state; the operations of a micro-batch go by ordinal."""

    def __init__(self, capacity: int, ttl: float):
        self.capacity, self.ttl = capacity, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("entries", "namespace string, key string", "value string, written double, used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        shard = Shard(self.capacity, self.ttl, {tuple(k): tuple(v) for k, v in self.state.iterator()})
        told = [shard.apply(r.ordinal, r.ts, r.op, r.namespace, r.key, r.value) for r in pd.concat(list(rows)).sort_values("ordinal").itertuples()]
        for at in shard.changed:
            if at in shard.entries:
                self.state.updateValue(at, shard.entries[at])
            elif self.state.containsKey(at):
                self.state.removeKey(at)
        yield _frame(told)

    def close(self) -> None:
        pass


def stream(ops: DataFrame, ttl_seconds: float, capacity: int, shards: int = 64) -> DataFrame:
    """As `answers`, for a stream of operations."""
    return sharded(ops, shards).groupBy("shard").transformWithStateInPandas(CacheState(max(1, capacity // shards), ttl_seconds), TOLD, "Append", "None")
