"""Ranges by explicit splitters: sampled once, kept as values, and used by every reader; and places in an order, from sorted ranges that are written once.

The number of a row's range is computed from its own keys and the splitters, never from the task that happens to hold it, so any two
readers of the same rows agree, whatever plans, exchanges and adaptive execution do to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stored import stored

#: Rows that a range is to have, and ranges at most; a longer range is sorted outside of memory.
ROWS, MOST = 1 << 17, 4096
#: Files of places at most: a task each, so a range of a large table has more rows than it is to have.
FILES = 1024
#: Sampled keys of a range.
SAMPLED = 24


@dataclass(frozen=True)
class Ranges:
    """splitters: ascending keys; range k holds what is above splitter k - 1 and not above splitter k."""

    names: tuple[str, ...]
    kind: T.StructType
    splitters: tuple[tuple, ...]

    @classmethod
    def of(cls, rows: DataFrame, order: dict[str, Column], size: int = ROWS, count: int | None = None) -> Ranges:
        """Splitters for rows in this order, nulls first. What is sampled decides how even ranges are, not what is right."""
        names = tuple(order)
        keys = rows.select(*(c.alias(n) for n, c in order.items()))
        count = keys.count() if count is None else count
        parts = min(MOST, -(-count // size))
        if parts < 2:
            return cls(names, keys.schema, ())
        drawn = keys.sample(min(1.0, 1.2 * SAMPLED * parts / count), seed=11).limit(4 * SAMPLED * parts)
        # a sample of a bounded number of keys, in order
        told = [tuple(r) for r in drawn.sort(*names).collect()]
        cut = dict.fromkeys(told[k * len(told) // parts] for k in range(1, parts)) if told else {}
        return cls(names, keys.schema, tuple(cut))

    def __len__(self) -> int:
        return len(self.splitters) + 1

    def table(self, rows: DataFrame) -> DataFrame:
        """The splitters as rows, to be written and read back by `read`."""
        return rows.sparkSession.createDataFrame([(k, *s) for k, s in enumerate(self.splitters)], T.StructType([T.StructField("_k", T.IntegerType()), *self.kind]))

    @classmethod
    def read(cls, table: DataFrame) -> Ranges:
        told = sorted(map(tuple, table.collect()))
        return cls(tuple(table.columns[1:]), T.StructType(table.schema[1:]), tuple(r[1:] for r in told))

    def part(self, rows: DataFrame, *keys: Column) -> DataFrame:
        """rows with `_part`, by halving over the splitters, which travel as one broadcast row."""
        if not self.splitters:
            return rows.withColumn("_part", F.lit(0))
        steps = [1 << k for k in reversed(range(len(self.splitters).bit_length()))]
        array = rows.sparkSession.createDataFrame([([Row(**dict(zip(self.names, s, strict=True))) for s in self.splitters],)], T.StructType([T.StructField("_splitters", T.ArrayType(self.kind))]))
        key = F.struct(*(k.alias(n) for n, k in zip(self.names, keys, strict=True)))
        step = lambda at, s: F.when(F.coalesce(F.get("_splitters", at + s - 1) < F.col("_key"), F.lit(False)), at + s).otherwise(at)
        found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)
        return rows.withColumn("_key", key).crossJoin(F.broadcast(array)).withColumn("_part", found).drop("_splitters", "_key")


def numbered(rows: DataFrame, name: str, *order: Column, size: int = ROWS) -> DataFrame:
    """rows with their place in an order, from 0. They are dealt into sorted ranges of some `size` rows and written once, each with its range and its place there; the sizes of
    the ranges before, a row each, are added when that table is read. An order that leaves ties is completed by the hash of the row; rows equal in all share a range."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    keys = {f"_o{i}": c for i, c in enumerate(order)} | {"_tie": F.xxhash64(*(rows[f"`{c}`"] for c in rows.columns))}
    parts = max(1, min(FILES, -(-rows.count() // size)))
    ranged = rows.withColumns(keys).repartitionByRange(parts, *map(F.col, keys)).sortWithinPartitions(*keys)
    # a number is its task's in the upper bits and the row's place in the task in the lower 33; the table is what every reader sees
    placed = stored(ranged.select(*columns, F.monotonically_increasing_id().alias("_number")))
    part, at = F.shiftright("_number", 33), F.col("_number").bitwiseAND((1 << 33) - 1)
    before = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select(F.col("_part"), "_before")
    # FILES rows at most are broadcast
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").select(*columns, (F.col("_before") + at).alias(name))
