"""The keys that an expansion has seen: a table in buckets that only grows, with a Bloom filter in front."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stored import folder, stored

#: Bits of the filter, in words of 64, and bits of a key. The filter never has more than 2**17 rows, whatever was seen.
WORDS, HASHES = 1 << 17, 3


def _places(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(64 * WORDS)) for k in range(HASHES)]


class SeenKeys:
    """Keys (canon_key) of all levels. Each level's keys are written into the buckets of one table, sorted, so a join with keys deals out and sorts those keys only, never
    what was seen before. Keys that the filter does not know are new without any join."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        """As many buckets as the session has shuffle partitions, if not told."""
        self.spark, self.buckets = spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"seen_{uuid.uuid4().hex}"
        self.path = f"{folder(spark)}/{self.name}"
        self.bits: DataFrame | None = None

    def add(self, keys: DataFrame) -> None:
        """keys: canon_key, none of them seen before. Repeats within keys go."""
        keys = keys.select("canon_key").distinct()
        keys.repartition(self.buckets, "canon_key").write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, "canon_key").sortBy("canon_key").saveAsTable(self.name)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(where)
        at = keys.select(F.explode(F.array(*_places(F.col("canon_key")))).alias("at"))
        bits = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        if self.bits is not None:
            bits = bits.unionByName(self.bits).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        self.bits = stored(bits)

    @property
    def keys(self) -> DataFrame:
        return self.spark.table(self.name)

    def maybe(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows that the filter does not rule out: nearly all that were seen, and few others while the filter is not full."""
        if self.bits is None:
            return rows.limit(0)
        columns = rows.columns
        for k, at in enumerate(_places(F.col(key))):
            bits = self.bits.select(F.col("word").alias(f"_w{k}"), F.col("bits").alias(f"_b{k}"))
            rows = rows.withColumn(f"_at{k}", at).join(F.broadcast(bits), F.shiftright(F.col(f"_at{k}"), 6) == F.col(f"_w{k}"))
            rows = rows.filter(f"shiftright(_b{k}, cast(_at{k} & 63 as int)) & 1 = 1")
        return rows.select(*(f"`{c}`" for c in columns))

    def met(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows whose key was seen."""
        if self.bits is None:
            return rows.limit(0)
        known = self.keys.select(F.col("canon_key").alias("_known"))
        return self.maybe(rows, key).join(known.hint("merge"), F.col(key) == F.col("_known"), "left_semi")

    def new(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows (distinct keys) whose key was not seen."""
        seen = self.met(rows.select(key), key).select(F.col(key).alias("_seen"))
        return rows.join(seen, F.col(key) == F.col("_seen"), "left_anti")

    def drop(self) -> None:
        """The table, once no lazy result reads it."""
        self.spark.sql(f"drop table if exists {self.name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
