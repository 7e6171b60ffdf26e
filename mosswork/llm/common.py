"""What the operators of this subpackage share: durable tables, row ids, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one in local mode only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own_dir:
        _own_dir[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="mosswork-")
    return _own_dir[sc.applicationId]


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage is cut, and a lost
    executor costs a reread only. The table goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mosswork-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.mosswork_path = jpath
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete durable tables that nothing reads any more."""
    for t in tables:
        t.mosswork_path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(t.mosswork_path, True)


def only(df: DataFrame, **columns) -> DataFrame:
    """The named columns under the operator's own names; missing ones raise, extra ones go.
    Names are matched as written, so dots and clashes with working columns do no harm."""
    return df.select(*(df[f"`{c}`"].alias(n) for n, c in columns.items()))


def text_or_empty(c="text"):
    return F.coalesce(F.col(c), F.lit(""))


def batches(it, rows: int = 2048, mb: int = 16):
    """Arrow batches cut so that none holds more than `rows` rows or, beyond one row, `mb` MB."""
    for b in it:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > mb << 20:
                n //= 2
            yield b.slice(at, n)
            at += n


def batch(schema: pa.Schema, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, schema.types, strict=True)], schema=schema)


#: A key is hot if it holds more than one in so many of the rows; so there are at most as many hot keys.
HOT = 1000


def joined(rows: DataFrame, told: DataFrame, *key: str) -> DataFrame:
    """rows joined with told (unique by key; its column `n` says how many of the rows have that key). Rows of hot keys
    stay where they are and meet at most HOT broadcast rows, so that no task gets all rows of one key; the others are joined by
    shuffle. `rows` and `told` are read more than once and should be durable."""
    total = told.agg(F.sum("n")).first()[0] or 0
    told, hot = told.filter(F.col("n") <= total // HOT), told.filter(F.col("n") > total // HOT)
    near = rows.join(F.broadcast(hot), list(key))
    far = rows.join(F.broadcast(hot.select(*key)), list(key), "left_anti")
    return near.unionByName(far.join(told.hint("merge"), list(key)))


def bound(value, f):
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values, combine):
    """Running totals of an array in as many rounds as its length has binary digits; no array is appended to."""
    step = lambda acc, r: F.transform(acc, lambda x, i: F.coalesce(combine(x, F.get(acc, i - F.pow(F.lit(2), r).cast("int"))), x))
    return bound(values, lambda v: F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(v), F.lit(1)))).cast("int")), v, step))
