"""Exact dedup by content sort.

Texts are compared after deleting space and \\t..\\r. Sampled splitters range-partition the
normalised bytes, an external sort puts equals next to each other, and neighbouring texts are compared in
full. Of equal texts the row with the most code points, then the smallest id, stays.

Splitters are (32 leading characters, 64-bit hash, id), so the sample that reaches the driver is
small whatever the texts' length, and a group of copies of any size is cut over several ranges:
no task gets more than its share. A group cut by a border leaves its parts at the ends of ranges;
only these two runs of each range are merged, again by full comparison of the neighbours, through a table
with two rows a partition. Texts are shuffled once.

Defined cases: null counts as an empty text, and all-blank texts are equal; null ids rank last; of
fully equal rows one is kept; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, batches, durable, only, text_or_empty

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
OUT = "doc_id long, n long, text_sha256 string, run long, place long, run_n long, run_size long, run_best long, run_place long, edge long, edge_text string"
ARROW = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in OUT.split(", ")])
#: So many rows of ends are broadcast; more are joined by shuffle.
MOST_ENDS = 100_000
NO_ID = 2**63 - 1  # ranks a null id last


def normalise(text):
    return F.translate(text, BLANK, "")


def _runs(it):
    """Sorted rows (doc_id, n, norm) to rows with their run's size and best row. edge: 1 first run
    of the partition, 2 last, 3 both, whose text is given with its first row."""
    pid = TaskContext.get().partitionId()
    run, text, rows, digest = 0, None, [], ""

    def flush(last: bool):
        best = min(range(len(rows)), key=lambda i: (-rows[i][1], NO_ID if rows[i][0] is None else rows[i][0], i))
        edge = (run == 0) + 2 * last
        n, m = len(rows), rows[best][1]
        at = (pid << 32) + run
        return batch(
            ARROW, [r[0] for r in rows], [r[1] for r in rows], [digest] * n, [at] * n, range(n), [m] * n, [n] * n, [rows[best][0]] * n, [best] * n, [edge] * n,
            [text.as_py() if edge and i == 0 else None for i in range(n)],
        )

    done: list[pa.RecordBatch] = []
    for b in batches(it):
        norm = b.column(2)
        same = [text is not None and pc.equal(text, norm[0]).as_py(), *pc.equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_pylist()] if len(norm) else []
        for i, (doc, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            if not same[i]:
                if rows:
                    done.append(flush(False))
                    run += 1
                text, rows = norm[i], []
                digest = hashlib.sha256(text.as_buffer()).hexdigest()
            rows.append((doc, n))
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            done = []
        if text is not None:  # don't hold the batch
            text = pa.scalar(text.as_py())
    if rows:
        yield flush(True)


def _merged(runs: DataFrame) -> DataFrame:
    """run, size, best, best_run, best_place of the runs at the ends of ranges, merged over borders.
    Two rows a partition at most."""
    ends = runs.filter(F.col("edge_text").isNotNull()).select("run", "run_n", "run_size", "run_best", "run_place", "edge", F.shiftright("run", 32).alias("pid"), "edge_text")
    order = Window.orderBy("run")
    before = ends.drop("edge_text").select("*", F.lag("run").over(order).alias("before"), F.lag("pid").over(order).alias("before_pid"))
    texts = ends.select(F.col("run").alias("r"), F.col("edge_text").alias("t"))
    same = (
        before.filter("before is not null and before_pid <> pid")
        .join(texts.withColumnsRenamed({"r": "run", "t": "own"}), "run")
        .join(texts.withColumnsRenamed({"r": "before", "t": "other"}), "before")
        .filter("own = other")
        .select("run", F.lit(0).alias("new"))
    )
    grouped = before.join(same, "run", "left").withColumn("group", F.sum(F.coalesce("new", F.lit(1))).over(order))
    rank = F.struct((-F.col("run_n")).alias("n"), F.coalesce("run_best", F.lit(NO_ID)).alias("id"), "run", "run_best", "run_place")
    whole = grouped.groupBy("group").agg(F.sum("run_size").alias("size"), F.min(rank).alias("b"))
    return grouped.select("run", "group").join(whole, "group").select("run", "size", F.col("b.run_best").alias("best"), F.col("b.run").alias("best_run"), F.col("b.run_place").alias("best_place"))


def dedup(documents: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """One row per row of documents: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = only(documents, doc_id=doc_id, text=text).withColumn("text", text_or_empty())
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("n"), normalise(F.col("text")).alias("norm"))
    keyed = keyed.select("*", F.substring("norm", 1, 32).alias("head"), F.xxhash64("norm").alias("h"))
    ranged = keyed.repartitionByRange("head", "h", "doc_id").sortWithinPartitions("head", "h", "norm", "doc_id")
    runs = durable(ranged.select("doc_id", "n", "norm").mapInArrow(_runs, OUT), "content-runs")
    ends = durable(_merged(runs), "content-ends")  # two rows a partition at most
    joined = runs.join(F.broadcast(ends) if ends.count() <= MOST_ENDS else ends.hint("merge"), "run", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("run_best")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("size", "run_size").alias("group_size"),
        ((F.coalesce("best_run", "run") == F.col("run")) & (F.coalesce("best_place", "run_place") == F.col("place"))).alias("kept"),
        "text_sha256",
    )


def kept_rows(documents: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """documents without the rows that `dedup` drops, all columns."""
    key = lambda d, i, t: [F.col(i).isNull().alias("_no_id"), F.coalesce(F.col(i).cast("long"), F.lit(NO_ID)).alias("_id"), t.alias("_digest")]
    stay = dedup(documents, doc_id, text).filter("kept")
    stay = stay.select(*key(stay, "doc_id", F.col("text_sha256")))
    own = documents.select(F.struct(*(documents[f"`{c}`"] for c in documents.columns)).alias("row"))
    t = F.coalesce(F.col("row")[text], F.lit(""))
    keyed = own.select("row", *key(own, f"row.`{doc_id}`", F.sha2(normalise(t), 256)), (-F.length(t)).alias("_n"), F.xxhash64(t).alias("_h"))
    keys = ["_no_id", "_id", "_digest"]
    one = Window.partitionBy(*keys).orderBy("_n", "_h")  # of rows equal in id and normalised text
    return keyed.join(stay, keys, "left_semi").withColumn("_k", F.row_number().over(one)).filter("_k = 1").select("row.*")
