"""Exact vector search and duplicate rules over embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canon_key
from .metric import WIDE, WIDE_PAIRS, Metric



def topk(queries: DataFrame, index: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """query_id, rank, id, score of the k nearest of each query. queries, index: id, e. Blocks that cannot hold a neighbour are never joined. Ties go to the smaller id."""
    metric = Metric.of(index, WIDE)
    if metric is None:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    return metric.topk(queries, k, least)


def similar(queries: DataFrame, index: DataFrame, least: float) -> DataFrame:
    """query_id, id, score of all pairs of different ids that reach the threshold."""
    metric = Metric.of(index, WIDE_PAIRS)
    return metric.pairs(queries, least) if metric else queries.sparkSession.createDataFrame([], "query_id long, id long, score double")


def in_batch(batch: DataFrame, threshold: float) -> DataFrame:
    """position, best_score, duplicate_of of a batch (position, e): a candidate is a duplicate if the best match among all
    others reaches the threshold and came earlier. A better match that came later hides an earlier one."""
    e = batch.select(F.col("position").alias("id"), "e")
    best = topk(e, e, 1).select(F.col("query_id").alias("position"), F.greatest("score", F.lit(0.0)).alias("best_score"), F.col("id").alias("other"))
    return best.select("position", "best_score", F.when((F.col("best_score") >= threshold) & (F.col("other") < F.col("position")), F.col("other")).alias("duplicate_of"))


def decision(db: Column, batch: Column, duplicate_of: Column, indexed: Column, threshold: float, action: str, answer: Column | None = None) -> Column:
    """struct(decision, reason). indexed: whether the index holds anything. answer: the recorded judgement; none counts as duplicate."""
    made = lambda d, r: F.struct(F.lit(d).alias("decision"), r.alias("reason"))
    out = F.when(duplicate_of.isNotNull(), made("reject", F.lit("within_batch_duplicate"))).when((F.greatest(db, batch) < threshold) | ~indexed, made("accept", F.lit("below_threshold")))
    if action == "reject":
        return out.otherwise(made("reject", F.when(db >= threshold, "above_threshold_db").otherwise("above_threshold_batch")))
    same = F.coalesce(answer, F.lit(True)) if answer is not None else F.lit(True)
    return out.when(same, made("reject", F.lit("llm_duplicate"))).otherwise(made("accept", F.lit("llm_distinct")))


def single(db: Column, threshold: float, action: str, answer: Column | None = None) -> Column:
    """The rule for candidates of one parent."""
    made = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    out = F.when(db < threshold, made("accept", "below_threshold"))
    if action == "reject":
        return out.otherwise(made("reject", "above_threshold_reject"))
    same = F.coalesce(answer, F.lit(True)) if answer is not None else F.lit(True)
    return out.when(same, made("reject", "llm_duplicate")).otherwise(made("accept", "llm_distinct"))


def committed(index: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """index with new rows of its dimension whose canonical key it lacks; the first of equal keys by position."""
    ok = new.filter(F.size("e") == dim).groupBy("canon_key").agg(F.min_by(F.struct("id", "e"), "position").alias("r")).select("canon_key", "r.*")
    return index.unionByName(ok.join(index, "canon_key", "left_anti"))


def loaded(rows: DataFrame) -> DataFrame:
    """Rows (position, canon_key, id, e) of the first row's dimension, first of each key."""
    dim = rows.filter("e is not null").agg(F.min_by(F.size("e"), "position").alias("dim"))
    return rows.crossJoin(F.broadcast(dim)).filter(F.size("e") == F.col("dim")).groupBy("canon_key").agg(F.min_by(F.struct("id", "e"), "position").alias("r")).select("canon_key", "r.*")


def hashed_embedding(words: Column, dim: int = 64) -> Column:
    """A stand-in for a model: signed counts of hashed words, of length one. Where the signs cancel in all places, the counts stand without them, so that no text with words is zero."""
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731 - the value is computed once, each word is hashed once
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int") + 1
    placed = F.transform(words, lambda w: F.when(F.pmod(F.hash(w), F.lit(2)) == 0, place(w)).otherwise(-place(w)))
    slots = F.sequence(F.lit(1), F.lit(dim))
    held = lambda p, i: F.size(F.filter(p, lambda x: x == i)).cast("double")
    counts = lambda p: let(F.transform(slots, lambda i: held(p, i) - held(p, -i)), lambda v: F.when(F.exists(v, lambda x: x != 0), v).otherwise(F.transform(slots, lambda i: held(p, i) + held(p, -i))))
    return let(let(placed, counts), lambda raw: let(F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.transform(raw, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)).cast("float"))))


def missing(queue: DataFrame, have: DataFrame) -> DataFrame:
    """canon_key, subject, hop of queue rows (subject, hop, line_no) without a vector, at the least hop of each canonical key. have: canon_key."""
    keyed = queue.withColumn("canon_key", canon_key(F.col("subject"))).filter("canon_key <> ''")
    first = keyed.groupBy("canon_key").agg(F.min_by(F.struct("subject", "hop"), F.struct("hop", "line_no")).alias("r"))
    return first.join(have, "canon_key", "left_anti").select("canon_key", "r.*")
