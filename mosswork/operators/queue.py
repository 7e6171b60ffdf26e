"""The work queue as a fold over its event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered
from .stored import stored

KEY = ["subject", "hop"]
#: Steps between the least and the largest jitter.
DRAWS = 1 << 20


def retry_delay(retry: Column, base: float = 5.0, backoff: float = 2.0, cap: float = 120.0, jitter: float = 0.0, of: Column | None = None) -> Column:
    """Seconds before that retry; exponential under a cap, give or take the part `jitter` of it. The draw is a hash of what `of` names and
    the retry, so every reader and every repeat of a task has the same."""
    raw = F.lit(max(0.0, base)) * F.pow(F.lit(max(1.0, backoff)), F.greatest(retry - 1, F.lit(0)))
    raw = F.least(raw, F.lit(cap)) if cap > 0 else raw
    if jitter > 0:
        drawn = F.pmod(F.xxhash64(F.concat_ws(":", of, retry.cast("string"))), F.lit(DRAWS)) / (DRAWS / 2) - 1
        raw = F.greatest(raw * (1 + jitter * drawn), F.lit(0.0))
        raw = F.least(raw, F.lit(cap)) if cap > 0 else raw
    return raw


def retries(events: DataFrame, max_retries: int = 3, **delay) -> DataFrame:
    """subject, hop, retry, failed_at, due_at, outcome of the errors of a queue's events: `failed` is the last that counts, `superseded` one whose row had another event before it was
    due, `retry` one that puts its row back. Only the first errors of a key count, so the window keeps max_retries rows of a key in each task before it shuffles; the next
    event of each of them is a partial minimum."""
    of = Window.partitionBy(*KEY).orderBy("ordinal")
    errors = events.filter("event = 'error'").select(*KEY, "ordinal", "ts").withColumn("retry", F.row_number().over(of)).filter(F.col("retry") <= max_retries)
    errors = stored(errors)
    later = events.select(*KEY, F.col("ordinal").alias("o"), F.col("ts").alias("t")).join(errors.select(*KEY, "ordinal", "retry"), KEY).filter("o > ordinal")
    next_ = later.groupBy(*KEY, "retry").agg(F.min_by("t", "o").alias("next"))
    due = F.col("ts") + retry_delay(F.col("retry"), **delay, of=F.concat_ws(":", "subject", F.col("hop").cast("string")))
    told = errors.join(next_, [*KEY, "retry"], "left").withColumn("due_at", F.when(F.col("retry") < max_retries, due))
    outcome = F.when(F.col("due_at").isNull(), "failed").when(F.col("next") <= F.col("due_at"), "superseded").otherwise("retry")
    return told.select(*KEY, "retry", F.col("ts").alias("failed_at"), "due_at", outcome.alias("outcome"))


def state(events: DataFrame, max_retries: int = 3, base: float = 5.0, backoff: float = 2.0, cap: float = 120.0) -> DataFrame:
    """Queue rows of events (ordinal, ts in seconds, event, subject, hop, parent_subject, parent_hop).

    Of a key the first enqueue inserts, later ones fill missing parents; errors count up to failure; of the last
    claim, done, error and reset the latest sets the status. Everything is one partial aggregation by key:
    a key that a third of all events name is one row a task."""
    on = lambda *e: F.col("event").isin(*e)
    errors = F.count_if(on("error"))
    last = F.max_by(F.when(on("claim", "done", "error", "reset"), F.col("event")), F.when(on("claim", "done", "error", "reset"), F.col("ordinal")))
    first_parent = lambda c: F.min_by(F.when(on("enqueue"), F.col(c)), F.when(on("enqueue") & F.col(c).isNotNull(), F.col("ordinal")))
    rows = events.groupBy(*KEY).agg(
        F.count_if(on("enqueue")).alias("enqueued"), errors.alias("errors"), last.alias("last"), F.max(F.when(on("error"), F.col("ts"))).alias("failed_at"),
        F.min(F.when(on("enqueue"), F.col("ts"))).alias("created_at"), F.min(F.when(on("enqueue"), F.col("ordinal"))).alias("position"),
        first_parent("parent_subject").alias("parent_subject"), first_parent("parent_hop").alias("parent_hop"),
    )
    rows = rows.filter("enqueued > 0").withColumn("retries", F.least(F.col("errors"), F.lit(max_retries)))
    status = (
        F.when(F.col("last") == "done", "done").when((F.col("last") == "error") & (F.col("errors") >= max_retries), "failed").when(F.col("last") == "claim", "working").otherwise("pending")
    )
    retry = F.when((status == "pending") & (F.col("errors") > 0), F.col("failed_at") + retry_delay(F.col("errors"), base, backoff, cap))
    return rows.select(*KEY, status.alias("status"), "retries", "created_at", "parent_subject", "parent_hop", retry.alias("retry_at"), "position")


def metrics(rows: DataFrame, max_depth: int = 0, *by: str) -> DataFrame:
    if max_depth:
        rows = rows.filter(F.col("hop") <= max_depth)
    return rows.groupBy(*by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("done", "working", "pending", "failed")))


def claim(rows: DataFrame, n: int, now: float, max_depth: int = 0) -> DataFrame:
    """The next n rows: due retries first, then new ones, each in order of arrival. A global order of at most n rows: each task keeps n."""
    ready = rows.filter((F.col("status") == "pending") & (F.col("retry_at").isNull() | (F.col("retry_at") <= now)))
    if max_depth:
        ready = ready.filter(F.col("hop") <= max_depth)
    return ready.orderBy((F.col("retries") == 0).cast("int"), "position").limit(n)


def next_due(rows: DataFrame, now: float, max_depth: int = 0) -> DataFrame:
    waiting = rows.filter("status = 'pending'")
    if max_depth:
        waiting = waiting.filter(F.col("hop") <= max_depth)
    return waiting.agg(F.min(F.greatest(F.coalesce("retry_at", F.lit(now)) - now, F.lit(0.0))).alias("seconds"))


def last_write(rows: DataFrame, *key: str) -> DataFrame:
    """The last row of each key by `ordinal`."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), "ordinal").alias("r")).select(*key, "r.*")


def reset_working(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("status") == "working", "pending").otherwise(F.col("status")))


def with_order(rows: DataFrame) -> DataFrame:
    return numbered(rows, "place", F.coalesce("retry_at", F.lit(float("-inf"))), F.col("created_at"), F.col("subject"), F.col("hop"))
