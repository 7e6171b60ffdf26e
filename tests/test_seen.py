"""Seen keys in buckets: right answers, and plans that deal out new keys only."""

import random

from pyspark.sql import functions as F

from mosswork.operators.stored import stored
from mosswork.plans import crawl
from mosswork.plans.seen import SeenKeys


def table(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "canon_key string")


def test_levels_of_keys(spark):
    r = random.Random(2)
    seen, plain = SeenKeys(spark, buckets=8), set()
    assert seen.met(table(spark, ["a"]), "canon_key").count() == 0 and seen.new(table(spark, ["a"]), "canon_key").count() == 1
    for level in range(4):
        asked = {f"k{r.randrange(4000)}" for _ in range(1500)} | {"", "é", f"only {level}"}
        new = {x.canon_key for x in seen.new(table(spark, asked), "canon_key").collect()}
        assert new == asked - plain
        rows = table(spark, asked).select(F.col("canon_key").alias("form"), F.lit(level).alias("n"))
        assert {x.form for x in seen.met(rows, "form").collect()} == asked & plain
        maybe = seen.maybe(rows, "form").count()
        assert len(asked & plain) <= maybe <= len(asked & plain) + 10  # the filter is nearly empty
        seen.add(table(spark, sorted(new) * 2))
        plain |= new
    assert seen.keys.count() == len(plain)
    seen.drop()


def test_only_the_frontier_is_shuffled(spark):
    seen = SeenKeys(spark, buckets=8)
    for k in range(3):
        seen.add(spark.range(k * 1000, (k + 1) * 1000).select(F.concat(F.lit("k"), "id").alias("canon_key")))
    asked = spark.range(2500, 6000).select(F.concat(F.lit("k"), "id").alias("form"))
    plan = seen.met(asked, "form")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
    # the one exchange stands over the asked keys, which the filter has thinned out
    scan, exchange = plan.index("Bucketed: true"), plan.index("Exchange hashpartitioning")
    assert exchange < scan and "BroadcastHashJoin" in plan[exchange:scan]
    assert seen.met(asked, "form").count() == 500
    seen.drop()


def test_tree_by_levels(spark):
    edges = spark.createDataFrame([(i, j) for i in range(300) for j in (2 * i + 1, 2 * i + 2, i // 2)], "parent long, child long")
    got = {tuple(x) for x in crawl.levels(spark.createDataFrame([(0,)], "node long"), edges, lambda df, name: stored(df)).collect()}
    assert got == {(i, (i + 1).bit_length() - 1) for i in range(601)}
