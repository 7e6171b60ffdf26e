"""Places in an order: exact whatever plans and adaptive execution do."""

import random

import pytest
from pyspark.sql import functions as F

from mosswork.operators import index, queue
from mosswork.operators.ranges import Ranges, numbered


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.adaptive.enabled", before)


def exact(placed, key):
    """Rows, and whether places are 0.. in the order of key, which is unique."""
    n = placed.count()
    a = placed.agg(F.countDistinct("place"), F.min("place"), F.max("place")).first()
    return n, tuple(a) == (n, 0, n - 1)


@pytest.mark.parametrize("wide", [True, False])
def test_a_million_rows(spark, adaptive, wide, tmp_path):
    n = 1_000_000
    rows = spark.range(0, n, 1, 8).select(F.xxhash64("id").alias("k"), F.pmod(F.col("id"), F.lit(5)).cast("int").alias("hop"))
    if wide:
        rows = rows.withColumns({"pad": F.repeat(F.lit("wide "), 20), "more": F.sha2(F.col("k").cast("string"), 256)})
    rows.write.parquet(str(tmp_path / "rows"))
    for source in (rows, spark.read.parquet(str(tmp_path / "rows"))):
        placed = numbered(source, "place", F.col("hop"), F.col("k"), size=30_000)
        assert exact(placed, "k") == (n, True)
        # each hop has a fifth of the rows, and neighbours are in order
        assert {tuple(r) for r in placed.groupBy("hop").agg(F.min("place"), F.max("place")).collect()} == {(h, h * n // 5, (h + 1) * n // 5 - 1) for h in range(5)}
        some = placed.filter("hop = 3 and pmod(k, 997) = 5").select("k", "place").collect()
        by_place = sorted(some, key=lambda r: r.place)
        assert len(some) > 100 and [r.k for r in by_place] == sorted(r.k for r in some)


def test_ten_million_rows(spark, adaptive):
    placed = numbered(spark.range(0, 10_000_000, 1, 16).select(F.xxhash64("id").alias("k")), "place", F.col("k"))
    a = placed.agg(F.count("*"), F.sum("place"), F.max("place"), F.bit_xor("place")).first()
    assert tuple(a)[:3] == (10_000_000, 10_000_000 * 9_999_999 // 2, 9_999_999)
    sign = placed.agg(F.min_by("place", "k"), F.max_by("place", "k")).first()
    assert tuple(sign) == (0, 9_999_999)


def test_operators_on_a_million_rows(spark):
    n = 1_000_000
    rows = spark.range(0, n, 1, 8).select(F.when(F.col("id") % 3 == 0, F.col("id") * 1.5).alias("retry_at"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("created_at"), F.concat(F.lit("s"), "id").alias("subject"), F.lit(0).alias("hop"))
    assert exact(queue.with_order(rows), "subject") == (n, True)
    entries = spark.range(0, n, 1, 8).select("id", F.concat(F.lit("T"), F.xxhash64("id").cast("string")).alias("title"), (F.col("id") % 4).cast("int").alias("hop"))
    assert exact(index.browse_order(entries), "id") == (n, True)


def test_small_and_odd_orders(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "", "a", "é", "z"]), r.choice([None, 1, 2]), i) for i in range(500)] + [("a", 1, 7)] * 3
    df = spark.createDataFrame(rows, "t string, h int, place_ int").repartition(4)
    for size in (1000, 20, 3):
        got = sorted((x.place, x.t, x.h, x.place_) for x in numbered(df, "place", F.col("h"), F.col("t"), size=size).collect())
        assert [x[0] for x in got] == list(range(len(rows)))
        keys = [((x[2] is not None, x[2] or 0), (x[1] is not None, (x[1] or "").encode())) for x in got]
        assert keys == sorted(keys) and sorted(map(repr, (x[1:] for x in got))) == sorted(repr(x) for x in rows)
    assert numbered(df.limit(0), "place", F.col("t")).count() == 0


def test_splitters_are_kept(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("a"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("b"))
    made = Ranges.of(df, {"b": F.col("b"), "a": F.col("a")}, size=100)
    assert len(made) > 10
    made.table(df).write.parquet(str(tmp_path / "s"))
    again = Ranges.read(spark.read.parquet(str(tmp_path / "s")))
    assert again.splitters == made.splitters
    one, other = ({tuple(x) for x in m.part(d, F.col("b"), F.col("a")).select("a", "_part").collect()} for m, d in ((made, df), (again, df.repartition(9))))
    assert one == other and len({p for _, p in one}) == len(made)
    below = {p: max((b is not None, (b or ""), a) for a, b, q in ((x.a, x.b, x._part) for x in made.part(df, F.col("b"), F.col("a")).collect()) if q == p) for p in range(len(made))}
    assert [below[p] for p in sorted(below)] == sorted(below.values())


def test_f9_rows_are_placed_once(spark, tmp_path):
    """Rows are read for their number, sampled and dealt out; what is read afterwards is a table of places, not the rows and their ranges again."""
    spark.range(0, 50_000, 1, 4).select(F.xxhash64("id").alias("k")).write.parquet(str(tmp_path / "rows"))
    placed = numbered(spark.read.parquet(str(tmp_path / "rows")), "place", F.col("k"), size=1000)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and not [f for f in placed.inputFiles() if str(tmp_path) in f]
    assert exact(placed, "k") == (50_000, True)
    assert [r.k for r in placed.sort("place").collect()] == sorted(r.k for r in placed.collect())
