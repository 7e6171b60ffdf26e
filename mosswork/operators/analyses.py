"""Evaluation analyses: coverage, factuality, overlap, similarity, style, hops, ablation."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.rates import mean, median, rate_or_zero, seeded, std, verdict_counts, verdict_rates
from ..functions.text import hop_bucket, ngrams
from .ranges import ROWS, Ranges
from .stored import stored

BUCKETS = [f"hop{i}" for i in range(5)] + ["hop5plus"]
# Order of prompts in ablation tables; both spellings of the calibrated one.
PROMPTS = {"baseline": 0, "calibrate": 1, "calibrated": 1, "soft": 2, "dont_know": 3}
#: Words whose n-grams are made distinct together; n-grams of a part, in all runs and before copies of other tasks meet.
WORDS, GRAMS = 1 << 18, 1 << 22


def min_hop(articles: DataFrame, words: Column | None = None, least: int = 0) -> DataFrame:
    """The article of least hop of each subject, first row of equals; the word filter comes first."""
    if words is not None:
        articles = articles.filter(F.size(words) >= least)
    others = [c for c in articles.columns if c != "subject"]
    return articles.groupBy("subject").agg(F.min_by(F.struct(*others), F.struct("hop", "line_no")).alias("r")).select("subject", "r.*")


def pick(articles: DataFrame, policy: str) -> DataFrame:
    """first, last, minhop or maxhop row of each subject."""
    others = F.struct(*(c for c in articles.columns if c != "subject"))
    rule = {
        "first": F.min_by(others, "line_no"), "last": F.max_by(others, "line_no"),
        "minhop": F.min_by(others, F.struct("hop", "line_no")), "maxhop": F.max_by(others, F.struct("hop", (-F.col("line_no")).alias("o"))),
    }[policy]
    return articles.groupBy("subject").agg(rule.alias("r")).select("subject", "r.*")


def verdict_stats(claims: DataFrame, *keys: str) -> DataFrame:
    return claims.groupBy(*keys).agg(*verdict_counts(F.col("verdict"))).withColumns(verdict_rates())


def frontier(records: DataFrame) -> DataFrame:
    """Records without a reference page carry their web rates once more as frontier columns, others null."""
    new = {f"frontier_{c}": F.when(F.col("is_frontier"), F.col(c)) for c in records.columns if c.startswith("web_")}
    return records.withColumns(new)


def run_means(records: DataFrame, run: list[str], measures: list[str], found: Column) -> DataFrame:
    """Means over the records of a run; measures over found records only, coverage over all."""
    return records.groupBy(*run).agg(F.count("*").alias("n"), F.avg(found.cast("double")).alias("coverage"), *(mean(F.when(found, F.col(m))).alias(m) for m in measures))


def mean_of_means(runs: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Mean and sample deviation over runs (or seeds) of their means."""
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), *(f(F.col(m)).alias(f"{m}_{n}") for m in measures for n, f in (("mean", mean), ("std", std))))


def pooled(records: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return records.groupBy(*keys).agg(F.count("*").alias("n"), *(mean(F.col(m)).alias(m) for m in measures))


def ratio_of_sums(records: DataFrame, keys: list[str], of: dict[str, tuple[str, str]]) -> DataFrame:
    return records.groupBy(*keys).agg(*(rate_or_zero(F.sum(n), F.sum(d)).alias(k) for k, (n, d) in of.items()))


def summary(records: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """mean, std, median, non-null count of each measure."""
    return records.groupBy(*keys).agg(*(e.alias(f"{m}_{n}") for m in measures for n, e in (("mean", mean(F.col(m))), ("std", std(F.col(m))), ("median", median(F.col(m))), ("n", F.count(m)))))


def sampled(subjects: DataFrame, key: str, n: int, seed: int, *by: str) -> DataFrame:
    """n rows by the order of a seeded hash, of each group of `by`. Without groups it is a top-n, of which each task keeps n rows."""
    order = [seeded(F.col(key), seed), F.col(key)]
    if not by:
        return subjects.orderBy(*order).limit(n)
    return subjects.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def quotas(subjects: DataFrame, key: str, seed: int, quota: dict[str, int]) -> DataFrame:
    """By hop bucket, as many as its quota; all if there are no more."""
    b = subjects.withColumn("bucket", hop_bucket(F.col("hop")))
    limit = F.create_map(*(F.lit(x) for kv in quota.items() for x in kv))
    r = F.row_number().over(Window.partitionBy("bucket").orderBy(seeded(F.col(key), seed), F.col(key)))
    return b.withColumn("_r", r).filter(F.col("_r") <= F.coalesce(F.try_element_at(limit, F.col("bucket")), F.lit(0))).drop("_r")


def hop_stats(articles: DataFrame, words: Column) -> DataFrame:
    """Every bucket, empty ones too: n, share in percent, mean, deviation and median of words."""
    spark = articles.sparkSession
    all_ = spark.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    rows = articles.select(hop_bucket(F.col("hop")).alias("bucket"), F.size(words).cast("double").alias("w")).groupBy("bucket").agg(
        F.count("*").alias("n"), F.avg("w").alias("words_mean"), F.stddev_samp("w").alias("words_std"), F.median("w").alias("words_median")
    )
    whole = rows.agg(F.sum("n").alias("whole"))
    full = all_.join(rows, "bucket", "left").crossJoin(F.broadcast(whole))
    return full.select("bucket", F.coalesce("n", F.lit(0)).alias("n"), (F.lit(100.0) * F.coalesce("n", F.lit(0)) / F.col("whole")).alias("pct"), "words_mean", "words_std", "words_median")


def set_overlap(members: DataFrame, group: str, item: str) -> DataFrame:
    """Each pair of groups (a < b): sizes, shared items, Jaccard, overlap coefficient. Pairs are counted through the
    items' sets of groups, of which there are few groups; equal sets are counted once with their number."""
    sets = members.select(group, item).distinct().groupBy(item).agg(F.sort_array(F.collect_list(group)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    sizes = sets.select(F.explode("g").alias("x"), "n").groupBy("x").agg(F.sum("n").alias("size"))
    pairs = sets.select("n", F.explode("g").alias("a"), "g").select("n", "a", F.explode("g").alias("b")).filter("a < b").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    every = sizes.select(F.col("x").alias("a"), F.col("size").alias("size_a")).join(sizes.select(F.col("x").alias("b"), F.col("size").alias("size_b")), F.col("a") < F.col("b"))
    full = every.join(pairs, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    union = F.col("size_a") + F.col("size_b") - F.col("shared")
    return full.withColumns({"jaccard": rate_or_zero(F.col("shared"), union), "overlap": rate_or_zero(F.col("shared"), F.least("size_a", "size_b"))})


def venn(members: DataFrame, group: str, item: str, groups: list[str]) -> DataFrame:
    """mask, n: how many items are in exactly those groups; bit i is groups[i]."""
    bit = F.lit(0)
    for i, g in enumerate(groups):
        bit = F.when(F.col(group) == g, 1 << i).otherwise(bit)
    return members.groupBy(item).agg(F.bit_or(bit).alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))


def found_anywhere(records: DataFrame, found: Column) -> DataFrame:
    return records.groupBy("subject").agg(F.bool_or(found).alias("found"))


def _word_hashes(words: pa.Array) -> list[np.ndarray]:
    """Each word as two lanes of 64 bits; a distinct word is hashed once."""
    told = words.dictionary_encode("encode")
    of = b"".join(hashlib.blake2b((w or "").encode(), digest_size=16).digest() for w in told.dictionary.to_pylist())
    return [lane[told.indices.to_numpy()] for lane in np.frombuffer(of, np.uint64).reshape(-1, 2).T]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _grams(schema: pa.Schema, parts: int):
    """Rows (run, w, m) to rows (part, run, k, grams): the hashes of n-grams of one to three words of a run that fall into a part, each once in so many WORDS. m: 0, or how many
    of the words stand before the border that an n-gram has to span."""
    steps = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))

    def made(b: pa.RecordBatch):
        sizes, runs, lanes = _sizes(b.column(1)), b.column(0).dictionary_encode("encode"), _word_hashes(b.column(1).flatten())
        codes = np.repeat(runs.indices.to_numpy(), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left, before = np.repeat(sizes, sizes) - place, np.repeat(b.column(2).to_numpy(), sizes)
        for k in (1, 2, 3):
            at = np.flatnonzero((left >= k) & ((before == 0) | ((place < before) & (place + k > before))))
            if not len(at):
                continue
            h, h2 = (_mixed(x[at]) for x in lanes)
            for j in range(1, k):
                h, h2 = (_mixed(g * s + x[at + j]) for g, s, x in zip((h, h2), steps, lanes, strict=True))
            order = np.argsort(h)
            order = order[np.argsort(codes[at][order], kind="stable")]
            h, h2, code = h[order], h2[order], codes[at][order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]) | (code[1:] != code[:-1])])
            h, h2, code = h[new], h2[new], code[new]
            part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (code[1:] != code[:-1])]))
            offsets = (16 * np.append(starts, len(h))).astype(np.int64)
            held = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.column_stack([h, h2]).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part[starts]), runs.dictionary.take(pa.array(code[starts])), pa.array(np.full(len(starts), k, np.int32)), held], schema=schema)

    def work(it):
        for b in it:
            ends, at = np.cumsum(_sizes(b.column(1))), 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right")))
                yield from made(b.slice(at, to - at))
                at = to

    return work


def _counted(schema: pa.Schema):
    """The distinct n-grams of one part, run and k."""

    def work(rows: pa.Table) -> pa.Table:
        h, h2 = np.frombuffer(b"".join(x.as_buffer() for x in rows["grams"]), np.uint64).reshape(-1, 2).T
        order = np.argsort(h)
        if ((h[order][1:] == h[order][:-1]) & (h2[order][1:] != h2[order][:-1])).any():
            order = np.lexsort((h2, h))
        h, h2 = h[order], h2[order]
        n = 1 + int(((h[1:] != h[:-1]) | (h2[1:] != h2[:-1])).sum())
        return pa.Table.from_arrays([rows["run"].slice(0, 1), rows["k"].slice(0, 1), pa.array([n])], schema=schema)

    return work


def ngram_types(texts: DataFrame, run: str, order: str, words: Column, size: int = ROWS) -> DataFrame:
    """Tokens, types, type-token ratio, 2- and 3-gram types of each run's texts laid one after another, so n-grams span texts.

    Words are hashed (128 bits in two lanes), n-grams are made of their words' hashes in both lanes, and are made distinct within WORDS words before they are shuffled, so a hot one is there
    once for each of these; they are dealt by their hash into parts of some GRAMS, which are counted one by one. Those over a border need the last two words of the texts before: ends of texts, which are stored,
    not texts, are put in order, in ranges of some `size` texts by stored splitters; only the rows at the ends of ranges are looked at together."""
    ends_of = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.slice(w, 1, 2).alias("head"), F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)).alias("tail"))
    edge = stored(texts.select(run, order, F.get(F.transform(F.array(words), ends_of), F.lit(0)).alias("x")).select(run, order, "x.*")).filter("n > 0")
    keys = {"_run": F.col(run), "_order": F.col(order)}
    edge = Ranges.of(edge, keys, size).part(edge, *keys.values()).withColumnRenamed("_part", "part")
    own = Window.partitionBy("part", run).orderBy(order)
    last = lambda over: [F.lag("tail").over(over).alias("p1"), F.lag("tail", 2).over(over).alias("p2")]
    placed = edge.withColumns({"at": F.row_number().over(own), "back": F.row_number().over(Window.partitionBy("part", run).orderBy(F.desc(order)))})
    columns = [run, "at", "head", "p1", "p2"]
    inside = placed.select(run, "at", "head", *last(own)).filter("at > 2").select(*columns)
    ends = placed.filter("at <= 2 or back <= 2")  # four rows of a range and run at most
    first = ends.select(run, "at", "head", *last(Window.partitionBy(run).orderBy(order))).filter("at <= 2").select(*columns)
    none = F.array().cast("array<string>")
    before = F.reverse(F.slice(F.reverse(F.concat(F.coalesce("p2", none), F.coalesce("p1", none))), 1, 2))  # texts of one word pass on the word before them
    cross = inside.unionByName(first).select(run, before.alias("b"), F.slice("head", 1, 2).alias("head")).filter("size(b) > 0")
    every = texts.select(F.col(run).alias("run"), words.alias("w"), F.lit(0).alias("m")).unionByName(cross.select(F.col(run).alias("run"), F.concat("b", "head").alias("w"), F.size("b").alias("m")))
    tokens = edge.groupBy(F.col(run).alias("run")).agg(F.sum("n").alias("tokens")).withColumns({f"types_{k}": F.lit(0).cast("long") for k in (1, 2, 3)})
    parts = max(1, -(-3 * (edge.agg(F.sum("n")).first()[0] or 0) // GRAMS))
    named, number = T.StructField("run", texts.schema[run].dataType), T.StructField("k", T.IntegerType())
    held, count = (T.StructType(x) for x in ([T.StructField("part", T.IntegerType()), named, number, T.StructField("grams", T.BinaryType())], [named, number, T.StructField("n", T.LongType())]))
    grams = every.mapInArrow(_grams(to_arrow_schema(held), parts), held)
    told = grams.groupBy("part", "run", "k").applyInArrow(_counted(to_arrow_schema(count)), count)
    told = told.groupBy("run").agg(F.lit(0).cast("long").alias("tokens"), *(F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"types_{k}") for k in (1, 2, 3)))
    kinds = told.unionByName(tokens).groupBy(F.col("run").alias(run)).agg(*(F.sum(c).alias(c) for c in tokens.columns[1:]))
    return kinds.withColumn("ttr", rate_or_zero(F.col("types_1"), F.col("tokens"))).withColumns({f"diversity_{k}": F.col(f"types_{k}") / F.greatest(F.lit(1), F.col("tokens") - (k - 1)) for k in (2, 3)})


def link_stats(articles: DataFrame, run: str, found: Column, key) -> DataFrame:
    """Links in all, distinct, distinct by canonical key; spread of their number by article."""
    n = articles.select(run, found.alias("l"))
    each = n.select(run, F.explode("l").alias("t")).groupBy(run).agg(F.count("*").alias("links"), F.countDistinct("t").alias("distinct_links"), F.countDistinct(key(F.col("t"))).alias("canonical_links"))
    spread = n.groupBy(run).agg(F.count("*").alias("articles"), F.avg(F.size("l")).alias("mean"), F.stddev_samp(F.size("l")).alias("std"), F.median(F.size("l")).alias("median"), F.min(F.size("l")).alias("least"), F.max(F.size("l")).alias("most"))
    return spread.join(each, run, "left").withColumn("ttr", rate_or_zero(F.col("distinct_links"), F.col("links")))


def claim_rows(records: DataFrame) -> DataFrame:
    """A row per claim with its verdicts by place; ragged ends are empty."""
    z = F.arrays_zip("claims", "wiki_verdicts", "web_verdicts")
    rows = records.select("subject", F.posexplode_outer(z).alias("claim_idx", "x"))
    none = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("subject", "claim_idx", none(F.col("x.claims")).alias("claim"), none(F.col("x.wiki_verdicts")).alias("wiki_verdict"), none(F.col("x.web_verdicts")).alias("web_verdict"))


def not_found(records: DataFrame) -> DataFrame:
    """Subjects whose first record (by line) says they were not found, with all candidates of theirs."""
    g = records.groupBy("subject").agg(F.min_by("found", "line_no").alias("found"), F.array_join(F.sort_array(F.collect_set("candidate")), "|").alias("candidates"))
    return g.filter(~F.col("found")).select("subject", "candidates")


def best_flag(rows: DataFrame, group: str, value: str) -> DataFrame:
    return rows.withColumn("best", F.col(value) == F.max(value).over(Window.partitionBy(group)))


def shortfall(attempted: DataFrame, returned: DataFrame) -> DataFrame:
    """How many attempted subjects came back, did not, or came back without claims."""
    r = attempted.join(returned.select("subject", "n_claims"), "subject", "left")
    return r.agg(F.count("*").alias("attempted"), F.count("n_claims").alias("returned"), F.count_if(F.col("n_claims").isNull()).alias("missing"), F.count_if(F.col("n_claims") == 0).alias("without_claims"))


def task_matrix(subjects: DataFrame, candidates: list[str], baselines: list[str]) -> DataFrame:
    """Every subject with every candidate and baseline, which are few."""
    each = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    return subjects.select("subject", each(candidates).alias("candidate")).select("*", each(baselines).alias("baseline"))
