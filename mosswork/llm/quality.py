"""Quality classifier: interpolated modified Kneser-Ney models over characters, one of trusted text and one of toxic text.

N-grams are of `LENGTH` real characters: nothing is folded, so what is gathered grows with the input. Counts, continuation
counts, context totals and probabilities are sharded aggregations and joins by n-gram. Documents stand in blocks; each block's
distinct n-grams are joined to the probabilities and meet the block again, so a task holds what its own block needs.

A document's perplexity is 2 to the mean cross-entropy of its characters under the trusted model. A document is rejected if its
cross-entropy lies outside quantiles of trusted text in its language (low values are runs of the same; high ones are noise), or if
its most toxic passage, the one that the toxic model explains best beside the trusted one, passes a quantile of trusted text. A
hash-chosen third of the trusted documents is held out of the counts and sets these thresholds; a quantile of n documents is widened
by two of its standard errors, which shrink with the root of n. A third of the toxic ones is held out to measure what is caught.

Defined cases: null texts are empty; an empty text has no perplexity and is rejected; a null language is a language of
its own; a language without held-out trusted text takes the thresholds of all languages, and without any trusted text
every document that has text is kept; without toxic labels no passage is toxic; of several labels of one id, one bad label spoils it; labels without a document and null ids
train nothing; rows with the same id are each scored by their own text; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, batches, dropped, durable, only, text_or_empty

LOWEST, HIGHEST = 0.001, 0.995
#: One in so many trusted documents sets thresholds instead of training.
HELD_OUT = 3


#: N-grams have so many real characters (code points, nothing folded).
LENGTH = 4
PAD = "\0" * (LENGTH - 1)
#: Uniform probability below the shortest n-grams: one of all code points.
LEAST = 1 / 0x110000
#: So many labelled ids are broadcast (8 bytes each).
MOST_IDS = 2_000_000
#: Bytes of text in a block, if a task reads as much; entries of a task's pages of costs.
BLOCK, PAGE = 48 << 20, 400_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _hashes(s: np.ndarray) -> np.ndarray:
    """64-bit hashes of all LENGTH neighbours in code points."""
    s = s.astype(np.uint64) + np.uint64(1)
    s ^= s << np.uint64(31)
    s *= _FACTORS[0]
    s ^= s >> np.uint64(29)
    s *= _FACTORS[4]
    s ^= s >> np.uint64(32)
    n = len(s) - LENGTH + 1
    return reduce(lambda h, j: h + s[j : n + j] * _FACTORS[j], range(LENGTH), np.zeros(n, np.uint64))


def _parts(texts: list[str], most: int = 400_000):
    """Lists of texts that have about `most` characters, joined with padding: texts, joined, and the hashes of the n-grams that
    end at each character, with their places."""
    part, n = [], 0
    for i, t in enumerate(texts):
        part.append(t)
        n += len(t)
        if n > most or i == len(texts) - 1:
            joined = "".join(PAD + x for x in part)
            own = np.repeat(np.tile([True, False], len(part)), [k for x in part for k in (len(x), len(PAD))])[: len(joined) - len(PAD)]
            place = np.flatnonzero(own)
            yield part, joined, _hashes(np.frombuffer(joined.encode("utf-32-le"), np.uint32))[place], place
            part, n = [], 0


def character_counts(texts: DataFrame) -> DataFrame:
    """gram, n of a table (text): n-grams of LENGTH real characters, combined by part before they are shuffled."""
    schema = pa.schema([("gram", pa.string()), ("n", pa.int64())])

    def count(it):
        for b in batches(it):
            for _, joined, h, place in _parts(b.column(0).to_pylist()):
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                yield batch(schema, [joined[i : i + LENGTH] for i in place[first].tolist()], n)

    return texts.mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def probabilities(needed: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """needed (gram, distinct) with p, its interpolated modified Kneser-Ney probability. Counts, totals and probabilities are
    sharded by n-gram and joined by it; only four totals an order go to the driver."""
    levels, at = [], counts
    wanted = [needed]
    for k in range(LENGTH, 0, -1):
        at = durable(at, f"{name}-{k}")
        levels.append(at)
        at = at.groupBy(F.substring("gram", 2, k - 1).alias("gram")).agg(F.count("*").alias("n"))
        if k > 1:
            wanted.append(durable(wanted[-1].select(F.substring("gram", 2, k - 1).alias("gram")).distinct(), f"{name}-wanted-{k - 1}"))
    lower, merged = None, lambda df: df.hint("merge")  # noqa: E731 - one plan at every size
    for k, (at, want) in enumerate(zip(levels[::-1], wanted[::-1], strict=True), 1):
        n = at.agg(*(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))).first()
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        d = [max(0.05, i - (i + 1) * y * n[i] / n[i - 1]) if n[0] and n[i - 1] else 0.5 * i for i in (1, 2, 3)]
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        totals = at.groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("n").alias("total"), F.sum(off).alias("left"))
        seen = at.select("gram", (F.col("n") - off).alias("own"))
        p = want.withColumn("context", F.substring("gram", 1, k - 1)).join(merged(seen), "gram", "left").join(merged(totals), "context", "left")
        if lower is None:
            p = p.withColumn("low", F.lit(LEAST))
        else:
            p = p.withColumn("suffix", F.substring("gram", 2, k - 1)).join(merged(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("low"))), "suffix")
        mixed = F.when(F.col("total").isNull(), F.col("low")).otherwise((F.coalesce("own", F.lit(0.0)) + F.col("left") * F.col("low")) / F.col("total"))
        old, lower = lower, durable(p.select("gram", mixed.alias("p")), f"{name}-p-{k}")
        dropped(at, *([want] if k < LENGTH else []), *([old] if old is not None else []))
    return lower


def scored(docs: DataFrame, trained: DataFrame, toxic: DataFrame) -> DataFrame:
    """docs with `bits`, the mean cross-entropy per character of `text` (null for an empty text), and `peak`, by how many bits the
    model of toxic text explains its most toxic passage better than that of trusted text (0 at least).
    trained, toxic: tables (text) to count.

    Documents stand in blocks. A block's distinct n-grams are joined to the sharded probabilities and meet the block again,
    so that no task holds more of the model than its own block reads; texts travel once, compressed."""
    keep = [c for c in docs.columns if c != "text"]
    text = docs.columns.index("text")

    def blocks(it):
        where, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for b in batches(it, 8192):
            if held and size + b.nbytes > BLOCK:
                yield where + n, held
                n, held, size = n + 1, [], 0
            held.append(b)
            size += b.nbytes
        if held:
            yield where + n, held

    buckets = max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def grams_of(it):
        """A block's distinct n-grams, dealt into buckets by their hash: a row holds many of them."""
        schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("grams", pa.list_(pa.string()))])
        for block, held in blocks(it):
            known, found = np.empty(0, np.uint64), [[] for _ in range(buckets)]
            for b in held:
                for _, joined, h, place in _parts(b.column(text).to_pylist()):
                    u, first = np.unique(h, return_index=True)
                    new = ~np.isin(u, known, assume_unique=True)
                    for k, i in zip((u[new] >> np.uint64(33)).astype(np.int64) % buckets, place[first[new]].tolist(), strict=True):
                        found[k].append(joined[i : i + LENGTH])
                    known = np.union1d(known, u)
            some = [k for k in range(buckets) if found[k]]
            yield batch(schema, some, np.full(len(some), block), [found[k] for k in some])

    def packed(it):
        schema = pa.schema([("block", pa.int64()), ("rows", pa.binary())])
        for block, held in blocks(it):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as w:
                for b in held:
                    w.write_batch(b)
            yield batch(schema, [block], [out.getvalue().to_pybytes()])

    def paged(it):
        """Rows (gram, cost, gain, blocks) to a row per block: its n-grams one after another, their costs and gains."""
        schema = pa.schema([("block", pa.int64()), ("grams", pa.string()), ("cost", pa.binary()), ("gain", pa.binary())])

        def page(rows):
            grams = np.frombuffer("".join(g for r in rows for g in r.column(0).to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, LENGTH)
            cost, gain = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in (1, 2))
            of = np.repeat(np.arange(len(grams)), np.concatenate([r.column(3).value_lengths().to_numpy() for r in rows]))
            block = np.concatenate([r.column(3).flatten().to_numpy() for r in rows])
            order = np.argsort(block, kind="stable")
            of, block = of[order], block[order]
            ends = [*np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
            own = [of[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            return batch(schema, block[np.array(ends) - 1], [grams[x].tobytes().decode("utf-32-le") for x in own], [cost[x].tobytes() for x in own], [gain[x].tobytes() for x in own])

        held, n = [], 0
        for b in it:
            if b.num_rows:
                held.append(b)
                n += len(b.column(3).flatten())
            if n > PAGE:
                yield page(held)
                held, n = [], 0
        if held:
            yield page(held)

    each = docs.mapInArrow(grams_of, "bucket int, block long, grams array<string>").repartition("bucket").select("bucket", "block", F.explode("grams").alias("gram"))
    each = durable(each.groupBy("bucket", "gram").agg(F.collect_list("block").alias("blocks")), "block-grams")
    needed = each.select("gram")
    good = probabilities(needed, character_counts(trained), "good").withColumnRenamed("p", "good")
    bad = probabilities(needed, character_counts(toxic), "toxic").withColumnRenamed("p", "bad")
    costs = good.join(bad.hint("merge"), "gram").select("gram", (-F.log2("good")).cast("float").alias("cost"), F.log2(F.col("bad") / F.col("good")).cast("float").alias("gain"))
    told = each.join(costs.hint("merge"), "gram").select("gram", "cost", "gain", "blocks").mapInArrow(paged, "block long, grams string, cost binary, gain binary")
    schema = docs.select(*keep).schema.add("bits", "double").add("peak", "double")

    def score(own, told):
        s = np.frombuffer("".join(told.column("grams").to_pylist()).encode("utf-32-le"), np.uint32)
        keys = _hashes(s)[::LENGTH] if len(s) else np.empty(0, np.uint64)
        order = np.argsort(keys)
        cost, gain = (np.frombuffer(b"".join(told.column(c).to_pylist()), np.float32)[order] for c in ("cost", "gain"))
        keys = keys[order]
        out = []
        for rows in own.column("rows"):
            for b in pa.ipc.open_stream(rows.as_py()):
                bits, peak = [], []
                for part, _, h, _ in _parts(b.column(text).to_pylist()):
                    at = np.searchsorted(keys, h)
                    if len(h) and (at.max() >= len(keys) or (keys[at] != h).any()):
                        raise RuntimeError("the documents came in another order when they were read again; write them as a table first")
                    end = 0
                    for t in part:
                        mine, end = at[end : end + len(t)], end + len(t)
                        c = np.concatenate([[0.0], np.cumsum(gain[mine], dtype=np.float64)])
                        bits.append(float(cost[mine].mean(dtype=np.float64)) if t else None)
                        peak.append(float((c - np.minimum.accumulate(c)).max()) if t else None)
                out.append(pa.RecordBatch.from_arrays([*(b.column(docs_at[c]) for c in keep), pa.array(bits, pa.float64()), pa.array(peak, pa.float64())], names=[*keep, "bits", "peak"]))
        return pa.Table.from_batches(out)

    docs_at = {c: i for i, c in enumerate(docs.columns)}
    return docs.mapInArrow(packed, "block long, rows binary").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, schema)


def trusted_ids(labels: DataFrame, doc_id="doc_id", quality="quality", toxic="toxic") -> DataFrame:
    """id, held (whether it sets thresholds) of ids of which every label says good and not toxic."""
    of = only(labels, id=doc_id, q=quality, t=toxic).filter("id is not null")
    good = of.groupBy("id").agg(F.bool_and((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0)).alias("good")).filter("good")
    return good.select("id", (F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0).alias("held"))


def toxic_ids(labels: DataFrame, doc_id="doc_id", toxic="toxic") -> DataFrame:
    """id of ids that a label calls toxic, without those held out to measure what is caught."""
    of = only(labels, id=doc_id, t=toxic).filter("id is not null and t = 1")
    return of.filter(F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) != 0).select("id").distinct()


def _error(level: float) -> float:
    """Two standard errors of a quantile of one normal value, in quartile distances; of n values it is 1/sqrt(n) of that."""
    normal = NormalDist()
    return 2 * (level * (1 - level)) ** 0.5 / normal.pdf(normal.inv_cdf(level)) / (2 * normal.inv_cdf(0.75))


def classify(documents: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", lang="lang") -> DataFrame:
    """One row per row of documents: doc_id, text_hash, lang, perplexity, keep."""
    docs = only(documents, doc_id=doc_id, text=text, lang=lang).withColumn("text", text_or_empty())
    ids, toxic = durable(trusted_ids(labels), "trusted"), durable(toxic_ids(labels), "toxic")
    few = ids.count() + toxic.count() <= MOST_IDS  # else texts are shuffled to meet their labels
    named = lambda ids: F.broadcast(ids) if few else ids.hint("merge")
    texts_of = lambda ids: docs.join(named(ids), F.col("doc_id") == F.col("id"), "left_semi").select("text")
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "lang", "text")
    bits = durable(scored(own, texts_of(ids.filter(~F.col("held"))), texts_of(toxic)), "bits")
    held = bits.join(named(ids.filter("held")), F.col("doc_id") == F.col("id"), "left_semi").filter("bits is not null")

    def ends(by) -> DataFrame:
        q = F.percentile_approx("bits", [LOWEST, 0.25, 0.5, 0.75, HIGHEST], 10_000)
        t = F.percentile_approx("peak", [0.25, 0.75, HIGHEST], 10_000)
        far = lambda iqr, level: iqr * _error(level) / F.sqrt(F.count("*"))
        return by.agg((q[0] - far(q[3] - q[1], LOWEST)).alias("lo"), (q[4] + far(q[3] - q[1], HIGHEST)).alias("hi"), (t[2] + far(t[1] - t[0], HIGHEST)).alias("top"))

    by_lang = ends(held.groupBy(F.col("lang").alias("of")))
    overall = ends(held).withColumnsRenamed({"lo": "all_lo", "hi": "all_hi", "top": "all_top"})
    # one row per language, of which there are few thousand on earth, is not a proven bound: Spark decides by size
    told = bits.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left").crossJoin(F.broadcast(overall))  # one row
    inside = F.col("bits").between(F.coalesce("lo", "all_lo"), F.coalesce("hi", "all_hi")) & (F.col("peak") <= F.coalesce("top", "all_top"))
    return told.select("doc_id", "text_hash", "lang", F.pow(F.lit(2.0), "bits").alias("perplexity"), (F.col("bits").isNotNull() & F.coalesce(inside, F.lit(True))).alias("keep"))


def kept_rows(documents: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", lang="lang") -> DataFrame:
    """documents, all columns, without those that the classifier rejects."""
    drop = classify(documents, labels, doc_id, text, lang).filter(~F.col("keep")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), F.col("lang").alias("_lang")).distinct()
    own = documents.select(F.struct(*(documents[f"`{c}`"] for c in documents.columns)).alias("row"))
    same = F.col(f"row.`{doc_id}`").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col("row")[text], F.lit(""))) == F.col("_h")) & F.col(f"row.`{lang}`").eqNullSafe(F.col("_lang"))
    return own.join(drop, same, "left_anti").select("row.*")
