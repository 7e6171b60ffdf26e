"""N-gram Jaccard join with a MinHash LSH forest.

Documents with equal shingle sets become one class. Each class has one signature of `DEPTH` minima in each of `TREES`
trees. A tree is its signatures in sorted order: neighbours that share a prefix of d minima are below one trie node of
depth d. A class is linked to the first class of the deepest node that holds another before it, and matched prefixes are shortened level by
level until two sets at the threshold meet in some tree with the target recall. How far that is depends on the set: the nearest
other set of n shingles has similarity n/(n+1) at most, so sets that can't reach the threshold with any other never enter a tree.
Every class has one link at most for each tree, whatever its prefix; copies are never paired with each other here.

The connected families are then verified exactly: members of a family are dealt into blocks of up to `BLOCK` members or `BLOCK_BYTES` of
text, each pair of blocks is one task that counts common shingles of all pairs by matrix products, and what leaves the task is a
row per member (number of links, least linked member), not a row per pair. A family of any size so becomes many equal tasks; no
links are lost to caps. A text is sent once for each block of its family: 8 MB of texts once, 80 MB ten times.

A true pair that no tree brings together directly is still found if its family is connected otherwise, so recall is at least
the target. Links of a document count all other documents with Jaccard similarity at or above the threshold, copies included.

Defined cases: null texts and texts without words have no shingles, so no links, and each is its own class; a text of
fewer than five words is one shingle; very long texts are read whole; rows with the same id and text are one document given twice (each gets the same result); null ids rank last
as class names; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, batches, durable, joined, only, text_or_empty
from .components import components
from .shingles import MinHash, shingle_sets

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH = 24, 8
#: Members and bytes of text of a block.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
COLUMNS = 4096


def prefix_length(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """Where shortening ends: the longest prefix at which two sets of that similarity meet in some tree with that probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def signed(documents: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), bytes (of it), c (digest of the shingle set, null if empty), n (its size), trees (a signature each: two
    bytes of every minimum)."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("bytes", pa.int64()), ("c", pa.binary()), ("n", pa.int64()), ("trees", pa.list_(pa.binary()))])

    def sign(it):
        hashes = MinHash(TREES * DEPTH)
        for b in batches(it):
            texts = b.column(2).to_pylist()
            sets = shingle_sets(texts, WORDS)
            some = [s for s in sets if len(s)]
            rows = iter(hashes.signatures(some).astype(">u2") if some else ())
            width = 2 * DEPTH
            cut = lambda row: [row[i : i + width] for i in range(0, TREES * width, width)]
            yield batch(schema, b.column(0), b.column(1), [len(t.encode()) for t in texts], [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], [len(s) for s in sets], [cut(next(rows).tobytes()) if len(s) else None for s in sets])

    return documents.select("doc_id", "th", "text").mapInArrow(sign, "doc_id long, th long, bytes long, c binary, n long, trees array<binary>")


LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("depth", pa.int32())])


def tries(least: int):
    """Sorted rows (tree, sig, c), whole nodes of depth `least` at a time, to the links of their tries."""

    def linked(tree: np.ndarray, sig: np.ndarray, c: np.ndarray):
        """Rows of one partition in order. sig: a row of DEPTH numbers each."""
        same = np.cumprod(sig[1:] == sig[:-1], 1).sum(1)
        common = np.append(0, np.where(tree[1:] == tree[:-1], same, 0))
        at, parent = np.arange(len(c)), np.arange(len(c))
        for depth in range(DEPTH, least - 1, -1):  # the first row of the node of that depth
            first = np.maximum.accumulate(np.where(common < depth, at, 0))
            parent = np.where(common == depth, first, parent)
        some = parent != at
        return batch(LINKS, c[some].tolist(), c[parent[some]].tolist(), common[some].astype(np.int32))

    def run(it):
        held: list = []

        def ready(parts):
            tree = np.concatenate([b.column(0).to_numpy() for b in parts])
            sig = np.frombuffer(b"".join(x for b in parts for x in b.column(1).to_pylist()), ">u2").reshape(-1, DEPTH)
            return tree, sig, np.array([x for b in parts for x in b.column(2).to_pylist()], object)

        for b in it:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) > 200_000:
                tree, sig, c = ready(held)
                key = (tree[1:] != tree[:-1]) | (sig[1:, :least] != sig[:-1, :least]).any(1)
                ends = np.flatnonzero(key)
                if len(ends):  # the last node may go on in the next batch
                    end = int(ends[-1]) + 1
                    yield linked(tree[:end], sig[:end], c[:end])
                    held = [pa.RecordBatch.from_arrays([pa.array(tree[end:], pa.int32()), pa.array([x.tobytes() for x in sig[end:]], pa.binary()), pa.array(c[end:].tolist(), pa.binary())], names=["tree", "sig", "c"])]
        if held:
            yield linked(*ready(held))

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of each pair of sets."""
    flat = np.concatenate([*left, *right])
    values, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
    useful = counts > 1
    column = np.where(useful, np.cumsum(useful) - 1, -1)[where]
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    keep = column >= 0
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, int(useful.sum()), COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        grid = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        grid[row[a:b], column[a:b] - lo] = 1
        out += (grid[: len(left)] @ grid[len(left) :].T).astype(np.int64)
    return out


VERIFIED = pa.schema([("c", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])


def _verify(threshold: float):
    share = Fraction(threshold).limit_denominator(10_000)

    def verify(key, t):
        """The links of one pair of blocks: for each member the least member linked with it, directly or
        not, within the task, and how many documents it is linked with."""
        lo, hi = key[1].as_py(), key[2].as_py()
        seen = {c: (b, s, x) for c, b, s, x in zip(t["c"].to_pylist(), t["block"].to_pylist(), t["size"].to_pylist(), t["text"].to_pylist(), strict=True)}
        names = sorted(seen)
        left = [c for c in names if seen[c][0] == lo]
        right = left if lo == hi else [c for c in names if seen[c][0] == hi]
        sets = dict(zip(names, shingle_sets([seen[c][2] for c in names], WORDS), strict=True))
        if not left or not right:
            return VERIFIED.empty_table()
        common = _common([sets[c] for c in left], [sets[c] for c in right])
        sizes = [np.array([len(sets[c]) for c in side]) for side in (left, right)]
        linked = common * share.denominator >= (sizes[0][:, None] + sizes[1][None, :] - common) * share.numerator
        if lo == hi:
            np.fill_diagonal(linked, False)
        weight = [np.array([seen[c][1] for c in side]) for side in (left, right)]
        links = dict.fromkeys(names, 0)
        for c, n in zip(left, (linked @ weight[1]).tolist(), strict=True):
            links[c] += n
        if lo != hi:
            for c, n in zip(right, (weight[0] @ linked).tolist(), strict=True):
                links[c] += n
        root = {c: c for c in names}

        def top(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for i in range(len(left)):
            for j in np.flatnonzero(linked[i]).tolist():
                a, b = top(left[i]), top(right[j])
                root[max(a, b)] = min(a, b)
        out = [c for c in names if links[c]]
        return pa.Table.from_arrays([pa.array(out, pa.binary()), pa.array([top(c) for c in out], pa.binary()), pa.array([links[c] for c in out], pa.int64())], schema=VERIFIED)

    return verify


def join(documents: DataFrame, doc_id="doc_id", text="text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of documents: doc_id, text_hash, class_id (least id of the documents that links connect), copy_of
    (least id of the same shingle set), n_links, first (least text_hash of the class's least id)."""
    docs = only(documents, doc_id=doc_id, text=text).withColumn("text", text_or_empty())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    sets = durable(signed(docs), "signatures")
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    one = sets.filter("c is not null").groupBy("doc_id", "th").agg(*(F.first(x).alias(x) for x in ("c", "bytes", "n", "trees")))
    classes = durable(one.groupBy("c").agg(F.min(name).alias("rep"), F.count("*").alias("size"), *(F.first(x).alias(x) for x in ("bytes", "n", "trees"))), "classes")

    least = prefix_length(threshold, recall)
    share = Fraction(threshold).limit_denominator(10_000)
    reachable = classes.filter(F.col("n") * share.denominator >= (F.col("n") + 1) * share.numerator)
    nodes = reachable.select("c", F.posexplode("trees").alias("tree", "sig")).select("tree", "sig", "c")
    dealt = nodes.repartition("tree", F.substring("sig", 1, 2 * least)).sortWithinPartitions("tree", "sig", "c")
    families = components(dealt.mapInArrow(tries(least), "a binary, b binary, depth int"))

    blocks = families.select(F.col("node").alias("c"), F.col("root").alias("family")).join(classes.select("c", "rep", "size", "bytes"), "c")
    blocks = durable(blocks, "members")
    number = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    told = durable(blocks.groupBy("family").agg(number.alias("blocks"), F.count("*").alias("n")), "family-sizes")
    member = joined(blocks, told, "family").drop("n").withColumnRenamed("blocks", "n").withColumn("block", F.pmod(F.xxhash64("c"), "n").cast("int"))
    member = durable(member.select("c", "family", "n", "block", "size", F.col("rep.doc_id").alias("id"), F.col("rep.th").alias("h")), "families")
    # a table of members can be small enough to broadcast on small inputs alone; the plan is one for all sizes
    texts = docs.join(member.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h")))
    tasks = texts.select("family", "block", "c", "size", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    tasks = tasks.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")
    found = durable(tasks.groupBy("family", "lo", "hi").applyInArrow(_verify(threshold), "c binary, root binary, links long"), "links")

    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    linked = links.join(whole.withColumnRenamed("node", "c"), "c")
    named = classes.select("c", "rep", "size").join(linked.hint("merge"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    roots = named.groupBy("root").agg(F.min("rep").alias("top"))
    named = named.join(roots, "root").select("c", "rep", "top", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    return sets.select("doc_id", "th", "c").join(named.hint("merge"), "c", "left").select(
        "doc_id",
        F.col("th").alias("text_hash"),
        F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("class_id"),
        F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("c").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("th") == F.col("top.th"))).alias("kept"),
    )


def kept_rows(documents: DataFrame, doc_id="doc_id", text="text", threshold: float = THRESHOLD) -> DataFrame:
    """documents, all columns, with one document of each class: its least id."""
    drop = join(documents, doc_id, text, threshold).filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    own = documents.select(F.struct(*(documents[f"`{c}`"] for c in documents.columns)).alias("row"))
    same = F.col(f"row.`{doc_id}`").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col("row")[text], F.lit(""))) == F.col("_h"))
    return own.join(drop.hint("merge"), same, "left_anti").select("row.*")
