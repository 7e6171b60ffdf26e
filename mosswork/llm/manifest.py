"""Merkle manifest of a table: a digest of every row, a tree of eights over each group, a tree over the groups, proofs.

Rows are sorted by group and id in ranges, and stored with their place in the range. The rows of each group in each range are counted; running
sums of these counts give every row its index in its group, so a node has a coordinate: (group, level, index), over the leaves index * 8**level and on.
A task hashes the complete aligned subtrees of the stretch of leaves that it reads; what is left at the ends of stretches, a few nodes a level, is
shuffled by coordinate of the block (8**HEIGHT leaves) and finished there. Blocks of blocks finish the upper levels: three rounds are enough for
6 * 10**10 leaves. A group of any size is so cut over tasks, and no task holds more than a block. Proofs go down the same blocks: those of a
block's own node are sent to its leaves once.

Defined cases: a null field is `-`, so it differs from an empty text; the null group is a group, the first; null ids come first in their group; equal ids
are ordered by digest, so equal rows have leaves of their own, whose proofs may be exchanged; very long texts are one digest each; an empty table gives
no rows; further columns play no part whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, batches, dropped, durable

FAN, HEIGHT = 8, 4
BLOCK = FAN**HEIGHT
#: So many rows of counts by range and group are broadcast; more are joined by shuffle.
MOST_COUNTS = 100_000
STEPS = "array<struct<before:string,after:string>>"
_STEP = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def field(value: Column) -> Column:
    """A field without doubt where it ends: bytes, colon, value; `-` for null."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s.before, acc, s.after), 256))


def proof_text(steps: Column) -> Column:
    """All siblings, from the leaf up, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s.before, s.after)), "")


def _h(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(m: int) -> int:
    """Levels over m nodes until one is left, within a block."""
    if m > BLOCK:
        return HEIGHT
    h = 0
    while FAN**h < m:
        h += 1
    return h


def _levels(nodes: list[str], h: int) -> list[list[str]]:
    out = [nodes]
    for _ in range(h):
        nodes = [_h(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        out.append(nodes)
    return out


def complete(first: int, nodes: list[str], m: int) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the largest complete aligned subtrees of a stretch of the m leaves of a group, which starts at `first`."""
    top, at, end = height(m), first, first + len(nodes)
    while at < end:
        level = 0
        while level < top and at % FAN ** (level + 1) == 0 and min(m, at + FAN ** (level + 1)) <= end:
            level += 1
        upto = min(end, at + FAN**level)
        yield level, at // FAN**level, _levels(nodes[at - first : upto - first], level)[level][0]
        at = upto


def finished(pieces: list[tuple[int, int, str]], h: int) -> str:
    """The node of a block from complete subtrees (level, index in the block, digest)."""
    nodes: dict[int, str] = {}
    for level in range(h + 1):
        nodes |= {i: d for n, i, d in pieces if n == level}
        if level < h:
            runs = groupby(sorted(nodes), lambda i: i // FAN)
            nodes = {j: _h([nodes[i] for i in ids]) for j, ids in runs}
    return nodes[0]


_PIECES = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("m", pa.int64()), ("level", pa.int64()), ("idx", pa.int64()), ("digest", pa.string())])


def _subtrees(it):
    """Rows (grp, idx, m, digest), stretches of which follow one another, to complete subtrees. Any order is right; only stretches save shuffling."""
    grp, first, m, nodes = None, 0, 0, []

    def flush():
        made = list(complete(first, nodes, m))
        blocks = [i * FAN**n // BLOCK for n, i, _ in made]
        local = [i - b * BLOCK // FAN**n for (n, i, _), b in zip(made, blocks, strict=True)]
        return batch(_PIECES, [grp] * len(made), blocks, [m] * len(made), [x[0] for x in made], local, [x[2] for x in made])

    for b in batches(it):
        for g, i, n, d in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if nodes and (g != grp or i != first + len(nodes) or i % BLOCK == 0):
                yield flush()
                nodes = []
            if not nodes:
                grp, first, m = g, i, n
            nodes.append(d)
    if nodes:
        yield flush()


_BLOCKS = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("m", pa.int64()), ("digest", pa.string())])


def _finish(it):
    """Rows (grp, block, m, pieces) to the nodes of blocks."""
    for b in batches(it):
        rows = [[*x] for x in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)]
        made = [finished([(p["level"], p["idx"], p["digest"]) for p in ps], height(m)) for _, _, m, ps in rows]
        yield batch(_BLOCKS, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], made)


def _indexed(leaves: DataFrame, *order: str) -> tuple[DataFrame, list[DataFrame]]:
    """leaves with idx, their place in their group by `order`, and m, its size; and the tables to drop. Ranges are sorted and stored once, with the places
    in them; counts are taken from what is stored, so a second sampling can't disagree."""
    ranged = durable(leaves.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id()), "manifest-ranged")
    placed = ranged.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("part", "grp").agg(F.min("at").alias("start"), F.count("*").alias("c"))
    of = Window.partitionBy("grp")
    before = F.sum("c").over(of.orderBy("part")) - F.col("c")
    counts = durable(counts.select("part", "grp", (before - F.col("start")).alias("shift"), F.sum("c").over(of).alias("m")), "manifest-counts")
    few = counts.count() <= MOST_COUNTS
    rows = placed.join(F.broadcast(counts) if few else counts.hint("merge"), ["part", "grp"])
    if not few:  # a merge join deals rows by range and group
        rows = rows.sortWithinPartitions("part", "grp", "at")
    return rows.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift"), [ranged, counts]


def _blocks(rows: DataFrame) -> DataFrame:
    """grp, block, m, digest of the blocks of rows (grp, idx, m, digest)."""
    pieces = durable(rows.select("grp", "idx", "m", "digest").mapInArrow(_subtrees, "grp string, block long, m long, level long, idx long, digest string"), "manifest-pieces")
    ready = sum((F.col("m") > FAN**k).cast("long") for k in range(HEIGHT))  # height(m)
    ragged = pieces.filter(F.col("level") < ready).groupBy("grp", "block", "m").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("pieces"))
    out = durable(pieces.filter(F.col("level") == ready).select("grp", "block", "m", "digest").unionByName(ragged.mapInArrow(_finish, "grp string, block long, m long, digest string")), "manifest-blocks")
    dropped(pieces)
    return out


def _steps(rows: DataFrame, above: DataFrame, keep: Sequence[str]) -> DataFrame:
    """rows (grp, idx, m, digest and the columns of `keep`) with root, and steps: siblings from each row up to the root. above: grp, block, steps,
    root of each block. A block's rows follow its own record, and no block has more than BLOCK."""
    kinds = dict(rows.dtypes)
    none = F.lit(None)
    own = rows.select("grp", F.shiftright("idx", 3 * HEIGHT).alias("block"), "idx", "m", "digest", *keep, none.cast(STEPS).alias("steps"), none.cast("string").alias("root"))
    told = above.select("grp", "block", F.lit(-1).cast("long").alias("idx"), none.cast("long").alias("m"), none.cast("string").alias("digest"), *(none.cast(kinds[c]).alias(c) for c in keep), "steps", "root")
    dealt = own.unionByName(told).repartition("grp", "block").sortWithinPartitions("grp", "block", "idx")
    names = ["grp", "idx", "digest", *keep]
    at = {c: i for i, c in enumerate(dealt.columns)}

    def walk(it):
        import pyarrow as pa

        upper, root, held, m = [], None, [], 0

        def flush():
            whole = pa.Table.from_batches(held).combine_chunks()
            levels = _levels(whole.column("digest").to_pylist(), height(m))[:-1]
            cuts = []
            for nodes in levels:  # siblings before and after each node
                sides = []
                for j in range(0, len(nodes), FAN):
                    run = nodes[j : j + FAN]
                    sides += [{"before": "".join(run[:k]), "after": "".join(run[k + 1 :])} for k in range(len(run))]
                cuts.append(sides)
            for lo in range(0, whole.num_rows, 1024):
                part = whole.slice(lo, 1024)
                steps = [[*(sides[i // FAN**n] for n, sides in enumerate(cuts)), *upper] for i in range(lo, lo + part.num_rows)]
                columns = [part.column(c).combine_chunks() for c in names]
                yield from pa.table([*columns, pa.array([root] * part.num_rows, pa.string()), pa.array(steps, _STEP)], names=[*names, "root", "steps"]).to_batches()

        for b in batches(it):
            starts = {i for i, x in enumerate(b.column(at["idx"]).to_pylist()) if x < 0}
            cut = sorted({0, *starts, b.num_rows})
            for lo, hi in zip(cut, cut[1:]):
                rest = b.slice(lo, hi - lo)
                if lo in starts:
                    if held:
                        yield from flush()
                        held = []
                    upper, root = rest.column(at["steps"])[0].as_py(), rest.column(at["root"])[0].as_py()
                    rest = rest.slice(1)
                if rest.num_rows:
                    held.append(rest.select(names))
                    m = rest.column(at["m"])[0].as_py()
        if held:
            yield from flush()

    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    return dealt.mapInArrow(walk, f"{schema}, root string, steps {STEPS}")


def _tree(leaves: DataFrame, keep: Sequence[str], *order: str):
    """The trees of all groups of leaves (grp, digest, the columns of `order` and `keep`): roots (grp, digest), and a function of what stands above
    the roots (grp, steps, root) that gives every leaf its proof; and the tables to drop when it has been read."""
    rows, old = _indexed(leaves, *order)
    rounds = [rows]
    while True:
        made = _blocks(rounds[-1])
        old.append(made)
        if not made.filter(F.col("m") > BLOCK).limit(1).count():
            break
        more = made.filter(F.col("m") > BLOCK)
        rounds.append(more.select("grp", F.col("block").alias("idx"), F.ceil(F.col("m") / BLOCK).alias("m"), "digest"))
    made = old[-len(rounds) :]
    roots = made[-1].select("grp", "digest")
    for done in made[:-1]:
        roots = roots.unionByName(done.filter(F.col("m") <= BLOCK).select("grp", "digest"))

    def proofs(above: DataFrame) -> DataFrame:
        """above: one row a group."""
        told = None
        for k in range(len(rounds) - 1, -1, -1):
            tops = made[k].filter(F.col("m") <= BLOCK).select("grp", "block").join(above, "grp")
            told = tops if told is None else tops.unionByName(told)
            if k:
                told = durable(_steps(rounds[k], told, []).select("grp", F.col("idx").alias("block"), "steps", "root"), "manifest-steps")
                old.append(told)
        return _steps(rows, told, keep)

    return roots, proofs, old


def manifest(documents: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), doc_id: str = "doc_id", group: str = "lang", also: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of documents: grp, doc_id, idx (its place in its group), leaf, subroot, root and steps, its proof: the siblings
    before and after it, level by level, through the group's root to the table's. also: further columns, computed where the row is read."""
    also = also or {}
    value = lambda c: documents[f"`{c}`"]
    # a mark before the name keeps the null group apart, and first
    grp = F.coalesce(F.concat(F.lit("+"), value(group).cast("string")), F.lit(""))
    leaves = durable(documents.select(grp.alias("grp"), value(doc_id).cast("long").alias("doc_id"), digest(*map(value, fields)).alias("digest"), *(c.alias(n) for n, c in also.items())), "manifest-leaves")
    roots, proofs, old = _tree(leaves, ["doc_id", *also], "doc_id", "digest")
    roots = durable(roots, "manifest-roots")
    # the groups' roots are the leaves of one more tree
    top_roots, top_proofs, top_old = _tree(roots.select(F.lit("").alias("grp"), "digest", F.col("grp").alias("name")), ["name"], "name")
    root = top_roots.select("grp", F.array().cast(STEPS).alias("steps"), F.col("digest").alias("root"))
    above = durable(top_proofs(root).select(F.col("name").alias("grp"), "steps", "root"), "manifest-above")
    dropped(leaves, *top_old)
    told = proofs(above).withColumnRenamed("digest", "leaf")
    # the group's root is what the steps of its own tree give; it is read from the groups, which `above` names
    subroots = roots.select("grp", F.col("digest").alias("subroot"))
    return told.join(F.broadcast(subroots) if roots.count() <= MOST_COUNTS else subroots.hint("merge"), "grp").select(
        F.expr("nullif(grp, '')").substr(2, 1 << 30).alias("grp"), "doc_id", "idx", "leaf", "subroot", "root", "steps", *also
    )
