"""Suffix-array dedup: removes each byte that a `LENGTH`-byte string covers which also starts earlier.

Suffixes are sorted in shards. Which shard a string belongs to is settled by content: of the hashes of its `GRAM`-byte
pieces the least is its anchor, so equal strings have equal anchors wherever they stand. Strings with one anchor
that follow each other make a segment. Equal segments are equal strings throughout; only their first is of interest, and all
others go. Different segments under one anchor are what may need sorting. Each of their strings holds the `SIDE` bytes before the anchor
or the `SIDE` bytes behind it, so a segment has two halves, known by the anchor and those bytes; halves that no
other segment shares hold no repeat. The bytes of the other halves are laid one after another in the order of the
documents, their suffixes are sorted by induction (see suffix_sort), common prefixes are computed in text order, and neighbours that share
`LENGTH` bytes are one string, of which all but the first occurrence go.

Copies meet as segments: each task first keeps one row of equal segments, so a passage in a third of all documents is a row a task, and
nothing is paired. Texts move twice, to their requests and to their removals, and are never sorted as a whole.

Order of starts: document id (nulls last), hash of the text, place in the text. Defined cases: a null text is empty; matches never
cross documents; rows with the same id and text are one document given twice (each gets the same result); an empty
table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, batches, durable, only, text_or_empty
from .suffix_sort import FACTOR, _hashes, _powers, prefixes, suffix_array

LENGTH, GRAM = 100, 24
#: Each string reaches so far beyond its anchor on one side at least.
SIDE = (LENGTH - GRAM) // 2
#: Bytes of a document that are anchored at once: a place takes 20 bits beside the hash.
STRETCH = 1 << 20
#: Segments compared within a task before rows are sent; bytes of a shard.
HELD, SHARD = 2_000_000, 1_500_000
NO_ID = 2**63 - 1
#: place: start, number of strings and the anchor's distance from the start, packed; sides: hashes of both halves, 31 and 32 bits, 0 for none.
#: A row with sides -1 is no segment but a range of starts that a task already knows to repeat: segment is its start, place its length.
_SEGMENTS = pa.schema([(n, pa.int64()) for n in ("id", "th", "anchor", "segment", "place", "sides")])
SEGMENTS = "id long, th long, anchor long, segment long, place long, sides long"
_RANGES = pa.schema([(n, pa.int64()) for n in ("id", "th", "start", "n")])
RANGES = "id long, th long, start long, n long"
M = np.uint64(0x9E3779B97F4A7C15)


def _place(start, n, anchor):
    return start << 16 | n << 8 | anchor


def _start(place):
    return place >> 16


def _n(place):
    return place >> 8 & 255


def segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, hash, place and sides of each segment of a text."""
    found = [_stretch(np.frombuffer(data, np.uint8, min(STRETCH + LENGTH - 1, len(data) - at), at), at) for at in range(0, max(0, len(data) - LENGTH + 1), STRETCH)]
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


@cache
def _back() -> np.ndarray:
    """Powers of the inverse of the hash's factor, which shift the hash of a stretch to the place 0."""
    return _powers(STRETCH + LENGTH, pow(FACTOR, -1, 2**64))


def _stretch(b: np.ndarray, at: int):
    h, grams = b.astype(np.uint64) + np.uint64(1), {}
    for k in range(5):  # hashes of 1, 2, 4, 8 and 16 bytes
        grams[1 << k] = h
        if k < 4:
            w = 1 << k
            h = h[:-w] * (M + np.uint64(2 * k)) + h[w:]
            h = h ^ (h >> np.uint64(29))
    h = grams[16][: len(b) - GRAM + 1] * M + grams[8][16:]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(30)
    places = np.arange(len(h), dtype=np.uint64)
    least = (h & ~np.uint64(STRETCH * 2 - 1)) | places
    width, of = LENGTH - GRAM + 1, 1
    while of * 2 <= width:
        least = np.minimum(least[:-of], least[of:])
        of *= 2
    if of < width:
        least = np.minimum(least[: len(least) - (width - of)], least[width - of :])
    anchor = (least & np.uint64(STRETCH * 2 - 1)).astype(np.int64)
    start = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    n = np.diff(np.append(start, len(anchor)))
    sums, _ = _hashes(b)
    end, anchor = start + n + LENGTH - 1, anchor[start]
    away = anchor - start
    back = _back()  # the same bytes have one hash in every text
    whole = (sums[end] - sums[start]) * back[start]
    whole = (whole ^ n.astype(np.uint64) * M ^ away.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
    before, behind = np.maximum(anchor - SIDE, 0), np.minimum(anchor + GRAM + SIDE, len(b))
    sides = [((sums[y] - sums[x]) * back[x] * M) >> np.uint64(b) | np.uint64(1) for x, y, b in ((before, anchor, 33), (anchor, behind, 32))]
    left, right = np.where(away > SIDE, sides[0], np.uint64(0)), np.where(away - n < SIDE, sides[1], np.uint64(0))
    return h[anchor].view(np.int64), (whole ^ (whole >> np.uint64(32))).view(np.int64), _place(start + at, n, away), (left << np.uint64(32) | right).view(np.int64)


def _rows(it):
    """Batches (id, th, text) to tables of segments, HELD or more at a time."""
    parts, held = [], 0
    for b in batches(it):
        for i, th, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            a, *rest = segments(t.encode())
            if len(a):
                parts.append((np.full(len(a), i), np.full(len(a), th), a, *rest))
                held += len(a)
        if held >= HELD:
            yield [np.concatenate(x) for x in zip(*parts, strict=True)]
            parts, held = [], 0
    if parts:
        yield [np.concatenate(x) for x in zip(*parts, strict=True)]


def _firsts(rows) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by anchor, segment and place; whether each is the first of equal segments."""
    order = np.lexsort((rows[4], rows[1], rows[0], rows[3], rows[2]))
    a, s = rows[2][order], rows[3][order]
    return order, np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1]))



def _later(rows, order, first) -> list[np.ndarray]:
    """Ranges of starts of rows that are not the first of their segment, joined where they touch."""
    x = [rows[c][order] for c in (0, 1, 4)]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    gone = ~first & ~np.logical_and.reduce([c == c[lead] for c in x])
    i, th, place = (c[gone] for c in x)
    return _joined([i, th, _start(place), _n(place)])


def _joined(x: list[np.ndarray]) -> list[np.ndarray]:
    order = np.lexsort((x[2], x[1], x[0]))
    i, th, start, n = (c[order] for c in x)
    if not len(i):
        return [i, th, start, n]
    new = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (th[1:] != th[:-1]) | (start[1:] > start[:-1] + n[:-1])))
    end = np.maximum.reduceat(start + n, new)
    return [i[new], th[new], start[new], end - start[new]]


def first_segments(it):
    """The first of equal segments of a task's rows, and the ranges of the others."""
    for rows in _rows(it):
        order, first = _firsts(rows)
        i, th, start, n = _later(rows, order, first)
        ranges = (i, th, th, start, n, np.full(len(i), -1))  # any key does, as long as it is spread
        yield batch(_SEGMENTS, *(np.concatenate([c[order][first], r]) for c, r in zip(rows, ranges, strict=True)))


def _sorted_groups(it):
    """Sorted rows of a partition, whole anchors at a time."""
    rest = None
    for b in it:
        rows = [b.column(i).to_numpy() for i in range(6)]
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
        if not len(rows[0]):
            continue
        last = np.searchsorted(rows[2], rows[2][-1])
        if last:
            yield [c[:last] for c in rows]
        rest = [c[last:] for c in rows]
    if rest is not None:
        yield rest


_FOUND = pa.schema([*_SEGMENTS, ("sort", pa.bool_())])


def _shared(keys: list[np.ndarray], some: np.ndarray) -> np.ndarray:
    """Of the marked rows, those whose keys another marked row has too."""
    at = np.flatnonzero(some)
    keys = [k[at] for k in keys]
    order = np.lexsort(keys)
    same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    out = np.zeros(len(some), bool)
    out[at[order]] = np.append(False, same) | np.append(same, False) if len(at) else False
    return out


def compared(it):
    """Later copies of segments (sort false), and the first of each segment of which another one shares a half (sort true; sides
    that no other shares are 0)."""
    for rows in _sorted_groups(it):
        known = rows[5] == -1
        if known.any():
            yield batch(_FOUND, *(c[known] for c in rows), np.zeros(int(known.sum()), bool))
            rows = [c[~known] for c in rows]
        if not len(rows[0]):
            continue
        order, first = _firsts(rows)
        rows = [c[order] for c in rows]
        lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        gone = ~first & ~np.logical_and.reduce([rows[c] == rows[c][lead] for c in (0, 1, 4)])
        left, right = rows[5].view(np.uint64) >> np.uint64(32), rows[5].view(np.uint64) & np.uint64(2**32 - 1)
        left, right = (np.where(_shared([side, rows[2]], first & (side != 0)), side, np.uint64(0)) for side in (left, right))
        rows[5] = (left << np.uint64(32) | right).view(np.int64)
        pick = gone | (first & (rows[5] != 0))
        yield batch(_FOUND, *(c[pick] for c in rows), first[pick])


_HALVES = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("half", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())])
HALVES = "id long, th long, half long, start long, n long, bytes binary"


def _cut(it):
    """Rows (id, th, text, wanted: anchor, place, sides) to rows with the bytes of the halves."""
    for b in batches(it, rows=256):
        out = []
        for i, th, t, wanted in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
            data = t.encode()
            for w in wanted:
                start, n, away = _start(w["place"]), _n(w["place"]), w["place"] & 255
                split = min(max(away - SIDE, 0), n)  # strings before it hold what is before the anchor
                sides = w["sides"] & 2**64 - 1
                for side, s, m in ((sides >> 32, start, split), (sides & 2**32 - 1 and sides | 1 << 63, start + split, n - split)):
                    if side and m:
                        half = (w["anchor"] ^ (side & 2**32 - 1) * 0x9E3779B97F4A7C15 ^ side >> 63) & 2**64 - 1
                        out.append((i, th, half - (half >> 63 << 64), s, m, data[s : s + m + LENGTH - 1]))
        if out:
            yield batch(_HALVES, *map(list, zip(*out, strict=True)))


def sorted_shard(t: pa.Table) -> pa.Table:
    """Ranges of starts in a shard's segments at which a string of LENGTH bytes begins that also starts earlier."""
    ids, ths, starts, ns = (t[c].to_numpy() for c in ("id", "th", "start", "n"))
    order = np.lexsort((starts, ths, ids))
    parts = t["bytes"].to_pylist()
    parts, ids, ths, starts, ns = [parts[i] for i in order], ids[order], ths[order], starts[order], ns[order]
    # 0 ends the text, 1 ends a segment, bytes follow
    text = np.append(np.frombuffer(b"".join([p + b"\0" for p in parts]), np.uint8).astype(np.int64) + 2, 0)
    lengths = ns + LENGTH
    base = np.cumsum(lengths) - lengths
    text[base + lengths - 1] = 1
    sa = suffix_array(text)
    shared = prefixes(text, sa)
    valid = np.zeros(len(text) + 1, np.int64)
    np.add.at(valid, base, 1)
    np.add.at(valid, base + ns, -1)
    valid = np.cumsum(valid[:-1]) > 0
    group = np.cumsum(shared[sa] < LENGTH)
    keep = valid[sa]
    at, group = sa[keep], group[keep]
    least = np.full(group[-1] + 1, len(text), np.int64)
    np.minimum.at(least, group, at)
    of = np.searchsorted(base, at, "right") - 1
    head = least[group]
    head_of = np.searchsorted(base, head, "right") - 1
    place = lambda o, x: (ids[o], ths[o], starts[o] + x - base[o])
    mine, theirs = place(of, at), place(head_of, head)
    gone = ~np.logical_and.reduce([a == b for a, b in zip(mine, theirs, strict=True)])
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in _joined([*(c[gone] for c in mine), np.ones(int(gone.sum()), np.int64)])], schema=_RANGES)


def repeats(docs: DataFrame) -> DataFrame:
    """id, th, start, n: starts, n in a row, of strings that also start earlier. docs: id, th, text."""
    firsts = docs.mapInArrow(first_segments, SEGMENTS)
    dealt = firsts.repartition("anchor").sortWithinPartitions("anchor", "segment", "id", "th", "place")
    found = durable(dealt.mapInArrow(compared, SEGMENTS + ", sort boolean"), "segments")
    n = F.shiftright("place", 8).bitwiseAND(F.lit(255))
    known = F.col("sides") == -1
    ranges = found.filter(~F.col("sort")).select("id", "th", F.when(known, F.col("segment")).otherwise(F.shiftright("place", 16)).alias("start"), F.when(known, F.col("place")).otherwise(n).alias("n"))
    some = found.filter("sort")
    size = some.agg(F.sum(n + LENGTH)).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    wanted = some.groupBy(F.col("id").alias("i"), F.col("th").alias("h")).agg(F.collect_set(F.struct("anchor", "place", "sides")).alias("wanted"))
    bytes_ = docs.join(wanted.hint("merge"), (F.col("id") == F.col("i")) & (F.col("th") == F.col("h"))).select("id", "th", "text", "wanted")
    bytes_ = bytes_.mapInArrow(_cut, HALVES)
    shard = F.pmod(F.xxhash64("half"), F.lit(shards)).alias("shard")
    sorted_ = bytes_.groupBy(shard).applyInArrow(sorted_shard, RANGES)
    return ranges.unionByName(sorted_)


def dedup(documents: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """One row per row of documents: doc_id, n_bytes, removed (array of start, end of bytes), kept (binary)."""
    own = only(documents, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    docs = own.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"), "text", "doc_id")
    found = repeats(docs.select("id", "th", "text"))
    ranges = found.groupBy(F.col("id").alias("i"), F.col("th").alias("h")).agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("ranges"))
    joined = docs.join(ranges.hint("merge"), (F.col("id") == F.col("i")) & (F.col("th") == F.col("h")), "left").select("doc_id", "text", "ranges")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def cut(it):
        for b in batches(it):
            out = []
            for i, t, rs in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                data, runs = t.encode(), []
                for r in rs or ():
                    s, e = r["start"], r["start"] + r["n"] + LENGTH - 1
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(e, runs[-1][1])
                    else:
                        runs.append([s, e])
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True))
                out.append((i, len(data), [{"start": s, "end": e} for s, e in runs], kept))
            if out:
                yield batch(schema, *map(list, zip(*out, strict=True)))

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
