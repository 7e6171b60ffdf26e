"""Best-fit packing by minimum bin slack.

Documents are cut into pieces of at most `size` tokens. Lengths are at most `size` different
numbers, so the plan is made on their counts: for each bin, the longest piece left is placed, a
bitset subset-sum over the lengths left finds the fullest combination beside it, and both are
removed, as often at once as the counts allow. Plan and counts have a size bound of their own;
pieces then take their places by rank among pieces of equal length. Ranks are counted in salted
groups, so a length that a third of all pieces have is shared by many tasks.

Defined cases: a null text is empty and one token long (the end mark); pieces of equal length are
ordered by id (nulls first), piece and checksum; rows given twice are packed twice; an empty table gives an empty
result; further columns are dropped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, batches, durable, only
from .tokens import WordEncoder, opened

SIZE = 2048
END = 0
#: Pieces of one length in a group in which ranks are counted.
GROUP = 1_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(documents: DataFrame, vocabulary: str, doc_id="doc_id", text="text", size: int = SIZE) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""
    end = np.array([END], "<u4").tobytes()

    def cut(it):
        encoder = opened(WordEncoder, vocabulary)
        for b in batches(it, rows=512):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    for column, v in zip(out, (doc, k, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        column.append(v)
            yield batch(_PIECES, *out)

    return only(documents, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths, as often as counts allow, whose sum is the largest up to `room`. lengths: ascending."""
    bits, layers, goal, mask = 1, [], 1 << room, (1 << room + 1) - 1
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        n = lengths[i]
        for _ in range(min(counts[n], room // n)):
            more = bits | bits << n & mask
            if more == bits:
                break
            layers.append((n, bits))
            bits = more
            if bits & goal:
                break
        if bits & goal:
            break
    left, chosen = bits.bit_length() - 1, []
    for n, before in reversed(layers):
        if not before >> left & 1:
            chosen.append(n)
            left -= n
    return chosen


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first bin, offset): the pieces of that length from that rank on go into
    bins from that one on, one each, at that offset; up to the next entry's rank."""
    counts = {n: c for n, c in counts.items() if c}
    lengths, ranks, entries, bins = sorted(counts), dict.fromkeys(counts, 0), [], 0
    while lengths:
        first = lengths[-1]
        counts[first] -= 1
        chosen = [first, *fullest(counts, lengths, size - first)]
        counts[first] += 1
        need = {n: chosen.count(n) for n in set(chosen)}
        times, offset = min(counts[n] // k for n, k in need.items()), 0
        for n in chosen:
            entries.append((n, ranks[n], bins, offset))
            ranks[n] += times
            offset += n
        for n, k in need.items():
            counts[n] -= times * k
        lengths = [n for n in lengths if counts[n]]
        bins += times
    return entries


def packed(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces with sequence_id and offset. cut: a durable table of pieces; it is read three times."""
    histogram = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `size` rows
    entries = np.array(sorted(plan({r.length: r.n for r in histogram}, size)), np.int64).reshape(-1, 4)
    salts = cut.sparkSession.createDataFrame([(r.length, -(-r.n // GROUP)) for r in histogram], "length long, salts long")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), "salts"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    place = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("k", F.row_number().over(place)).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k") - 1).alias("rank"))
    keys, schema = (entries[:, 0] << 44) + entries[:, 1], pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def put(it):
        for b in it:
            rank, length = b.column(5).to_numpy(), b.column(3).to_numpy()
            e = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            yield batch(schema, *b.columns[:5], entries[e, 2] + rank - entries[e, 1], entries[e, 3])

    return ranked.mapInArrow(put, PIECES + ", sequence_id long, offset long")


def pack(documents: DataFrame, vocabulary: str, doc_id="doc_id", text="text", size: int = SIZE) -> DataFrame:
    return packed(durable(pieces(documents, vocabulary, doc_id, text, size), "pieces"), size)
