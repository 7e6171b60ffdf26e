"""Spelling variants: words one inserted, deleted or replaced code point apart, each led to its most frequent neighbour.

Of two such words, L code points in the shorter, one edit leaves the first or the last L // 2 intact. So the dictionary is sorted twice, forward and reversed, once for
words as the shorter and once as the longer of a pair, and words that share their first half stand together as a block. Ranges of blocks are scanned in tasks. A block with
too many pairs is subdivided: of the part where the edit must be, again one half is intact, so its words go to blocks that share more at the front and
to blocks that share more at the back, until blocks are small or a single code point is open, where there are no more words than the
alphabet allows. Blocks beyond MOST_ROWS are subdivided so before they are dealt out, the others inside their task. Pairs are verified in full by their
common beginning and end. A pair is found in one block only: where a block is divided, pairs that share the longer front are left to that side. Each word's
neighbours are counted and their best is taken in the task, so pairs are never shuffled.

Defined cases: null words take no part; a word that is listed more than once counts with the sum of its numbers; ties go to the smaller word in code point order; the empty word is
a word; very long words make blocks of their own; an empty dictionary gives no rows; further columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, batches, dropped, durable, only

#: Pairs of a block that are compared without subdividing it, rows of a block that goes to one task, rows and pairs at a time.
MOST_PAIRS, MOST_ROWS, CHUNK_ROWS, CHUNK_PAIRS = 400, 1 << 15, 1 << 17, 1 << 20
NO_CAP = 1 << 30
RUN = r"[A-Za-zÀ-ÿ]"
_PATH = ["size", "side", "a", "b", "cap"]


def runs(text: Column, least: int = 1) -> Column:
    """All maximal runs of letters of at least `least` code points, A-Z in lower case."""
    found = F.regexp_extract_all(text, F.lit(f"{RUN}{{{least},}}"), F.lit(0))
    return F.transform(found, lambda w: F.translate(w, "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))))


def _back(w: Column, b: Column) -> Column:
    return F.when(b > 0, F.right(w, b)).otherwise(F.lit(""))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.concat(F.substring("w", F.lit(1), F.col("a")), F.lit("|"), _back(F.col("w"), F.col("b"))))


def _memberships(dictionary: DataFrame) -> DataFrame:
    """Each word forward and reversed, as the shorter and as the longer of a pair."""
    size = F.char_length("word")
    as_ = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), (size - longer).alias("size")) for side in (0, 1) for longer in (0, 1))))
    each = dictionary.select("word", "n", as_.alias("x")).filter("x.size >= 0").select("x.*", "n", F.when(F.col("x.side") == 0, F.col("word")).otherwise(F.reverse("word")).alias("w"))
    return _keyed(each.select("size", "side", F.floor(F.col("size") / 2).cast("int").alias("a"), F.lit(0).alias("b"), F.lit(NO_CAP).alias("cap"), "w", "n"))


def _subdivided(rows: DataFrame) -> DataFrame:
    """rows with blocks of more than MOST_ROWS in their halves."""
    while True:
        counts = rows.groupBy(*_PATH, "key").agg(F.count("*").alias("c"))
        large = durable(counts.filter((F.col("c") > MOST_ROWS) & (F.col("size") - F.col("a") - F.col("b") > 1)).drop("c"), "large-blocks")
        n = large.count()
        if not n:
            dropped(large)
            return rows
        # few blocks are large; the check of their number keeps the broadcast bounded, and beyond it skewed partitions of the join are split at run time
        large = F.broadcast(large) if n <= 100_000 else large
        half = F.floor((F.col("size") - F.col("a") - F.col("b")) / 2).cast("int")
        both = F.explode(F.array(F.struct((F.col("a") + half).alias("a"), F.col("b"), F.col("cap")), F.struct(F.col("a"), (F.col("b") + half).alias("b"), F.least("cap", F.col("a") + half).alias("cap"))))
        split = rows.join(large, [*_PATH, "key"], "left_semi").select("size", "side", "w", "n", both.alias("x")).select("size", "side", "x.*", "w", "n")
        rows = durable(rows.join(large, [*_PATH, "key"], "left_anti").unionByName(_keyed(split)), "spelling-blocks")


def _pairs(shorts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each of `shorts` (places of rows) with the rows from `at` to before `ends`, CHUNK_PAIRS or so at a time."""
    n = ends - at
    shorts, at, n = shorts[n > 0], at[n > 0], n[n > 0]
    total = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK_PAIRS)))
        m = n[lo:hi]
        yield np.repeat(shorts[lo:hi], m), np.repeat(at[lo:hi], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        lo = hi


def neighbours(words: list[str], blocks: np.ndarray, size: int, a: int, b: int, cap: int, most_end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places in words) one edit apart within blocks of words of `size` or one more code points, which share their first a and last b. Only pairs that
    share fewer than `cap` at the front and `most_end` at the end."""
    joined = "".join(words)
    try:
        letters, base = np.frombuffer(joined.encode("latin-1"), np.uint8), 256
    except UnicodeEncodeError:
        letters, base = np.frombuffer(joined.encode("utf-32-le"), np.uint32), 1 << 21
    length = np.fromiter(map(len, words), np.int64, len(words))
    long, wide = length > size, np.arange(size + 1)
    front = np.zeros((len(words), size + 1), letters.dtype)
    back = front.copy()
    front[wide[None, :] < length[:, None]] = letters
    back[wide[None, :] >= size + 1 - length[:, None]] = letters

    def near(i, j):
        """Keeps the pairs that are one edit apart and within the limits."""
        differ = front[i, :size] != front[j, :size]
        p = np.where(differ.any(1), differ.argmax(1), size) if size else np.zeros(len(i), np.int64)
        differ = back[i, 1:][:, ::-1] != back[j, 1:][:, ::-1]
        s = np.where(differ.any(1), differ.argmax(1), size) if size else np.zeros(len(i), np.int64)
        ok = (p + s >= size - ~long[j]) & (p < cap_) & (s < most_end)
        return i[ok], j[ok]

    todo = [(np.arange(len(words)), blocks, a, b, cap, False)]
    while todo:
        rows, block, a, b, cap_, inserts = todo.pop()
        order = np.lexsort((long[rows], block))
        rows, block = rows[order], block[order]
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        sizes = np.diff(np.append(first, len(rows)))
        shorts = np.add.reduceat(~long[rows], first) if len(first) else sizes
        pairs = shorts * (sizes - shorts) + (0 if inserts else shorts * (shorts - 1) // 2)
        open_ = size - a - b
        small = (pairs <= MOST_PAIRS) | (open_ < 1)
        end_of, begin_of = np.repeat(first + sizes, sizes), np.repeat(first + shorts, sizes)
        is_small, is_short = np.repeat(small, sizes), ~long[rows]
        mine = np.flatnonzero(is_small & is_short)
        for i, j in _pairs(mine, end_of[mine], begin_of[mine] if inserts else mine + 1):
            yield near(rows[i], rows[j])
        rest = ~is_small
        if not rest.any():
            continue
        if open_ == 1 and not inserts:  # shorts that differ in the one open place: as many as the alphabet has letters
            mine = np.flatnonzero(rest & is_short)
            for i, j in _pairs(mine, begin_of[mine], mine + 1):
                yield near(rows[i], rows[j])
        half = max(1, open_ // 2)
        for columns, path in (([front[rows[rest], a + t] for t in range(half)], (a + half, b, cap_)), ([back[rows[rest], size - b - t] for t in range(half)], (a, b + half, min(cap_, a + half)))):
            group = np.unique(block[rest], return_inverse=True)[1].astype(np.int64)
            for column in columns:
                group = np.unique(group * base + column, return_inverse=True)[1].astype(np.int64)
            todo.append((rows[rest], group, *path, inserts or open_ == 1))


_FOUND = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _scanned(it):
    """Sorted rows (path, key, w, n) to each word's number of neighbours and its best one, a row or some rows a word."""
    held: list[tuple] = []

    def flush(rows):
        path = dict(zip(_PATH, rows[0][:5], strict=True))
        words, n = [r[6] for r in rows], np.array([r[7] for r in rows], np.int64)
        keys = [r[5] for r in rows]
        blocks = np.cumsum([0, *(x != y for x, y in zip(keys, keys[1:]))])
        found = list(neighbours(words, blocks, path["size"], path["a"], path["b"], path["cap"], path["size"] // 2 if path["side"] else NO_CAP))
        if not sum(len(i) for i, _ in found):
            return
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
        named = [w[::-1] for w in words] if path["side"] else words
        rank = np.empty(len(named), np.int64)
        rank[sorted(range(len(named)), key=named.__getitem__)] = np.arange(len(named))
        order = np.lexsort((rank[j], -n[j], i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        near = np.diff(np.append(first, len(i)))
        yield batch(_FOUND, [named[k] for k in i[first].tolist()], near, n[j[first]], [named[k] for k in j[first].tolist()])

    for b in batches(it, rows=1 << 14):
        for row in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
            # a block stays whole; blocks of one path go together
            if held and row[:6] != held[-1][:6] and (row[:5] != held[-1][:5] or len(held) >= CHUNK_ROWS):
                yield from flush(held)
                held = []
            held.append(row)
    if held:
        yield from flush(held)


def near_words(dictionary: DataFrame) -> DataFrame:
    """word, n_near, best_n, best of the words (word, n; each once) that have neighbours."""
    rows = _subdivided(_memberships(dictionary))
    ranged = rows.select(*_PATH, "key", "w", "n").repartitionByRange(*_PATH, "key").sortWithinPartitions(*_PATH, "key", "w")
    found = ranged.mapInArrow(_scanned, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def group(words: DataFrame, ratio: int = 10, word: str = "word", n: str = "n") -> DataFrame:
    """word, form, root, n, n_near, form_n: a word's form is its neighbour of largest n, if that is `ratio` times its own at least; its root is where
    forms lead. Numbers grow by `ratio` on the way, so a chain is no longer than the logarithm of the largest, and is halved in each round."""
    given = only(words, word=word, n=n).filter("word is not null")
    dictionary = durable(given.groupBy("word").agg(F.sum("n").cast("long").alias("n")), "dictionary")
    near = durable(dictionary.join(near_words(dictionary), "word", "left").withColumn("leads", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))), "near-words")
    roots = near.filter("leads").select("word", F.col("best").alias("root"))
    least, most = dictionary.agg(F.min("n"), F.max("n")).first()
    hops = math.floor(math.log(most / max(1, least), ratio) + 1e-9) if most else 0
    for _ in range(math.ceil(math.log2(hops)) if hops > 1 else 0):
        roots = durable(roots, "spelling-roots")
        roots = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("beyond")), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"))
    led = lambda c: F.when(F.col("leads"), F.col(c))
    return near.join(roots, "word", "left").select("word", led("best").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), led("best_n").alias("form_n"))
