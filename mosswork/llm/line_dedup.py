"""Line dedup by winnowing over line hashes (native).

A repeated run is `min_run` or more consecutive lines that also occur earlier: in a document of
smaller id, or in the same document further up. Lines compare trimmed, by 64-bit hashes;
`min_run` of them together decide. With `min_words`, fewer lines are a run too if they hold more words
than that together, down to one long line. Every line covered by a repeated run goes; the first occurrence stays.

Winnowing: of every `min_run` consecutive line hashes the least (the last of equals) is a
fingerprint, so two equal runs always share one at the same place; with `min_words` each shorter run of so many words chooses one
too. Only fingerprints are stored, with their position and the lines around, which are half of the lines in the mean. Those that occur once go. The
positions of the others are joined: each is extended both ways, by comparing lines, to the windows that chose it, and a window
is joined to the earliest position of the same lines. Windows that touch make one run. That is one minimum per
content, combined map-side: copies are never paired with each other. The rows of a line that very many rows hold stay where they are
and meet its minimum by broadcast (see common.joined).

Defined cases: a null text is empty, an empty text is one empty line; documents of fewer than
`min_run` lines keep all without `min_words`; order between rows of one id is by text hash, and rows with the same id and text
are one document given twice (each gets the same result); very long texts cost in proportion to their lines; an empty table
gives an empty result; further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, joined, only, text_or_empty


def _sum(a):
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def fingerprints(docs: DataFrame, min_run: int, min_words: int | None = None) -> DataFrame:
    """A row per fingerprint of each document (doc_id, text_hash, text): print, its position, and the lines (h, words) from `first`
    on that a window around it can hold."""
    own = F.split("text", "\n")
    words = F.transform(own, lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))) if min_words is not None else F.array().cast("array<int>")
    lines = docs.select("doc_id", "text_hash", F.transform(own, lambda x: F.xxhash64(F.trim(x))).alias("h"), words.alias("words"))

    def chosen(n: int):
        """Positions that windows of n lines choose."""
        at = F.sequence(F.lit(0), F.size("h") - n)
        if n < min_run:
            at = F.filter(at, lambda i: _sum(F.slice("words", i + 1, F.lit(n))) > min_words)
        cut = lambda i: F.slice("h", i + 1, F.lit(n))
        place = F.transform(at, lambda i: (i + n - F.array_position(F.reverse(cut(i)), F.array_min(cut(i)))).cast("int"))
        return F.when(F.size("h") >= n, place).otherwise(F.array().cast("array<int>"))

    places = F.array_distinct(F.concat(*(chosen(n) for n in range(min_run if min_words is None else 1, min_run + 1))))
    first = lambda p: F.greatest(p - (min_run - 1), F.lit(0))
    around = lambda c, p: F.slice(c, first(p) + 1, p - first(p) + min_run)
    each = F.transform(places, lambda p: F.struct(F.get("h", p).alias("print"), p.alias("place"), first(p).alias("first"), around("h", p).alias("lines"), around("words", p).alias("words")))
    return lines.select("doc_id", "text_hash", F.explode(each).alias("x")).select("doc_id", "text_hash", "x.*")


def extended(prints: DataFrame, min_run: int, min_words: int | None = None) -> DataFrame:
    """doc_id, text_hash, at, lines of each window that chose a fingerprint: the fingerprint with lines on both sides."""
    windows = []
    for n in range(min_run if min_words is None else 1, min_run + 1):
        for back in range(n):
            at = F.col("place") - back
            lines = F.slice("lines", F.greatest(at - F.col("first"), F.lit(0)) + 1, F.lit(n))
            last_least = n - F.array_position(F.reverse(lines), F.array_min(lines)) == back
            fits = (at >= F.col("first")) & (F.size(lines) == n) & last_least
            if n < min_run:
                fits = fits & (_sum(F.slice("words", F.greatest(at - F.col("first"), F.lit(0)) + 1, F.lit(n))) > min_words)
            windows.append(F.when(fits, F.struct(at.alias("at"), lines.alias("lines"))))
    each = F.explode(F.filter(F.array(*windows), lambda w: w.isNotNull()))
    return prints.select("doc_id", "text_hash", each.alias("w")).select("doc_id", "text_hash", "w.at", "w.lines")


def repeated_windows(docs: DataFrame, min_run: int, min_words: int | None = None) -> DataFrame:
    """doc_id, text_hash, at, n: windows of n lines of which the same lines also begin earlier."""
    each = durable(fingerprints(docs, min_run, min_words), "line-fingerprints")
    shared = durable(each.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1"), "line-shared")
    windows = durable(extended(joined(each, shared, "print"), min_run, min_words), "line-windows")
    here = F.struct(F.col("doc_id"), F.col("text_hash"), F.col("at"))
    first = durable(windows.groupBy("lines").agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1"), "line-firsts")
    return joined(windows, first, "lines").filter(~here.eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "at", F.size("lines").alias("n"))


def dedup(documents: DataFrame, doc_id="doc_id", text="text", min_run: int = 3, min_words: int | None = None) -> DataFrame:
    """One row per row of documents: doc_id, n_lines, removed (array of line numbers, from 0), kept_text."""
    docs = only(documents, doc_id=doc_id, text=text).withColumn("text", text_or_empty()).withColumn("text_hash", F.xxhash64("text"))
    gone = (
        repeated_windows(docs, min_run, min_words)
        .groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"))
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1))))).alias("removed"))
    )
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th")), "left")
    out = out.select("doc_id", "text", "removed", F.split("text", "\n").alias("lines"))
    # the lines before each removed one and behind the last, from the end of the run before: slices, not a search for each line
    ends = F.concat("removed", F.array(F.size("lines")))
    gaps = F.filter(F.transform(ends, lambda e, i: F.struct((F.coalesce(F.get("removed", i - 1), F.lit(-1)) + 1).alias("a"), e.alias("e"))), lambda g: g.a < g.e)
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(gaps, lambda g: F.array_join(F.slice("lines", g.a + 1, g.e - g.a), "\n")), "\n"))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), kept.alias("kept_text"))
