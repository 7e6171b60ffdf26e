"""Benchmark decontamination: an FM-index of every shard of the corpus, searched backwards for the benchmark's windows.

Words are maximal runs of digits, ASCII letters and everything beyond ASCII, with A-Z in lower case. A window is WINDOW words of an item that follow
one another; an item of fewer words, but not none, is one window. A word of a document inside an occurrence of a window is hit.

`index` cuts the corpus into shards of SHARD_WORDS words at most (whole documents; those longer than a shard are cut, with WINDOW - 1 words repeated).
A shard's words are numbered, its suffixes sorted by doubling what is sorted until all differ (ends of documents are all different symbols), and kept as a wavelet matrix of the
words before the sorted suffixes, with every SAMPLE-th position and every beginning of a document. The index does not depend on the
benchmark and is stored, so a lost executor costs a search and no sorting. `search` takes distinct windows in blocks of MOST_WINDOWS, which are
broadcast: a pass over the index for each block, in which all windows of the block take one step back after another through the ranks of all shards in
turn; what is found is walked to a sampled position. Pieces and blocks of a document meet by its number, with merged spans only.

Defined cases: null text has no words, and a document of none is never hit; a null item text has no window; items of one id are one item; a null item id is listed as `null`;
repeated rows are rows; windows of equal words are one window of several items; very long texts are cut as said; an empty benchmark or corpus gives no hits or no rows; further columns are
dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, batches, dropped, durable, only

WINDOW = 10
#: Symbols of a shard, which are its words and documents, fit into 21 bits, so three are a 63-bit key.
SHARD_WORDS = (1 << 20) - 1
SAMPLE = 16
#: Windows, with the items that have them, of one broadcast.
MOST_WINDOWS = 200_000
_BITS = 21

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Whether a byte belongs to a word.
_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_CASE = np.frombuffer(_LOWER, np.uint8)


#: A-Z in lower case, a blank for all that is in no word.
_BLANKED = bytes(c if _WORD[c] else 32 for c in _LOWER)


def words(text: str) -> list[bytes]:
    return text.encode().translate(_BLANKED).split()


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and how many each text has."""
    texts = texts.cast(pa.binary())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends.astype(np.int64) - ends[0]
    inside = _WORD[low := _CASE[raw]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[ends[:-1][ends[:-1] < len(raw)]] = inside[ends[:-1][ends[:-1] < len(raw)]]
    at = np.flatnonzero(begins)
    kept = np.cumsum(inside, dtype=np.int64)
    offsets = np.append(kept[at] - 1, kept[-1] if len(kept) else 0).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])])
    bounds = np.searchsorted(at, ends)
    return found, np.diff(bounds)


def suffixes(symbols: np.ndarray) -> np.ndarray:
    """The sorted order of the suffixes of symbols, which are below 2**21 and not 0. No suffix is the beginning of another, as a closing symbol occurs once."""
    n = len(symbols)
    s = np.zeros(n + 2, np.int64)
    s[:n] = symbols
    key = (s[:n] << 2 * _BITS) | (s[1 : n + 1] << _BITS) | s[2 : n + 2]
    order = np.argsort(key)
    sorted_ = key[order]
    new = np.empty(n, bool)
    new[:1], new[1:] = True, sorted_[1:] != sorted_[:-1]
    rank = np.zeros(n + 1, np.int64)
    rank[order] = first = np.flatnonzero(new)[np.cumsum(new) - 1]  # the place of the first of equals
    depth = 3
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = np.flatnonzero(~alone)  # places whose suffixes are not told apart yet; equal ones stand together
        if not len(open_):
            return order
        at = order[open_]
        beyond = rank[np.minimum(at + depth, n)]
        key = (first[open_] << 32) | beyond
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        fresh = np.empty(len(key), bool)
        fresh[0], fresh[1:] = True, key[1:] != key[:-1]
        new[open_] = fresh
        first[open_] = open_[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        rank[at] = first[open_]
        depth *= 2


class Bits:
    """A bit vector with the number of ones before each word of it."""

    def __init__(self, bits: np.ndarray | None = None, words: np.ndarray | None = None):
        if words is None:
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(len(bits) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words), np.int64)
        np.cumsum(np.bitwise_count(words[:-1]), out=self.before[1:], dtype=np.int64)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """A sequence of symbols below 2**depth by the bits of its symbols, highest first; zeros go before ones at each level."""

    def __init__(self, depth: int, n: int, levels: list[Bits]):
        self.levels, self.depth, self.n = levels, depth, n
        self.zeros = [n - int(b.ones(np.array([n]))[0]) for b in levels]

    @classmethod
    def of(cls, symbols: np.ndarray, depth: int) -> Wavelet:
        levels, s = [], symbols.astype(np.uint32)
        for k in range(depth - 1, -1, -1):
            bit = (s >> np.uint32(k)) & np.uint32(1) == 1
            levels.append(Bits(bit))
            s = np.concatenate([s[~bit], s[bit]])
        return cls(depth, len(symbols), levels)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands before place i, and where its run begins in the last level, which cancels out against the same for place 0."""
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.ones(i)
            i = np.where((symbol >> (self.depth - 1 - k)) & 1 == 1, zeros + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and `rank` of it and i."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits.at(i).astype(np.int64), bits.ones(i)
            symbol = symbol * 2 + one
            i = np.where(one == 1, zeros + ones, i - ones)
        return symbol, i


class FMIndex:
    """Of texts of numbered words: symbol 0 ends a text, word w is symbol w + 1. `starts` are the places of the texts' first words."""

    def __init__(self, wavelet: Wavelet, totals: np.ndarray, marked: Bits, sampled: np.ndarray):
        self.wavelet, self.totals, self.marked, self.sampled = wavelet, totals, marked, sampled
        self.base = wavelet.rank(np.arange(len(totals) - 1), np.zeros(len(totals) - 1, np.int64))

    @classmethod
    def of(cls, numbers: np.ndarray, n_words: int, starts: np.ndarray) -> FMIndex:
        """numbers: the words of all texts laid one behind another, with -1 behind each text."""
        ends = np.flatnonzero(numbers < 0)
        apart = numbers + len(ends) + 1
        apart[ends] = np.arange(1, len(ends) + 1)
        order = suffixes(apart)
        symbols = numbers + 1
        before = symbols[order - 1]  # that before the first place is the last text's end
        totals = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_words + 1))])
        keep = np.zeros(len(numbers), bool)
        keep[::SAMPLE] = keep[starts] = True
        marks = keep[order]
        return cls(Wavelet.of(before, max(1, int(n_words).bit_length())), totals, Bits(marks), order[marks].astype(np.int32))

    def back(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.totals[symbol] + self.wavelet.rank(symbol, i) - self.base[symbol]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each pattern; a row is a pattern's words, 0 before it where it is shorter."""
        symbols = patterns.astype(np.int64)
        lo, hi = self.totals[symbols[:, -1]], self.totals[symbols[:, -1] + 1]
        for k in range(symbols.shape[1] - 2, -1, -1):
            live = np.flatnonzero((symbols[:, k] > 0) & (lo < hi))
            if not len(live):
                break
            both = self.back(np.tile(symbols[live, k], 2), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = both[: len(live)], both[len(live) :]
        return lo, np.maximum(lo, hi)

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the sorted suffixes: back word by word until a sampled one."""
        out, walking, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        at = rows.astype(np.int64)
        while len(walking):
            known = self.marked.at(at) == 1
            out[walking[known]] = self.sampled[self.marked.ones(at[known])] + steps
            walking, at = walking[~known], at[~known]
            if len(at):
                symbol, ranked = self.wavelet.access(at)
                at = self.totals[symbol] + ranked - self.base[symbol]
            steps += 1
        return out

    def stored(self) -> tuple[int, int, bytes, bytes, bytes, bytes]:
        w = self.wavelet
        return w.depth, w.n, b"".join(b.words.tobytes() for b in w.levels), self.totals.astype(np.int32).tobytes(), self.marked.words.tobytes(), self.sampled.tobytes()

    @classmethod
    def loaded(cls, depth: int, n: int, levels: bytes, totals: bytes, marked: bytes, sampled: bytes) -> FMIndex:
        each = np.frombuffer(levels, np.uint64).reshape(depth, -1)
        wavelet = Wavelet(depth, n, [Bits(words=x) for x in each])
        return cls(wavelet, np.frombuffer(totals, np.int32).astype(np.int64), Bits(words=np.frombuffer(marked, np.uint64)), np.frombuffer(sampled, np.int32))


_INDEX = pa.schema(
    [("docs", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("from_word", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("words", pa.list_(pa.binary())), ("depth", pa.int64()), ("n", pa.int64()), ("levels", pa.binary()), ("totals", pa.binary()), ("marked", pa.binary()), ("sampled", pa.binary())]
)
_INDEX_DDL = "docs array<long>, rows array<long>, n_words array<long>, from_word array<long>, starts array<long>, words array<binary>, depth long, n long, levels binary, totals binary, marked binary, sampled binary"


def _shard(pieces) -> pa.RecordBatch:
    """An index row of pieces (row, doc_id, words of the document, first word, word array); pieces without words are listed only."""
    full = [p for p in pieces if len(p[4])]
    pieces = full + [p for p in pieces if not len(p[4])]
    sizes = np.array([len(p[4]) for p in full], np.int64)
    starts = np.cumsum(np.concatenate([[0], sizes + 1]))[:-1] if len(full) else np.zeros(0, np.int64)
    columns = [[p[1] for p in pieces]], [[p[0] for p in pieces]], [[p[2] for p in pieces]], [[p[3] for p in pieces]], [starts.tolist()]
    if not full:
        return batch(_INDEX, *columns, [[]], *([x] for x in (0, 0, b"", b"", b"", b"")))
    coded = pa.concat_arrays([p[4] for p in full]).dictionary_encode()
    numbers = np.full(int(sizes.sum()) + len(full), -1, np.int64)
    inside = np.ones(len(numbers), bool)
    inside[starts + sizes] = False
    numbers[inside] = coded.indices.to_numpy()
    made = FMIndex.of(numbers, len(coded.dictionary), starts)
    return batch(_INDEX, *columns, pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), *([x] for x in made.stored()))


def _indexed(it):
    """Batches (doc_id, text) to index rows. A row's number is its task's and its place there; they are stored once, so no second reading can number otherwise."""
    row = (TaskContext.get().partitionId() << 33) - 1
    held, size = [], 0
    for b in batches(it, mb=8):
        found, counts = _split(b.column(1))
        at = 0
        for doc, n in zip(b.column(0).to_pylist(), counts.tolist(), strict=True):
            row += 1
            own = found.slice(at, n)
            at += n
            for first in range(0, max(1, n - WINDOW + 1), SHARD_WORDS - WINDOW + 1):
                piece = own.slice(first, SHARD_WORDS)
                if held and (size + len(piece) > SHARD_WORDS or len(held) >= SHARD_WORDS):
                    yield _shard(held)
                    held, size = [], 0
                held.append((row, doc, n, first, piece))
                size += len(piece)
    if held:
        yield _shard(held)


def index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: a row for each shard. It serves any number of searches; `dropped` deletes it."""
    docs = only(documents, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return durable(docs.mapInArrow(_indexed, _INDEX_DDL), "fm-index")


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """item, window: the distinct windows of each item, as words with blanks between."""

    def cut(it):
        schema = pa.schema([("item", pa.string()), ("window", pa.binary())])
        for b in batches(it):
            items, found = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(t)
                own = {b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else ()
                items += [i] * len(own)
                found += own
                if len(found) > 50_000:
                    yield batch(schema, items, found)
                    items, found = [], []
            yield batch(schema, items, found)

    rows = only(benchmark, item=item_id, text=text).select(F.coalesce(F.col("item").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "item string, window binary").distinct()


class _Block:
    """Distinct windows of one broadcast: their words as numbers, and the items of each."""

    def __init__(self, pairs: list[tuple[str, bytes]]):
        of: dict[bytes, list[str]] = {}
        for item, window in pairs:
            of.setdefault(window, []).append(item)
        self.items = [sorted(x) for x in of.values()]
        split = [w.split(b" ") for w in of]
        known = sorted({w for ws in split for w in ws})
        number = {w: i + 1 for i, w in enumerate(known)}
        self.sizes = np.array([len(ws) for ws in split], np.int64)
        self.rows = np.zeros((len(split), max([1, *map(len, split)])), np.int32)
        for row, ws in zip(self.rows, split, strict=True):
            row[len(row) - len(ws) :] = [number[w] for w in ws]
        self.words = pa.array(known, pa.binary())


_HITS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
_HITS_DDL = "row long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _found(shard: dict, block: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shard's text where windows begin, and the windows' numbers."""
    none = np.zeros(0, np.int64)
    if not shard["n"] or not len(block.rows):
        return none, none
    to = pc.index_in(block.words, value_set=shard["words"]).fill_null(-1).to_numpy().astype(np.int64) + 1  # symbol of each word, 0 if the shard has none
    of = np.concatenate([[0], to])
    symbols = of[block.rows]
    live = np.flatnonzero(((symbols > 0) == (block.rows > 0)).all(1))
    if not len(live):
        return none, none
    made = FMIndex.loaded(*(shard[k] for k in ("depth", "n", "levels", "totals", "marked", "sampled")))
    lo, hi = made.ranges(symbols[live])
    n = hi - lo
    rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return made.places(rows), np.repeat(live, n)


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Spans that touch or overlap become one."""
    order = np.argsort(starts, kind="stable")
    starts, upto = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > upto[:-1]]))
    last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    return [{"start": int(a), "end": int(b)} for a, b in zip(starts[new], upto[last], strict=True)]


def search(indexed: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", most: int = MOST_WINDOWS) -> DataFrame:
    """doc_id, n_words, spans of words (start, end exclusive, merged) and the sorted items whose windows occur, a row for each document."""
    spark = indexed.sparkSession
    cut = durable(windows(benchmark, item_id, text), "windows")
    blocks = max(1, -(-cut.count() // most))
    dealt = cut.select("item", "window", F.pmod(F.xxhash64("item", "window"), F.lit(blocks)).alias("block"))
    hits = None
    for k in range(blocks):
        told = spark.sparkContext.broadcast(_Block([(r.item, bytes(r.window)) for r in dealt.filter(F.col("block") == k).collect()]))  # some `most` rows
        found = indexed.mapInArrow(_searcher(told), _HITS_DDL)
        hits = found if hits is None else hits.unionByName(found)
    dropped(cut)
    whole = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return whole.mapInArrow(_joined, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def _joined(it):
    """Spans of all pieces and blocks of a document, merged."""
    for b in batches(it):
        starts, ends = (np.asarray(b.column("spans").flatten().field(k)) for k in ("start", "end"))
        cut = np.concatenate([[0], np.cumsum(b.column("spans").value_lengths().to_numpy())])
        spans = [_merged(starts[i:j], ends[i:j]) if i < j else [] for i, j in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(spans, _HITS.field("spans").type), b.column("items")], ["doc_id", "n_words", "spans", "items"])


def _searcher(told):
    def run(it):
        for b in it:
            for i in range(b.num_rows):
                shard = {c: b.column(c)[i].as_py() for c in b.schema.names if c != "words"}
                shard["words"] = b.column("words")[i].values
                block = told.value
                at, window = _found(shard, block)
                starts = np.array(shard["starts"], np.int64)
                piece = np.searchsorted(starts, at, "right") - 1
                order = np.argsort(piece, kind="stable")
                at, window, piece = at[order], window[order], piece[order]
                cut = np.searchsorted(piece, np.arange(len(shard["rows"]) + 1))
                spans, items = [[] for _ in shard["rows"]], [[] for _ in shard["rows"]]
                for p in np.unique(piece).tolist():
                    mine = slice(cut[p], cut[p + 1])
                    first = at[mine] - starts[p] + shard["from_word"][p]
                    spans[p] = _merged(first, first + block.sizes[window[mine]])
                    items[p] = sorted({x for w in np.unique(window[mine]).tolist() for x in block.items[w]})
                for lo in range(0, len(spans), 4096):
                    own = slice(lo, lo + 4096)
                    yield batch(_HITS, shard["rows"][own], shard["docs"][own], shard["n_words"][own], spans[own], items[own])

    return run
