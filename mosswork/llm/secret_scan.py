"""Secret scans with corpus-wide ownership frequency (native).

Candidates of each text are hashed by their secret value. The hashes are counted over the corpus by
distinct repositories and owners: a value seen with many owners, or in many repositories of few owners, is
a widely copied example; one that stays with few of both looks live. Base kinds (assign, access, hex) are always reported, with
that verdict beside them; the further kind `opaque` (long mixed strings, which alone would catch
too much) is reported only where its value looks live and it overlaps no base span.

The counts come from partial aggregations, (hash, owner, repository), (hash, owner), then hash, so a value
that a third of all rows hold shrinks within each task before it is shuffled; its candidates meet the counts by
broadcast (see common.joined). Texts are never shuffled: candidates go through one small table.

Positions: Spark gives matched strings, not places, so a place is the summed length of the pieces
between matches (`split`) and the matches before it; both come from the same leftmost
non-overlapping scan. Sums are running totals, so many spans of one very long text cost little more than in proportion. Code points throughout.

Defined cases: a null text is empty; a null owner or repository counts as one value of its own;
rows with the same id and text are one document given twice, each gets the same result; rows with the
same id and other texts are judged apart; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, durable, joined, only, running, text_or_empty

#: Fixed by the contract: kind, pattern, group that holds the secret value, least length of that group.
BASE_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: 24 or more characters of one run with an upper-case letter, a lower-case letter and two digits.
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9][A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}"
#: A value in more distinct repositories than this is an example, whoever owns them.
MAX_REPOS = 10
KINDS = (*BASE_KINDS, ("opaque", OPAQUE, 0, 24))
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,hash:bigint,hash2:int>>"


def spans_of(text: Column, rank: int) -> Column:
    """All spans of one kind in a text; matches shorter than the kind's least length go."""
    kind, pattern, group, least = KINDS[rank]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secret = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.transform(F.split(text, pattern, -1), F.length)

    zipped = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), secret.alias("secret"))
    span = lambda x, end: F.struct(
        (end - F.length(x.whole)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), F.xxhash64(x.secret).alias("hash"), F.hash(x.secret).alias("hash2")
    )
    ends = lambda z: running(F.transform(z, lambda x: x.gap + F.length(x.whole)), lambda x, y: x + y)
    placed = bound(zipped, lambda z: F.zip_with(z, ends(z), lambda x, e: F.struct(x.alias("x"), e.alias("e"))))
    spans = F.transform(F.filter(placed, lambda y: F.length(y.x.secret) >= least), lambda y: span(y.x, y.e))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*(spans_of(text, r) for r in range(len(BASE_KINDS)))))


def _apart(every: Column) -> Column:
    """Of all spans of a text, sorted, the opaque ones that overlap no base span: the furthest end of base spans up to them and the
    next start of one behind them say so."""
    base = lambda s: s.rank < len(BASE_KINDS)
    reach = running(F.transform(every, lambda s: F.when(base(s), s.end).otherwise(0)), lambda x, y: F.greatest(x, y))
    ahead = F.reverse(running(F.transform(F.reverse(every), lambda s: F.when(base(s), s.start).otherwise(2**31 - 1)), lambda x, y: F.least(x, y)))
    kept = F.filter(F.arrays_zip(every.alias("s"), reach.alias("reach"), ahead.alias("ahead")), lambda z: ~base(z.s) & (z.reach <= z.s.start) & (z.ahead >= z.s.end))
    return F.transform(kept, lambda z: z.s)


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds `base` and `opaque`, the sorted spans of `text`."""
    docs = docs.withColumn("base", base_spans(F.col("text"))).withColumn("opaque", spans_of(F.col("text"), len(BASE_KINDS)))
    docs = docs.withColumn("every", F.when((F.size("base") > 0) & (F.size("opaque") > 0), F.array_sort(F.concat("base", "opaque"))))
    return docs.withColumn("opaque", F.when(F.col("every").isNull(), F.col("opaque")).otherwise(_apart(F.col("every")))).drop("every")


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, hash2, n_owners, n_repos, n (rows) of candidates (hash, hash2, owner, repo)."""
    seen = candidates.groupBy("hash", "hash2", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = seen.groupBy("hash", "hash2", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash", "hash2").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n"))


def judged(scanned: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """doc_id, text_hash, spans: every candidate of each document with `live`, sorted by start and kind."""
    each = scanned.select("doc_id", "text_hash", "owner", "repo", F.explode(F.concat("base", "opaque")).alias("s")).select("*", "s.hash", "s.hash2")
    frequency = durable(ownership(each.select("hash", "hash2", "owner", "repo")), "secret-ownership")
    return (
        joined(each, frequency, "hash", "hash2")
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set(F.struct("s.start", "s.rank", "s.end", "s.kind", ((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).alias("live")))).alias("spans"))
    )


def find(documents: DataFrame, doc_id="doc_id", text="text", owner="source", repo="doc_id", max_owners: int = 2, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per row of documents: doc_id, spans: array<struct<start,rank,end,kind,live>>."""
    docs = only(documents, doc_id=doc_id, text=text, owner=owner, repo=repo).withColumn("text", text_or_empty())
    scanned = with_candidates(docs.withColumn("text_hash", F.xxhash64("text"))).drop("text")
    scanned = durable(scanned, "secret-candidates")
    found = judged(scanned.filter("size(base) + size(opaque) > 0"), max_owners, max_repos).withColumnsRenamed({"doc_id": "id", "text_hash": "th"})
    every = scanned.select("doc_id", "text_hash").join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th")), "left")
    keep = F.filter("spans", lambda s: (s.kind != "opaque") | s.live)
    return every.select("doc_id", F.coalesce(keep, F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,live:boolean>>")).alias("spans"))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each maximal run of spans, sorted by start, replaced by `mask`. The text is cut once, at all edges of runs."""
    cut = lambda y, a, n: F.array_join(F.slice(y.chars, a + 1, n), "")

    def written(y: Column) -> Column:
        heads = F.transform(y.spans, lambda s, i: F.struct(s.start.alias("start"), F.coalesce(F.get(y.reach, i - 1), F.lit(0)).alias("before")))
        heads = F.filter(heads, lambda h: h.start >= h.before)
        pieces = F.transform(heads, lambda h: F.concat(cut(y, h.before, h.start - h.before), F.lit(mask)))
        return F.concat(F.array_join(pieces, ""), cut(y, F.element_at(y.reach, -1), F.size(y.chars)))

    reach = running(F.transform(spans, lambda s: s.end), lambda x, y: F.greatest(x, y))
    whole = F.struct(spans.alias("spans"), reach.alias("reach"), F.split(text, "").alias("chars"))
    return F.when(F.size(spans) == 0, text).otherwise(bound(whole, written))


def redacted(documents: DataFrame, doc_id="doc_id", text="text", owner="source", repo="doc_id", max_owners: int = 2, max_repos: int = MAX_REPOS) -> DataFrame:
    """documents, all columns, with base spans and live-looking opaque strings masked in `text`.

    Candidates of all documents are counted, as `find` does. Base spans need no verdict, so only texts of documents that
    hold an opaque candidate leave the map side."""
    columns = documents.columns
    own = documents.select(F.struct(*(documents[f"`{c}`"] for c in columns)).alias("row"))
    plain = F.coalesce(F.col("row")[text], F.lit(""))
    named = own.select("row", F.col("row")[doc_id].alias("doc_id"), F.col("row")[owner].alias("owner"), F.col("row")[repo].alias("repo"), plain.alias("text"), F.xxhash64(plain).alias("text_hash"))
    scanned = with_candidates(named)
    write = lambda rows, spans: rows.select(F.when(F.size(spans) == 0, F.col("row")).otherwise(F.col("row").withField(text, redact(F.col("text"), spans))).alias("row"))
    easy = write(scanned.filter("size(opaque) = 0"), F.col("base"))
    rare = durable(scanned.filter("size(opaque) > 0"), "secret-opaque")
    candidates = durable(scanned.select("doc_id", "text_hash", "owner", "repo", "base", "opaque").filter("size(base) + size(opaque) > 0"), "secret-candidates")
    found = judged(candidates, max_owners, max_repos).withColumnsRenamed({"doc_id": "id", "text_hash": "th"})
    hard = rare.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th")))
    hard = write(hard, F.filter("spans", lambda s: (s.kind != "opaque") | s.live))
    return easy.unionByName(hard).select("row.*")
