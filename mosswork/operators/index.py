"""Search index, slugs and cross references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import STOP_WORDS
from ..functions.text import index_tokens, slug
from ..functions.wikitext import links
from .ranges import numbered
from .stored import stored

#: Words of 64 bits of the filter in front of the titles, and bits of a key, all in one word. It is broadcast, and never larger, whatever there is of titles.
WORDS, BITS = 1 << 19, 3


def postings(entries: DataFrame, span: int = 100_000, dedupe: bool = True) -> DataFrame:
    """token, part, ids of entries (id, title, snippet): a part holds the ids of one span, so the list of a word that all entries have is many
    rows of bounded length. dedupe=False lists an id once per occurrence."""
    t = entries.select("id", F.explode(index_tokens(F.concat_ws(" ", "title", F.substring("snippet", 1, 500)), STOP_WORDS)).alias("token"))
    if dedupe:
        t = t.distinct()
    return t.groupBy("token", F.floor(F.col("id") / span).alias("part")).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def search(entries: DataFrame, query: list[str], k: int = 50) -> DataFrame:
    """One for each token found, two more for each that is inside the title; k best (the feature's limit)."""
    has = lambda w: F.array_contains(index_tokens(F.concat_ws(" ", "title", F.substring("snippet", 1, 500)), STOP_WORDS), w).cast("int")
    score = sum((has(w) for w in query), F.lit(0))
    score = score + F.when(score > 0, sum((2 * F.lower("title").contains(w).cast("int") for w in query), F.lit(0))).otherwise(0)
    return entries.select("id", "title", score.cast("long").alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(k)


#: Kinds of blocks, and what an entry gains by one: a token of the entry, a word of its title that holds the query's.
HIT, TITLE = 0, 1
GAIN = {HIT: 1, TITLE: 2}


def blocks(entries: DataFrame, span: int = 4096) -> DataFrame:
    """The stored index of entries (id, title, snippet) for `ranked`: word, kind, part, n, ids. A block holds the ids of one word among `span` that follow one another, so its length is
    bounded. Blocks are sorted by word and part, so a reader of few words and parts skips the files and pages of the others."""
    text = index_tokens(F.concat_ws(" ", "title", F.substring("snippet", 1, 500)), STOP_WORDS)
    words = lambda kind, found: F.transform(F.array_distinct(found), lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word")))
    titled = F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), 0)
    each = entries.select("id", F.explode(F.concat(words(HIT, text), words(TITLE, titled))).alias("x")).select("id", "x.*", F.floor(F.col("id") / span).alias("part"))
    made = each.groupBy("kind", "word", "part").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return stored(made.select("word", "kind", "part", F.size("ids").alias("n"), "ids").repartitionByRange("kind", "word", "part").sortWithinPartitions("kind", "word", "part"))


class Ranked:
    """The k best entries of a query, by postings alone.

    What a part of the entries can reach at most follows from which blocks it has, without their ids. The most promising parts are read first; then only those that can still
    get in before the k-th best. `read` and `all` are numbers of blocks."""

    def __init__(self, index: DataFrame, query: list[str], k: int = 50, first: int = 8):
        self.index, self.query, self.k = index, list(dict.fromkeys(query)), k
        word = F.col("word")
        meets = F.array(*(F.when((F.col("kind") == HIT) & (word == w) | (F.col("kind") == TITLE) & word.contains(w), F.lit(i)) for i, w in enumerate(self.query)))
        self.mine = (F.col("kind") == HIT) & word.isin(self.query) | (F.col("kind") == TITLE) & F.array_size(F.array_compact(meets)).cast("boolean")
        self.meets = F.array_compact(meets)
        known = index.filter(self.mine).select("part", "kind", "n", F.explode(self.meets).alias("q"))  # without ids
        gain = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("q"))) * GAIN[kind]
        bounds = known.groupBy("part").agg((gain(HIT) + gain(TITLE)).alias("bound"), F.count_if(F.col("kind") == HIT).alias("hits")).filter("hits > 0")
        self.bounds = stored(bounds)
        self.all = self._blocks(self.bounds)
        begun = stored(self.bounds.orderBy(F.desc("bound"), "part").limit(first))
        found = stored(self._scored(begun))
        kth = found.orderBy(F.desc("score"), "id").limit(k).agg(F.count("*").alias("n"), F.min("score").alias("score"), F.max_by("id", F.struct(-F.col("score"), "id")).alias("id")).first()
        rest = self.bounds.join(begun.select("part"), "part", "left_anti")
        if kth.n == k:  # of equal scores the smaller id goes first, so only parts before the k-th can still tie
            part = index.filter((F.col("kind") == HIT) & word.isin(self.query) & F.array_contains("ids", kth.id)).agg(F.max("part")).first()[0]
            rest = rest.filter((F.col("bound") > kth.score) | (F.col("bound") == kth.score) & (F.col("part") <= part))
        rest = stored(rest)
        self.read = self._blocks(begun) + self._blocks(rest)
        self.rows = found.unionByName(self._scored(rest)).orderBy(F.desc("score"), "id").limit(k)

    def _chosen(self, parts: DataFrame) -> DataFrame:
        return self.index.filter(self.mine).join(parts.select("part"), "part", "left_semi")

    def _blocks(self, parts: DataFrame) -> int:
        return self._chosen(parts).select("word", "kind", "part").count()

    def _scored(self, parts: DataFrame) -> DataFrame:
        """id, score of the entries of the parts that have a token of the query."""
        each = self._chosen(parts).select("kind", F.explode(self.meets).alias("q"), "ids").select("kind", "q", F.explode("ids").alias("id"))
        gain = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("q")))
        scored = each.groupBy("id").agg(gain(HIT).alias("h"), gain(TITLE).alias("t"))
        return scored.filter("h > 0").select("id", (F.col("h") * GAIN[HIT] + F.col("t") * GAIN[TITLE]).cast("long").alias("score"))


def ranked(index: DataFrame, query: list[str], k: int = 50) -> DataFrame:
    """id, score: the same rows as `search`, from the blocks of `blocks`."""
    return Ranked(index, query, k).rows


def slug_map(articles: DataFrame) -> DataFrame:
    """key, slug: exact and lower-case titles; later articles (by position) take over."""
    keys = articles.select(F.explode(F.array_distinct(F.array("title", F.lower("title")))).alias("key"), slug(F.col("title")).alias("slug"), "position")
    return keys.groupBy("key").agg(F.max_by("slug", "position").alias("slug"))


def _marks(hash_: str) -> tuple[Column, Column]:
    """The word of the filter that a hash belongs to, and its bits there."""
    return F.expr(f"pmod({hash_}, {WORDS})"), F.expr(" | ".join(f"shiftleft(1L, cast(shiftright({hash_}, {40 + 6 * k}) & 63 as int))" for k in range(BITS)))


def _perhaps(each: DataFrame, slugs: DataFrame) -> DataFrame:
    """The links of which a filter does not rule out that they lead to a key, as they are or in lower case: all that do, and few others. The others need not move."""
    word, bits = _marks("h")
    known = stored(slugs.select(F.xxhash64("key").alias("h")).select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")))
    rows = each.withColumns({"h1": F.xxhash64("target"), "h2": F.xxhash64(F.lower("target"))})
    for k in (1, 2):
        word, bits = _marks(f"h{k}")
        rows = rows.withColumn(f"w{k}", word).join(F.broadcast(known.select(F.col("word").alias(f"w{k}"), F.col("bits").alias(f"b{k}"))), f"w{k}", "left").withColumn(f"m{k}", bits)
    return rows.filter("b1 & m1 = m1 or b2 & m2 = m2").select(*each.columns)


def existing_links(articles: DataFrame, slugs: DataFrame) -> DataFrame:
    """title, target, slug of links that lead to an article: exact key first, then lower case; once per slug."""
    slugs = stored(slugs)
    each = _perhaps(articles.select("title", F.posexplode(links(F.col("text"))).alias("i", "target")), slugs)
    exact = each.join(slugs.withColumnRenamed("slug", "s1"), F.col("target") == F.col("key"), "left").drop("key")
    lower = exact.join(slugs.withColumnRenamed("slug", "s2"), F.lower("target") == F.col("key"), "left").drop("key")
    found = lower.select("title", "i", "target", F.coalesce("s1", "s2").alias("slug")).filter("slug is not null")
    return found.groupBy("title", "slug").agg(F.min_by("target", "i").alias("target"))


def parents(articles: DataFrame) -> DataFrame:
    return articles.groupBy("title").agg(F.max_by(F.struct("parent", "hop"), "position").alias("r")).select("title", "r.*")


def browse_order(entries: DataFrame) -> DataFrame:
    """Places by hop, then title."""
    return numbered(entries, "place", F.col("hop"), F.lower("title"), F.col("id"))


def cross_references(entries: DataFrame) -> DataFrame:
    """site, title, other site and path of titles that two or more sites have, in any case. Of a title each site has one path; there are few sites."""
    of = entries.groupBy(F.lower("title").alias("key"), "site").agg(F.min("path").alias("path"))
    shared = of.groupBy("key").agg(F.collect_list(F.struct("site", "path")).alias("sites")).filter("size(sites) > 1")
    titles = entries.select("site", "title", F.lower("title").alias("key")).distinct()
    each = titles.join(shared, "key").select("site", "title", F.explode("sites").alias("o")).filter("o.site <> site")
    return each.select("site", "title", F.col("o.site").alias("other_site"), F.col("o.path").alias("other_path"))


def featured(entries: DataFrame, preferred: list[str], most: int = 15) -> DataFrame:
    """Preferred titles in their order, then roots by title; `most` of them (the feature's limit)."""
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col("title")) if preferred else F.lit(0)
    rank = F.when(place > 0, place).otherwise(10**6)
    return entries.filter((place > 0) | (F.col("hop") == 0)).orderBy(rank, "title").limit(most)
