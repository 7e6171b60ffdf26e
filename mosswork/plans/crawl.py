"""Level-synchronous expansion: a frontier of subjects becomes the next one by recorded answers.

Providers are tables joined in; what a provider leaves unanswered fails closed: no article, not a named entity, a duplicate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canon_key, plural, singular, title_and_confidence
from ..functions.wikitext import categories, links_outside
from ..operators import vector
from ..operators.stored import stored
from .seen import SeenKeys

#: So many keys that were seen, or have forms, are broadcast.
MOST_HITS = 200_000


def phrases(wikitext: Column, confidence: float | None = None) -> Column:
    """Links, then categories, each once, in order. confidence: links carry one, "Title (0.97)", and those below go."""
    links = links_outside(wikitext)
    if confidence is not None:
        told = F.transform(links, title_and_confidence)
        links = F.transform(F.filter(told, lambda x: F.coalesce(x.confidence, F.lit(0.0)) >= confidence), lambda x: x.title)
    return F.array_distinct(F.concat(links, categories(wikitext)))


def candidates(articles: DataFrame, confidence: float | None = None) -> DataFrame:
    """subject, hop, place, phrase of articles (subject, hop, wikitext)."""
    return articles.select("subject", "hop", F.posexplode(phrases(F.col("wikitext"), confidence)).alias("place", "phrase"))


def _known(keys: DataFrame, seen: DataFrame | SeenKeys) -> DataFrame:
    """key, in_seen, plural_seen of the keys (key, one, many) of which one form was seen. Keys are distinct, so no key is hot."""
    forms = keys.select("key", F.explode(F.array(*(F.struct(F.col(c).alias("form"), F.lit(c == "key").alias("own")) for c in ("key", "one", "many")))).alias("f"))
    forms = forms.select("key", "f.*").filter("form is not null")
    met = seen.met(forms, "form") if isinstance(seen, SeenKeys) else forms.join(seen.select(F.col("canon_key").alias("form")).distinct(), "form")
    return met.groupBy("key").agg(F.bool_or("own").alias("in_seen"), F.bool_or(~F.col("own")).alias("plural_seen"))


def _told(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """rows with the flags of their keys. A word that a third of all rows have is no hot key where the hits are few enough to be broadcast; beyond
    that the join's skewed partitions are split at run time."""
    hits = stored(hits)
    flagged = rows.join(F.broadcast(hits) if hits.count() <= MOST_HITS else hits, "key", "left")
    return flagged.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("in_seen", "plural_seen")})


def _forms(keys: DataFrame) -> DataFrame:
    return keys.select("key", singular(F.col("key")).alias("one"), plural(F.col("key")).alias("many"))


def seen_flags(each: DataFrame, seen: DataFrame | SeenKeys) -> DataFrame:
    """Adds key, in_seen, plural_seen. Distinct keys and their variants meet the seen keys in one join; then the flags of a key meet its candidates."""
    keyed = each.withColumn("key", canon_key(F.col("phrase"))).filter("key <> ''")
    return _told(keyed, _known(_forms(keyed.select("key").distinct()), seen))


def kept_first(nodes: DataFrame) -> DataFrame:
    """subject, hop, key, kept of nodes (subject, hop, key, first, open, t1, f1, t2, f2): the first independent set in the order of `first`. An open node is kept if none
    of its targets that come before it is kept. Each round decides at least the first open node of every article; there are as many rounds as the longest chain of
    forms is long."""
    own = ["subject", "hop", "key"]
    before = lambda i: F.when(F.col(f"f{i}") < F.col("first"), F.col(f"t{i}"))
    left = nodes.filter("open").select(*own, before(1).alias("b1"), before(2).alias("b2"))
    decided = left.filter("b1 is null and b2 is null").select(*own, F.lit(True).alias("kept"))
    left = stored(left.filter("b1 is not null or b2 is not null"))
    while not left.isEmpty():
        state = lambda i: decided.select("subject", "hop", F.col("key").alias(f"b{i}"), F.col("kept").alias(f"k{i}"))
        asked = left.join(state(1), ["subject", "hop", "b1"], "left").join(state(2), ["subject", "hop", "b2"], "left")
        free = lambda i: F.col(f"b{i}").isNull() | ~F.coalesce(F.col(f"k{i}"), F.lit(True))
        kept = F.when(F.col("k1") | F.col("k2"), False).when(free(1) & free(2), True)
        told = stored(asked.select(*own, "b1", "b2", kept.alias("kept")))
        decided = decided.unionByName(told.filter("kept is not null").select(*own, "kept"))
        left = told.filter("kept is null").drop("kept")
    return decided


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def _first(keys: pa.Array) -> pa.Array:
    """Of the strings of each array, whether none before it there is the same. Whole batches at a time, none of them is a Python object."""
    sizes = keys.value_lengths().fill_null(0).to_numpy()
    codes = keys.flatten().fill_null("").dictionary_encode().indices.to_numpy()
    first = np.zeros(len(codes), bool)
    first[np.unique(np.repeat(np.arange(len(sizes)), sizes) * (len(codes) + 1) + codes, return_index=True)[1]] = True
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(first))


def _entries(rows: DataFrame) -> DataFrame:
    """The rows with key, phrase, place and first of each of their phrases (listed) instead of these; first: no earlier phrase has the key. No phrase is sorted, however long the array is."""
    kept = [c for c in rows.columns if c != "listed"]
    keyed = rows.withColumn("keys", F.transform("listed", canon_key))
    each = F.posexplode(F.arrays_zip(F.col("listed").alias("phrase"), F.col("keys").alias("key"), F.col("firsts").alias("first")))
    return keyed.withColumn("firsts", _first("keys")).select(*kept, each.alias("place", "x")).select(*kept, "place", "x.*").filter("key <> ''")


def deduplicated(articles: DataFrame, listed: Column, seen: DataFrame | SeenKeys) -> DataFrame:
    """subject, hop, place, phrase, key, reason of every candidate. articles: unique by subject and hop; listed: their candidates, an array of phrases in order.

    A candidate is kept if neither its key nor its singular nor plural was seen or kept before. What was seen is found for the distinct keys of the corpus, and so is which of
    them can be in each other's way; only those of an article that have such a form there are shuffled, and take part in the rounds of `kept_first`. What they
    bar comes back to the article as a short list. Candidates themselves never move: they are unfolded from their article at the end."""
    own = ["subject", "hop", "key"]
    # each phrase of the corpus is looked at once, not each time that it stands somewhere
    named = stored(articles.select(F.explode(F.array_distinct(listed)).alias("phrase")).distinct().withColumn("key", canon_key(F.col("phrase"))).filter("key <> ''"))
    keys = stored(_forms(named.select("key").distinct()))
    flags = stored(_told(keys, _known(keys, seen)))
    # forms that can be kept, of keys that are not out already
    form = F.explode(F.array(F.struct(F.lit(1).alias("i"), F.col("one").alias("form")), F.struct(F.lit(2).alias("i"), F.col("many").alias("form"))))
    open_ = flags.filter("not in_seen and not plural_seen").select(F.col("key").alias("form"))
    pairs = stored(flags.filter("not plural_seen").select("key", form.alias("x")).select("key", "x.*").filter("form <> key").join(open_, "form"))
    forms = pairs.groupBy("key").agg(*(F.max(F.when(F.col("i") == i, F.col("form"))).alias(f"t{i}") for i in (1, 2)))
    part = stored(forms.join(pairs.select(F.col("form").alias("key")).distinct(), "key", "full").join(flags.select("key", "in_seen"), "key").join(named, "key"))
    placed = articles.select("subject", "hop", F.posexplode(listed).alias("place", "phrase"))
    # an article's words are in one task, so the first places are taken before they are shuffled
    met = placed.join(F.broadcast(part) if part.count() <= MOST_HITS else part, "phrase")
    rows = stored(met.groupBy(*own, "t1", "t2", "in_seen").agg(F.min("place").alias("first")))
    # only what has a form in its own article
    target = lambda i: rows.filter("not in_seen").select("subject", "hop", F.col("key").alias(f"t{i}"), F.col("first").alias(f"f{i}"))
    nodes = stored(rows.join(target(1), ["subject", "hop", "t1"], "left").join(target(2), ["subject", "hop", "t2"], "left").withColumn("open", ~F.col("in_seen")))
    kept = stored(kept_first(nodes))
    one = lambda i: kept.filter("kept").select("subject", "hop", F.col("key").alias(f"t{i}"), F.lit(True).alias(f"k{i}"))
    barred = nodes.filter("f1 is not null or f2 is not null").join(one(1), ["subject", "hop", "t1"], "left").join(one(2), ["subject", "hop", "t2"], "left")
    barred = barred.select(*own, F.least(*(F.when(F.col(f"k{i}"), F.col(f"f{i}")) for i in (1, 2))).alias("bar")).filter("bar is not null")
    lists = barred.groupBy("subject", "hop").agg(F.map_from_entries(F.collect_list(F.struct("key", "bar"))).alias("bars"))
    each = _entries(articles.join(lists, ["subject", "hop"], "left").select("subject", "hop", "bars", listed.alias("listed")))
    told = _told(each, flags.filter("in_seen or plural_seen").select("key", "in_seen", "plural_seen"))
    bar = F.try_element_at("bars", F.col("key"))
    reason = F.when(F.col("plural_seen"), "plural_variant").when(bar < F.col("place"), "plural_variant_batch").when(F.col("in_seen"), "seen").when(~F.col("first"), "batch").otherwise("kept")
    return told.select("subject", "hop", "place", "phrase", "key", reason.alias("reason"))


def gated(kept: DataFrame, decisions: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Adds passed and gate_reason. decisions: phrase, is_ne, confidence; the first of a canonical key (by `line_no`) decides, none rejects."""
    d = decisions.withColumn("key", canon_key(F.col("phrase"))).groupBy("key").agg(F.min_by(F.struct("is_ne", "confidence"), "line_no").alias("d"))
    j = kept.join(d, "key", "left")
    reason = F.when(F.col("d").isNull(), "missing").when(~F.coalesce("d.is_ne", F.lit(False)), "not_named_entity")
    if threshold > 0:
        reason = reason.when(F.col("d.confidence").isNull(), "missing_confidence").when(F.col("d.confidence") < threshold, "below_conf")
    return j.withColumn("gate_reason", reason.otherwise("accepted")).withColumn("passed", F.col("gate_reason") == "accepted").drop("d")


def ready(subjects: DataFrame, *stages: DataFrame) -> DataFrame:
    """Subjects (subject, hop) that every enabled stage before has a payload for."""
    for s in stages:
        subjects = subjects.join(s.select("subject", "hop").distinct(), ["subject", "hop"], "left_semi")
    return subjects


def distinct_enough(new: DataFrame, reached: DataFrame, embeddings: DataFrame, threshold: float, answers: DataFrame | None = None) -> DataFrame:
    """The similarity stage of a wave: new rows (canon_key, phrase, position) that are no duplicate of one reached or of one before them in the wave. Exact
    repeats of a phrase go first. embeddings: canon_key, e; what has none is a duplicate. answers: canon_key, same: a judge's word where a score is above
    the threshold; without one it is a duplicate."""
    once = new.groupBy("phrase").agg(F.min_by(F.struct("canon_key", "position"), "position").alias("r")).select("phrase", "r.*")
    e = once.join(embeddings, "canon_key").select("canon_key", "phrase", F.col("position").alias("id"), "e")
    index = reached.join(embeddings, "canon_key").select((-1 - F.xxhash64("canon_key") % (1 << 62)).alias("id"), "e")
    best = vector.topk(e.select("id", "e"), index, 1).select(F.col("query_id").alias("id"), F.col("score").alias("db"))
    batch = vector.in_batch(e.select(F.col("id").alias("position"), "e"), threshold).select(F.col("position").alias("id"), "best_score", "duplicate_of")
    j = e.drop("e").join(best, "id", "left").join(batch, "id", "left")
    told = (answers or new.sparkSession.createDataFrame([], "canon_key string, same boolean")).select("canon_key", "same")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    d = vector.decision(zero("db"), zero("best_score"), F.col("duplicate_of"), F.lit(True), threshold, "llm", F.col("same"))
    return j.join(told, "canon_key", "left").withColumn("d", d).select("canon_key", "phrase", F.col("id").alias("position"), "d.decision", "d.reason")


def levels(roots: DataFrame, edges: DataFrame, save) -> DataFrame:
    """node, depth of everything that edges (parent, child) reach from roots (node), level by level; a node has its least depth."""
    frontier = save(roots.select("node", F.lit(0).alias("depth")).distinct(), "level")
    reached, depth, seen = frontier, 0, SeenKeys(roots.sparkSession)
    while not frontier.isEmpty():
        depth += 1
        seen.add(frontier.select(F.col("node").cast("string").alias("canon_key")))
        next_ = frontier.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        next_ = seen.new(next_.withColumn("key", F.col("node").cast("string")), "key")
        frontier = save(next_.select("node", F.lit(depth).alias("depth")), "level")
        reached = reached.unionByName(frontier)
    seen.drop()
    return reached


def expand(
    seeds: DataFrame, articles: DataFrame, decisions: DataFrame, max_depth: int, save, max_subjects: int | None = None, threshold: float = 0.0,
    embeddings: DataFrame | None = None, similarity: float = 0.9, answers: DataFrame | None = None, stages: tuple[DataFrame, ...] = (), confidence: float | None = None,
) -> DataFrame:
    """subject, hop, parent_subject, canon_key of everything reached. articles: subject, wikitext as a provider recorded them.
    save(df, name) makes each level durable (a table or checkpoint), so a lost executor repeats one level at most. What was seen is a table in buckets (`SeenKeys`), so a level
    deals out its own candidates only.
    embeddings: with them new subjects pass the similarity stage. stages: payloads that an article needs before it is written. confidence: links carry one."""
    frontier = save(seeds.select("subject", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("parent_subject"), canon_key(F.col("subject")).alias("canon_key")).dropDuplicates(["canon_key"]), "level")
    reached, seen = frontier, SeenKeys(seeds.sparkSession)
    for hop in range(1, max_depth + 1):
        seen.add(frontier)
        written = ready(frontier.select("subject", "hop"), *stages).join(articles, "subject")
        # read several times below: an article is fetched and parsed once a level
        written = save(written.select("subject", "hop", phrases(F.col("wikitext"), confidence).alias("listed")), "written")
        each = deduplicated(written, F.col("listed"), seen).filter("reason = 'kept'")
        ok = gated(each, decisions, threshold).filter("passed")
        # of articles that name one key on a level the first by subject and place is its parent
        new = ok.groupBy(F.col("key").alias("canon_key")).agg(F.min(F.struct("subject", "place", "phrase")).alias("r"))
        if embeddings is not None:
            wave = save(new.select("canon_key", F.col("r.phrase").alias("phrase"), F.xxhash64("canon_key").alias("position")), "wave")
            new = new.join(distinct_enough(wave, reached, embeddings, similarity, answers).filter("decision = 'accept'").select("canon_key"), "canon_key", "left_semi")
        frontier = new.select(F.col("r.phrase").alias("subject"), F.lit(hop).alias("hop"), F.col("r.subject").alias("parent_subject"), "canon_key")
        if max_subjects is not None:
            left = max_subjects - reached.count()
            frontier = frontier.orderBy("parent_subject", "subject").limit(max(0, left))
        frontier = save(frontier, "level")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    seen.drop()
    return reached
