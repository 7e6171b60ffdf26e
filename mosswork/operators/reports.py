"""Report rows: records of evaluated articles, persona effects, paper tables, breadth, style, ablation, capture traps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import mean, median, rate_or_zero, std
from ..functions.similarity import lexical
from ..functions.text import canon_key
from .analyses import set_overlap, verdict_stats
from .evidence import snippet_domains
from .stored import stored

#: Members (rows) of a task that compares the entities of groups.
MEMBERS = 500_000

# Measures of the two text reports.
STYLE = ["sent_len_mean_diff", "sent_len_std_diff", "ttr_candidate", "ttr_reference", "ttr_diff", "funcword_cosine", "punct_density_candidate", "punct_density_reference", "punct_density_diff"]
TEXT = ["ngram_1_jaccard", "ngram_1_overlap", "ngram_2_jaccard", "ngram_2_overlap", "ngram_3_jaccard", "ngram_3_overlap", "tfidf_cosine", "jaccard", "semantic_cosine", "combined_similarity"]


def records(articles: DataFrame, claims: DataFrame) -> DataFrame:
    """A row per evaluated article: its facts, for each evidence source its verdict counts and rates, and frontier columns, which repeat the web's where
    the reference page was looked for and not found. articles: subject, wiki_subject_found, ...; claims: subject, source (wiki or web), verdict."""
    out = articles
    for source in ("wiki", "web"):
        s = verdict_stats(claims.filter(F.col("source") == source), "subject").drop("n_claims")
        named = {"true_rate": f"true_rate_against_{source}", "false_rate": f"false_rate_against_{source}", "unverifiable_rate": f"unverifiable_rate_against_{source}", "accuracy": f"accuracy_against_{source}"}
        out = out.join(s.select("subject", *(F.col(c).alias(named.get(c, f"{source}_{c}")) for c in s.columns if c != "subject")), "subject", "left")
    frontier = F.coalesce(~F.col("wiki_subject_found"), F.lit(False))
    counts = {f"frontier_web_{k}": F.coalesce(f"web_{k}", F.lit(0)) for k in ("n_supported", "n_refuted", "n_insufficient")}
    rates = {f"frontier_web_{k}": F.coalesce(f"{k}_against_web", F.lit(0.0)) for k in ("true_rate", "false_rate", "unverifiable_rate")}
    rates["frontier_web_precision"] = F.col("accuracy_against_web")
    return out.withColumns({"is_frontier": frontier} | {k: F.when(frontier, c) for k, c in (counts | rates).items()})


def spread(rows: DataFrame, keys: list[str], measures: list[str], counted: str, name: str, with_median: bool = False) -> DataFrame:
    """Mean and deviation (and median) of each measure by run, and how many rows have `counted`."""
    told = [("mean", mean), ("std", std)] + ([("median", median)] if with_median else [])
    return rows.groupBy(*keys).agg(F.count(counted).alias(name), *(f(F.col(m)).alias(f"{n}_{m}") for m in measures for n, f in told))


def persona_effect(evaluated: DataFrame, members: DataFrame) -> DataFrame:
    """Each pair of personas of one topic and model: mean precision of both over strictly found articles and its difference, mean rate of
    refuted claims, and how far the canonical entities of common subjects agree.
    evaluated: topic, model, persona, found, accuracy, false_rate; members: topic, model, persona, subject, entity."""
    keys = ["topic", "model"]
    precise = evaluated.groupBy(*keys, "persona").agg(mean(F.when(F.col("found"), F.col("accuracy"))).alias("precision"), mean(F.coalesce("false_rate", F.lit(0.0))).alias("hallucination"))
    sides = [precise.select(*keys, F.col("persona").alias(f"persona_{i}"), F.col("precision").alias(f"precision_{i}"), F.col("hallucination").alias(f"hallucination_{i}")) for i in (1, 2)]
    pairs = sides[0].join(sides[1], keys).filter("persona_1 < persona_2").withColumn("precision_delta", F.col("precision_1") - F.col("precision_2"))
    shared = common_entities(members, keys, "persona").withColumnsRenamed({"a": "persona_1", "b": "persona_2"})
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("common_subjects", "entities_1", "entities_2", "shared_entities")}
    full = pairs.join(shared, [*keys, "persona_1", "persona_2"], "left").withColumns(zero)
    union = F.col("entities_1") + F.col("entities_2") - F.col("shared_entities")
    return full.withColumns({"jaccard": F.when(union > 0, F.col("shared_entities") / union).otherwise(1.0), "overlap": rate_or_zero(F.col("shared_entities"), F.least("entities_1", "entities_2"))})


def common_entities(members: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Each pair of groups (a < b) of one key: common subjects, entities of either side over them, entities both have. members: keys, group, subject,
    entity (canonical, or null for a subject without any). Rows meet by subject, never by group."""
    rows = stored(members.select(*keys, "subject", F.col(group).alias("g"), "entity"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // MEMBERS))  # a task holds as much whatever there is in all
    dealt = rows.repartition(tasks, *keys, "subject")
    of = dealt.select(*keys, "subject", "g").distinct().groupBy(*keys, "subject").agg(F.array_sort(F.collect_set("g")).alias("groups")).filter("size(groups) > 1")
    pair = of.select(*keys, F.explode("groups").alias("a"), "groups").select(*keys, "a", F.explode("groups").alias("b")).filter("a < b")
    subjects = pair.groupBy(*keys, "a", "b").agg(F.count("*").alias("common_subjects"))
    # a member moves to its entity once and is laid beside the other groups of its subject there
    met = dealt.filter("entity is not null").join(of.hint("merge"), [*keys, "subject"]).select(*keys, "entity", "g", "groups").repartition(tasks, *keys, "entity")
    sided = met.select(*keys, "entity", "g", F.explode("groups").alias("other")).filter("g <> other")
    seen = sided.groupBy(*keys, F.least("g", "other").alias("a"), F.greatest("g", "other").alias("b"), "entity").agg(F.bool_or(F.col("g") < F.col("other")).alias("in_a"), F.bool_or(F.col("g") > F.col("other")).alias("in_b"))
    counts = seen.groupBy(*keys, "a", "b").agg(F.count_if("in_a").alias("entities_1"), F.count_if("in_b").alias("entities_2"), F.count_if(F.col("in_a") & F.col("in_b")).alias("shared_entities"))
    return subjects.join(counts, [*keys, "a", "b"], "left")


def topic_table(evaluated: DataFrame) -> DataFrame:
    """By topic and model over records, not over runs: how many were found, precision, refuted and undecided rates over strictly found ones.
    evaluated: topic, model, found, accuracy, false_rate, unverifiable_rate."""
    found = F.coalesce("found", F.lit(False))
    told = {"precision": "accuracy", "hallucination_rate": "false_rate", "unverifiable_rate": "unverifiable_rate"}
    zero = lambda c: F.col(c) if c == "accuracy" else F.coalesce(c, F.lit(0.0))
    rows = evaluated.groupBy("topic", "model").agg(
        F.count("*").alias("n_evaluated"), F.count_if(found).alias("n_found"), *(f(F.when(found, zero(c))).alias(k + n) for k, c in told.items() for n, f in (("", mean), ("_std", std)))
    )
    return rows.withColumns({"n_not_found": F.col("n_evaluated") - F.col("n_found"), "coverage": rate_or_zero(F.col("n_found"), F.col("n_evaluated"))})


def entity_table(linked: DataFrame) -> DataFrame:
    """By topic and model: mean and deviation of the number of entities of an article. linked: topic, model, n_links."""
    return linked.groupBy("topic", "model").agg(mean(F.col("n_links")).alias("mean_raw_entities"), std(F.col("n_links")).alias("std_raw_entities"))


def subject_overlap(members: DataFrame) -> DataFrame:
    """By topic, each pair of models: shared and own subjects. members: topic, model, subject."""
    keyed = members.select(F.struct("topic", "model").alias("g"), F.struct("topic", "subject").alias("item"))
    pairs = set_overlap(keyed, "g", "item").filter("a.topic = b.topic")
    own = lambda c: F.col(c) - F.col("shared")
    return pairs.select(F.col("a.topic").alias("topic"), F.col("a.model").alias("model_1"), F.col("b.model").alias("model_2"), "size_a", "size_b", "shared", own("size_a").alias("only_1"), own("size_b").alias("only_2"), "jaccard")


def breadth(articles: DataFrame, run: str) -> DataFrame:
    """By run: links and categories, in all, distinct and by canonical key; sections, words, hops 0, 1, 2 and more, first words of subjects.
    articles: run, subject, hop, links, categories, sections, words."""
    n = articles.withColumns({"nl": F.size("links"), "nc": F.size("categories"), "prefix": F.lower(F.get(F.split(F.trim("subject"), r"\s+"), 0))})
    spread_of = lambda c, k, fs: [f(F.col(c)).alias(f"{m}_{k}") for m, f in fs]
    both = [("mean", mean), ("std", std)]
    rows = n.groupBy(run).agg(
        F.count("*").alias("n_articles"), F.sum("nl").alias("total_links"), F.sum("nc").alias("total_categories"), *spread_of("nl", "links", [*both, ("median", median)]), *spread_of("nc", "categories", both[:1]),
        *spread_of("sections", "sections", both), *spread_of("words", "words", [*both, ("median", median)]), *(F.count_if(F.col("hop") == h).alias(f"n_hop_{h}") for h in (0, 1, 2)), F.count_if(F.col("hop") >= 3).alias("n_hop_3plus"),
        mean(F.col("hop")).alias("mean_hop"), F.max("hop").alias("max_hop"), F.countDistinct(F.when(F.col("prefix") != "", F.col("prefix"))).alias("n_prefixes"),
    )
    each = articles.select(run, F.explode(F.concat(F.transform("links", _kind("link")), F.transform("categories", _kind("category")))).alias("e"))
    link = F.when(F.col("e.kind") == "link", F.col("e.x"))
    kinds = each.groupBy(run).agg(F.countDistinct(link).alias("unique_links"), F.countDistinct(canon_key(link)).alias("unique_canonical_links"), F.countDistinct(F.when(F.col("e.kind") == "category", F.col("e.x"))).alias("unique_categories"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("unique_links", "unique_canonical_links", "unique_categories")}
    return rows.join(kinds, run, "left").withColumns(zero).withColumns({"entity_ttr": rate_or_zero(F.col("unique_links"), F.col("total_links")), "prefix_diversity": rate_or_zero(F.col("n_prefixes"), F.col("n_articles"))})


def _kind(k: str):
    return lambda x: F.struct(F.lit(k).alias("kind"), x.alias("x"))


def ablation_table(runs: DataFrame, evaluated: DataFrame, per_seed: int, n_seeds: int) -> DataFrame:
    """A row per run, of runs without records too (counts 0, all else null): means over seeds of their means; a seed counts for the reference's rates only if
    it has a precision, and the like for the web's. runs: dir, cost, n_subjects; evaluated: dir, seed, found (strict), and for wiki and web accuracy_*, true_rate_*,
    false_rate_*, unverifiable_rate_*; sim_semantic, sim_combined."""
    found = F.coalesce("found", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    web = F.col("accuracy_web").isNotNull()
    rates = ("true_rate", "false_rate", "unverifiable_rate")
    seeds = evaluated.groupBy("dir", "seed").agg(
        mean(F.when(found, F.col("accuracy_wiki"))).alias("wiki_precision"), mean(F.col("accuracy_web")).alias("web_precision"), *(mean(F.when(ok, zero(f"{r}_{s}"))).alias(f"{s}_{r}") for s, ok in (("wiki", found), ("web", web)) for r in rates)
    )
    counted = seeds.withColumns({f"{s}_{r}": F.when(F.col(f"{s}_precision").isNotNull(), F.col(f"{s}_{r}")) for s in ("wiki", "web") for r in rates})
    columns = [f"{s}_{r}" for s in ("wiki", "web") for r in ("precision", *rates)]
    over = counted.groupBy("dir").agg(*(mean(F.col(c)).alias(c) for c in columns), *(std(F.col(c)).alias(f"{c}_std") for c in [*columns[:4], "web_precision"]))
    whole = evaluated.groupBy("dir").agg(F.count("*").alias("n_returned"), F.count_if(found).alias("n_found"), mean(F.col("sim_semantic")).alias("sim_semantic"), mean(F.col("sim_combined")).alias("sim_combined"))
    rows = runs.join(whole, "dir", "left").join(over, "dir", "left")
    none = F.col("n_returned").isNull()
    return rows.withColumns({
        "n_subjects": F.when(none, 0).otherwise(F.col("n_subjects")), "n_attempted": F.when(none, 0).otherwise(per_seed * n_seeds), "coverage": F.try_divide(F.col("n_found"), F.col("n_returned")),
        "n_returned": F.coalesce("n_returned", F.lit(0)), "n_found": F.coalesce("n_found", F.lit(0)), "cost_at_1m": F.when(~none & (F.col("cost") > 0), F.col("cost") * 1_000_000),
    })


def latex(rows: DataFrame, group: str, columns: list[str], best: str) -> DataFrame:
    """line, place: a table's rows in LaTeX, the best value of each group in bold; empty values are dashes."""
    top = F.max(best).over(Window.partitionBy(group))
    shown = lambda c: F.coalesce(F.format_string("%.3f", F.col(c)), F.lit("--")) if dict(rows.dtypes)[c] == "double" else F.replace(F.coalesce(F.col(c).cast("string"), F.lit("--")), F.lit("_"), F.lit("\\_"))
    cells = [F.when(F.col(best) == top, F.concat(F.lit("\\textbf{"), shown(c), F.lit("}"))).otherwise(shown(c)) if c == best else shown(c) for c in columns]
    return rows.select(*columns, F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("line"))


def capture_record(subjects: DataFrame, pages: DataFrame, measures: list[str], combined: Column) -> DataFrame:
    """Subjects with their similarity to a reference page: computed where the page is found and both texts have words, else null, also the combined one.
    subjects: subject, words; pages: subject, found, page_words, and the measures."""
    j = subjects.join(pages, "subject", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    ok = F.col("found") & (F.size("words") > 0) & (F.size(F.coalesce("page_words", F.array().cast("array<string>"))) > 0)
    return j.withColumns({m: F.when(ok, F.col(m)) for m in measures} | {"combined_similarity": F.when(ok, combined)})


def capture_table(rows: DataFrame, tag: str, systems: list[str], measures: list[str]) -> DataFrame:
    """By tag: coverage, mean and deviation of each system's measures, mean and median of positive word counts. rows: tag, wiki_found, SYSTEM_MEASURE, SYSTEM_word_count."""
    told = [f(F.col(f"{s}_{m}")).alias(f"{s}_{n}_{m}") for s in systems for m in measures for n, f in (("mean", mean), ("std", std))]
    words = [f(F.when(F.col(f"{s}_word_count") > 0, F.col(f"{s}_word_count"))).alias(f"{s}_{n}_word_count") for s in systems for n, f in (("mean", mean), ("median", median))]
    return rows.groupBy(tag).agg(F.count("*").alias("n_subjects"), rate_or_zero(F.count_if("wiki_found"), F.count("*")).alias("wiki_coverage"), *told, *words)


def legacy_claim_rows(rows: DataFrame) -> DataFrame:
    """A row per claim with a verdict; addresses of its sources joined by bars. rows: subject, candidate, claims array<struct<claim,verdict,confidence,urls>>."""
    each = rows.select("subject", "candidate", F.posexplode("claims").alias("claim_idx", "c")).filter(F.col("c.verdict").isin("true", "false", "uncertain"))
    return each.select("subject", "candidate", "claim_idx", F.coalesce("c.claim", F.lit("")).alias("claim"), F.col("c.verdict").alias("verdict"), "c.confidence", F.array_join(F.filter("c.urls", lambda u: F.coalesce(u, F.lit("")) != ""), "|").alias("cited_source_urls"))


def legacy_records(tasks: DataFrame, baselines: DataFrame, checks: DataFrame) -> DataFrame:
    """A row per task (subject, candidate, baseline) with what was recorded of it: whether the baseline has a page, its sources and their distinct domains, the check of
    the article. baselines: subject, baseline, found, urls; checks: subject, candidate, baseline, claims."""
    none = F.array().cast("array<string>")
    urls = F.filter(F.coalesce("urls", none), lambda u: F.coalesce(u, F.lit("")) != "")
    j = tasks.join(baselines, ["subject", "baseline"], "left").join(checks, ["subject", "candidate", "baseline"], "left")
    return j.select("subject", "candidate", "baseline", F.coalesce("found", F.lit(False)).alias("baseline_found"), urls.alias("baseline_source_urls"), F.array_sort(snippet_domains(urls)).alias("baseline_source_domains"), "claims")


def grounding(subject: Column, context: Column, most: int = 16) -> Column:
    """The block of a prompt that states what is known. context: struct(summary, aliases, salient_facts array<struct<predicate,object,confidence>>)."""
    tidy = lambda c: F.trim(F.coalesce(c, F.lit("")))
    facts = F.filter(F.slice(F.coalesce(context.salient_facts, F.array().cast("array<struct<predicate:string,object:string,confidence:double>>")), 1, most), lambda f: (tidy(f.predicate) != "") & (tidy(f.object) != ""))
    sure = lambda f: F.when(f.confidence.isNull(), "").otherwise(F.concat(F.lit(" (c="), F.format_string("%.2f", f.confidence), F.lit(")")))
    lines = F.transform(facts, lambda f: F.concat(F.lit("- "), subject, F.lit(" — "), tidy(f.predicate), F.lit(" — "), tidy(f.object), sure(f)))
    names = F.array_join(F.transform(F.coalesce(context.aliases, F.array().cast("array<string>")), tidy), ", ")
    none = lambda c: F.when(c == "", "(none)").otherwise(c)
    return F.concat(F.lit("SELF-RAG CONTEXT (grounding; use to stay factual; do not quote verbatim):\nSummary: "), tidy(context.summary), F.lit("\nAliases: "), none(names), F.lit("\nSalient facts:\n"), none(F.array_join(lines, "\n")))


def bounded_sample_size(available: Column, fraction: float, least: int, most: int) -> Column:
    """How many to sample: none if there are fewer than `least`, else the fraction, `least` at least and `most` at most."""
    target = F.greatest((available * fraction).cast("long"), F.lit(least).cast("long"))
    return F.when(available < least, F.lit(0).cast("long")).otherwise(F.least(target, F.lit(most).cast("long"), available.cast("long")))


def chunked(rows: DataFrame, by: list[str], order: str, size: int = 25) -> DataFrame:
    """rows with `chunk` and its `start`: as many in a row of a group as one call takes."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return rows.withColumn("_at", at).withColumns({"chunk": F.floor(F.col("_at") / size).cast("int"), "start": (F.floor(F.col("_at") / size) * size).cast("int")}).drop("_at")


def cross_similarity(articles: DataFrame, group: str, most: int = 100) -> DataFrame:
    """Each pair of groups (a < b): mean and deviation of the similarity of their texts over the first common subjects by name, `most` of them (the
    report's own limit); a subject's text is its first row. articles: group, subject, line_no, words."""
    first = articles.groupBy("subject", group).agg(F.min_by("words", "line_no").alias("w"))
    named = first.select("subject", F.col(group).alias("g"))
    of = named.groupBy("subject").agg(F.array_sort(F.collect_set("g")).alias("gs")).filter("size(gs) > 1")
    pair = of.select("subject", F.explode("gs").alias("a"), "gs").select("subject", "a", F.explode("gs").alias("b")).filter("a < b")
    kept = pair.withColumn("_r", F.row_number().over(Window.partitionBy("a", "b").orderBy("subject"))).filter(F.col("_r") <= most).drop("_r")
    side = lambda k, w: first.select("subject", F.col(group).alias(k), F.col("w").alias(w))
    both = kept.join(side("a", "x"), ["subject", "a"]).join(side("b", "y"), ["subject", "b"]).filter("size(x) > 0 and size(y) > 0")
    m = {k: c for k, c in lexical(F.col("x"), F.col("y")).items() if k in ("jaccard", "ngram_2_overlap", "ngram_3_overlap")}
    rows = both.select("a", "b", *(c.alias(k) for k, c in m.items()))
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"), *(f(F.col(k)).alias(f"{n}_{k}") for k in m for n, f in (("mean", mean), ("std", std))))
