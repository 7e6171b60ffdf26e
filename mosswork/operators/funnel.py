"""The attrition funnel: decision logs to entity, hop, model and total rows.

Each log becomes rows of (subject, hop) with its own counts; the rows of all logs are laid one under another and aggregated once by key, so a
hop, model or total takes one shuffle of partial sums, and no log is joined. Reasons are counted apart, only where they are asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import counter_json, rate_or_null, rate_or_zero
from ..functions.wikitext import raw_links

# Reasons and stages that mean a failed check, stages of canonical dedup, the stage of indexed candidates.
FAILURES = ["missing_in_batch_output", "sdk_exception", "no_output_file"]
FAILURE_STAGES = ["similarity_batch_http_error", "similarity_batch_missing_output", "similarity_batch_fallback_all"]
DEDUP_STAGES = ["queue_dedup_pre_ner", "queue_dedup_batch_pre_ner", "queue_dedup", "queue_dedup_batch"]
INDEXED = "similarity_filter_skip_indexed"
KEY = ["subject", "hop"]
COUNTS = (
    "raw_wikilink_occurrences raw_wikilink_unique extracted_link_targets extracted_categories ner_candidates canonical_pre_ner_input canonical_kept "
    "canonical_rejected_total canonical_rejected_seen canonical_rejected_batch canonical_rejected_plural canonical_rejected_other ner_accepted ner_rejected "
    "ner_rejected_not_ne ner_rejected_low_conf ner_rejected_parse_fail ner_summary_error_count similarity_accepted similarity_rejected similarity_skipped "
    "sim_rejected_llm_duplicate sim_rejected_within_batch sim_rejected_above_threshold_db sim_rejected_above_threshold_batch sim_rejected_failure sim_rejected_other inserted_children"
).split()
REASONS = ("canonical_reason_counts", "ner_reject_reason_counts", "ner_summary_parse_modes", "similarity_reject_reason_counts", "similarity_skip_reason_counts", "similarity_failure_reason_counts")
# The order of models in reports.
MODEL_ORDER = ["deepseek", "gpt-5-mini", "llama"]
#: Columns that are maxima over an entity's rows, flags, and rows of which the last counts; all others are sums.
MAXIMA = ("ner_candidates", "canonical_pre_ner_input", "canonical_kept", "canonical_rejected_total")
FLAGS = ("ner_processed", "sim_processed", "has_article")
LAST = {"queue": "queue_status string, parent_subject string, parent_hop int", "article": "raw_wikilink_occurrences long, raw_wikilink_unique long", "meta": "extracted_link_targets long, extracted_categories long"}
SURVIVAL = {
    "canonical_survival": ("canonical_kept", "canonical_pre_ner_input"),
    "ner_survival": ("ner_accepted", "canonical_kept"),
    "similarity_survival": ("similarity_accepted", "ner_accepted"),
    "overall_survival_to_inserted": ("inserted_children", "canonical_pre_ner_input"),
}


def is_failure(reason: Column) -> Column:
    return reason.isin(FAILURES) | reason.startswith("batch_status=") | reason.startswith("http_status=")


def normalised(stage: Column, decision: Column, reason: Column) -> Column:
    """struct(outcome, reason, failed)."""
    tidy = lambda c: F.trim(F.coalesce(c, F.lit("")))
    st, dc, rs = tidy(stage), F.lower(tidy(decision)), tidy(reason)
    made = lambda o, r, f: F.struct(F.lit(o).alias("outcome"), r.alias("reason"), f.alias("failed"))
    given = lambda *other: F.coalesce(F.nullif(rs, F.lit("")), *other)
    no = F.lit(False)
    return (
        F.when(st == INDEXED, made("skipped", F.lit("already_in_embedding_index"), no))
        .when(dc == "accept", made("accepted", given(F.lit("accepted")), no))
        .when(dc == "skip", made("skipped", given(F.lit("skip")), no))
        .when((dc == "reject") & is_failure(rs), made("rejected", rs, F.lit(True)))
        .when((dc == "reject") & st.isin(FAILURE_STAGES), made("rejected", given(st), F.lit(True)))
        .when(dc == "reject", made("rejected", given(F.lit("reject")), no))
        .otherwise(made("unknown", given(F.nullif(st, F.lit("")), F.lit("unknown")), no))
    )


def _last(name: str, ordinal: Column, **columns: Column) -> Column:
    """A row of which the one with the greatest ordinal counts."""
    kinds = dict(x.strip().split() for x in LAST[name].split(","))
    return F.struct(ordinal.cast("long").alias("ordinal"), *(columns[k].cast(t).alias(k) for k, t in kinds.items())).alias(name)


def queue_rows(records: DataFrame) -> DataFrame:
    """records: subject, hop, status, parent_subject, parent_hop, ordinal. The last row of a key counts."""
    return records.select(*KEY, _last("queue", F.col("ordinal"), queue_status=F.col("status"), parent_subject=F.col("parent_subject"), parent_hop=F.col("parent_hop")))


def child_rows(records: DataFrame) -> DataFrame:
    """One inserted child for each entity of the queue whose last row names that parent."""
    last = records.groupBy(*KEY).agg(F.max_by(F.struct("parent_subject", "parent_hop"), "ordinal").alias("r")).filter("r.parent_subject is not null")
    return last.select(F.col("r.parent_subject").alias("subject"), F.col("r.parent_hop").alias("hop"), F.lit(1).alias("inserted_children"))


def article_rows(articles: DataFrame) -> DataFrame:
    """articles: subject, hop, wikitext, line_no. The last row of a key counts."""
    l = raw_links(F.col("wikitext"))
    return articles.select(*KEY, F.lit(True).alias("has_article"), _last("article", F.col("line_no"), raw_wikilink_occurrences=l.n, raw_wikilink_unique=F.size(l.targets)))


def meta_rows(meta: DataFrame) -> DataFrame:
    """meta: subject, hop, links, categories, ner_candidates, diag, line_no. Diagnostic rows tell the candidates, the most of them; the last of
    the others tells links and categories."""
    size = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0))
    diag = F.coalesce("diag", F.lit(False))
    last = _last("meta", F.col("line_no"), extracted_link_targets=size("links"), extracted_categories=size("categories"))
    return meta.select(*KEY, F.when(diag, size("ner_candidates")).alias("ner_candidates"), F.when(~diag, last).alias("meta"))


def summary_rows(summaries: DataFrame) -> DataFrame:
    """summaries: subject, hop, pre_dedup_count, post_dedup_count, filtered_count."""
    pre, post = (F.coalesce(c, F.lit(0)) for c in ("pre_dedup_count", "post_dedup_count"))
    gone = F.coalesce("filtered_count", F.greatest(pre - post, F.lit(0)))
    return summaries.select(*KEY, F.lit(True).alias("ner_processed"), pre.alias("canonical_pre_ner_input"), post.alias("canonical_kept"), gone.alias("canonical_rejected_total"))


def _canonical(rejected: DataFrame) -> DataFrame:
    low = rejected.filter(F.col("stage").isin(DEDUP_STAGES))
    return low.select(*KEY, F.coalesce(F.nullif("rejection_reason", F.lit("")), "stage").alias("reason"))


def _variants(plural: DataFrame) -> DataFrame:
    return plural.select(*KEY, F.when(F.coalesce("stage", F.lit("")).contains("batch"), "plural_variant_batch").otherwise("plural_variant").alias("reason"))


def rejected_rows(rejected: DataFrame) -> DataFrame:
    """rejected: subject, hop, stage, rejection_reason; stages of canonical dedup count, by class of reason."""
    batch, seen = F.col("reason").contains("batch"), F.col("reason").contains("seen")
    one = lambda c: c.cast("int")
    classes = {"batch": batch, "seen": ~batch & seen, "other": ~batch & ~seen}
    return _canonical(rejected).select(*KEY, *(one(c).alias(f"canonical_rejected_{k}") for k, c in classes.items()))


def plural_rows(plural: DataFrame) -> DataFrame:
    return plural.select(*KEY, F.lit(1).alias("canonical_rejected_plural"))


def run_summary_rows(summaries: DataFrame) -> DataFrame:
    """summaries: subject, hop, stage, parse_mode, chunk_failures. Failures of chunks of whole runs, exceptions of single ones."""
    whole = F.col("stage") == "ner_run_summary_global"
    errors = F.when(whole, F.coalesce("chunk_failures", F.lit(0))).otherwise((F.coalesce("parse_mode", F.lit("")) == "exception").cast("int"))
    return summaries.filter(F.col("stage").isin("ner_run_summary_global", "ner_run_summary")).select(*KEY, F.lit(True).alias("ner_processed"), errors.alias("ner_summary_error_count"))


def ner_rows(decisions: DataFrame) -> DataFrame:
    """decisions: subject, hop, passed_threshold, decision_reason, source of each phrase."""
    r = F.lower(F.coalesce("decision_reason", F.lit("")))
    ne = r.contains("not_named_entity") | (r == "not_ne")
    low = ~ne & (r.contains("below_conf") | r.contains("missing_confidence"))
    fail = ~ne & ~low & (r.rlike("parse_fail|ner_call_failed|ner_parse") | (F.coalesce("source", F.lit("")) == "missing"))
    no = ~F.coalesce("passed_threshold", F.lit(False))
    classes = {"ner_accepted": ~no, "ner_rejected": no, "ner_rejected_not_ne": no & ~low & ~fail, "ner_rejected_low_conf": no & low, "ner_rejected_parse_fail": no & fail}
    return decisions.select(*KEY, F.lit(True).alias("ner_processed"), *(c.cast("int").alias(k) for k, c in classes.items()))


def _judged(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn("s", normalised(F.col("stage"), F.col("decision"), F.col("reason"))).select(*KEY, "s.*")


def similarity_rows(decisions: DataFrame) -> DataFrame:
    """decisions: subject, hop, stage, decision, reason."""
    n = _judged(decisions)
    r, no = F.lower("reason"), F.col("outcome") == "rejected"
    classes, rest = {"failure": no & F.col("failed")}, no & ~F.col("failed")
    for c in ("llm_duplicate", "within_batch", "above_threshold_db", "above_threshold_batch"):
        classes[c] = rest & r.contains(c)
        rest = rest & ~r.contains(c)
    classes["other"] = rest
    told = {f"similarity_{o}": F.col("outcome") == o for o in ("accepted", "rejected", "skipped")} | {f"sim_rejected_{k}": c for k, c in classes.items()}
    return n.select(*KEY, F.lit(True).alias("sim_processed"), *(c.cast("int").alias(k) for k, c in told.items()))


def reason_rows(rejected: DataFrame | None = None, plural: DataFrame | None = None, decisions: DataFrame | None = None, summaries: DataFrame | None = None, similarity: DataFrame | None = None) -> DataFrame:
    """subject, hop, counter, reason: a row for each time that a reason counts. summaries also has parse_modes."""
    tagged = lambda df, name: df.select(*KEY, F.lit(name).alias("counter"), "reason")
    parts = []
    if rejected is not None:
        parts.append(tagged(_canonical(rejected), REASONS[0]))
    if plural is not None:
        parts.append(tagged(_variants(plural), REASONS[0]))
    if decisions is not None:
        no = decisions.filter(~F.coalesce("passed_threshold", F.lit(False)))
        parts.append(tagged(no.withColumn("reason", F.coalesce(F.nullif("decision_reason", F.lit("")), F.lit("rejected"))), REASONS[1]))
    if summaries is not None:
        modes = F.when(F.col("stage") == "ner_run_summary_global", F.coalesce("parse_modes", F.array().cast("array<string>"))).otherwise(F.filter(F.array("parse_mode"), lambda m: F.coalesce(m, F.lit("")) != ""))
        parts.append(tagged(summaries.filter(F.col("stage").isin("ner_run_summary_global", "ner_run_summary")).withColumn("reason", F.explode(modes)), REASONS[2]))
    if similarity is not None:
        n = _judged(similarity)
        name = F.when((F.col("outcome") == "rejected") & F.col("failed"), F.array(F.lit(REASONS[3]), F.lit(REASONS[5]))).when(F.col("outcome") == "rejected", F.array(F.lit(REASONS[3]))).when(F.col("outcome") == "skipped", F.array(F.lit(REASONS[4])))
        parts.append(n.select(*KEY, F.explode(name).alias("counter"), "reason"))
    return reduce(DataFrame.unionByName, parts)


def counters(reasons: DataFrame, *keys: str) -> DataFrame:
    """Each counter, merged over the keys, as JSON with sorted keys; null where nothing counts."""
    n = reasons.groupBy(*keys, "counter", "reason").agg(F.count("*").alias("n"))
    entry = F.struct("reason", "n")
    told = n.groupBy(*keys).agg(*(F.filter(F.collect_list(F.when(F.col("counter") == c, entry)), lambda x: x.isNotNull()).alias(c) for c in REASONS))
    return told.select(*keys, *(F.when(F.size(c) > 0, counter_json(F.map_from_entries(c))).alias(c) for c in REASONS))


def entities(*rows: DataFrame) -> DataFrame:
    """Rows of any logs to one row per entity that any of them knows: counts filled, fallbacks applied in their order, survival added."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    has = set(every.columns)
    lasts = {k: [c.split()[0] for c in t.split(", ")] for k, t in LAST.items()}
    told = [F.max(k).alias(k) for k in lasts if k in has] + [F.max(k).alias(k) for k in FLAGS if k in has]
    told += [(F.max(c) if c in MAXIMA else F.sum(c)).alias(c) for c in COUNTS if c in has]
    e = every.groupBy(*KEY).agg(*told)
    e = e.withColumns({c: F.col(f"{k}.{c}") for k, cs in lasts.items() if k in has for c in cs})
    missing = {c: F.lit(None).cast(t) for c, t in (("queue_status", "string"), ("parent_subject", "string"), ("parent_hop", "int")) if c not in e.columns}
    flags = {c: F.coalesce(F.col(c), F.lit(False)) if c in has else F.lit(False) for c in FLAGS}
    e = e.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c in e.columns else F.lit(0).cast("long") for c in COUNTS} | flags | missing).drop(*lasts)
    given = lambda c, other: F.when(F.col("ner_processed") & (F.col(c) == 0), other).otherwise(F.col(c))
    e = e.withColumn("canonical_pre_ner_input", given("canonical_pre_ner_input", F.col("ner_candidates")))
    e = e.withColumn("canonical_kept", given("canonical_kept", F.col("ner_accepted") + F.col("ner_rejected")))
    e = e.withColumn("canonical_rejected_total", given("canonical_rejected_total", F.greatest(F.col("canonical_pre_ner_input") - F.col("canonical_kept"), F.lit(0))))
    e = e.withColumn("ner_candidates", given("ner_candidates", F.col("canonical_pre_ner_input")))
    return e.withColumns({k: rate_or_null(F.col(n), F.col(d)) for k, (n, d) in SURVIVAL.items()})


def by_hop(e: DataFrame, *more: str) -> DataFrame:
    """Sums over all entities of a hop; processed ones are those whose queue row is done."""
    done, article = F.col("queue_status") == "done", F.col("has_article")
    rest = article & ~F.coalesce(done, F.lit(False))
    rows = e.groupBy(*more, "hop").agg(
        F.count("*").alias("entities"), F.count_if(done).alias("entities_processed"), F.count_if(rest).alias("entities_unprocessed"), F.count_if("sim_processed").alias("entities_sim_processed"),
        F.count_if(article).alias("entities_with_article"), *(F.sum(c).alias(c) for c in COUNTS),
        F.coalesce(F.sum(F.when(done, F.col("ner_candidates"))), F.lit(0)).alias("ner_candidates_processed"), F.coalesce(F.sum(F.when(rest, F.col("ner_candidates"))), F.lit(0)).alias("ner_candidates_unprocessed"),
    )
    return rows.withColumns({k: rate_or_null(F.col(n), F.col(d)) for k, (n, d) in SURVIVAL.items()})


def total(hops: DataFrame) -> DataFrame:
    whole = [c for c, t in hops.dtypes if t in ("bigint", "int") and c != "hop"]
    return hops.agg(*(F.sum(c).alias(c) for c in whole))


def survival_spread(e: DataFrame) -> DataFrame:
    """Mean and population deviation of survival over processed entities of a hop."""
    return e.filter("queue_status = 'done'").groupBy("hop").agg(*(f(c).alias(f"{c}_{n}") for c in SURVIVAL for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def candidates_total(*given: Column) -> Column:
    """The first of several counts that is neither missing nor 0."""
    return F.coalesce(*(F.nullif(c, F.lit(0)) for c in given), F.lit(0)).cast("long")


def by_model(runs: DataFrame, candidates: Column, *keys: str) -> DataFrame:
    """Sums over a model's runs (or model and hop) and ratios of sums, 0 where the denominator is; models in their fixed order (`place`), others
    last. candidates: what the candidates of a row are; the model rollup and the one by hop differ in it."""
    sums = ("canonical_kept", "canonical_rejected_total", "ner_accepted", "ner_rejected", "similarity_accepted", "similarity_rejected", "similarity_skipped", "inserted_children")
    rows = runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.sum(candidates).alias("candidates_total"), *(F.sum(c).alias(c) for c in sums))
    of = {k: (n, "candidates_total" if d == "canonical_pre_ner_input" else d) for k, (n, d) in SURVIVAL.items()}
    place = F.array_position(F.array(*map(F.lit, MODEL_ORDER)), F.col(keys[0]))
    return rows.withColumns({k: rate_or_zero(F.col(n), F.col(d)) for k, (n, d) in of.items()} | {"place": F.coalesce(F.nullif(place, F.lit(0)), F.lit(len(MODEL_ORDER) + 1))})
