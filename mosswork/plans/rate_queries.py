"""Factuality, coverage, funnel and overlap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rates import found, mean, seeded, std
from ..functions.similarity import WEIGHTS_CAPTURE, WEIGHTS_EVALUATION, combined, punctuation_density, sentence_lengths, tfidf_cosine, type_token_ratio, with_shared
from ..functions.similarity import STOP_WORDS
from ..functions import text as tx
from ..operators import analyses as an
from ..operators import funnel as fn
from .registry import query, table
from .text_queries import TOKENS

MEASURES = ["accuracy", "true_rate", "false_rate", "unverifiable_rate"]
CLAIMS_SQL = """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'supported' WHEN 'R' THEN 'refuted' ELSE 'insufficient' END AS verdict FROM lineitem"""
STATS_SQL = f"""SELECT l_orderkey, count(*) AS n_claims, count(*) FILTER (verdict = 'supported') AS n_supported, count(*) FILTER (verdict = 'refuted') AS n_refuted,
    count(*) FILTER (verdict = 'insufficient') AS n_insufficient, (count(*) FILTER (verdict = 'supported'))::DOUBLE / count(*) AS true_rate, (count(*) FILTER (verdict = 'refuted'))::DOUBLE / count(*) AS false_rate,
    (count(*) FILTER (verdict = 'insufficient'))::DOUBLE / count(*) AS unverifiable_rate,
    (count(*) FILTER (verdict = 'supported'))::DOUBLE / nullif(count(*) FILTER (verdict <> 'insufficient'), 0) AS accuracy FROM ({CLAIMS_SQL}) GROUP BY l_orderkey"""
RECORDS_SQL = f"""SELECT s.*, c_mktsegment AS topic, o_orderpriority AS model, o_orderstatus <> 'P' AS found, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus <> 'P' END AS flag, o_orderkey % 3 AS seed
    FROM ({STATS_SQL}) s JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""


def claims(spark, sf_dir):
    """Line items as claims: A supported, R refuted, N insufficient."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(flag == "A", "supported").when(flag == "R", "refuted").otherwise("insufficient").alias("verdict"))


def records(spark, sf_dir):
    """Orders as evaluated articles: topic is the market segment, model the priority; status P means no reference page."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    s = an.verdict_stats(claims(spark, sf_dir), "l_orderkey")
    j = s.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    ok = F.col("o_orderstatus") != "P"
    return j.select(*s.columns, F.col("c_mktsegment").alias("topic"), F.col("o_orderpriority").alias("model"), ok.alias("found"), F.when(F.col("o_orderkey") % 3 != 0, ok).alias("flag"), (F.col("o_orderkey") % 3).alias("seed"))


def rounded(df, *keys):
    return df.select(*keys, *(F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes if c not in keys))


@query(f"SELECT l_orderkey, n_claims, n_supported, n_refuted, n_insufficient, round(true_rate, 9) AS true_rate, round(false_rate, 9) AS false_rate, round(unverifiable_rate, 9) AS unverifiable_rate, round(accuracy, 9) AS accuracy FROM ({STATS_SQL})")
def verdict_stats(spark, sf_dir):
    return rounded(an.verdict_stats(claims(spark, sf_dir), "l_orderkey"), "l_orderkey")


_RUN_SQL = f"""SELECT topic, model, seed, count(*) AS n, avg(CASE WHEN found THEN 1.0 ELSE 0.0 END) AS coverage, {', '.join(f'avg(CASE WHEN found THEN {m} END) AS {m}' for m in MEASURES)} FROM ({RECORDS_SQL}) GROUP BY topic, model, seed"""


@query(f"""SELECT topic, model, count(*) AS n, round(avg(CASE WHEN found THEN 1.0 ELSE 0.0 END), 9) AS coverage, {', '.join(f'round(avg(CASE WHEN found THEN {m} END), 9) AS {m}' for m in MEASURES)},
    round(stddev_samp(CASE WHEN found THEN accuracy END), 9) AS accuracy_std FROM ({RECORDS_SQL}) GROUP BY topic, model""")
def factuality_by_topic_model(spark, sf_dir):
    r = records(spark, sf_dir)
    rows = r.groupBy("topic", "model").agg(
        F.count("*").alias("n"), F.avg(F.col("found").cast("double")).alias("coverage"), *(mean(F.when(F.col("found"), F.col(m))).alias(m) for m in MEASURES), std(F.when(F.col("found"), F.col("accuracy"))).alias("accuracy_std")
    )
    return rounded(rows, "topic", "model")


@query(f"SELECT topic, model, seed, n, round(coverage, 9) AS coverage, {', '.join(f'round({m}, 9) AS {m}' for m in MEASURES)} FROM ({_RUN_SQL})")
def factuality_run_level(spark, sf_dir):
    return rounded(an.run_means(records(spark, sf_dir), ["topic", "model", "seed"], MEASURES, F.col("found")), "topic", "model", "seed")


@query(f"SELECT topic, model, count(*) AS runs, {', '.join(f'round(avg({m}), 9) AS {m}_mean, round(stddev_samp({m}), 9) AS {m}_std' for m in MEASURES)} FROM ({_RUN_SQL}) GROUP BY topic, model")
def two_level_seed_summary(spark, sf_dir):
    runs = an.run_means(records(spark, sf_dir), ["topic", "model", "seed"], MEASURES, F.col("found"))
    return rounded(an.mean_of_means(runs, ["topic", "model"], MEASURES), "topic", "model")


@query(f"SELECT model, count(*) AS n, {', '.join(f'round(avg({m}), 9) AS {m}' for m in MEASURES)} FROM ({RECORDS_SQL}) GROUP BY model")
def aggregate_by_candidate(spark, sf_dir):
    return rounded(an.pooled(records(spark, sf_dir), ["model"], MEASURES), "model")


@query(f"SELECT model, round(sum(n_supported)::DOUBLE / sum(n_claims), 9) AS true_rate, round(sum(n_refuted)::DOUBLE / sum(n_claims), 9) AS false_rate FROM ({RECORDS_SQL}) GROUP BY model")
def ratio_of_sums(spark, sf_dir):
    return rounded(an.ratio_of_sums(records(spark, sf_dir), ["model"], {"true_rate": ("n_supported", "n_claims"), "false_rate": ("n_refuted", "n_claims")}), "model")


@query(f"SELECT topic, count(*) FILTER (NOT found) AS n, round(avg(CASE WHEN NOT found THEN true_rate END), 9) AS frontier_web_true_rate FROM ({RECORDS_SQL}) GROUP BY topic")
def frontier_slice(spark, sf_dir):
    r = records(spark, sf_dir).select("topic", F.col("true_rate").alias("web_true_rate"), (~F.col("found")).alias("is_frontier"))
    return rounded(an.frontier(r).groupBy("topic").agg(F.count_if("is_frontier").alias("n"), F.avg("frontier_web_true_rate").alias("frontier_web_true_rate")), "topic")


@query("""SELECT doc_id, coalesce(quality = 1, false) AS strict, CASE WHEN quality IS NOT NULL THEN quality = 1 WHEN doc_id % 7 > 0 OR doc_id % 11 > 0 THEN true WHEN doc_id % 5 > 0 AND doc_id % 5 = doc_id % 4 THEN false ELSE true END AS loose
    FROM documents LEFT JOIN labels USING (doc_id)""")
def wiki_found_strict_loose(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("flag")), "doc_id", "left")
    i = F.col("doc_id")
    told = lambda strict: found(F.col("flag"), i % 7, i % 11, i % 4, i % 5, [], strict)
    return d.select("doc_id", told(True).alias("strict"), told(False).alias("loose"))


@query("""SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS strict, count(*) FILTER (quality IS NULL OR quality = 1) AS loose, round((count(*) FILTER (quality = 1))::DOUBLE / count(*), 9) AS coverage
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def coverage_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    q = F.col("quality")
    rows = d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(q == 1).alias("strict"), F.count_if(q.isNull() | (q == 1)).alias("loose"))
    return rows.withColumn("coverage", F.round(F.col("strict") / F.col("n"), 9))


@query("""SELECT o_orderkey FROM orders ORDER BY md5('123:' || o_orderkey::VARCHAR), o_orderkey LIMIT 50""")
def seeded_sample(spark, sf_dir):
    return an.sampled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 50, 123)


@query(f"""WITH k AS (SELECT unnest([42, 123, 7]) AS seed), r AS (SELECT seed, r.*, row_number() OVER (PARTITION BY k.seed, model ORDER BY md5(k.seed || ':' || l_orderkey::VARCHAR), l_orderkey) AS p FROM ({RECORDS_SQL.replace(', o_orderkey % 3 AS seed', '')}) r CROSS JOIN k)
    SELECT model, count(*) AS runs, round(avg(a), 9) AS accuracy_mean, round(stddev_samp(a), 9) AS accuracy_std FROM (SELECT model, seed, avg(accuracy) AS a FROM r WHERE p <= 100 GROUP BY model, seed) GROUP BY model""")
def multi_seed_sample(spark, sf_dir):
    r = records(spark, sf_dir).drop("seed")
    parts = [an.sampled(r, "l_orderkey", 100, s, "model").withColumn("seed", F.lit(s)) for s in (42, 123, 7)]
    runs = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("model", "seed").agg(mean(F.col("accuracy")).alias("accuracy"))
    return rounded(an.mean_of_means(runs, ["model"], ["accuracy"]), "model")


# the funnel: an order is a subject, hop its key modulo 4; line items are decisions
_FUNNEL_SQL = """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS subject, CAST(o_orderkey % 4 AS INT) AS hop, o_orderstatus, o_orderpriority AS model, o_orderkey FROM orders), l AS (
    SELECT CAST(l_orderkey AS VARCHAR) AS subject, CAST(l_orderkey % 4 AS INT) AS hop, l_returnflag AS f, l_linestatus AS s, l_linenumber AS n FROM lineitem), n AS (
    SELECT subject, hop, count(*) FILTER (f = 'A') AS ner_accepted, count(*) FILTER (f <> 'A') AS ner_rejected, count(*) FILTER (f = 'N') AS ner_rejected_low_conf FROM l GROUP BY subject, hop), m AS (
    SELECT subject, hop, count(*) FILTER (s = 'F') AS similarity_accepted, count(*) FILTER (s = 'O' AND n % 2 = 0) AS sim_rejected_failure, count(*) FILTER (s = 'O' AND n % 2 = 1) AS sim_rejected_llm_duplicate FROM l WHERE f = 'A' GROUP BY subject, hop), q AS (
    SELECT subject, hop, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'working' END AS queue_status, model, CAST(o_orderkey % 9 AS BIGINT) AS pre FROM o), e AS (
    SELECT q.*, coalesce(ner_accepted, 0) AS ner_accepted, coalesce(ner_rejected, 0) AS ner_rejected, coalesce(ner_rejected_low_conf, 0) AS ner_rejected_low_conf, coalesce(similarity_accepted, 0) AS similarity_accepted,
        coalesce(sim_rejected_failure, 0) AS sim_rejected_failure, coalesce(sim_rejected_llm_duplicate, 0) AS sim_rejected_llm_duplicate, n.subject IS NOT NULL AS p, q.pre AS canonical_pre_ner_input FROM q LEFT JOIN n USING (subject, hop) LEFT JOIN m USING (subject, hop)), f AS (
    SELECT *, CASE WHEN p THEN ner_accepted + ner_rejected ELSE 0 END AS canonical_kept FROM e), g AS (
    SELECT *, CASE WHEN p THEN greatest(canonical_pre_ner_input - canonical_kept, 0) ELSE 0 END AS canonical_rejected_total FROM f)"""
_FUNNEL_COLUMNS = ["canonical_pre_ner_input", "canonical_kept", "canonical_rejected_total", "ner_accepted", "ner_rejected", "ner_rejected_low_conf", "similarity_accepted", "sim_rejected_failure", "sim_rejected_llm_duplicate"]


def _decisions(spark, sf_dir):
    """Line items as decisions on phrases, and those that pass as decisions on similarity."""
    key = (F.col("l_orderkey").cast("string").alias("subject"), (F.col("l_orderkey") % 4).cast("int").alias("hop"))
    f, s, n = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    decisions = l.select(*key, (f == "A").alias("passed_threshold"), F.when(f == "R", "not_named_entity").when(f == "N", "below_conf").alias("decision_reason"), F.lit("model").alias("source"))
    sims = l.filter(f == "A").select(*key, F.lit("").alias("stage"), F.when(s == "F", "accept").otherwise("reject").alias("decision"), F.when((s == "O") & (n % 2 == 0), "http_status=500").when(s == "O", "llm_duplicate").alias("reason"))
    return l, key, decisions, sims


def funnel_entities(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", F.col("o_orderpriority").alias("model"))
    key = (F.col("k").cast("string").alias("subject"), (F.col("k") % 4).cast("int").alias("hop"))
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("working")
    none = F.lit(None)
    queue = fn.queue_rows(o.select(*key, status.alias("status"), none.cast("string").alias("parent_subject"), none.cast("int").alias("parent_hop"), F.col("k").alias("ordinal")))
    pre = o.select(*key, (F.col("k") % 9).alias("canonical_pre_ner_input"))
    _, _, decisions, sims = _decisions(spark, sf_dir)
    return fn.entities(queue, pre, fn.ner_rows(decisions), fn.similarity_rows(sims))


@query(f"{_FUNNEL_SQL} SELECT subject, hop, queue_status, {', '.join(_FUNNEL_COLUMNS)}, round(canonical_kept::DOUBLE / nullif(canonical_pre_ner_input, 0), 4) AS canonical_survival, round(ner_accepted::DOUBLE / nullif(canonical_kept, 0), 4) AS ner_survival FROM g")
def funnel_entity(spark, sf_dir):
    return funnel_entities(spark, sf_dir).select("subject", "hop", "queue_status", *_FUNNEL_COLUMNS, "canonical_survival", "ner_survival")


@query(f"""{_FUNNEL_SQL} SELECT hop, count(*) AS entities, count(*) FILTER (queue_status = 'done') AS entities_processed, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _FUNNEL_COLUMNS)},
    round(sum(ner_accepted)::DOUBLE / nullif(sum(canonical_kept), 0), 4) AS ner_survival FROM g GROUP BY hop""")
def funnel_hop(spark, sf_dir):
    return fn.by_hop(funnel_entities(spark, sf_dir)).select("hop", "entities", "entities_processed", *_FUNNEL_COLUMNS, "ner_survival")


@query(f"{_FUNNEL_SQL} SELECT count(*) AS entities, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _FUNNEL_COLUMNS)} FROM g")
def funnel_total(spark, sf_dir):
    return fn.total(fn.by_hop(funnel_entities(spark, sf_dir))).select("entities", *_FUNNEL_COLUMNS)


_MODEL_SQL = """, count(*) AS n_runs, CAST(sum(canonical_pre_ner_input) AS BIGINT) AS candidates_total, CAST(sum(canonical_kept) AS BIGINT) AS canonical_kept, CAST(sum(ner_accepted) AS BIGINT) AS ner_accepted,
    round(coalesce(sum(canonical_kept)::DOUBLE / nullif(sum(canonical_pre_ner_input), 0), 0), 9) AS canonical_survival, round(coalesce(sum(ner_accepted)::DOUBLE / nullif(sum(canonical_kept), 0), 0), 9) AS ner_survival"""


def _modelled(spark, sf_dir, *keys):
    model = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("subject"), F.when(F.col("o_orderpriority") == "1-URGENT", "llama").when(F.col("o_orderpriority") == "2-HIGH", "deepseek").otherwise(F.col("o_orderpriority")).alias("model"))
    rows = fn.by_model(funnel_entities(spark, sf_dir).join(model, "subject"), fn.candidates_total(F.col("canonical_pre_ner_input")), *keys)
    return rows.select(*keys, F.col("place").cast("int").alias("place"), "n_runs", "candidates_total", "canonical_kept", "ner_accepted", F.round("canonical_survival", 9).alias("canonical_survival"), F.round("ner_survival", 9).alias("ner_survival"))


_MODELS = "CASE model WHEN '1-URGENT' THEN 'llama' WHEN '2-HIGH' THEN 'deepseek' ELSE model END AS model, CASE model WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 1 ELSE 4 END AS place"


@query(f"{_FUNNEL_SQL} SELECT {_MODELS} {_MODEL_SQL} FROM g GROUP BY ALL")
def funnel_model(spark, sf_dir):
    return _modelled(spark, sf_dir, "model")


@query(f"{_FUNNEL_SQL} SELECT {_MODELS}, hop {_MODEL_SQL} FROM g GROUP BY ALL")
def funnel_model_hop(spark, sf_dir):
    return _modelled(spark, sf_dir, "model", "hop")


@query(f"""{_FUNNEL_SQL} SELECT hop, round(avg(round(ner_accepted::DOUBLE / nullif(canonical_kept, 0), 4)), 9) AS ner_survival_mean, round(stddev_pop(round(ner_accepted::DOUBLE / nullif(canonical_kept, 0), 4)), 9) AS ner_survival_std FROM g WHERE queue_status = 'done' GROUP BY hop""")
def funnel_mean_std(spark, sf_dir):
    return fn.survival_spread(funnel_entities(spark, sf_dir)).select("hop", F.round("ner_survival_mean", 9).alias("ner_survival_mean"), F.round("ner_survival_std", 9).alias("ner_survival_std"))


@query("""SELECT CAST(l_orderkey % 4 AS INT) AS hop, '{' || string_agg('"' || r || '":' || n, ',' ORDER BY r) || '}' AS ner_reject_reason_counts FROM (
    SELECT l_orderkey % 4 AS l_orderkey, CASE l_returnflag WHEN 'R' THEN 'not_named_entity' ELSE 'below_conf' END AS r, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL) GROUP BY l_orderkey""")
def funnel_reasons(spark, sf_dir):
    _, _, decisions, _ = _decisions(spark, sf_dir)
    return fn.counters(fn.reason_rows(decisions=decisions), "hop").select("hop", "ner_reject_reason_counts")


# every log of a run: line items also say what canonical dedup rejected and how answers were parsed
_ALL_LOGS = """WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS subject, CAST(l_orderkey % 4 AS INT) AS hop, l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f, l_linestatus AS s FROM lineitem), o AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS subject, CAST(o_orderkey % 4 AS INT) AS hop, o_orderkey AS k, o_orderstatus AS st FROM orders), k AS (
    SELECT subject, hop FROM l UNION SELECT subject, hop FROM o UNION SELECT CAST(o_orderkey // 4 AS VARCHAR), CAST((o_orderkey // 4) % 4 AS INT) FROM orders WHERE o_orderkey >= 4), a AS (
    SELECT subject, hop, true AS has_article, k % 5 + 1 AS raw_wikilink_occurrences, CASE WHEN k % 5 > 0 THEN 2 ELSE 1 END AS raw_wikilink_unique, k % 7 AS extracted_link_targets, k % 2 AS extracted_categories FROM o WHERE k % 3 = 0), c AS (
    SELECT CAST(k // 4 AS VARCHAR) AS subject, CAST((k // 4) % 4 AS INT) AS hop, count(*) AS inserted_children FROM o WHERE k >= 4 GROUP BY ALL), d AS (
    SELECT subject, hop, max(n) AS ner_candidates, max(CASE WHEN q > 25 THEN q ELSE 0 END) AS pre, max(CASE WHEN q > 25 THEN n ELSE 0 END) AS kept, max(CASE WHEN q > 25 THEN greatest(q - n, 0) ELSE 0 END) AS gone,
        count(*) FILTER (n = 1) AS rb, count(*) FILTER (n = 2) AS rs, count(*) FILTER (n = 3) AS ro, count(*) FILTER (n IN (4, 5)) AS rp, CAST(coalesce(sum(CASE WHEN n = 6 THEN 2 WHEN n = 7 AND f = 'A' THEN 1 ELSE 0 END), 0) AS BIGINT) AS ec,
        count(*) FILTER (f = 'A') AS ok, count(*) FILTER (f <> 'A') AS no, count(*) FILTER (f = 'R') AS ne, count(*) FILTER (f = 'N') AS low FROM l GROUP BY subject, hop), e AS (
    SELECT k.*, coalesce(has_article, false) AS has_article, st, coalesce(raw_wikilink_occurrences, 0) AS raw_wikilink_occurrences, coalesce(raw_wikilink_unique, 0) AS raw_wikilink_unique, coalesce(extracted_link_targets, 0) AS extracted_link_targets, coalesce(extracted_categories, 0) AS extracted_categories,
        coalesce(inserted_children, 0) AS inserted_children, d.subject IS NOT NULL AS p, coalesce(d.ner_candidates, 0) AS nc, CASE WHEN coalesce(pre, 0) = 0 AND d.subject IS NOT NULL THEN d.ner_candidates ELSE coalesce(pre, 0) END AS canonical_pre_ner_input,
        CASE WHEN coalesce(kept, 0) = 0 AND d.subject IS NOT NULL THEN ok + no ELSE coalesce(kept, 0) END AS canonical_kept, coalesce(gone, 0) AS gone, coalesce(rb, 0) AS canonical_rejected_batch, coalesce(rs, 0) AS canonical_rejected_seen, coalesce(ro, 0) AS canonical_rejected_other, coalesce(rp, 0) AS canonical_rejected_plural,
        coalesce(ec, 0) AS ner_summary_error_count, coalesce(ok, 0) AS ner_accepted, coalesce(no, 0) AS ner_rejected, coalesce(ne, 0) AS ner_rejected_not_ne, coalesce(low, 0) AS ner_rejected_low_conf
    FROM k LEFT JOIN a USING (subject, hop) LEFT JOIN c USING (subject, hop) LEFT JOIN d USING (subject, hop) LEFT JOIN (SELECT subject, hop, st FROM o) USING (subject, hop)), g AS (
    SELECT *, CASE WHEN p AND gone = 0 THEN greatest(canonical_pre_ner_input - canonical_kept, 0) ELSE gone END AS canonical_rejected_total, CASE WHEN p AND nc = 0 THEN canonical_pre_ner_input ELSE nc END AS ner_candidates FROM e)"""
_ALL_COLUMNS = "raw_wikilink_occurrences raw_wikilink_unique extracted_link_targets extracted_categories ner_candidates canonical_pre_ner_input canonical_kept canonical_rejected_total canonical_rejected_seen canonical_rejected_batch canonical_rejected_plural canonical_rejected_other ner_accepted ner_rejected ner_rejected_not_ne ner_rejected_low_conf ner_summary_error_count inserted_children".split()


def _all_logs(spark, sf_dir):
    l, key, decisions, sims = _decisions(spark, sf_dir)
    n, none = F.col("l_linenumber"), F.lit(None)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    own = (F.col("k").cast("string").alias("subject"), (F.col("k") % 4).cast("int").alias("hop"))
    parent = F.when(F.col("k") >= 4, F.expr("k div 4"))
    queue = o.select(*own, F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"), parent.cast("string").alias("parent_subject"), (parent % 4).cast("int").alias("parent_hop"), F.col("k").alias("ordinal"))
    written = o.filter("k % 3 = 0")
    text = F.concat(F.repeat(F.lit("[[A|x]] "), (F.col("k") % 5).cast("int")), F.lit("[[B]]"))
    drafts = written.select(*own, F.lit("[[old]] [[older]] [[oldest]]").alias("wikitext"), F.lit(0).alias("line_no"))
    articles = drafts.unionByName(written.select(*own, text.alias("wikitext"), F.lit(1).alias("line_no")))
    listed = lambda c: F.array_repeat(F.lit("x"), c.cast("int"))
    plain = lambda at, a, b: written.select(*own, listed(a).alias("links"), listed(b).alias("categories"), none.cast("array<string>").alias("ner_candidates"), none.cast("boolean").alias("diag"), F.lit(at).alias("line_no"))
    diag = l.select(*key, none.cast("array<string>").alias("links"), none.cast("array<string>").alias("categories"), listed(n).alias("ner_candidates"), F.lit(True).alias("diag"), n.alias("line_no"))
    meta = plain(0, F.lit(9), F.lit(9)).unionByName(plain(1, F.col("k") % 7, F.col("k") % 2)).unionByName(diag)
    summaries = l.filter("cast(l_quantity as long) > 25").select(*key, F.col("l_quantity").cast("long").alias("pre_dedup_count"), n.cast("long").alias("post_dedup_count"), none.cast("long").alias("filtered_count"))
    rejected = l.filter("l_linenumber <= 3 or l_linenumber = 7").select(*key, F.when(n == 7, "elsewhere").when(n == 1, "queue_dedup_batch").otherwise("queue_dedup").alias("stage"), F.when(n == 2, "already_seen").when(n == 3, "odd").otherwise("").alias("rejection_reason"))
    plural = l.filter("l_linenumber in (4, 5)").select(*key, F.when(n == 4, "plural_batch").otherwise("plural").alias("stage"))
    runs = l.filter("l_linenumber in (6, 7)").select(
        *key, F.when(n == 6, "ner_run_summary_global").otherwise("ner_run_summary").alias("stage"), F.when(n == 7, F.when(F.col("l_returnflag") == "A", "exception").otherwise("json")).alias("parse_mode"),
        F.array(F.lit("json"), F.lit("regex_simple")).alias("parse_modes"), F.lit(2).alias("chunk_failures"),
    )
    return queue, articles, meta, summaries, rejected, plural, runs, decisions, sims


@query(f"""{_ALL_LOGS} SELECT hop, count(*) AS entities, count(*) FILTER (st = 'F') AS entities_processed, count(*) FILTER (has_article AND coalesce(st, '') <> 'F') AS entities_unprocessed, count(*) FILTER (has_article) AS entities_with_article,
    {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _ALL_COLUMNS)}, CAST(sum(CASE WHEN st = 'F' THEN ner_candidates ELSE 0 END) AS BIGINT) AS ner_candidates_processed, round(sum(inserted_children)::DOUBLE / nullif(sum(canonical_pre_ner_input), 0), 4) AS overall_survival_to_inserted FROM g GROUP BY hop""")
def funnel_all_logs(spark, sf_dir):
    queue, articles, meta, summaries, rejected, plural, runs, decisions, sims = _all_logs(spark, sf_dir)
    e = fn.entities(fn.queue_rows(queue), fn.child_rows(queue), fn.article_rows(articles), fn.meta_rows(meta), fn.summary_rows(summaries), fn.rejected_rows(rejected), fn.plural_rows(plural), fn.run_summary_rows(runs), fn.ner_rows(decisions), fn.similarity_rows(sims))
    return fn.by_hop(e).select("hop", "entities", "entities_processed", "entities_unprocessed", "entities_with_article", *_ALL_COLUMNS, "ner_candidates_processed", "overall_survival_to_inserted")


_COUNTED = {
    "canonical_reason_counts": "CASE n WHEN 1 THEN 'queue_dedup_batch' WHEN 2 THEN 'already_seen' WHEN 3 THEN 'odd' WHEN 4 THEN 'plural_variant_batch' WHEN 5 THEN 'plural_variant' END",
    "ner_reject_reason_counts": "CASE f WHEN 'R' THEN 'not_named_entity' WHEN 'N' THEN 'below_conf' END",
    "similarity_reject_reason_counts": "CASE WHEN f = 'A' AND s = 'O' THEN CASE WHEN n % 2 = 0 THEN 'http_status=500' ELSE 'llm_duplicate' END END",
    "similarity_failure_reason_counts": "CASE WHEN f = 'A' AND s = 'O' AND n % 2 = 0 THEN 'http_status=500' END",
}


@query("WITH l AS (SELECT CAST(l_orderkey % 4 AS INT) AS hop, l_linenumber AS n, l_returnflag AS f, l_linestatus AS s FROM lineitem), r AS (" + " UNION ALL ".join(f"SELECT hop, '{k}' AS c, {v} AS r FROM l" for k, v in _COUNTED.items())
       + """ UNION ALL SELECT hop, 'ner_summary_parse_modes', unnest(CASE WHEN n = 6 THEN ['json', 'regex_simple'] ELSE [CASE f WHEN 'A' THEN 'exception' ELSE 'json' END] END) FROM l WHERE n IN (6, 7)), k AS (SELECT hop, c, r, count(*) AS n FROM r WHERE r IS NOT NULL GROUP BY ALL), j AS (
       SELECT hop, c, '{' || string_agg('"' || r || '":' || n, ',' ORDER BY r) || '}' AS t FROM k GROUP BY hop, c) SELECT hop, """ + ", ".join(f"max(t) FILTER (c = '{k}') AS {k}" for k in [*_COUNTED, "ner_summary_parse_modes"]) + " FROM j GROUP BY hop")
def funnel_counters(spark, sf_dir):
    _, _, _, _, rejected, plural, runs, decisions, sims = _all_logs(spark, sf_dir)
    return fn.counters(fn.reason_rows(rejected, plural, decisions, runs, sims), "hop").select("hop", *_COUNTED, "ner_summary_parse_modes")


SIM = [("", "accept", ""), ("", "Accept", "ok"), ("x", "reject", "http_status=500"), ("x", "reject", "sdk_exception"), ("similarity_batch_http_error", "reject", "odd"), ("similarity_batch_http_error", "reject", ""), ("s", "reject", None), ("similarity_filter_skip_indexed", "accept", "r"), ("s", "skip", ""), ("s", "", ""), ("", None, "")]


@query("""SELECT event_id, outcome, reason, failed FROM events JOIN (VALUES (0,'accepted','accepted',false),(1,'accepted','ok',false),(2,'rejected','http_status=500',true),(3,'rejected','sdk_exception',true),(4,'rejected','odd',true),(5,'rejected','similarity_batch_http_error',true),
    (6,'rejected','reject',false),(7,'skipped','already_in_embedding_index',false),(8,'skipped','skip',false),(9,'unknown','s',false),(10,'unknown','unknown',false)) v(id, outcome, reason, failed) ON event_id % 11 = id""")
def normalize_similarity_reason(spark, sf_dir):
    """Each event has one of the decisions."""
    kinds = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(("stage", "decision", "reason"), r, strict=True))) for r in SIM))
    d = table(spark, sf_dir, "events").select("event_id", F.get(kinds, (F.col("event_id") % len(SIM)).cast("int")).alias("s")).select("event_id", "s.*")
    return d.select("event_id", fn.normalised(F.col("stage"), F.col("decision"), F.col("reason")).alias("x")).select("event_id", "x.*")


_BOUGHT = "SELECT DISTINCT c_mktsegment AS g, l_partkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "


def bought(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"))
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("g"))
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("g", "item")


@query(f"""WITH m AS ({_BOUGHT}), s AS (SELECT g, count(*) AS n FROM m GROUP BY g), p AS (SELECT a.g AS a, b.g AS b, count(*) AS shared FROM m a JOIN m b ON a.item = b.item AND a.g < b.g GROUP BY a.g, b.g)
    SELECT x.g AS a, y.g AS b, x.n AS size_a, y.n AS size_b, coalesce(shared, 0) AS shared, round(coalesce(shared, 0)::DOUBLE / (x.n + y.n - coalesce(shared, 0)), 9) AS jaccard, round(coalesce(shared, 0)::DOUBLE / least(x.n, y.n), 9) AS overlap
    FROM s x JOIN s y ON x.g < y.g LEFT JOIN p ON p.a = x.g AND p.b = y.g""")
def entity_overlap_pairs(spark, sf_dir):
    return rounded(an.set_overlap(bought(spark, sf_dir), "g", "item"), "a", "b")


@query(f"""WITH m AS ({_BOUGHT}) SELECT mask, count(*) AS n FROM (SELECT item, CAST(bit_or(CASE g WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 4 ELSE 0 END) AS INT) AS mask FROM m GROUP BY item) GROUP BY mask""")
def subject_overlap_venn(spark, sf_dir):
    return an.venn(bought(spark, sf_dir), "g", "item", ["AUTOMOBILE", "BUILDING", "MACHINERY"])


# pairs of documents: each with the one before it by id
_PAIRS_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {TOKENS.replace('text', "coalesce(text, '')")} AS w FROM documents), p AS (SELECT a.doc_id, b.doc_id AS other, a.text, b.text AS text_b, a.w, b.w AS v FROM d a JOIN d b ON a.doc_id = b.doc_id + 1)"""
_G = lambda w, n: f"list_distinct(list_transform(range(1, greatest(1, len({w}) - {n - 2})), lambda i: array_to_string({w}[i : i + {n - 1}], '|')))"
_J = lambda a, b: f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"
_O = lambda a, b: f"len(list_intersect({a}, {b}))::DOUBLE / nullif(least(len({a}), len({b})), 0)"


def pairs(spark, sf_dir):
    """Each document with the one before it, by an equi-join on the id: doc_id, other, their texts and words. Texts are shuffled alone, words are read from them after that."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    before = d.select(F.col("doc_id").alias("other"), F.col("text").alias("text_b"))
    return d.join(before.hint("merge"), F.col("doc_id") == F.col("other") + 1).withColumns({"w": tx.tokens(F.col("text")), "v": tx.tokens(F.col("text_b"))})


def measured(spark, sf_dir):
    """doc_id, other, and the lexical measures of the two."""
    return with_shared(pairs(spark, sf_dir).select("doc_id", "other", "w", "v"), "w", "v")


@query(f"""{_PAIRS_SQL}, g AS (SELECT doc_id, other, {_G('w', 1)} AS a1, {_G('v', 1)} AS b1, {_G('w', 2)} AS a2, {_G('v', 2)} AS b2, {_G('w', 3)} AS a3, {_G('v', 3)} AS b3 FROM p)
    SELECT doc_id, other, round({_J('a1', 'b1')}, 9) AS jaccard, {', '.join(f"round({_J(f'a{n}', f'b{n}')}, 9) AS ngram_{n}_jaccard, round({_O(f'a{n}', f'b{n}')}, 9) AS ngram_{n}_overlap" for n in (1, 2, 3))} FROM g""")
def pair_ngram_overlap(spark, sf_dir):
    p, m = measured(spark, sf_dir)
    return p.select("doc_id", "other", *(F.round(c, 9).alias(k) for k, c in m.items()))


@query(f"""{_PAIRS_SQL}, g AS (SELECT doc_id, other, {_G('w', 1)} AS a1, {_G('v', 1)} AS b1, {_G('w', 2)} AS a2, {_G('v', 2)} AS b2, {_G('w', 3)} AS a3, {_G('v', 3)} AS b3 FROM p), m AS (
    SELECT doc_id, other, {_J('a1', 'b1')} AS j, {_O('a1', 'b1')} AS o1, {_O('a2', 'b2')} AS o2, {_O('a3', 'b3')} AS o3 FROM g)
    SELECT doc_id, other, {', '.join(f'''round(coalesce((coalesce({w[0]} * j, 0) + coalesce({w[1]} * o1, 0) + coalesce({w[2]} * o2, 0) + coalesce({w[3]} * o3, 0)) / nullif(CASE WHEN j IS NULL THEN 0 ELSE {w[0]} END + CASE WHEN o1 IS NULL THEN 0 ELSE {w[1]} END
    + CASE WHEN o2 IS NULL THEN 0 ELSE {w[2]} END + CASE WHEN o3 IS NULL THEN 0 ELSE {w[3]} END, 0), 0)::DOUBLE, 9) AS {n}''' for n, w in (('evaluation', ('0.1::DOUBLE',) * 4), ('capture', ('0.15::DOUBLE', '0.15::DOUBLE', '0.25::DOUBLE', '0.25::DOUBLE'))))} FROM m""")
def combined_similarity(spark, sf_dir):
    p, m = measured(spark, sf_dir)
    return p.select("doc_id", "other", F.round(combined(m, WEIGHTS_EVALUATION), 9).alias("evaluation"), F.round(combined(m, WEIGHTS_CAPTURE), 9).alias("capture"))


_TF_WORDS = lambda t: rf"list_filter(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "))"


@query(f"""{_PAIRS_SQL}, t AS (SELECT doc_id, {_TF_WORDS('text')} AS x, {_TF_WORDS('text_b')} AS y FROM p), g AS (
    SELECT doc_id, unnest(list_concat(x, list_transform(range(1, greatest(1, len(x))), lambda i: x[i] || ' ' || x[i + 1]))) AS g, 0 AS side FROM t UNION ALL SELECT doc_id, unnest(list_concat(y, list_transform(range(1, greatest(1, len(y))), lambda i: y[i] || ' ' || y[i + 1]))), 1 FROM t), c AS (
    SELECT doc_id, g, (count(*) FILTER (side = 0))::DOUBLE AS p, (count(*) FILTER (side = 1))::DOUBLE AS q FROM g GROUP BY doc_id, g), w AS (SELECT doc_id, p * i AS p, q * i AS q FROM (SELECT *, CASE WHEN p > 0 AND q > 0 THEN 1.0::DOUBLE ELSE 1 + ln(1.5::DOUBLE) END AS i FROM c))
    SELECT t.doc_id, round(coalesce(sum(p * q) / nullif(sqrt(sum(p * p)) * sqrt(sum(q * q)), 0), 0), 9) AS cosine FROM t LEFT JOIN w ON w.doc_id = t.doc_id GROUP BY t.doc_id""")
def tfidf_pairs(spark, sf_dir):
    return tfidf_cosine(pairs(spark, sf_dir), "doc_id", "text", "text_b").select("doc_id", F.round("cosine", 9).alias("cosine"))


@query(rf"""WITH s AS (SELECT doc_id, {TOKENS} AS w, list_transform(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> ''), lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> ''))) AS l,
    length(regexp_replace(text, '[^.,;:!?\-()\[\]{{}}"''/]', '', 'g')) AS p, len(list_filter(string_split_regex(text, '\s+'), lambda y: y <> '')) AS n FROM documents)
    SELECT doc_id, round(list_avg(l), 9) AS sentence_words, round(p::DOUBLE / greatest(n, 1), 9) AS punctuation, round(len(list_distinct(w))::DOUBLE / nullif(len(w), 0), 9) AS ttr FROM s""")
def stylistic_features(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", tx.tokens(F.col("text")).alias("w"))
    l = sentence_lengths(F.col("text"))
    return d.select(
        "doc_id", F.round(F.aggregate(l, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(l), F.lit(0)), 9).alias("sentence_words"), F.round(punctuation_density(F.col("text")), 9).alias("punctuation"), F.round(type_token_ratio(F.col("w")), 9).alias("ttr")
    )


@query("""SELECT o_orderkey AS subject, o_orderpriority AS candidates FROM orders WHERE o_orderstatus = 'P'""")
def not_found_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("subject"), F.col("o_orderpriority").alias("candidate"), (F.col("o_orderstatus") != "P").alias("found"), F.col("o_orderkey").alias("line_no"))
    return an.not_found(o)


@query("""SELECT c_mktsegment AS topic, c_custkey, round(c_acctbal, 2) AS balance FROM customer QUALIFY c_acctbal = max(c_acctbal) OVER (PARTITION BY c_mktsegment)""")
def best_per_group(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("topic"), "c_custkey", F.round("c_acctbal", 2).alias("balance"))
    return an.best_flag(c, "topic", "balance").filter("best").drop("best")


@query(f"""SELECT count(*) AS attempted, count(n_claims) AS returned, count(*) FILTER (n_claims IS NULL) AS missing, count(*) FILTER (n_claims = 0) AS without_claims FROM orders LEFT JOIN ({STATS_SQL}) ON o_orderkey = l_orderkey""")
def attempt_shortfall(spark, sf_dir):
    s = an.verdict_stats(claims(spark, sf_dir), "l_orderkey").select(F.col("l_orderkey").alias("subject"), "n_claims")
    return an.shortfall(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("subject")), s)


@query("""SELECT l_orderkey AS subject, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, v) - 1 AS INT) AS claim_idx, l_linenumber::VARCHAR AS claim, v AS wiki_verdict, '' AS web_verdict
    FROM (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'supported' WHEN 'R' THEN 'refuted' ELSE 'insufficient' END AS v FROM lineitem)""")
def claim_explode(spark, sf_dir):
    """Every line item is a claim, those of one number too."""
    listed = claims(spark, sf_dir).groupBy(F.col("l_orderkey").alias("subject")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "verdict"))).alias("v"))
    r = listed.select("subject", F.transform("v", lambda x: x.l_linenumber.cast("string")).alias("claims"), F.transform("v", lambda x: x.verdict).alias("wiki_verdicts"), F.array().cast("array<string>").alias("web_verdicts"))
    return an.claim_rows(r)
