"""Queries of runs, reports, images and recorded answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import wikitext as wk
from ..functions.similarity import legacy_of, semantic_cosine, style_similarity, stylistic
from ..functions.similarity import FUNCTION_WORDS, WEIGHTS_LEGACY, reading_grade, sentence_mean, type_token_ratio
from ..operators import analyses as an
from ..operators import evidence as ev
from ..operators import index, pages, reports, salvage
from ..operators import queue as qu
from ..operators import vector as ve
from ..operators.ranges import numbered
from ..sources import logs, runs
from .engine_queries import _EVENTS, _STATE, queue_events
from .rate_queries import _PAIRS_SQL, _G, _J, _O, measured, pairs, records, rounded, RECORDS_SQL
from .registry import query, table
from .text_queries import ARTICLE_SQL, KEY, TOKENS, articles

# runs -------------------------------------------------------------------------------------------------------------------------------
# a file for each customer; seven folders in 21 hold no file of a run, and some folders have further ones below
_PATHS = "SELECT 'root/a' || (c_custkey % 21) || CASE WHEN c_custkey % 15 = 0 THEN '/b' || (c_custkey % 2) ELSE '' END AS dir, CASE WHEN c_custkey % 3 > 0 OR c_custkey % 15 = 0 THEN ['queue.json', 'queue.jsonl', 'articles_wikitext.jsonl', 'x.txt'][c_custkey % 4 + 1] ELSE 'x.txt' END AS name FROM customer"


def _paths(spark, sf_dir):
    k = F.col("c_custkey")
    names = F.get(F.array(*map(F.lit, ("queue.json", "queue.jsonl", "articles_wikitext.jsonl", "x.txt"))), (k % 4).cast("int"))
    name = F.when((k % 3 > 0) | (k % 15 == 0), names).otherwise("x.txt")
    return runs.files(table(spark, sf_dir, "customer"), F.concat(F.lit("root/a"), (k % 21).cast("string"), F.when(k % 15 == 0, F.concat(F.lit("/b"), (k % 2).cast("string"))).otherwise(""), F.lit("/"), name))


@query(f"""WITH f AS ({_PATHS}), r AS (SELECT dir FROM f GROUP BY dir HAVING bool_or(name IN ('queue.json', 'queue.jsonl')) AND bool_or(name = 'articles_wikitext.jsonl'))
    SELECT dir, replace(dir, '/', '__') AS safe FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE starts_with(r.dir, o.dir || '/'))""")
def run_dirs(spark, sf_dir):
    return runs.run_dirs(_paths(spark, sf_dir)).select("dir", tx.safe_run_name(F.concat(F.lit("/"), F.col("dir"), F.lit("/"))).alias("safe"))


def _supplier_meta(spark, sf_dir):
    k = F.col("s_suppkey")
    some = lambda n, c: F.when(k % n != 0, c)
    s = F.col("s_name")
    meta = F.to_json(F.struct(
        some(2, F.concat(F.lit(" "), s, F.lit(" "))).alias("seed"), F.struct(some(5, F.concat(F.lit("g"), k)).alias("global_model_key")).alias("cascading_defaults"),
        F.struct(F.concat(F.lit("a"), k).alias("model_key"), some(7, F.concat(F.lit("e"), k)).alias("elicit_model_key"), F.concat(F.lit("p"), k).alias("persona"), F.lit("arg topic").alias("topic")).alias("args_raw"),
        F.struct(some(4, F.lit("left")).alias("elicit")).alias("personas"),
    ))
    dir_ = F.concat(F.lit("/data/topic_runs/m"), k, F.lit("/old_o'neil_3d/"), s, F.lit("/run"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", dir_.alias("dir"), some(3, meta).alias("meta"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN CASE WHEN s_suppkey % 5 <> 0 THEN 'g' ELSE 'a' END ELSE 'm' END || s_suppkey AS model, CASE WHEN s_suppkey % 3 = 0 THEN 'Old O''Neil 3D' WHEN s_suppkey % 2 <> 0 THEN s_name ELSE '' END AS topic,
    CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 4 <> 0 THEN 'left' ELSE 'p' || s_suppkey END AS persona, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 7 <> 0 THEN 'e' || s_suppkey WHEN s_suppkey % 5 <> 0 THEN 'g' || s_suppkey ELSE 'a' || s_suppkey END AS model_key,
    CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 2 <> 0 THEN ' ' || s_name || ' ' ELSE 'arg topic' END AS funnel_topic FROM supplier""")
def run_facts(spark, sf_dir):
    r = _supplier_meta(spark, sf_dir).select("s_suppkey", runs.facts(F.col("dir"), F.col("meta")).alias("f"), runs.model_facts(F.col("meta")).alias("m"))
    return r.select("s_suppkey", "f.model", "f.topic", "f.persona", "m.model_key", F.col("m.topic").alias("funnel_topic"))


@query("""WITH d AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 0 THEN '/x/analysis/' WHEN s_suppkey % 10 = 1 THEN '/x/.hid/' ELSE '/x/' END || 'r' || s_suppkey AS dir FROM supplier WHERE s_suppkey % 3 <> 0)
    SELECT dir, CASE WHEN k % 5 <> 0 THEN 'g' ELSE 'a' END || k AS model, CASE WHEN k % 2 <> 0 THEN s_name ELSE 'unknown' END AS topic FROM d JOIN supplier ON k = s_suppkey WHERE k % 10 > 1""")
def analysed_runs(spark, sf_dir):
    k = F.col("s_suppkey")
    m = _supplier_meta(spark, sf_dir).filter("meta is not null").select(F.concat(F.when(k % 10 == 0, "/x/analysis/").when(k % 10 == 1, "/x/.hid/").otherwise("/x/"), F.lit("r"), k).alias("dir"), "meta")
    found = m.select("dir", F.explode(F.array(F.lit("articles.jsonl"), F.lit("run_meta.json"))).alias("name"))
    return runs.analysed(found, m, "eval.jsonl", "articles.jsonl").select("dir", "model", "topic")


def _part_meta(spark, sf_dir):
    k = F.col("p_partkey")
    some = lambda n, c: F.when(k % n != 0, c)
    meta = F.to_json(F.struct(
        F.struct(F.when(k % 2 == 0, "gpt-5-nano").when(k % 3 == 0, "gpt-5-mini").alias("global_model_key"), some(4, F.get(F.array(*map(F.lit, ("min", "low", "medium", "high", "odd"))), (k % 5).cast("int"))).alias("global_reasoning_effort")).alias("cascading_defaults"),
        F.struct(F.lit("other").alias("model_key"), (k % 2 == 0).alias("self_rag")).alias("args_raw"), F.when(k % 3 == 0, k % 7 == 0).alias("self_rag_enabled"), some(2, F.lit(" calibrated ")).alias("elicitation_strategy"),
        F.when(k % 3 == 0, F.col("p_retailprice")).alias("total_cost_usd"), F.when(k % 5 != 0, k % 4).alias("n_articles_written"), F.lit(0.25).alias("cost_per_article_usd"),
    ))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("dir"), runs.ablation(meta).alias("a")).select("dir", "a.*")


_ABLATION = """SELECT p_partkey::VARCHAR AS dir, CASE WHEN p_partkey % 2 = 0 THEN 'gpt-5-nano' WHEN p_partkey % 3 = 0 THEN 'gpt-5-mini' ELSE 'other' END AS model, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 7 = 0 ELSE p_partkey % 2 = 0 END AS self_rag,
    CASE WHEN p_partkey % 2 <> 0 THEN 'calibrated' ELSE 'baseline' END AS prompt, CASE WHEN p_partkey % 4 <> 0 THEN ['min', 'low', 'medium', 'high', 'odd'][p_partkey % 5 + 1] ELSE 'low' END AS effort,
    CASE WHEN p_partkey % 3 = 0 THEN p_retailprice / CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE greatest(p_partkey % 4, 1) END ELSE 0.25 END AS cost FROM part"""


@query(f"SELECT dir, model, self_rag, prompt, effort, round(cost, 6) AS cost, model || '/' || effort || '/' || prompt || CASE WHEN self_rag THEN '_selfrag' ELSE '_noselfrag' END AS display, CAST(count(*) AS BIGINT) AS n_subjects FROM ({_ABLATION}) JOIN lineitem ON dir = l_partkey::VARCHAR GROUP BY ALL")
def ablation_runs(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("dir"))
    return runs.ablation_runs(_part_meta(spark, sf_dir), a).select("dir", "model", "self_rag", "prompt", "effort", F.round("cost", 6).alias("cost"), "display", "n_subjects")


@query("""SELECT model, CAST(CASE model WHEN 'gpt-5-mini' THEN 0 WHEN 'gpt-5-nano' THEN 1 ELSE 99 END AS INT) AS model_place, prompt, CAST(CASE prompt WHEN 'baseline' THEN 0 WHEN 'calibrated' THEN 1 ELSE 99 END AS INT) AS prompt_place, effort,
    CAST(CASE effort WHEN 'min' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 99 END AS INT) AS effort_place, count(*) AS n FROM (""" + _ABLATION + ") GROUP BY ALL")
def ablation_order(spark, sf_dir):
    place = lambda c, order: runs.ranked(F.col(c), order).cast("int").alias(f"{c}_place")
    a = _part_meta(spark, sf_dir).groupBy("model", "prompt", "effort").agg(F.count("*").alias("n"))
    return a.select("model", place("model", runs.MODELS), "prompt", place("prompt", runs.PROMPTS), "effort", place("effort", runs.EFFORTS), "n")


@query("SELECT n_name AS dir, 'topic' AS category, count(s_suppkey) AS article_count FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey % 2 = 0 GROUP BY n_name")
def site_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("dir"))
    a = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("dir")
    return runs.site_rows(n.select("dir", F.lit("topic").alias("category")), a).select("dir", "category", "article_count")


def _images(spark, sf_dir):
    i = F.col("page_id")
    raw = F.when(i % 5 == 1, F.concat(F.lit('{"store_path":"s/'), i, F.lit('.png","source":"commons"}'))).when(i % 5 == 2, '{"image_url":"u"}').when(i % 5 == 3, F.concat(F.lit('"'), F.col("url"), F.lit('"'))).when(i % 5 == 4, '""')
    return table(spark, sf_dir, "pages").select((i % 3).alias("run"), i.alias("subject"), runs.image_entry(raw).alias("entry"))


@query("""SELECT page_id AS subject, CASE page_id % 5 WHEN 1 THEN 's/' || page_id || '.png' WHEN 3 THEN '' END AS store_path, CASE page_id % 5 WHEN 1 THEN '' WHEN 3 THEN url END AS image_url, CASE page_id % 5 WHEN 1 THEN 'commons' WHEN 3 THEN 'legacy' END AS source FROM pages""")
def image_entries(spark, sf_dir):
    return _images(spark, sf_dir).select("subject", "entry.store_path", "entry.image_url", "entry.source")


@query("""WITH i AS (SELECT page_id % 3 AS run, CASE page_id % 5 WHEN 1 THEN 'commons' WHEN 3 THEN 'legacy' END AS s FROM pages), c AS (SELECT run, s, count(*) AS n FROM i WHERE s IS NOT NULL GROUP BY ALL), t AS (SELECT run, string_agg(s || ':' || n, ', ' ORDER BY n DESC, s) AS sources FROM c GROUP BY run)
    SELECT run, count(*) AS total, count(s) AS found, count(*) - count(s) AS missing, round(100.0 * count(s) / count(*), 1) AS pct, sources FROM i JOIN t USING (run) GROUP BY run, sources""")
def image_coverage(spark, sf_dir):
    return runs.image_coverage(_images(spark, sf_dir))


@query("""WITH s AS (SELECT c_custkey AS subject, c_custkey % 4 AS run, c_custkey % 3 AS state FROM customer) SELECT run, subject, CASE WHEN state = 1 THEN 'old' ELSE 'new' END AS entry, CASE WHEN state = 0 THEN 'new' WHEN state = 1 THEN 'new' ELSE 'new' END AS forced FROM s""")
def image_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), (F.col("c_custkey") % 4).alias("run"))
    cache = c.filter("subject % 3 = 1").select("run", "subject", F.lit("old").alias("entry"))
    new = c.select("subject", F.lit("new").alias("entry"))
    forced = runs.merged_images(cache, new, c, force=True).withColumnRenamed("entry", "forced")
    return runs.merged_images(cache, new, c).join(forced, ["run", "subject"])


@query("""SELECT p_name AS name, min(p_partkey::VARCHAR) AS path FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 45) GROUP BY p_name""")
def missing_images(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return runs.missing_files(p.select(F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("path")), p.filter("p_size > 45").select(F.col("p_name").alias("name"))).select("name", "path")


# reports ----------------------------------------------------------------------------------------------------------------------------
_SIDES = """SELECT l_orderkey AS k, l_linestatus AS s, count(*) FILTER (l_returnflag = 'A') AS ok, count(*) FILTER (l_returnflag = 'R') AS no, count(*) FILTER (l_returnflag = 'N') AS un, count(*) AS n FROM lineitem GROUP BY ALL"""


@query(f"""WITH c AS ({_SIDES}), w AS (SELECT * FROM c WHERE s = 'F'), b AS (SELECT * FROM c WHERE s = 'O'), r AS (SELECT o_orderkey AS subject, w.ok AS wiki_n_supported, round(w.ok::DOUBLE / w.n, 9) AS true_rate_against_wiki, round(w.ok::DOUBLE / nullif(w.ok + w.no, 0), 9) AS accuracy_against_wiki, b.no AS web_n_refuted,
    round(b.un::DOUBLE / b.n, 9) AS unverifiable_rate_against_web, round(b.ok::DOUBLE / nullif(b.ok + b.no, 0), 9) AS accuracy_against_web, coalesce(o_orderstatus = 'O', false) AS is_frontier, b.no AS bn, b.n AS bt FROM orders LEFT JOIN w ON w.k = o_orderkey LEFT JOIN b ON b.k = o_orderkey)
    SELECT subject, wiki_n_supported, true_rate_against_wiki, accuracy_against_wiki, web_n_refuted, unverifiable_rate_against_web, accuracy_against_web, is_frontier, CASE WHEN is_frontier THEN coalesce(bn, 0) END AS frontier_web_n_refuted, CASE WHEN is_frontier THEN coalesce(round(bn::DOUBLE / bt, 9), 0) END AS frontier_web_false_rate,
    CASE WHEN is_frontier THEN accuracy_against_web END AS frontier_web_precision FROM r""")
def evaluated_records(spark, sf_dir):
    f = F.col("o_orderstatus")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("subject"), F.when(f != "P", f == "F").alias("wiki_subject_found"))
    flag = F.col("l_returnflag")
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), F.when(F.col("l_linestatus") == "F", "wiki").otherwise("web").alias("source"), F.when(flag == "A", "supported").when(flag == "R", "refuted").otherwise("insufficient").alias("verdict"))
    r = reports.records(o, c)
    return r.select("subject", "wiki_n_supported", *(F.round(x, 9).alias(x) for x in ("true_rate_against_wiki", "accuracy_against_wiki")), "web_n_refuted", *(F.round(x, 9).alias(x) for x in ("unverifiable_rate_against_web", "accuracy_against_web")), "is_frontier", "frontier_web_n_refuted", F.round("frontier_web_false_rate", 9).alias("frontier_web_false_rate"), F.round("frontier_web_precision", 9).alias("frontier_web_precision"))


_MEMBERS = "SELECT DISTINCT c_mktsegment AS topic, o_orderstatus AS model, o_orderpriority AS persona, o_custkey AS subject, l_partkey AS entity FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey"


def _members(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("persona"))
    c, l = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("topic")), table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("entity"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(l, F.col("o_orderkey") == F.col("l_orderkey")).select("topic", "model", "persona", F.col("o_custkey").alias("subject"), "entity")


@query(f"""WITH r AS ({RECORDS_SQL}), e AS (SELECT topic, seed AS model, model AS persona, avg(CASE WHEN found THEN accuracy END) AS p, avg(false_rate) AS h FROM r GROUP BY ALL), m AS (SELECT DISTINCT topic, CAST(subject % 3 AS BIGINT) AS model, persona, subject, entity FROM ({_MEMBERS})), k AS (SELECT DISTINCT topic, model, persona, subject FROM m), s AS (
    SELECT a.topic, a.model, a.persona AS p1, b.persona AS p2, a.subject FROM k a JOIN k b ON a.topic = b.topic AND a.model = b.model AND a.subject = b.subject AND a.persona < b.persona), n AS (SELECT topic, model, p1, p2, count(*) AS common FROM s GROUP BY ALL), x AS (
    SELECT s.topic, s.model, p1, p2, entity, bool_or(persona = p1) AS i1, bool_or(persona = p2) AS i2 FROM s JOIN m ON m.topic = s.topic AND m.model = s.model AND m.subject = s.subject AND m.persona IN (p1, p2) GROUP BY ALL), c AS (SELECT topic, model, p1, p2, count(*) FILTER (i1) AS e1, count(*) FILTER (i2) AS e2, count(*) FILTER (i1 AND i2) AS sh FROM x GROUP BY ALL)
    SELECT a.topic, a.model, a.persona AS persona_1, b.persona AS persona_2, round(a.p, 9) AS precision_1, round(a.p - b.p, 9) AS precision_delta, round(a.h, 9) AS hallucination_1, coalesce(common, 0) AS common_subjects, coalesce(e1, 0) AS entities_1, coalesce(sh, 0) AS shared_entities,
    round(CASE WHEN coalesce(e1 + e2 - sh, 0) > 0 THEN sh::DOUBLE / (e1 + e2 - sh) ELSE 1 END, 9) AS jaccard, round(coalesce(sh::DOUBLE / nullif(least(e1, e2), 0), 0), 9) AS overlap
    FROM e a JOIN e b ON a.topic = b.topic AND a.model = b.model AND a.persona < b.persona LEFT JOIN n ON n.topic = a.topic AND n.model = a.model AND n.p1 = a.persona AND n.p2 = b.persona LEFT JOIN c ON c.topic = a.topic AND c.model = a.model AND c.p1 = a.persona AND c.p2 = b.persona""")
def persona_effect(spark, sf_dir):
    e = records(spark, sf_dir).select("topic", F.col("seed").alias("model"), F.col("model").alias("persona"), "found", "accuracy", "false_rate")
    r = reports.persona_effect(e, _members(spark, sf_dir).withColumn("model", F.col("subject") % 3))
    r = r.select("topic", "model", "persona_1", "persona_2", "precision_1", "precision_delta", "hallucination_1", "common_subjects", "entities_1", "shared_entities", "jaccard", "overlap")
    return rounded(r, "topic", "model", "persona_1", "persona_2")


@query(f"""SELECT topic, model, count(*) AS n_evaluated, count(*) FILTER (found) AS n_found, count(*) FILTER (NOT found) AS n_not_found, round((count(*) FILTER (found))::DOUBLE / count(*), 9) AS coverage, round(avg(CASE WHEN found THEN accuracy END), 9) AS precision, round(stddev_samp(CASE WHEN found THEN accuracy END), 9) AS precision_std,
    round(avg(CASE WHEN found THEN false_rate END), 9) AS hallucination_rate, round(avg(CASE WHEN found THEN unverifiable_rate END), 9) AS unverifiable_rate FROM ({RECORDS_SQL}) GROUP BY topic, model""")
def paper_topic_table(spark, sf_dir):
    t = reports.topic_table(records(spark, sf_dir))
    return rounded(t.select("topic", "model", "n_evaluated", "n_found", "n_not_found", "coverage", "precision", "precision_std", "hallucination_rate", "unverifiable_rate"), "topic", "model")


@query(f"SELECT topic, model, round(avg(n), 9) AS mean_raw_entities, round(stddev_samp(n), 9) AS std_raw_entities FROM (SELECT topic, model, subject, count(DISTINCT entity) AS n FROM ({_MEMBERS}) GROUP BY ALL) GROUP BY topic, model")
def paper_entity_table(spark, sf_dir):
    n = _members(spark, sf_dir).groupBy("topic", "model", "subject").agg(F.countDistinct("entity").alias("n_links"))
    return rounded(reports.entity_table(n), "topic", "model")


@query(f"""WITH m AS (SELECT DISTINCT topic, model, subject FROM ({_MEMBERS})), n AS (SELECT topic, model, count(*) AS n FROM m GROUP BY ALL), s AS (SELECT a.topic, a.model AS m1, b.model AS m2, count(*) AS n FROM m a JOIN m b USING (topic, subject) WHERE a.model < b.model GROUP BY ALL)
    SELECT a.topic, a.model AS model_1, b.model AS model_2, a.n AS size_a, b.n AS size_b, coalesce(s.n, 0) AS shared, a.n - coalesce(s.n, 0) AS only_1, b.n - coalesce(s.n, 0) AS only_2, round(coalesce(s.n, 0)::DOUBLE / (a.n + b.n - coalesce(s.n, 0)), 9) AS jaccard FROM n a JOIN n b ON a.topic = b.topic AND a.model < b.model LEFT JOIN s ON s.topic = a.topic AND m1 = a.model AND m2 = b.model""")
def paper_subject_overlap(spark, sf_dir):
    return rounded(reports.subject_overlap(_members(spark, sf_dir).select("topic", "model", "subject").distinct()), "topic", "model_1", "model_2")


@query(f"""WITH d AS (SELECT lang, doc_id % 5 AS hop, {TOKENS} AS w, text FROM documents), a AS (SELECT lang, hop, array_to_string(w[1:3], ' ') AS subject, list_filter(w, lambda x: x LIKE 'c%') AS l, list_filter(w, lambda x: len(x) >= 10) AS c, len(string_split(text, chr(10))) AS sections, len(w) AS words FROM d), u AS (
    SELECT lang, count(DISTINCT x) AS unique_links, count(DISTINCT {KEY.format('x')}) AS unique_canonical_links FROM (SELECT lang, unnest(l) AS x FROM a) GROUP BY lang), v AS (SELECT lang, count(DISTINCT x) AS unique_categories FROM (SELECT lang, unnest(c) AS x FROM a) GROUP BY lang)
    SELECT lang, count(*) AS n_articles, CAST(sum(len(l)) AS BIGINT) AS total_links, unique_links, unique_canonical_links, unique_categories, round(avg(len(l)), 6) AS mean_links, round(stddev_samp(len(l)), 6) AS std_links, median(len(l)::DOUBLE) AS median_links, round(avg(sections), 6) AS mean_sections, round(avg(words), 6) AS mean_words, median(words::DOUBLE) AS median_words,
    count(*) FILTER (hop = 0) AS n_hop_0, count(*) FILTER (hop = 2) AS n_hop_2, count(*) FILTER (hop >= 3) AS n_hop_3plus, round(avg(hop), 6) AS mean_hop, CAST(max(hop) AS INT) AS max_hop, count(DISTINCT nullif(lower(string_split(subject, ' ')[1]), '')) AS n_prefixes, round(unique_links::DOUBLE / sum(len(l)), 6) AS entity_ttr
    FROM a JOIN u USING (lang) JOIN v USING (lang) GROUP BY lang, unique_links, unique_canonical_links, unique_categories""")
def breadth_stats(spark, sf_dir):
    a = articles(spark, sf_dir)
    a = a.select("lang", "subject", (F.col("doc_id") % 5).cast("int").alias("hop"), F.filter("w", lambda x: x.startswith("c")).alias("links"), F.filter("w", lambda x: F.length(x) >= 10).alias("categories"), F.size(F.split("text", "\n")).alias("sections"), F.size("w").alias("words"))
    b = reports.breadth(a, "lang")
    six = lambda c: F.round(c, 6).alias(c)
    return b.select("lang", "n_articles", "total_links", "unique_links", "unique_canonical_links", "unique_categories", six("mean_links"), six("std_links"), "median_links", six("mean_sections"), six("mean_words"), "median_words", "n_hop_0", "n_hop_2", "n_hop_3plus", six("mean_hop"), "max_hop", "n_prefixes", six("entity_ttr"))


def _measured(spark, sf_dir, names):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_mktsegment").alias("run"), k.alias("k"), *(F.when(k % (i + 2) != 0, F.col("c_acctbal") / (i + 1)).alias(m) for i, m in enumerate(names)))


_SPREAD = lambda names, med: ", ".join(f"round(avg({e}), 6) AS mean_{m}, round(stddev_samp({e}), 6) AS std_{m}" + (f", round(median({e}), 6) AS median_{m}" if med else "") for i, m in enumerate(names) for e in [f"CASE WHEN c_custkey % {i + 2} <> 0 THEN c_acctbal / {i + 1} END"])


@query(f"SELECT c_mktsegment AS run, count(*) FILTER (c_custkey % 4 <> 0) AS n_articles_with_style, {_SPREAD(reports.STYLE, False)} FROM customer GROUP BY c_mktsegment")
def style_report(spark, sf_dir):
    s = reports.spread(_measured(spark, sf_dir, reports.STYLE), ["run"], reports.STYLE, "ttr_candidate", "n_articles_with_style")
    return s.select("run", "n_articles_with_style", *(F.round(c, 6).alias(c) for c in s.columns[2:]))


@query(f"SELECT c_mktsegment AS run, count(*) FILTER (c_custkey % 3 <> 0) AS n_articles_with_ngram, {_SPREAD(reports.TEXT, True)} FROM customer GROUP BY c_mktsegment")
def text_report(spark, sf_dir):
    s = reports.spread(_measured(spark, sf_dir, reports.TEXT), ["run"], reports.TEXT, "ngram_1_overlap", "n_articles_with_ngram", True)
    return s.select("run", "n_articles_with_ngram", *(F.round(c, 6).alias(c) for c in s.columns[2:]))


_RATES = ("true_rate", "false_rate", "unverifiable_rate")


@query(f"""WITH r AS (SELECT *, topic AS dir FROM ({RECORDS_SQL}) WHERE topic <> 'BUILDING'), s AS (SELECT dir, seed, avg(CASE WHEN found THEN accuracy END) AS p, {', '.join(f'avg(CASE WHEN found THEN {x} END) AS {x}' for x in _RATES)} FROM r GROUP BY ALL), o AS (
    SELECT dir, avg(p) AS p, stddev_samp(p) AS sd, {', '.join(f'avg(CASE WHEN p IS NOT NULL THEN {x} END) AS {x}' for x in _RATES)} FROM s GROUP BY dir), w AS (SELECT dir, count(*) AS n, count(*) FILTER (found) AS f, avg(n_claims) AS sem FROM r GROUP BY dir), d AS (SELECT DISTINCT c_mktsegment AS dir FROM customer)
    SELECT dir, CAST(CASE WHEN n IS NULL THEN 0 ELSE 7 END AS INT) AS n_subjects, CAST(CASE WHEN n IS NULL THEN 0 ELSE 300 END AS INT) AS n_attempted, coalesce(n, 0) AS n_returned, coalesce(f, 0) AS n_found, round(f::DOUBLE / n, 9) AS coverage, round(p, 9) AS wiki_precision, round(sd, 9) AS wiki_precision_std, {', '.join(f'round({x}, 9) AS wiki_{x}' for x in _RATES)}, round(sem, 6) AS sim_semantic,
    CASE WHEN n IS NOT NULL THEN 25000.0::DOUBLE END AS cost_at_1m FROM d LEFT JOIN w USING (dir) LEFT JOIN o USING (dir)""")
def ablation_table(spark, sf_dir):
    """One run has no records."""
    r = records(spark, sf_dir).filter("topic <> 'BUILDING'")
    e = r.select(F.col("topic").alias("dir"), "seed", "found", *(F.col(x).alias(f"{x}_{s}") for s in ("wiki", "web") for x in ("accuracy", *_RATES)), F.col("n_claims").cast("double").alias("sim_semantic"), F.col("n_claims").cast("double").alias("sim_combined"))
    d = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("dir")).distinct().withColumns({"cost": F.lit(0.025), "n_subjects": F.lit(7)})
    t = reports.ablation_table(d, e, 100, 3)
    nine = lambda c: F.round(c, 9).alias(c)
    return t.select("dir", "n_subjects", "n_attempted", "n_returned", "n_found", nine("coverage"), nine("wiki_precision"), nine("wiki_precision_std"), *(nine(f"wiki_{x}") for x in _RATES), F.round("sim_semantic", 6).alias("sim_semantic"), "cost_at_1m")


@query(r"""WITH b AS (SELECT c_mktsegment AS topic, n_name AS name, round(max(c_acctbal), 2) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT topic, name, replace(topic, '_', '\_') || ' & ' || replace(name, '_', '\_') || ' & ' || CASE WHEN score = max(score) OVER (PARTITION BY topic) THEN '\textbf{' || printf('%.3f', score) || '}' ELSE printf('%.3f', score) END || ' \\' AS line FROM b""")
def latex_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    b = c.groupBy(F.col("c_mktsegment").alias("topic"), F.col("n_name").alias("name")).agg(F.round(F.max("c_acctbal"), 2).alias("score"))
    return reports.latex(b, "topic", ["topic", "name", "score"], "score").select("topic", "name", "line")


@query(f"""WITH l AS (SELECT doc_id, quality = 1 AS found FROM labels), d AS (SELECT doc_id, {TOKENS} AS w, n_chars FROM documents), r AS (SELECT doc_id, coalesce(found, false) AS f, CASE WHEN found AND len(w) > 0 THEN n_chars::DOUBLE END AS jaccard, len(w) AS n, doc_id % 4 AS tag FROM d LEFT JOIN l USING (doc_id))
    SELECT tag, count(*) AS n_subjects, round((count(*) FILTER (f))::DOUBLE / count(*), 9) AS wiki_coverage, round(avg(jaccard), 6) AS llm_mean_jaccard, round(stddev_samp(jaccard), 6) AS llm_std_jaccard, round(avg(CASE WHEN n > 0 THEN n END), 6) AS llm_mean_word_count, median(CASE WHEN n > 0 THEN n::DOUBLE END) AS llm_median_word_count FROM r GROUP BY tag""")
def capture_table(spark, sf_dir):
    w = tx.tokens(F.col("text"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("subject"), w.alias("words"), "n_chars")
    p = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("subject"), (F.col("quality") == 1).alias("found"), F.array(F.lit("x")).alias("page_words"))
    p = p.join(d.select("subject", F.col("n_chars").cast("double").alias("jaccard")), "subject")
    r = reports.capture_record(d.drop("n_chars"), p, ["jaccard"], F.col("jaccard"))
    rows = r.select((F.col("subject") % 4).alias("tag"), F.col("found").alias("wiki_found"), F.col("combined_similarity").alias("llm_jaccard"), F.size("words").alias("llm_word_count"))
    t = reports.capture_table(rows, "tag", ["llm"], ["jaccard"])
    return t.select("tag", "n_subjects", F.round("wiki_coverage", 9).alias("wiki_coverage"), *(F.round(c, 6).alias(c) for c in ("llm_mean_jaccard", "llm_std_jaccard", "llm_mean_word_count")), "llm_median_word_count")


@query("""WITH c AS (SELECT l_orderkey AS subject, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS i, l_partkey, l_suppkey, l_returnflag AS f FROM lineitem)
    SELECT subject, CAST(i AS INT) AS claim_idx, 'part ' || l_partkey AS claim, CASE f WHEN 'A' THEN 'true' ELSE 'false' END AS verdict, 'u' || l_partkey || '|u' || l_suppkey AS cited_source_urls FROM c WHERE f <> 'N'""")
def legacy_claims(spark, sf_dir):
    f = F.col("l_returnflag")
    c = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    claim = lambda x: F.struct(F.concat(F.lit("part "), x.l_partkey).alias("claim"), F.when(x.l_returnflag == "A", "true").when(x.l_returnflag == "R", "false").otherwise("open").alias("verdict"), F.lit(0.5).alias("confidence"), F.array(F.concat(F.lit("u"), x.l_partkey), F.lit(""), F.concat(F.lit("u"), x.l_suppkey)).alias("urls"))
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("subject")).agg(F.sort_array(F.collect_list(c)).alias("c")).select("subject", F.lit("ours").alias("candidate"), F.transform("c", claim).alias("claims"))
    return reports.legacy_claim_rows(r).select("subject", "claim_idx", "claim", "verdict", "cited_source_urls")


@query("""WITH t AS (SELECT n_name AS subject, c AS candidate, b AS baseline, n_nationkey AS k FROM nation, (VALUES ('a'), ('b')) x(c), (VALUES ('wiki'), ('web')) y(b)) SELECT subject, candidate, baseline, baseline = 'wiki' AND k % 2 = 0 AS baseline_found, CASE WHEN baseline = 'wiki' THEN 'https://A.org/1,https://b.net/2,https://a.org/3' ELSE '' END AS urls, CASE WHEN baseline = 'wiki' THEN 'a.org,b.net' ELSE '' END AS domains, CASE WHEN candidate = 'a' THEN 3 END AS claims FROM t""")
def legacy_records(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("subject"), "n_nationkey")
    urls = F.array(*map(F.lit, ("https://A.org/1", "", "https://b.net/2", "https://a.org/3")))
    base = n.select("subject", F.lit("wiki").alias("baseline"), (F.col("n_nationkey") % 2 == 0).alias("found"), urls.alias("urls"))
    checks = n.select("subject", F.lit("a").alias("candidate"), F.explode(F.array(F.lit("wiki"), F.lit("web"))).alias("baseline"), F.lit(3).alias("claims"))
    r = reports.legacy_records(an.task_matrix(n.select("subject"), ["a", "b"], ["wiki", "web"]), base, checks)
    return r.select("subject", "candidate", "baseline", "baseline_found", F.array_join("baseline_source_urls", ",").alias("urls"), F.array_join("baseline_source_domains", ",").alias("domains"), "claims")


@query("""WITH c AS (SELECT conv_id, turn, trim(coalesce(role, '')) AS r, trim(coalesce(text, '')) AS t FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, r, t) AS k FROM c), g AS (SELECT conv_id, string_agg('- S' || conv_id || ' — ' || r || ' — ' || t || CASE WHEN turn % 2 = 0 THEN ' (c=0.50)' ELSE '' END, chr(10) ORDER BY k) FILTER (k <= 16 AND r <> '' AND t <> '') AS x FROM f GROUP BY conv_id)
    SELECT conv_id, md5('SELF-RAG CONTEXT (grounding; use to stay factual; do not quote verbatim):' || chr(10) || 'Summary: short' || chr(10) || 'Aliases: ' || CASE WHEN conv_id % 2 = 0 THEN 'A, b' ELSE '(none)' END || chr(10) || 'Salient facts:' || chr(10) || coalesce(x, '(none)')) AS digest FROM g""")
def grounding_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.coalesce("role", F.lit(""))).alias("predicate"), F.trim(F.coalesce("text", F.lit(""))).alias("object"), F.when(F.col("turn") % 2 == 0, 0.5).alias("confidence"))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "predicate", "object", "confidence"))).alias("f"))
    facts = F.transform("f", lambda x: F.struct(x.predicate.alias("predicate"), x.object.alias("object"), x.confidence.alias("confidence")))
    context = F.struct(F.lit(" short ").alias("summary"), F.when(F.col("conv_id") % 2 == 0, F.array(F.lit(" A"), F.lit("b "))).alias("aliases"), facts.alias("salient_facts"))
    return g.select("conv_id", context.alias("c")).select("conv_id", F.md5(reports.grounding(F.concat(F.lit("S"), F.col("conv_id").cast("string")), F.col("c"))).alias("digest"))


@query("SELECT event_id, user_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 25 AS INT) AS chunk, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 25 * 25 AS INT) AS start FROM events")
def call_chunks(spark, sf_dir):
    return reports.chunked(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], "event_id").select("event_id", "user_id", "chunk", "start")


@query("SELECT c_nationkey AS k, CASE WHEN count(*) < 50 THEN 0 ELSE least(greatest(CAST(floor(count(*) * 0.3) AS BIGINT), 50), 60, count(*)) END AS n FROM customer GROUP BY 1")
def sample_sizes(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("c"))
    return n.select("k", reports.bounded_sample_size(F.col("c"), 0.3, 50, 60).alias("n"))


# recorded answers -------------------------------------------------------------------------------------------------------------------
_STEMS = "SELECT l_orderkey AS k, l_linenumber AS idx, max(l_returnflag) AS f FROM lineitem GROUP BY ALL"


@query(f"""WITH v AS ({_STEMS}), n AS (SELECT k, unnest(range(1, 8)) AS idx FROM (SELECT DISTINCT k FROM v)) SELECT n.k, CAST(n.idx - 1 AS INT) AS idx, CASE f WHEN 'A' THEN 'supported' WHEN 'R' THEN 'refuted' ELSE 'insufficient' END AS verdict, CASE WHEN f IS NULL THEN 0.0 WHEN f = 'N' THEN NULL ELSE 0.5 END::DOUBLE AS confidence FROM n LEFT JOIN v ON v.k = n.k AND v.idx = n.idx""")
def verdict_answers(spark, sf_dir):
    """Line items as the verdicts of an answer, with a fence and a comma too many; of repeated numbers the last counts."""
    f = F.col("l_returnflag")
    l = salvage.dealt(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", f.alias("f")), "k", each=4)
    word = lambda x: F.when(x.f == "A", "True").when(x.f == "R", " contradicted ").otherwise("who knows")
    one = lambda x: F.concat(F.lit('{"idx": "'), x.l_linenumber, F.lit('", "verdict": "'), word(x), F.lit('", "confidence": '), F.when(x.f == "N", "null").otherwise("0.5"), F.lit("},"))
    a = l.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "f"))).alias("v")).select("k", F.concat(F.lit('```json\n{"verdicts": ['), F.array_join(F.transform("v", one), " "), F.lit("]}\n```")).alias("a"))
    v = a.withColumn("v", salvage.verdict_list("a", F.lit(7)))
    return v.select("k", F.posexplode("v").alias("idx", "x")).select("k", "idx", "x.verdict", "x.confidence")


@query("""SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '{"claims": ["' || p_name || '", "' || p_brand || ' is"]}' WHEN 1 THEN '{"claims": ["' || p_name || '", "' || p_brand || ' is"]}' WHEN 2 THEN '{"claims": ["' || p_name || '"]}' ELSE '{"size": ' || p_size || '}' END AS object FROM part""")
def cut_answers(spark, sf_dir):
    """Answers cut inside a string, behind a key, inside a number; whole ones in talk."""
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat(F.lit('Here: {"claims": ["'), F.col("p_name"), F.lit('", "'), F.col("p_brand"), F.lit(' is"],} So.'))).when(k % 4 == 1, F.concat(F.lit('{"claims": ["'), F.col("p_name"), F.lit('", "'), F.col("p_brand"), F.lit(" is"))).when(
        k % 4 == 2, F.concat(F.lit('```{"claims": ["'), F.col("p_name"), F.lit('"], "more": '))).otherwise(F.concat(F.lit("{“size”: "), F.col("p_size"), F.lit(", ")))
    p = salvage.dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"))
    return p.select(k.alias("k"), salvage.salvaged(text).alias("object"))


_NER_MODE = "['dict', 'dict_nested', 'json', 'json_substring', 'regex_jsonish', 'regex_simple', 'empty'][p_partkey % 7 + 1]"


@query(f"""SELECT p_partkey AS k, {_NER_MODE} AS mode, CASE WHEN p_partkey % 7 < 6 THEN p_name END AS phrase, CASE WHEN p_partkey % 7 < 6 THEN p_size > 25 END AS is_ne, CASE WHEN p_partkey % 7 < 4 THEN 0.25::DOUBLE WHEN p_partkey % 7 < 6 THEN NULL END AS confidence, CASE WHEN p_partkey % 7 < 4 THEN 0.25::DOUBLE WHEN p_partkey % 7 < 6 THEN 0.9 END AS calibrated FROM part""")
def ner_answers(spark, sf_dir):
    """One decision in each of the six readings."""
    k, name, yes = F.col("p_partkey"), F.col("p_name"), F.when(F.col("p_size") > 25, "true").otherwise("false")
    whole = F.concat(F.lit('{"phrases": [{"phrase": " '), name, F.lit('", "is_ne": '), yes, F.lit(', "confidence": 0.25}]}'))
    broken = F.concat(F.lit('{"phrases": [{"phrase": "'), name, F.lit('", "is_ne": '), yes, F.lit(', "conf'))
    text = F.when(k % 7 == 0, whole).when(k % 7 == 1, F.concat(F.lit('{"data": ['), whole, F.lit("]}"))).when(k % 7 == 2, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(k % 7 == 3, F.concat(F.lit("Sure. "), whole, F.lit(" ok"))).when(k % 7 == 4, broken).when(k % 7 == 5, F.concat(F.lit("- "), name, F.lit(": "), yes)).otherwise(F.lit("none"))
    p = salvage.dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))
    p = p.select(k.alias("k"), salvage.recorded_decisions(text, k % 7 < 2).alias("p"))
    p = p.withColumn("c", salvage.calibrated(F.col("p.rows")))
    return p.select("k", F.col("p.mode").alias("mode"), F.explode_outer(F.arrays_zip(F.col("p.rows").alias("r"), F.col("c").alias("c"))).alias("x")).select("k", "mode", "x.r.phrase", "x.r.is_ne", "x.r.confidence", F.col("x.c.confidence").alias("calibrated"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 5 THEN 'plain ' || p_name ELSE p_name END AS text FROM part")
def response_texts(spark, sf_dir):
    """Six shapes of a provider's response."""
    k, t = F.col("p_partkey"), F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))
    shape = lambda a, b: F.concat(F.lit(a), t, F.lit(b))
    body = F.when(k % 6 == 0, shape('{"choices": [{"message": {"content": ', "}}]}")).when(k % 6 == 1, shape('{"output": [{"type": "x", "content": [{"text": ', "}]}]}")).when(k % 6 == 2, shape('{"result": {"answer": ', "}}")).when(
        k % 6 == 3, shape('{"choices": [{"text": ', "}]}")).when(k % 6 == 4, shape('{"id": "a name longer than the text of all parts", "deep": [{"er": ', "}]}")).otherwise(F.concat(F.lit("plain "), F.col("p_name")))
    return table(spark, sf_dir, "part").select(k.alias("k"), salvage.unwrapped(body).alias("text"))


@query("""SELECT o_custkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS place, 'S' || o_orderkey AS subject, CAST(o_orderkey % 5 AS INT) AS hop FROM orders""")
def nested_subjects(spark, sf_dir):
    """Subjects at any depth of a document; objects without a hop do not count."""
    one = lambda x: F.concat(F.lit('{"x": {"subject": "S'), x, F.lit('", "hop": "'), x % 5, F.lit('"}, "subject": "no hop"}'))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("o"))
    return o.select("k", F.posexplode(salvage.subject_hops(F.concat(F.lit('{"queue": [['), F.array_join(F.transform("o", one), ", "), F.lit("]]}")))).alias("place", "x")).select("k", "place", "x.subject", "x.hop")


@query("""SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN '{"a": "}"}' WHEN 1 THEN '[1, 2]' ELSE '{}' END AS found, CASE s_suppkey % 3 WHEN 0 THEN s_name || ',x' WHEN 1 THEN s_name ELSE '' END AS keys FROM supplier""")
def balanced_answers(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, 'see {"a": "}"} or [1]').when(k % 3 == 1, "p [1, 2] {bad}").otherwise("{ no end")
    cut = F.when(k % 3 == 0, F.concat(F.lit('{"keys": ["'), F.col("s_name"), F.lit('", "x'))).when(k % 3 == 1, F.concat(F.lit('["'), F.col("s_name"), F.lit('", '))).otherwise("nothing")
    return table(spark, sf_dir, "supplier").select(k.alias("k"), salvage.balanced_json(text).alias("found"), F.array_join(salvage.key_list(cut), ",").alias("keys"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'S::' || o_orderkey END AS subject, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 4 AS INT) END AS hop, CASE WHEN o_orderkey % 2 = 0 THEN 7 END AS chunk, CASE WHEN o_orderkey % 2 = 0 THEN 175 END AS start, CASE WHEN o_orderkey % 2 = 0 THEN 25 END AS n, CASE o_orderkey % 3 WHEN 0 THEN 30.5 ELSE 8.0 END::DOUBLE AS wait,
    CASE o_orderkey % 3 WHEN 1 THEN 5 ELSE 0 END::BIGINT AS input_tokens FROM orders""")
def request_names(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("ner::S::"), k, F.when(k % 2 == 0, F.concat(F.lit("::hop="), k % 4, F.lit("::chunk=7::start=175::n=25"))).otherwise("::x"))
    said = F.when(k % 3 == 0, "429: Limit resets at: 2026-01-01 10:00:30 UTC").when(k % 3 == 1, "Limit resets at: 2026-01-01 12:00:00").otherwise("in 2s")
    body = F.when(k % 3 == 0, '{"usage": {}}').when(k % 3 == 1, '{"usage": {"input_tokens": 0, "prompt_tokens": 5}}')
    o = table(spark, sf_dir, "orders").select(k.alias("k"), logs.custom_id(name).alias("c"), tx.wait_seconds(said, F.lit("2026-01-01 10:00:00").cast("timestamp")).alias("wait"), logs.usage(body).input_tokens.alias("input_tokens"))
    return o.select("k", "c.*", "wait", "input_tokens")


# texts ------------------------------------------------------------------------------------------------------------------------------
@query(f"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || '_x–Y ')
    , '[_\\-\\x{{2010}}-\\x{{2014}}\\x{{2212}}]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS funnel_key, replace({KEY.format('p_name')}, ' ', '_')[1:60] || '_h' || (p_size % 7) || '_' || sha1(p_name || '␞' || (p_size % 7))[1:12] AS item_key,
    CASE WHEN len(p_name) > 9 THEN rtrim(p_name[1:9]) || '…' ELSE p_name END AS clipped, true AS ok, p_size % 5 = 0 AS refusal, coalesce(TRY_CAST(CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE 'x' END AS INT), -1) AS number FROM part""")
def text_forms(spark, sf_dir):
    n, s = F.col("p_name"), F.col("p_size")
    a = tx.alternates(F.concat(n, F.lit(" (x), y")))
    refusal = F.when(s % 10 == 0, " ").when(s % 5 == 0, "Sorry: UNABLE to generate an article").otherwise(n)
    return table(spark, sf_dir, "part").select(
        "p_partkey", tx.funnel_key(F.concat(n, F.lit("_x–Y "))).alias("funnel_key"), tx.item_key(n, s % 7).alias("item_key"), tx.clip(n, 9).alias("clipped"), (F.size(a) == 3).alias("ok"), tx.is_refusal(refusal).alias("refusal"),
        tx.as_int(F.when(s % 2 == 0, s.cast("string")).otherwise("x"), -1).alias("number"),
    )


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS subject, CASE WHEN c_custkey % 3 = 0 THEN 'title' WHEN c_custkey % 3 = 1 THEN 'topic' END AS field FROM customer""")
def subject_fields(spark, sf_dir):
    k = F.col("c_custkey")
    told = tx.first_subject({"title": F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("c_name"))).when(k % 3 == 1, "  "), "topic": F.when(k % 3 < 2, F.concat(F.col("c_mktsegment"), F.lit("\t")))})
    return table(spark, sf_dir, "customer").select(k.alias("k"), told.alias("t")).select("k", "t.subject", "t.field")


@query("""SELECT p_partkey, 'Intro [[T' || p_partkey || '|the ' || p_name || ']] (0.97) {{x|{{y|{{z}}}}}}''''''bold'''''' <ref name="a">gone</ref>text [https://a.b/c label] <b>q</b> &quot;e&amp;' AS bare, 'Intro the ' || p_name || ' (0.97) bold text label q &quot;e&amp;' AS snippet, 'Intro the' AS excerpt, 'T' || p_partkey AS link,
    'Intro the ' || p_name || ': q "e&' AS untagged FROM part""")
def wikitext_forms(spark, sf_dir):
    n, k = F.col("p_name"), F.col("p_partkey")
    x = F.concat(F.lit("{{Infobox a|b={{c|d}}}} Intro [[T"), k, F.lit("|the "), n, F.lit("]] (0.97) {{x|{{y|{{z}}}}}}'''bold''' <ref name=\"a\">gone</ref>text [https://a.b/c label] <b>q</b> &quot;e&amp;"))
    p = table(spark, sf_dir, "part").select(k.alias("p_partkey"), n.alias("n"), x.alias("x"))
    untagged = wk.without_tags(F.concat(F.lit("<p>Intro the "), F.col("n"), F.lit(":</p> <b class='x'>q</b> &quot;e&amp;")))
    return p.select("p_partkey", salvage.without_infobox("x").alias("bare"), wk.snippet(F.col("x"), 400).alias("snippet"), wk.excerpt(F.col("x"), 2).alias("excerpt"), F.regexp_extract(wk.clean_for_evaluation(F.col("x")), r"Intro (\S+)", 1).alias("link"), untagged.alias("untagged"))


@query("""SELECT p_partkey, 'Lead the ' || p_name || ' label item one more text' AS plain, '[[ok]] ' || p_name || ' x]' AS balanced FROM part""")
def fallback_texts(spark, sf_dir):
    n = F.col("p_name")
    x = F.concat(F.lit("{{a|{{b}}}}Lead [[T|the "), n, F.lit("]]  [https://a.b label] https://c.d/e \n* item one\n== Title ==\n# more text {{c}}\n"))
    open_ = F.concat(F.lit("[[ok]] [["), n, F.lit(" x]"))
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(wk.fallback_text(x), r"\s+", " ").alias("plain"), salvage.balanced_links(open_).alias("balanced"))


@query(r"""WITH t AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM pages), u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' ') AS x FROM t)
    SELECT page_id, len(trim(x)) >= 300 AND NOT regexp_matches(left(x, 4000), '(?i)\b(page not found|not found|does not exist|no article|search results|create this page|captcha|access denied|403 forbidden|cloudflare|enable javascript|too many requests|rate limit)\b') AND contains(lower(x), 'the') AND len(list_distinct(list_filter(string_split_regex(lower(x), '[^\p{L}\p{N}_]+'), lambda w: w <> ''))) >= 80 AS real FROM u""")
def real_pages(spark, sf_dir):
    t = wk.html_text(F.col("html"))
    p = table(spark, sf_dir, "pages").select("page_id", t.alias("x"))
    return p.select("page_id", ev.looks_real(F.lit(" The "), F.lit(""), F.col("x"), tx.tokens(F.col("x"))).alias("real"))


@query(r"""SELECT page_id FROM pages WHERE NOT (html <> '' AND (regexp_matches(left(html, 2000), '(?is)""" + "|".join(ev.BLOCKED_TEXT).replace("'", "''") + r"""') OR (length(trim(html)) < 200 AND len(regexp_extract_all(html, '[.!?]\s')) < 2)))""")
def purged_pages(spark, sf_dir):
    return ev.purged(table(spark, sf_dir, "pages"), "html").select("page_id")


@query("""WITH RECURSIVE r AS (SELECT c_custkey AS s, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey // 2 * 2 + 5 END AS t FROM customer), w AS (SELECT c_custkey AS title, c_custkey AS here, 0 AS d FROM customer UNION ALL SELECT title, coalesce(t, here), d + 1 FROM w LEFT JOIN r ON s = here WHERE d < 5) SELECT title, here AS target FROM w WHERE d = 5""")
def redirects(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    r = c.filter("c_custkey % 5 <> 0").select(k.alias("source"), (F.floor(k / 2) * 2 + 5).alias("target"))
    return ev.redirected(c.select(k.alias("title")), r)


@query(f"""{_PAIRS_SQL}, s AS (SELECT doc_id, text, text_b, w, v, [{', '.join(f"'{x}'" for x in FUNCTION_WORDS)}] AS fw FROM p), c AS (SELECT doc_id, w, v, text, text_b, list_transform(fw, lambda f: len(list_filter(w, lambda x: x = f))::DOUBLE) AS a, list_transform(fw, lambda f: len(list_filter(v, lambda x: x = f))::DOUBLE) AS b FROM s), told AS (
    SELECT *, length(regexp_replace(text, '[^.,;:!?\\-()\\[\\]{{}}"''/]', '', 'g'))::DOUBLE / greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda y: y <> '')), 1) AS pa, length(regexp_replace(text_b, '[^.,;:!?\\-()\\[\\]{{}}"''/]', '', 'g'))::DOUBLE / greatest(len(list_filter(string_split_regex(text_b, '\\s+'), lambda y: y <> '')), 1) AS pb,
    coalesce(len(list_distinct(w))::DOUBLE / nullif(len(w), 0), 0) AS ta, coalesce(len(list_distinct(v))::DOUBLE / nullif(len(v), 0), 0) AS tb FROM c)
    SELECT doc_id, round(ta, 9) AS ttr_candidate, round(abs(ta - tb), 9) AS ttr_diff, round(pa, 9) AS punct_density_candidate, round(abs(pa - pb), 9) AS punct_density_diff, CASE WHEN list_sum(a) + list_sum(b) > 0 THEN round(coalesce(list_dot_product(a, b) / nullif(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 0), 0), 9) END AS funcword_cosine FROM told""")
def style_pairs(spark, sf_dir):
    s = stylistic(F.col("text"), F.col("text_b"), F.col("w"), F.col("v"))
    return pairs(spark, sf_dir).select("doc_id", *(F.round(s[k], 9).alias(k) for k in ("ttr_candidate", "ttr_diff", "punct_density_candidate", "punct_density_diff", "funcword_cosine")))


@query(f"""{_PAIRS_SQL}, g AS (SELECT doc_id, {_G('w', 1)} AS a1, {_G('v', 1)} AS b1, {_G('w', 2)} AS a2, {_G('v', 2)} AS b2, {_G('w', 3)} AS a3, {_G('v', 3)} AS b3 FROM p), m AS (SELECT doc_id, coalesce({_J('a1', 'b1')}, 0) AS j, coalesce({_O('a1', 'b1')}, 0) AS o1, coalesce({_O('a2', 'b2')}, 0) AS o2, coalesce({_O('a3', 'b3')}, 0) AS o3, CASE WHEN doc_id % 2 = 0 THEN 0.5::DOUBLE END AS s FROM g)
    SELECT doc_id, round(j, 9) AS jaccard, round(o3, 9) AS ngram_3_overlap, round((0.1::DOUBLE * (j + o1 + o2 + o3) + coalesce(0.2::DOUBLE * s, 0)) / (0.4::DOUBLE + CASE WHEN s IS NULL THEN 0 ELSE 0.2::DOUBLE END), 9) AS combined_similarity FROM m""")
def legacy_similarity(spark, sf_dir):
    """Measures that no provider gave do not weigh."""
    p, measures = measured(spark, sf_dir)
    m = legacy_of(measures, semantic_cosine=F.when(F.col("doc_id") % 2 == 0, 0.5))
    assert set(m) & set(WEIGHTS_LEGACY)
    return p.select("doc_id", *(F.round(m[k], 9).alias(k) for k in ("jaccard", "ngram_3_overlap", "combined_similarity")))


@query("""SELECT c_custkey AS k, round(1 - (least(1.0, abs(c_acctbal / 1000 - 3) / 20) + least(1.0, abs((c_custkey % 10) / 10.0 - 0.5) / 1) + least(1.0, abs((c_custkey % 80) - 20.0) / 50)) / 3, 9) AS similarity FROM customer""")
def style_similarity_rows(spark, sf_dir):
    k = F.col("c_custkey")
    a = {"grade": F.col("c_acctbal") / 1000, "diversity": (k % 10) / 10.0, "sentence_length": (k % 80).cast("double")}
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.round(style_similarity(a, {"grade": F.lit(3.0), "diversity": F.lit(0.5), "sentence_length": F.lit(20.0)}), 9).alias("similarity"))


# vectors, queue, index --------------------------------------------------------------------------------------------------------------
@query("""SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-9), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def semantic_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("other"), F.col("embedding").alias("b"))
    return e.join(b, F.col("vec_id") == F.col("other")).select("vec_id", F.round(semantic_cosine(F.col("embedding"), F.col("b")), 5).alias("cosine"))


@query("""WITH e AS (SELECT vec_id, 'k' || (vec_id % 700) AS canon_key FROM embeddings), i AS (SELECT canon_key, arg_min(vec_id, vec_id) AS id FROM e WHERE vec_id % 2 = 0 AND vec_id % 9 <> 0 GROUP BY canon_key) SELECT canon_key, id FROM i UNION ALL SELECT canon_key, min(vec_id) FROM e WHERE vec_id % 2 = 1 AND canon_key NOT IN (SELECT canon_key FROM i) GROUP BY canon_key""")
def committed_vectors(spark, sf_dir):
    """Even rows are loaded, those of another dimension left out; odd ones are committed."""
    v = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select(v.alias("id"), (v + 1).alias("position"), F.concat(F.lit("k"), v % 700).alias("canon_key"), F.when(v % 9 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("e"))
    first = e.filter("id % 2 = 0 and id % 9 <> 0").agg(F.min("position").alias("p"))
    loaded = ve.loaded(e.filter("id % 2 = 0").crossJoin(F.broadcast(first)).filter("position >= p").drop("p"))
    new = e.filter("id % 2 = 1").withColumn("e", F.array_repeat(F.lit(1.0).cast("float"), F.size(F.array_repeat(F.lit(1), 64))))
    return ve.committed(loaded, new, 64).select("canon_key", "id")


@query(f"""WITH a AS ({ARTICLE_SQL}), r AS (SELECT subject, hop, row_number() OVER (PARTITION BY {KEY.format('subject')} ORDER BY hop, line_no) AS k, {KEY.format('subject')} AS canon_key FROM a), s AS (SELECT {KEY.format("source")} AS canon_key FROM documents) SELECT canon_key, subject, hop FROM r WHERE k = 1 AND canon_key <> '' AND canon_key NOT IN (SELECT canon_key FROM s)""")
def embedding_backfill(spark, sf_dir):
    """Subjects at their least hop by canonical key that have no vector yet."""
    a = articles(spark, sf_dir)
    have = table(spark, sf_dir, "documents").select(tx.canon_key(F.col("source")).alias("canon_key")).distinct()
    return ve.missing(a.select("subject", "hop", "line_no"), have)


@query(f"""{_STATE} SELECT round(min(greatest(CASE WHEN errors > 0 AND last = 'error' THEN failed_at + least(5.0 * pow(2.0, greatest(errors - 1, 0)), 120.0) ELSE 1.0e9 END - 1.0e9, 0)), 3) AS seconds FROM s WHERE status = 'pending'""")
def queue_next_due(spark, sf_dir):
    return qu.next_due(qu.state(queue_events(spark, sf_dir), 40), 1.0e9).select(F.round("seconds", 3).alias("seconds"))


@query(f"""WITH e AS ({_EVENTS}), x AS (SELECT *, lead(ts) OVER (PARTITION BY subject, hop ORDER BY ordinal) AS next FROM e), r AS (
    SELECT *, row_number() OVER (PARTITION BY subject, hop ORDER BY ordinal) AS retry FROM x WHERE event = 'error'), d AS (SELECT *, CASE WHEN retry < 4 THEN ts + least(60000 * pow(3, retry - 1), 300000) END AS due_at FROM r WHERE retry <= 4)
    SELECT subject, hop, CAST(retry AS INT) AS retry, round(due_at - ts, 3) AS delay, CASE WHEN due_at IS NULL THEN 'failed' WHEN next <= due_at THEN 'superseded' ELSE 'retry' END AS outcome FROM d""")
def queue_retries(spark, sf_dir):
    """Errors of the event log and what becomes of them, after delays of 1000 minutes and more."""
    r = qu.retries(queue_events(spark, sf_dir), 4, base=60_000.0, backoff=3.0, cap=300_000.0)
    return r.select("subject", "hop", "retry", F.round(F.col("due_at") - F.col("failed_at"), 3).alias("delay"), "outcome")


@query(f"""{_STATE} SELECT subject, hop, CASE status WHEN 'working' THEN 'pending' ELSE status END AS status, row_number() OVER (ORDER BY position, subject, hop) - 1 AS place FROM s""")
def queue_recovered(spark, sf_dir):
    s = qu.reset_working(qu.state(queue_events(spark, sf_dir), 40)).withColumns({"retry_at": F.lit(None).cast("double"), "created_at": F.col("position").cast("double")})
    return qu.with_order(s).select("subject", "hop", "status", F.col("place").cast("long").alias("place"))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS place FROM lineitem""")
def row_places(spark, sf_dir):
    """Places of all order lines by date, in ranges of some 5000."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return numbered(rows, "place", F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), size=5000).select("l_orderkey", "l_linenumber", "place")


@query(f"""WITH a AS ({ARTICLE_SQL}) SELECT doc_id AS id, row_number() OVER (ORDER BY hop, lower(subject), doc_id) - 1 AS place FROM a""")
def browse_order(spark, sf_dir):
    e = articles(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("subject").alias("title"), "hop")
    return index.browse_order(e).select("id", F.col("place").cast("long").alias("place"))


@query(f"""WITH a AS ({ARTICLE_SQL}), t AS (SELECT DISTINCT subject AS title, hop FROM a), p AS (SELECT min(subject) AS one FROM a WHERE hop = 3) SELECT title FROM t, p WHERE title = one OR hop = 0 GROUP BY title, one ORDER BY title <> one, title LIMIT 15""")
def featured_articles(spark, sf_dir):
    e = articles(spark, sf_dir).select(F.col("subject").alias("title"), "hop").distinct()
    one = e.filter("hop = 3").agg(F.min("title")).first()[0]
    return index.featured(e.groupBy("title").agg(F.min("hop").alias("hop")), [one]).select("title")


@query(f"""WITH a AS ({ARTICLE_SQL}), s AS (SELECT subject AS title, arg_max(replace(subject, ' ', '_'), doc_id) AS slug FROM a GROUP BY subject), l AS (SELECT doc_id, unnest(list_distinct(list_transform(range(0, len(w) - 2), lambda i: array_to_string(w[i + 1 : i + 3], ' ')))) AS t FROM (SELECT doc_id, w FROM a WHERE len(w) >= 3)) SELECT doc_id, slug FROM l JOIN s ON l.t = s.title GROUP BY ALL""")
def existing_links(spark, sf_dir):
    """Every run of three words of a text is a link; those that are some article's title lead there."""
    a = articles(spark, sf_dir)
    runs_ = F.transform("w", lambda x, i: F.concat(F.lit("[["), x, F.lit(" "), F.get("w", i + 1), F.lit(" "), F.get("w", i + 2), F.lit("]]")))  # null at the end, which is not joined
    texts = a.filter("size(w) >= 3").select(F.col("doc_id").alias("title"), F.array_join(runs_, " ").alias("text"))
    slugs = index.slug_map(a.select(F.col("subject").alias("title"), F.col("doc_id").alias("position")))
    return index.existing_links(texts, slugs).select(F.col("title").alias("doc_id"), "slug")


@query("""SELECT o_custkey AS subject, min(o_orderkey) AS first, max(o_orderkey) AS last, arg_min(o_orderkey, struct_pack(h := o_orderkey % 4, k := o_orderkey)) AS minhop, arg_max(o_orderkey, struct_pack(h := o_orderkey % 4, k := -o_orderkey)) AS maxhop, bool_or(o_orderstatus = 'F') AS found FROM orders GROUP BY 1""")
def pick_policies(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), (F.col("o_orderkey") % 4).alias("hop"), F.col("o_orderkey").alias("line_no"), F.col("o_orderkey").alias("key"), "o_orderstatus")
    out = an.found_anywhere(o, F.col("o_orderstatus") == "F")
    for policy in ("first", "last", "minhop", "maxhop"):
        out = out.join(an.pick(o.select("subject", "hop", "line_no", "key"), policy).select("subject", F.col("key").alias(policy)), "subject")
    return out


# pages ------------------------------------------------------------------------------------------------------------------------------
@query("""SELECT p_partkey, p_name || ', x' AS list, '7 March ' || (1900 + p_size) AS date, p_name AS lang, p_size || ' km' AS unit, '' AS cite FROM part""")
def template_values(spark, sf_dir):
    n, s = F.col("p_name"), F.col("p_size")
    t = {"list": F.concat(F.lit("{{ubl|"), n, F.lit("|{{nowrap|x}}|df=y}}")), "date": F.concat(F.lit("{{start date|"), 1900 + s, F.lit("|3|7}}")), "lang": F.concat(F.lit("{{lang|de|"), n, F.lit("}}")), "unit": F.concat(F.lit("{{convert|"), s, F.lit("|km|mi}}")), "cite": F.concat(F.lit("{{cite web|"), n, F.lit("}}"))}
    return table(spark, sf_dir, "part").select("p_partkey", *(pages.resolve_templates(c).alias(k) for k, c in t.items()))


@query("""SELECT p_partkey, unnest(['name', 'size']) AS key, unnest(['[[' || p_brand || '|' || p_name || ']]', p_size || ' kg']) AS value FROM part""")
def infobox_rows(spark, sf_dir):
    x = F.concat(F.lit("Lead {{Infobox part\n| name = [["), F.col("p_brand"), F.lit("|"), F.col("p_name"), F.lit("]]\n| image = a.png\n| size = {{convert|"), F.col("p_size"), F.lit("|kg}}<ref>r</ref>\n| wide = 20px\n| on = yes}} text"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(pages.box_fields(x)).alias("f")).select("p_partkey", "f.*")


@query("""WITH g AS (SELECT o_orderkey AS title, CASE WHEN o_orderkey % 5 <> 0 THEN 'P' || o_custkey END AS parent, count(l_orderkey) AS raw, count(*) FILTER (l_returnflag <> 'N') AS deduped, count(*) FILTER (l_returnflag = 'A') AS accepted, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS enqueued FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT title, parent IS NULL AS seed, CASE WHEN raw > 0 THEN printf('%.1f', 100.0 * deduped / raw) || '%' ELSE '' END AS deduped_share, CASE WHEN raw > 0 AND deduped > 0 THEN printf('%.1f', 100.0 * accepted / deduped) || '%' ELSE '' END AS accepted_share, round(enqueued::DOUBLE / nullif(raw, 0), 4) AS overall,
    '<div>' || CASE WHEN parent IS NULL THEN '<b>SEED</b>' ELSE 'Parent: ' || parent END || ' Hop 1<p>' || CASE WHEN raw > 0 THEN 'Raw ' || raw || ' → Dedup ' || deduped || ' → NER ' || accepted || ' → Enqueued ' || enqueued ELSE 'No expansion data.' END || '</p></div>' AS box FROM g""")
def genealogy(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    f = F.col("l_returnflag")
    n = l.groupBy(F.col("l_orderkey").alias("title")).agg(F.count("*").alias("raw"), F.count_if(f != "N").alias("deduped"), F.count_if(f == "A").alias("accepted"), F.count_if((f == "A") & (F.col("l_linestatus") == "F")).alias("enqueued"))
    e = o.select(F.col("o_orderkey").alias("title"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("P"), F.col("o_custkey"))).alias("parent"), F.lit(1).alias("hop")).join(n, "title", "left").fillna(0, ["raw", "deduped", "accepted", "enqueued"])
    g = pages.genealogy(e)
    return g.withColumn("box", pages.genealogy_html(F.struct("seed", "parent", "hop", "raw", "deduped", "accepted", "enqueued"))).select("title", "seed", "deduped_share", "accepted_share", "overall", "box")


@query("""WITH s AS (SELECT p_name AS title, p_partkey AS k, CAST(p_partkey % 3 = 0 AS INT) AS known FROM part) SELECT k, '<p>See ' || CASE WHEN known = 1 THEN '<a href="s' || k || '.html">it</a>' ELSE 'it' END || ' and <b>Cats</b>.</p>' || chr(10) || '<h2 id="life">Life</h2>' || chr(10) || '<p>Born there.</p>' AS body, false AS guessed FROM s""")
def article_pages(spark, sf_dir):
    """Parts as articles: a text with a link to itself, bold, and a section; every third title has a page."""
    k = F.col("p_partkey")
    t = F.concat(F.lit("P"), k.cast("string"))
    a = table(spark, sf_dir, "part").select(t.alias("title"), F.concat(F.lit("{{Infobox x|a=bb}}See [["), t, F.lit("|it]] and '''Cats'''.\n\n== Life ==\nBorn there. {{gone|{{x}}}}")).alias("text"), k.alias("k"))
    slugs = a.filter("k % 3 = 0").select(F.col("title").alias("key"), F.concat(F.lit("s"), F.col("k")).alias("slug"))
    p = pages.linked(a, slugs).withColumn("p", pages.rendered("title", "text", "slugs", F.lit("")))
    return p.select("k", "p.body", "p.guessed")


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_name || '|' || p_brand ELSE p_name END AS claims FROM part")
def claim_answers(spark, sf_dir):
    """Claims of whole and of cut answers, trimmed, blank ones gone."""
    k = F.col("p_partkey")
    text = F.when(k % 2 == 0, F.concat(F.lit('{"claims": [" '), F.col("p_name"), F.lit(' ", "", "'), F.col("p_brand"), F.lit('"]}'))).otherwise(F.concat(F.lit('{"claims": ["'), F.col("p_name"), F.lit('", 7, '))) 
    return table(spark, sf_dir, "part").select(k.alias("k"), F.array_join(salvage.claim_list(text), "|").alias("claims"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'A ' || p_name WHEN 1 THEN 'M ' || p_name WHEN 2 THEN 'C ' || p_name ELSE 'B ' || p_name || ' rest' END AS text FROM part""")
def page_parts(spark, sf_dir):
    """The text of a page's article, else its main part, else the element named content, else its body; scripts and navigation never."""
    k, n = F.col("p_partkey"), F.col("p_name")
    own = F.when(k % 4 == 0, F.concat(F.lit("<main>m <article>A <b>"), n, F.lit("</b></article></main>"))).when(k % 4 == 1, F.concat(F.lit("<main>M<br> "), n, F.lit("</main>"))).when(k % 4 == 2, F.concat(F.lit("<div id='content'>C "), n, F.lit("</div>"))).otherwise(F.concat(F.lit("B "), n))
    html = F.concat(F.lit("<html><head><title>t</title></head><body><nav>menu</nav><script>x<1</script>"), own, F.lit("<p>rest</p></body></html>"))
    return table(spark, sf_dir, "part").select(k.alias("k"), salvage.dom_text(html).alias("text"))


@query(f"""SELECT doc_id, CASE WHEN len({TOKENS}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents""")
def hashed_embeddings(spark, sf_dir):
    """The stand-in for a model: vectors of length one, zero for texts without words."""
    from ..functions.similarity import dot

    e = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("w"))
    v = e.select("doc_id", ve.hashed_embedding(F.col("w"), 16).alias("e"))
    return v.select("doc_id", F.round(dot(F.col("e"), F.col("e")), 3).alias("norm"))


@query("""SELECT o_orderkey AS custom_id, '{"claims": ["c ' || o_custkey || '"]}' AS object FROM orders WHERE o_orderkey % 4 < 2""")
def batch_answers(spark, sf_dir):
    """Lines of a batch's output: chat and responses shapes, lines without a text or an id."""
    k = F.col("o_orderkey")
    said = F.concat(F.lit('{\\"claims\\": [\\"c '), F.col("o_custkey"), F.lit('\\",]}'))
    chat = F.concat(F.lit('{"custom_id": "'), k, F.lit('", "response": {"body": {"choices": [{"message": {"content": "'), said, F.lit('"}}]}}}'))
    other = F.concat(F.lit('{"custom_id": "'), k, F.lit('", "response": {"body": {"output": [{"content": [{"text": "'), said, F.lit('"}]}]}}}'))
    line = F.when(k % 4 == 0, chat).when(k % 4 == 1, other).when(k % 4 == 2, F.concat(F.lit('{"custom_id": "'), k, F.lit('", "error": 1}'))).otherwise("no json")
    return logs.batch_answers(table(spark, sf_dir, "orders").select(line.alias("value"))).select(F.col("custom_id").cast("long").alias("custom_id"), "object")


@query(f"""WITH d AS (SELECT source AS g, doc_id, {TOKENS} AS w FROM documents), s AS (SELECT g, w[1] AS subject, arg_min(w, doc_id) AS w FROM d WHERE len(w) > 0 GROUP BY ALL), p AS (SELECT x.g AS a, y.g AS b, x.subject, x.w AS w, y.w AS v, row_number() OVER (PARTITION BY x.g, y.g ORDER BY x.subject) AS r FROM s x JOIN s y ON x.subject = y.subject AND x.g < y.g), k AS (
    SELECT a, b, {_G('w', 1)} AS a1, {_G('v', 1)} AS b1, {_G('w', 2)} AS a2, {_G('v', 2)} AS b2, {_G('w', 3)} AS a3, {_G('v', 3)} AS b3 FROM p WHERE r <= 100), m AS (SELECT a, b, {_J('a1', 'b1')} AS j, CASE WHEN len(a2) > 0 AND len(b2) > 0 THEN {_O('a2', 'b2')} END AS o2, CASE WHEN len(a3) > 0 AND len(b3) > 0 THEN {_O('a3', 'b3')} END AS o3 FROM k)
    SELECT a, b, count(*) AS n, round(avg(j), 9) AS mean_jaccard, round(stddev_samp(j), 9) AS std_jaccard, round(avg(o2), 9) AS mean_ngram_2_overlap, round(avg(o3), 9) AS mean_ngram_3_overlap FROM m GROUP BY a, b""")
def cross_similarity(spark, sf_dir):
    """Sources as models, the first word of a text as its subject; the first twenty common subjects of a pair."""
    d = articles(spark, sf_dir).filter("size(w) > 0").select("source", F.get("w", 0).alias("subject"), "line_no", F.col("w").alias("words"))
    c = reports.cross_similarity(d.filter("source is not null"), "source", 100)
    return rounded(c.select("a", "b", "n", "mean_jaccard", "std_jaccard", "mean_ngram_2_overlap", "mean_ngram_3_overlap"), "a", "b")
