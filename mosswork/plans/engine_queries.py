"""Evidence, vector, queue, tree and expansion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import wikitext as wk
from ..functions.similarity import cosine, unit
from ..operators import analyses as an
from ..operators import evidence as ev
from ..operators import funnel as fn
from ..operators import queue as qu
from ..operators import vector as ve
from ..operators.stored import stored
from . import crawl
from .registry import query, table
from .text_queries import KEY, TOKENS


def saver(spark):
    """Levels as checkpoints in the cluster's folder."""
    return lambda df, name: stored(df)


# url, domain, root, first score, second score, label, excluded by the first scheme (with the suffix `net`), by the second
URLS = [
    ("https://www.britannica.com/a", "www.britannica.com", "britannica.com", 100, 100, "gold", False, False), ("http://en.wikipedia.org/x", "en.wikipedia.org", "wikipedia.org", 70, 98, "gold", True, False),
    ("https://news.bbc.co.uk/1", "news.bbc.co.uk", "co.uk", 35, 32, "low", False, False), ("https://cs.mit.edu/", "cs.mit.edu", "mit.edu", 93, 70, "acceptable", False, False),
    ("https://www.investopedia.com/t", "www.investopedia.com", "investopedia.com", 35, 69, "acceptable", False, False), ("http://healthline.com", "healthline.com", "healthline.com", 30, 65, "acceptable", False, False),
    ("https://www.mayoclinic.org/x", "www.mayoclinic.org", "mayoclinic.org", 88, 79, "good", False, False), ("http://webmd.com/", "webmd.com", "webmd.com", 72, 62, "acceptable", False, False),
    ("https://verywellhealth.com", "verywellhealth.com", "verywellhealth.com", 35, 61, "acceptable", False, False), ("https://blog.university-press.net/z", "blog.university-press.net", "university-press.net", 35, 70, "acceptable", True, False),
    ("https://www.linkedin.com/in/x", "www.linkedin.com", "linkedin.com", 35, 32, "low", False, True), ("http://plain.net", "plain.net", "plain.net", 30, 30, "low", True, False),
    ("https://plain.net:8080/p?q#r", "plain.net:8080", "plain.net:8080", 35, 32, "low", False, False), ("ftp://x", "x", "x", 30, 30, "low", False, False), ("https://loc.gov", "loc.gov", "loc.gov", 97, 98, "gold", False, False),
    ("https://a.ac.uk/p", "a.ac.uk", "ac.uk", 35, 65, "acceptable", False, False), ("notaurl", "", "", 30, 30, "low", False, False), ("https://medium.com/@x", "medium.com", "medium.com", 35, 56, "fair", False, False),
    ("https://www.reddit.com/r", "www.reddit.com", "reddit.com", 35, 32, "low", True, True), ("https://museum.example.org/", "museum.example.org", "example.org", 70, 70, "acceptable", False, False),
    ("https://x.fandom.com/wiki", "x.fandom.com", "fandom.com", 35, 32, "low", False, True),
]
_DOM = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"
_ROOT = "CASE WHEN contains({0}, '.') THEN array_to_string(string_split({0}, '.')[-2:], '.') ELSE {0} END"


def _scores(s):
    return "(VALUES " + ", ".join(f"('{k}', {float(v)}::DOUBLE)" for k, v in s.items()) + ") s(d, score)"


def _scored(source: str) -> str:
    words = ", ".join(f"CASE WHEN contains(d, '{k}') THEN {float(v)} ELSE 0 END" for k, v in ev.KEYWORDS.items())
    return f"""WITH u AS (SELECT url, {_DOM.format('url')} AS d FROM {source}), r AS (SELECT *, {_ROOT.format('d')} AS root FROM u), a AS (SELECT * FROM {_scores(ev.SCORES_A)}), b AS (SELECT * FROM {_scores(ev.SCORES_B)}), j AS (
    SELECT r.*, coalesce(a1.score, a2.score) AS ka, coalesce(b1.score, b2.score) AS kb FROM r LEFT JOIN a a1 ON a1.d = r.d LEFT JOIN a a2 ON a2.d = r.root LEFT JOIN b b1 ON b1.d = r.d LEFT JOIN b b2 ON b2.d = r.root), s AS (
    SELECT url, d, root, CAST(coalesce(ka, CASE WHEN regexp_matches(d, '\\.(edu|gov|org)$') THEN 70 WHEN starts_with(url, 'https') THEN 35 ELSE 30 END) AS DOUBLE) AS score_a,
    CAST(CASE WHEN kb IS NOT NULL THEN CASE WHEN starts_with(url, 'https') THEN least(100, kb + 1) ELSE kb END WHEN regexp_matches(d, '\\.(edu|gov|org|int|mil)$') THEN 70 WHEN regexp_matches(d, '(\\.ac\\.uk|\\.edu\\.au|\\.ac\\.jp)$') THEN 65
    WHEN greatest({words}) > 0 THEN greatest({words}) WHEN starts_with(url, 'https') THEN 32 ELSE 30 END AS DOUBLE) AS score_b FROM j)"""


# each page has one of the addresses
@query("SELECT page_id, v.url, domain, root, CAST(a AS DOUBLE) AS score_a, CAST(b AS DOUBLE) AS score_b, label, excluded, excluded_b FROM (VALUES " + ", ".join(f"({i}, '{u}', '{d}', '{r}', {a}, {b}, '{l}', {x}, {y})" for i, (u, d, r, a, b, l, x, y) in enumerate(URLS)) + f") v(i, url, domain, root, a, b, label, excluded, excluded_b) JOIN pages p ON p.page_id % {len(URLS)} = i")
def domain_scores(spark, sf_dir):
    u = F.col("url")
    d = table(spark, sf_dir, "pages").select("page_id", F.get(F.array(*(F.lit(x[0]) for x in URLS)), (F.col("page_id") % len(URLS)).cast("int")).alias("url"))
    return d.select(
        "page_id", "url", ev.domain(u).alias("domain"), ev.root(ev.domain(u)).alias("root"), ev.score_a(u).alias("score_a"), ev.score_b(u).alias("score_b"), ev.label(ev.score_b(u)).alias("label"),
        ev.excluded(u, ["net"]).alias("excluded"), ev.excluded(u, blocked=ev.BLOCKED_B).alias("excluded_b"),
    )


@query(_scored("pages") + " SELECT url, score_a, score_b FROM s")
def page_scores(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", ev.score_a(F.col("url")).alias("score_a"), ev.score_b(F.col("url")).alias("score_b"))


@query(_scored("pages") + """, p AS (SELECT page_id % 10 AS subject, pages.url, page_id AS position, root, score_a AS score FROM pages JOIN (SELECT DISTINCT url, root, score_a FROM s) USING (url)), f AS (SELECT subject, url, root, score, min(position) AS position FROM p WHERE score >= 30 AND root NOT IN ("""
       + ", ".join(f"'{d}'" for d in ev.BLOCKED) + """) GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY subject, root ORDER BY score DESC, position) AS r FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, position) AS rank FROM g WHERE r = 1)
    SELECT subject, url, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5""")
def unique_domain_topk(spark, sf_dir):
    r = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("subject"), "url", F.col("page_id").alias("position"))
    return ev.best_of_each_root(r, "subject", 5, 30.0).select("subject", "url", "rank")


_BLOCK = "|".join(ev.BLOCKED_TEXT).replace("'", "''")
TEXTS = [(1, "Please complete this reCAPTCHA to go on"), (2, "Access Denied"), (3, "Short but. Has two. Ends."), (4, "Just a moment... Cloudflare"), (5, ""), (6, "word " * 80), (7, "Subscribe to continue reading"), (8, "Too many requests"), (9, "tiny")]


@query(rf"""WITH t AS (SELECT page_id AS id, html AS x FROM pages UNION ALL VALUES {", ".join(f"({-i}, '{t}')" for i, t in TEXTS)})
    SELECT id, x <> '' AND (regexp_matches(left(x, 2000), '(?is){_BLOCK}') OR (length(trim(x)) < 200 AND len(regexp_extract_all(x, '[.!?]\s')) < 2)) AS blocked FROM t""")
def blocked_content(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("x")).unionByName(spark.createDataFrame([(-i, t) for i, t in TEXTS], "id long, x string"))
    return t.select("id", ev.is_blocked(F.col("x")).alias("blocked"))


@query("""SELECT page_id, reason FROM pages JOIN (VALUES (1,'captcha'),(2,'access-denied'),(3,'too-short'),(4,'cloudflare'),(5,'empty'),(6,'blocked-generic'),(7,'paywall'),(8,'rate-limited'),(9,'too-short')) v(id, reason) ON page_id % 9 + 1 = id""")
def blocked_reasons(spark, sf_dir):
    """Each page answers with one of the texts."""
    x = F.get(F.array(*(F.lit(t) for _, t in sorted(TEXTS))), (F.col("page_id") % len(TEXTS)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", ev.blocked_reason(x).alias("reason"))


_SUBJECTS = [" Ada (Countess of  Lovelace) ", "Mercury (planet)", "plain", "A (b) c", "(x)"]


@query("""WITH s AS (SELECT n_name AS subject, NULL AS short, NULL AS inside FROM nation UNION ALL SELECT * FROM (VALUES (' Ada (Countess of  Lovelace) ', 'Ada', 'Countess of  Lovelace'), ('Mercury (planet)', 'Mercury', 'planet'), ('plain', NULL, NULL), ('A (b) c', NULL, NULL), ('(x)', NULL, NULL)) v(s, a, b)), t AS (
    SELECT subject, trim(subject) AS clean, inside, CASE WHEN inside IS NULL THEN trim(subject) ELSE short || ' ' || inside END AS base FROM s)
    SELECT subject, '"' || base || '" history facts encyclopedia' AS first_pipeline, base || ' encyclopedia overview facts' AS q1, base || ' wikipedia' AS q2, CASE WHEN inside IS NULL THEN '"' || clean || '" biography history overview' ELSE '"' || inside || '" history overview' END AS q3 FROM t""")
def search_queries(spark, sf_dir):
    t = table(spark, sf_dir, "nation").select(F.col("n_name").alias("subject")).unionByName(spark.createDataFrame([(x,) for x in _SUBJECTS], "subject string"))
    q = tx.search_queries(F.col("subject"))
    return t.select("subject", tx.search_query(F.col("subject")).alias("first_pipeline"), *(F.get(q, i).alias(f"q{i + 1}") for i in range(3)))


@query(_scored("pages") + """, every AS (SELECT page_id % 7 AS subject, url, struct_pack(a := 0, b := page_id) AS position FROM pages UNION ALL SELECT (page_id + 3) % 7, url, struct_pack(a := 1, b := page_id) FROM pages), o AS (SELECT subject, url, min(position) AS position FROM every GROUP BY ALL), best AS (
    SELECT subject, url, position, root, score_b AS score FROM o JOIN (SELECT DISTINCT url, root, score_b FROM s) USING (url)), g AS (SELECT *, row_number() OVER (PARTITION BY subject, root ORDER BY score DESC, position) AS r FROM best), k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, position) AS rank FROM g WHERE r = 1)
    SELECT subject, url, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5""")
def second_evidence(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    of = lambda shift: p.select(((F.col("page_id") + shift) % 7).alias("subject"), "url", F.col("page_id").alias("position"))
    return ev.second_scheme(ev.merged_results(of(0), of(3)), 5).select("subject", "url", "rank")


@query("""SELECT c_custkey AS subject, coalesce(a.value, b.value) AS value, CAST(CASE WHEN a.value IS NOT NULL THEN 1 WHEN b.value IS NOT NULL THEN 2 END AS INT) AS phase FROM customer
    LEFT JOIN (SELECT o_custkey AS k, min(o_orderkey) AS value FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a ON a.k = c_custkey LEFT JOIN (SELECT o_custkey AS k, min(o_orderkey) AS value FROM orders GROUP BY 1) b ON b.k = c_custkey""")
def source_cascade(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    first = lambda d: d.groupBy(F.col("o_custkey").alias("subject")).agg(F.min("o_orderkey").alias("value"))
    return ev.first_answer(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject")), first(o.filter("o_orderstatus = 'P'")), first(o))


@query("""WITH s AS (SELECT q.vec_id AS query_id, i.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INT) AS rank, id, round(score, 5) AS score FROM r WHERE rank <= 5""")
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("e"))
    return ve.topk(e, e, 5).select("query_id", "rank", "id", F.round("score", 5).alias("score"))


@query("""SELECT q.vec_id AS query_id, i.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 5) AS score FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id
    WHERE list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) >= 0.35""")
def vector_threshold_join(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("e"))
    return ve.similar(e, e, 0.35).select("query_id", "id", F.round("score", 5).alias("score"))


@query("""WITH b AS (SELECT vec_id AS position, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.position, b.position AS other, round(list_dot_product(a.e, b.e), 12) AS score FROM b a JOIN b ON a.position <> b.position), m AS (SELECT position, max(score) AS best FROM s GROUP BY position), o AS (
    SELECT s.position, m.best, min(other) AS other FROM s JOIN m ON m.position = s.position AND m.best = s.score GROUP BY ALL)
    SELECT position, round(greatest(best, 0), 5) AS best_score, CASE WHEN best >= 0.3 AND other < position THEN other END AS duplicate_of FROM o""")
def in_batch_duplicates(spark, sf_dir):
    """All embeddings are one batch."""
    b = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("position"), F.col("embedding").alias("e"))
    return ve.in_batch(b, 0.3).select("position", F.round("best_score", 5).alias("best_score"), "duplicate_of")


@query("""WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i), v AS (SELECT label, list(x ORDER BY i) AS e FROM c GROUP BY label)
    SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.e, b.e), 5) AS cosine FROM v a JOIN v b ON a.label < b.label""")
def centroid_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    c = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    v = c.select("label", F.transform("v", lambda p: p.x).alias("e"))  # one row a label
    pairs = v.alias("p").join(v.alias("q"), F.col("p.label") < F.col("q.label"))
    return pairs.select(F.col("p.label").alias("a"), F.col("q.label").alias("b"), F.round(cosine(F.col("p.e"), F.col("q.e")), 5).alias("cosine"))


@query("""SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS norm FROM embeddings""")
def unit_vectors(spark, sf_dir):
    from ..functions.similarity import dot

    e = table(spark, sf_dir, "embeddings").select("vec_id", unit(F.transform("embedding", lambda x: x * 3)).alias("e"))
    return e.select("vec_id", F.round(dot(F.col("e"), F.col("e")), 4).alias("norm"))


_EVENTS = """SELECT event_id AS ordinal, epoch(ts) AS ts, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'done' ELSE 'error' END AS event, user_id::VARCHAR AS subject, CAST(user_id % 4 AS INT) AS hop FROM events"""
_STATE = f"""WITH e AS ({_EVENTS}), g AS (SELECT subject, hop, count(*) FILTER (event = 'enqueue') AS enqueued, count(*) FILTER (event = 'error') AS errors, arg_max(event, ordinal) FILTER (event <> 'enqueue') AS last, max(ts) FILTER (event = 'error') AS failed_at, min(ordinal) FILTER (event = 'enqueue') AS position FROM e GROUP BY subject, hop), s AS (
    SELECT *, CASE WHEN last = 'done' THEN 'done' WHEN last = 'error' AND errors >= 40 THEN 'failed' WHEN last = 'claim' THEN 'working' ELSE 'pending' END AS status FROM g WHERE enqueued > 0)"""


def queue_events(spark, sf_dir):
    kind = F.col("event_type")
    event = F.when(kind == "signup", "enqueue").when(kind.isin("view", "click"), "claim").when(kind == "purchase", "done").otherwise("error")
    none = F.lit(None)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ordinal"), F.col("ts").cast("timestamp").cast("double").alias("ts"), event.alias("event"), F.col("user_id").cast("string").alias("subject"), (F.col("user_id") % 4).cast("int").alias("hop"), none.cast("string").alias("parent_subject"), none.cast("int").alias("parent_hop")
    )


@query(f"{_STATE} SELECT subject, hop, status, CAST(least(errors, 40) AS BIGINT) AS retries, position FROM s")
def queue_state(spark, sf_dir):
    s = qu.state(queue_events(spark, sf_dir), 40)
    return s.select("subject", "hop", "status", F.col("retries").cast("long").alias("retries"), "position")


@query(f"{_STATE} SELECT hop, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'working') AS working, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed FROM s WHERE hop <= 2 GROUP BY hop")
def queue_metrics(spark, sf_dir):
    return qu.metrics(qu.state(queue_events(spark, sf_dir), 40), 2, "hop")


@query(f"{_STATE} SELECT subject, hop FROM s WHERE status = 'pending' ORDER BY errors = 0, position LIMIT 10")
def queue_claim(spark, sf_dir):
    return qu.claim(qu.state(queue_events(spark, sf_dir), 40), 10, 1e12).select("subject", "hop")


@query("SELECT event_id, event_id % 9 AS retry, least(5.0 * pow(2.0, greatest(event_id % 9 - 1, 0)), 120.0)::DOUBLE AS delay FROM events")
def retry_delay(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 9).alias("retry"))
    return e.withColumn("delay", qu.retry_delay(F.col("retry")))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS ordinal FROM events GROUP BY user_id")
def lww_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("ordinal"))
    return qu.last_write(e, "user_id").select("user_id", "event_type", "ordinal")


@query("""WITH RECURSIVE t AS (SELECT doc_id, 0 AS depth FROM documents WHERE doc_id = 0 UNION ALL SELECT d.doc_id, t.depth + 1 FROM documents d JOIN t ON d.doc_id // 3 = t.doc_id AND d.doc_id <> 0)
    SELECT depth, count(*) AS n FROM t GROUP BY depth""")
def bfs_levels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    edges = d.filter("doc_id <> 0").select(F.expr("doc_id div 3").alias("parent"), F.col("doc_id").alias("child"))
    return crawl.levels(d.filter("doc_id = 0").select(F.col("doc_id").alias("node")), edges, saver(spark)).groupBy("depth").agg(F.count("*").alias("n"))


@query("SELECT doc_id // 3 AS parent, count(*) AS children FROM documents WHERE doc_id > 0 GROUP BY 1")
def children_count(spark, sf_dir):
    parent = F.expr("doc_id div 3")
    none = F.lit(None).cast("long")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("subject"), F.lit(0).alias("hop"), F.when(F.col("doc_id") > 0, parent).otherwise(none).alias("parent_subject"), F.lit(0).alias("parent_hop"), F.col("doc_id").alias("ordinal"))
    return fn.child_rows(d).groupBy(F.col("subject").alias("parent")).agg(F.sum("inserted_children").alias("children"))


_EVERY = f"SELECT doc_id, CAST(unnest(range(len(w))) AS INT) AS place, unnest(w) AS phrase FROM (SELECT doc_id, {TOKENS} AS w FROM documents)"
_SEEN = f"SELECT DISTINCT unnest({TOKENS}) AS k FROM benchmark"


@query(f"""WITH c AS ({_EVERY}), s AS ({_SEEN}) SELECT doc_id, place, {KEY.format('phrase')} AS key, EXISTS (SELECT 1 FROM s WHERE k = phrase) AS in_seen FROM c WHERE {KEY.format('phrase')} <> ''""")
def seen_candidates(spark, sf_dir):
    return _flagged(spark, sf_dir).select("doc_id", "place", "key", "in_seen")


def _flagged(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("subject"), F.lit(0).alias("hop"), F.posexplode(tx.tokens(F.col("text"))).alias("place", "phrase"))
    seen = table(spark, sf_dir, "benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("canon_key")).distinct()
    return crawl.seen_flags(each, seen)


@query()
def pre_ner_dedup(spark, sf_dir):
    """Every word of every text is a candidate, the words of the benchmark were seen before."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("subject"), F.lit(0).alias("hop"), "text")
    seen = table(spark, sf_dir, "benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("canon_key")).distinct()
    return crawl.deduplicated(d, tx.tokens(F.col("text")), seen).select("subject", "place", "key", "reason")


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 1 THEN 'accepted' ELSE 'not_named_entity' END AS gate_reason FROM documents LEFT JOIN labels USING (doc_id)""")
def ner_gate(spark, sf_dir):
    kept = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"))
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("phrase"), (F.col("quality") == 1).alias("is_ne"), F.lit(None).cast("double").alias("confidence"), F.col("doc_id").alias("line_no"))
    return crawl.gated(kept, l).select("doc_id", "gate_reason")


@query()
def crawl_levels(spark, sf_dir):
    """Documents as articles: the first word is the subject, every word of the text a link; words of four letters and more are named entities."""
    w, save = tx.tokens(F.col("text")), saver(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract(F.lower("text"), tx.WORD, 0).alias("subject")).filter("subject <> ''")
    text = F.array_join(F.transform(F.array_distinct(w), lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), " ")
    chosen = save(d.groupBy("subject").agg(F.min("doc_id").alias("doc_id")), "chosen")  # only the texts of articles are made into links
    articles = d.join(chosen, ["subject", "doc_id"]).select("subject", "doc_id", text.alias("wikitext")).groupBy("subject").agg(F.min_by("wikitext", "doc_id").alias("wikitext"))
    words = d.select(F.explode(F.array_distinct(w)).alias("phrase")).distinct()
    decisions = words.select("phrase", (F.length("phrase") >= 4).alias("is_ne"), F.lit(None).cast("double").alias("confidence"), F.lit(0).alias("line_no"))
    return crawl.expand(spark.createDataFrame([("the",), ("der",), ("la",)], "subject string"), save(articles, "articles"), save(decisions, "decisions"), 2, save=save)


@query("""SELECT page_id, CAST(len(list_filter(regexp_extract_all(html, '(?is)<h([23])[^>]*>(.*?)</h[23]>', 2), lambda x: true)) AS INT) AS headings FROM pages""")
def page_headings(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(wk.contents(F.col("html"), 0)).alias("headings"))


@query("""SELECT n_nationkey AS subject, candidate, baseline FROM nation, (VALUES ('a'), ('b')) c(candidate), (VALUES ('x'), ('y'), ('z')) b(baseline)""")
def task_matrix(spark, sf_dir):
    return an.task_matrix(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("subject")), ["a", "b"], ["x", "y", "z"])
