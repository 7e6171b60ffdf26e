import json
import re

from pyspark.sql import functions as F

from mosswork.functions import rates
from mosswork.operators import evidence, index, metric, queue, reports, vector
from mosswork.operators.stored import stored
from mosswork.plans import crawl
from mosswork.sources import logs, sinks
from mosswork.streaming import queue as stream


def test_empty_conventions(spark):
    d = spark.createDataFrame([([], []), (["a"], ["a", "b"])], "a array<string>, b array<string>")
    got = d.select(rates.jaccard(F.col("a"), F.col("b")).alias("one"), rates.jaccard(F.col("a"), F.col("b"), None).alias("null"), rates.overlap(F.col("a"), F.col("b")).alias("o")).collect()
    assert tuple(got[0]) == (1.0, None, 0.0) and tuple(got[1]) == (0.5, 0.5, 1.0)
    n = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double").agg(rates.mean(F.col("x")).alias("m"), rates.std(F.col("x")).alias("s"), rates.population_std(F.col("x")).alias("p")).first()
    assert tuple(n) == (1.0, None, 0.0)


def test_json_lines_skip_what_is_broken(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"subject": "A", "hop": 1}\n\nnot json\n[1]\n{"subject": "B", "hop": 2\n{"subject": "C"}\n')
    rows = logs.json_lines(spark, str(tmp_path / "a.jsonl"), logs.SCHEMAS["queue"]).orderBy("line_no").collect()
    assert [(r.subject, r.hop) for r in rows] == [("A", 1), ("C", None)]


def test_queue_prefers_its_snapshot(spark):
    ddl = "subject string, hop int, status string, parent_subject string, parent_hop int, line_no long, event string"
    snap = spark.createDataFrame([("a", 0, "pending", None, None, 1, None), ("a", 0, "done", None, None, 2, None)], ddl)
    events = spark.createDataFrame([("b", 0, "x", None, None, 1, "enqueue")], ddl)
    assert [(r.subject, r.status) for r in logs.queue(snap, events).collect()] == [("a", "done")]
    assert [r.subject for r in logs.queue(snap.limit(0), events).collect()] == ["b"]


def test_csv_sink(spark, tmp_path):
    sinks.csv(spark.createDataFrame([("a", 0.5, None)], "k string, x double, y int"), str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).first().asDict() == {"k": "a", "x": "0.5000", "y": None}


EVENTS = [(1, 1.0, "enqueue", "a", 0, None, None), (2, 2.0, "enqueue", "a", 0, "p", 0), (3, 3.0, "claim", "a", 0, None, None), (4, 4.0, "error", "a", 0, None, None), (5, 5.0, "enqueue", "b", 1, "a", 0), (6, 6.0, "claim", "b", 1, None, None), (7, 7.0, "done", "b", 1, None, None), (8, 8.0, "enqueue", "c", 1, None, None)]


def test_queue_fold_and_its_stream_agree(spark, tmp_path):
    e = spark.createDataFrame(EVENTS, stream.EVENTS)
    batch = {r.subject: r for r in queue.state(e).collect()}
    assert batch["a"].status == "pending" and batch["a"].retries == 1 and batch["a"].retry_at == 9.0 and batch["a"].parent_subject == "p" and batch["b"].status == "done"
    assert [r.subject for r in queue.claim(queue.state(e), 5, 100.0).collect()] == ["a", "c"]
    assert [r.subject for r in queue.claim(queue.state(e), 5, 8.5).collect()] == ["c"]
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream.start(stream.queue_rows(stream.events(spark, str(tmp_path / "in"), files=1)), str(tmp_path / "ck"), str(tmp_path / "rows"))
    q.awaitTermination(120)
    assert {r.subject: tuple(r) for r in stream.latest(spark, str(tmp_path / "rows")).select(*queue.state(e).columns).collect()} == {k: tuple(v) for k, v in batch.items()}


def fold(candidates, seen):
    """The sequential rule, stated plainly."""
    from mosswork.functions.text import NOT_PLURAL

    def one(k):
        w = k.split()[-1]
        if len(w) <= 3 or w in NOT_PLURAL:
            return None
        if w.endswith("ies") and len(w) > 4:
            return k[:-3] + "y"
        if len(w) > 4 and (w.endswith(("ches", "shes")) or w[-3:] in ("ses", "xes", "zes")):
            return k[:-2]
        return k[:-1] if w.endswith("s") and not w.endswith("ss") else None

    def many(k):
        w = k.split()[-1]
        return k + "s" if len(w) > 3 and w not in NOT_PLURAL and not w.endswith("s") else None

    kept, out = set(), []
    for k in candidates:
        r = "plural_variant" if {one(k), many(k)} & seen else "plural_variant_batch" if {one(k), many(k)} & kept else "seen" if k in seen else "batch" if k in kept else "kept"
        out.append(r)
        if r == "kept":
            kept.add(k)
    return out


def test_candidate_dedup_is_sequential(spark):
    import random

    words, rnd = ["city", "cities", "dog", "dogs", "news", "bird", "birds", "boxes", "box", "glass", "tree", "trees"], random.Random(5)
    lists = [[rnd.choice(words) for _ in range(12)] for _ in range(20)]
    seen = {"bird", "boxes", "dogs"}
    rows = [(str(i), 0, l) for i, l in enumerate(lists)] + [("none", 0, None), ("empty", 0, [])]
    got = crawl.deduplicated(spark.createDataFrame(rows, "subject string, hop int, listed array<string>"), F.col("listed"), spark.createDataFrame([(s,) for s in seen], "canon_key string"))
    by = {(r.subject, r.place): r.reason for r in got.collect()}
    for i, l in enumerate(lists):
        assert [by[str(i), p] for p in range(len(l))] == fold(l, seen), l


def test_candidate_dedup_of_documents(spark):
    """Every token of every text is a candidate, in the order of the text; hot words, chains of forms, phrases in other case."""
    import random

    r = random.Random(8)
    texts = [(x.doc_id, [w for w in re.sub(r"[\W]+", " ", x.text.lower()).split(" ") if w]) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    seen = {w for _, ws in texts[:3] for w in ws[::7]}
    made = [(i, [f + r.choice(["", "s", "es", "ses"]) for w in ws if (f := w)]) for i, ws in texts[::4]]
    lists = [(i, ws) for i, ws in texts] + [(10**6 + i, ws) for i, ws in made]
    rows = [(str(i), 0, p, w if p % 3 else w.title()) for i, ws in lists for p, w in enumerate(ws)]
    table = spark.createDataFrame([(str(i), 0, [w if p % 3 else w.title() for p, w in enumerate(ws)]) for i, ws in lists], "subject string, hop int, listed array<string>")
    got = crawl.deduplicated(table.repartition(5), F.col("listed"), spark.createDataFrame([(s,) for s in seen], "canon_key string"))
    by = {(x.subject, x.place): (x.key, x.phrase, x.reason) for x in got.collect()}
    assert len(by) == len(rows)
    of = {}
    for subject, _, place, phrase in rows:
        key, shown, _ = by[subject, place]
        assert shown == phrase
        of.setdefault(subject, []).append(key)
    for subject, keys in of.items():
        assert [by[subject, p][2] for p in range(len(keys))] == fold(keys, seen), subject
    assert {x[2] for x in by.values()} == {"kept", "batch", "seen", "plural_variant", "plural_variant_batch"}


def test_expansion_does_not_depend_on_partitions(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    articles = spark.createDataFrame([("A", "[[B]] [[C]] [[Dogs]]"), ("B", "[[C]] [[E]]\n== See also ==\n[[Z]]"), ("C", "[[A]] [[Dog]] [[F]]")], "subject string, wikitext string")
    decisions = spark.createDataFrame([(x, x != "F", None, i) for i, x in enumerate("BCEFA")] + [("Dogs", True, None, 9)], "phrase string, is_ne boolean, confidence double, line_no int")
    seeds = spark.createDataFrame([("A",)], "subject string")
    runs = []
    for n in (1, 5):
        r = crawl.expand(seeds, articles.repartition(n), decisions, 3, lambda df, name: df.checkpoint())
        runs.append(sorted((x.subject, x.hop, x.parent_subject or "") for x in r.collect()))
    assert runs[0] == runs[1] == [("A", 0, ""), ("B", 1, "A"), ("C", 1, "A"), ("Dogs", 1, "A"), ("E", 2, "B")]


def test_expansion_reads_an_article_once_a_level(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def fetched(text):
        asked.add(1)
        return text

    given = spark.createDataFrame([("A", "[[Bees]] [[Bee]] [[C]]"), ("C", "[[A]] [[D]]")], "subject string, wikitext string")
    decisions = spark.createDataFrame([(x, True, None, 0) for x in ("Bees", "C", "D")], "phrase string, is_ne boolean, confidence double, line_no int")
    articles = given.select("subject", fetched("wikitext").alias("wikitext"))
    r = crawl.expand(spark.createDataFrame([("A",)], "subject string"), articles, decisions, 2, lambda df, name: stored(df))
    assert sorted(x.subject for x in r.collect()) == ["A", "Bees", "C", "D"]
    assert asked.value <= 2 * 2


def test_links_that_lead_nowhere_do_not_move(spark):
    slugs = spark.createDataFrame([("Ada", "Ada"), ("ada", "Ada"), ("bob c", "Bob_C"), ("x", "x")], "key string, slug string")
    rows = [(n, f"[[Nowhere {n}]] [[Ada]] [[ADA]] [[none {n}|x]] [[Bob C]] [[x]] [[ada]]") for n in range(500)]
    articles = spark.createDataFrame(rows, "title long, text string")
    got = {(r.title, r.slug): r.target for r in index.existing_links(articles, slugs).collect()}
    assert got == {(n, s): t for n in range(500) for s, t in (("Ada", "Ada"), ("Bob_C", "Bob C"), ("x", "x"))}
    each = articles.select("title", F.posexplode(F.split("text", " (?=\\[)")).alias("i", "target")).withColumn("target", F.regexp_extract("target", r"\[\[([^|\]]+)", 1))
    left = index._perhaps(each, slugs).groupBy("target").count().collect()
    assert {r.target for r in left} >= {"Ada", "ADA", "Bob C", "x", "ada"} and sum(r["count"] for r in left) < 5 * 500 + 20
    assert index._perhaps(each, slugs.limit(0)).count() == 0


def test_common_entities_are_dealt_by_rows(spark, monkeypatch):
    """Against a plain fold, in tasks of a few members each: as many as there are rows for, whatever the session's partitions are."""
    import random
    from itertools import combinations

    monkeypatch.setattr(reports, "MEMBERS", 20)
    r = random.Random(3)
    rows = list({(r.choice("xy"), r.choice("abcd"), r.randrange(9), r.choice([None, *range(12)])) for _ in range(300)})
    made = reports.common_entities(spark.createDataFrame(rows, "topic string, persona string, subject long, entity long"), ["topic"], "persona")
    got = {(x.topic, x.a, x.b): (x.common_subjects, x.entities_1, x.entities_2, x.shared_entities) for x in made.collect()}
    want = {}
    for t, (a, b) in ((t, p) for t in "xy" for p in combinations("abcd", 2)):
        of = lambda g: {s for u, h, s, _ in rows if (u, h) == (t, g)}
        both = of(a) & of(b)  # noqa: B023
        held = [{e for u, h, s, e in rows if (u, h) == (t, g) and s in both and e is not None} for g in (a, b)]
        want[t, a, b] = (len(both), len(held[0]), len(held[1]), len(held[0] & held[1]))
    assert got == want
    assert f"entity, {-(-len(rows) // 20)})" in re.sub(r"#\d+L?", "", made._jdf.queryExecution().toString())


def test_entries_of_a_list_are_found_without_sorting(spark):
    """Repeats are of canonical keys, within a list alone; lists may be null or empty, or hold nothing that has a key."""
    lists = [["b", "a", "B", "a", "--", "", "c"], None, [], ["a", None, "b"], ["!"], [f"w{i % 700}" for i in range(3000)]]
    rows = spark.createDataFrame(list(enumerate(lists)), "subject int, listed array<string>").repartition(2)
    got = {(x.subject, x.place): (x.phrase, x.key, x.first) for x in crawl._entries(rows).collect()}
    want = {}
    for i, phrases in enumerate(lists):
        before = set()
        for place, phrase in enumerate(phrases or []):
            key = (phrase or "").lower().strip("-!")
            if key:
                want[i, place] = (phrase, key, key not in before)
                before.add(key)
    assert got == want


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.6, 0.8])]
    e = spark.createDataFrame(rows, "id long, e array<float>")
    got = [(r.query_id, r.id) for r in vector.topk(e, e, 1).orderBy("query_id").collect()]
    assert got == [(0, 2), (1, 3), (2, 0), (3, 1)]
    d = {r.position: r.duplicate_of for r in vector.in_batch(e.withColumnRenamed("id", "position"), 0.7).collect()}
    assert d == {0: None, 1: None, 2: 0, 3: 1}
    fixed = spark.range(1).select(vector.decision(F.lit(0.95), F.lit(0.1), F.lit(None).cast("int"), F.lit(True), 0.9, "llm").reason.alias("a"), vector.decision(F.lit(0.5), F.lit(0.95), F.lit(None).cast("int"), F.lit(False), 0.9, "llm").decision.alias("b"), vector.single(F.lit(0.95), 0.9, "reject").reason.alias("c")).first()
    assert tuple(fixed) == ("llm_duplicate", "accept", "above_threshold_reject")


def test_evidence(spark):
    rows = [("s", f"https://{d}/{i}", i) for i, d in enumerate(["www.britannica.com", "britannica.com", "en.wikipedia.org", "nasa.gov", "plain.net"])]
    got = evidence.best_of_each_root(spark.createDataFrame(rows, "g string, url string, position int"), "g", 5).orderBy("rank").collect()
    assert [r.root for r in got] == ["britannica.com", "nasa.gov"]
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    cache = spark.createDataFrame([("n", "a", "1", "2024-01-01 23:59:00"), ("n", "b", "2", "2023-01-01 00:00:00")], "namespace string, key string, value string, written string").withColumn("written", F.col("written").cast("timestamp"))
    assert [r.key for r in evidence.fresh(cache, now, 3600).collect()] == ["a"]


def test_index(spark):
    e = spark.createDataFrame([(0, "Paris city", "the city of light city"), (1, "Rome", "city of seven hills")], "id int, title string, snippet string")
    p = {r.token: r.ids for r in index.postings(e).collect()}
    assert p["city"] == [0, 1] and "of" not in p
    assert {r.token: r.ids for r in index.postings(e, dedupe=False).collect()}["city"] == [0, 0, 0, 1]
    assert [(r.id, r.score) for r in index.search(e, ["city"]).collect()] == [(0, 3), (1, 1)]


def test_recorded_responses(spark):
    body = json.dumps({"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}})
    r = spark.createDataFrame([(body, "ner::A::B::hop=2::chunk=7::start=175::n=25"), (body, "A B::2::7")], "b string, c string").select(logs.answer_text(F.col("b")).alias("t"), logs.usage(F.col("b")).alias("u"), logs.custom_id(F.col("c")).alias("c")).first()
    assert r.t == "hi" and tuple(r.u) == (3, 4) and tuple(r.c) == ("A::B", 2, 7, 175, 25)


def test_queries_over_whole_tables(spark, tmp_path):
    import math
    from collections import Counter

    from mosswork.functions.similarity import STOP_WORDS
    from mosswork.plans import rate_queries as rq

    long = " ".join(f"word{i % 50}" for i in range(4000))
    texts = {1: "stone river stone", 2: long, 3: "river stone word7", 4: "x" * 500 + " river tail", 5: "tail river"}
    rows = [(i, t, "en", None if i == 3 else len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, n, "ARN"[n % 3]) for n in range(1, 8)] + [(1, 7, "A"), (2, 5, "R")]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for i in range(2, 6):
        a, b = set(texts[i].split()), set(texts[i - 1].split())
        want[i, i - 1] = len(a & b) / len(a | b)
    got = {(r.doc_id, r.other): r.jaccard for r in rq.pair_ngram_overlap(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert {(r.doc_id, r.other) for r in rq.combined_similarity(spark, str(tmp_path)).collect()} == set(want)

    def grams(t):
        w = [x for x in t.split() if len(x) > 1 and x not in STOP_WORDS]
        return Counter(w + [" ".join(p) for p in zip(w, w[1:])])

    def cosine(a, b):
        weight = lambda c, o: {g: n * (1 if g in o else 1 + math.log(1.5)) for g, n in c.items()}
        x, y = weight(a, b), weight(b, a)
        return sum(v * y.get(g, 0) for g, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    tf = {r.doc_id: r.cosine for r in rq.tfidf_pairs(spark, str(tmp_path)).collect()}
    assert tf.keys() == {2, 3, 4, 5} and all(abs(tf[i] - cosine(grams(texts[i]), grams(texts[i - 1]))) < 1e-6 for i in tf) and tf[5] > 0
    verdict = {"A": "supported", "R": "refuted", "N": "insufficient"}
    assert Counter((r.subject, r.claim, r.wiki_verdict) for r in rq.claim_explode(spark, str(tmp_path)).collect()) == Counter((k, str(n), verdict[f]) for k, n, f in items)


def test_candidates_and_batches_are_whole(spark, tmp_path, monkeypatch):
    import random

    from mosswork.plans import engine_queries as eq

    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    texts = [(1, " ".join(words + [words[0]])), (2, "alpha beta")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(words[90] + " beta",)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {words[90], "beta"}
    want = {(i, p, w, w in seen) for i, t in texts for p, w in enumerate(t.split())}
    assert {tuple(r) for r in eq.seen_candidates(spark, str(tmp_path)).select("doc_id", "place", "key", "in_seen").collect()} == want
    reasons = {(r.subject, r.place): r.reason for r in eq.pre_ner_dedup(spark, str(tmp_path)).collect()}
    assert len(reasons) == 103 and reasons["1", 80] == "kept" and "kept" not in (reasons["1", 90], reasons["1", 100], reasons["2", 1])

    r = random.Random(3)
    e = [[r.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    e[50], e[51] = list(e[7]), list(e[7])
    e = [[x / sum(y * y for y in v) ** 0.5 for x in v] for v in e]
    spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(e)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(metric, "BLOCK", 16)
    monkeypatch.setattr(metric, "AIM", 8)
    got = {x.position: (x.best_score, x.duplicate_of) for x in eq.in_batch_duplicates(spark, str(tmp_path)).collect()}
    assert got.keys() == set(range(60)) and got[50][1] == 7 and got[51][1] == 7 and got[7][1] is None
    for i in range(60):
        score, other = max((round(sum(a * b for a, b in zip(e[i], e[j])), 12), -j) for j in range(60) if j != i)
        assert abs(got[i][0] - max(score, 0)) < 1e-4 and got[i][1] == (-other if score >= 0.3 and -other < i else None)


def test_expansion_with_stages_and_similarity(spark, tmp_path):
    """A wave's later near repeats, those near what was reached, and what has no vector do not come in (the first of near repeats by a judge's word); articles
    without their payloads are not written."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    articles = spark.createDataFrame([("A", "[[Bird (0.9)]] [[Birdy (0.8)]] [[Low (0.1)]] [[Alpha (0.7)]] [[Bare (0.6)]] [[Tree (0.95)]]"), ("Bird", "[[Never (0.9)]]"), ("Tree", "[[Leaf (0.9)]]")], "subject string, wikitext string")
    names = ["bird", "birdy", "low", "alpha", "bare", "tree", "never", "leaf"]
    decisions = spark.createDataFrame([(n, True, None, i) for i, n in enumerate(names)], "phrase string, is_ne boolean, confidence double, line_no int")
    axis = {"a": [1.0, 0, 0, 0], "alpha": [1.0, 0, 0, 0], "bird": [0, 1.0, 0, 0], "birdy": [0, 1.0, 0, 0], "tree": [0, 0, 1.0, 0], "leaf": [0, 0, 0, 1.0], "never": [0, 0, 0.6, 0.8]}
    embeddings = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in axis.items()], "canon_key string, e array<double>")
    outlines = spark.createDataFrame([("A", 0), ("Tree", 1)], "subject string, hop int")
    r = crawl.expand(spark.createDataFrame([("A",)], "subject string"), articles, decisions, 3, lambda df, name: df.checkpoint(), embeddings=embeddings, similarity=0.9, answers=spark.createDataFrame([("bird", False), ("birdy", False)], "canon_key string, same boolean"), stages=(outlines,), confidence=0.5)
    got = {x.canon_key: x.hop for x in r.collect()}
    assert got.pop("a") == 0 and got.pop("tree") == 1 and got.pop("leaf") == 2 and len(got) == 1 and set(got) <= {"bird", "birdy"}
    known = spark.createDataFrame([("alpha", False)], "canon_key string, same boolean")
    wave = spark.createDataFrame([("alpha", "Alpha", 1), ("bare", "Bare", 2)], "canon_key string, phrase string, position long")
    d = crawl.distinct_enough(wave, spark.createDataFrame([("a",)], "canon_key string"), embeddings, 0.9, known).collect()
    assert [(x.canon_key, x.reason) for x in d] == [("alpha", "llm_distinct")]


def test_batch_names_and_site_links(spark):
    from mosswork.operators import reports

    e = spark.createDataFrame([("s", ["https://a.b/1", None, "x"])], "s string, u array<string>")
    assert e.select(evidence.snippet_domains(F.col("u")).alias("d")).first().d == ["a.b"]
    c = spark.createDataFrame([("u", i) for i in range(60)], "g string, i int")
    assert sorted({(r.chunk, r.start) for r in reports.chunked(c, ["g"], "i").collect()}) == [(0, 0), (1, 25), (2, 50)]
