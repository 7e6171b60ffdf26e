"""Readers, run folders and writers over small files."""

import json
import pytest
import os

from pyspark.sql import functions as F

from mosswork.functions import text as tx
from mosswork.operators import index, pages
from mosswork.sources import array, folders, logs, runs, sinks


def lines(path):
    return [x for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


def test_documents_and_titles(spark, tmp_path):
    assert logs.document(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "bad.json").write_text("{no")
    (tmp_path / "ok.json").write_text('{"a":\n 3}')
    assert logs.document(spark, str(tmp_path / "bad.json"), "a int").count() == 0 and logs.document(spark, str(tmp_path / "ok.json"), "a int").first().a == 3
    for name, text in (("l.txt", "A  b\n\n c \n"), ("t.json", '{"titles": ["A b", " c", ""]}'), ("o.json", '{"topics": ["A b", "c"]}'), ("a.json", '["A b", "c"]')):
        (tmp_path / name).write_text(text)
        assert [r.title for r in logs.titles(spark, str(tmp_path / name)).orderBy("line_no").collect()] == ["A b", "c"], name
    assert logs.line_count(spark, str(tmp_path / "l.txt")).first().lines == 2
    seen = spark.createDataFrame([("c",)], "canon_key string")
    assert [r.title for r in logs.preload(logs.titles(spark, str(tmp_path / "l.txt")), seen, 5, tx.canon_key).collect()] == ["A b"]
    assert logs.preload(logs.titles(spark, str(tmp_path / "l.txt")), seen.limit(0), 1, tx.canon_key).count() == 1


def test_first_existing_articles(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"subject": "A", "wikitext": "t"}\n{"subject": "B"}\n{"subject": "A", "wikitext": "u"}\n')
    got = logs.first_existing(spark, "subject string, wikitext string", str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl"))
    assert runs.whole_articles(got).count() == 2 and sorted(r.subject for r in runs.subjects(got).collect()) == ["A", "B"]
    assert logs.first_existing(spark, "subject string, wikitext string", str(tmp_path / "none")).count() == 0


def test_run_folders(spark, tmp_path):
    for d, names in (("x", ["queue.jsonl", "articles_wikitext.jsonl"]), ("x/deep", ["queue.json", "articles_wikitext.jsonl"]), ("y", ["queue.json"]), ("z/w", ["queue.json", "articles_wikitext.jsonl"])):
        (tmp_path / d).mkdir(parents=True, exist_ok=True)
        for n in names:
            (tmp_path / d / n).write_text("{}")
    got = [r.dir.rsplit(str(tmp_path), 1)[1] for r in runs.run_dirs(runs.listed(spark, str(tmp_path))).collect()]
    assert sorted(got) == ["/x", "/z/w"]


def test_counts_under_other_names(spark):
    d = spark.createDataFrame([("0", "5", None), ("7", "5", "x")], "candidates string, ner_candidates string, other string")
    assert [r.n for r in logs.aliased(d, n=["candidates", "ner_candidates", "gone"], m=["other"]).collect()] == [5, 7]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("b", 1, 0.5), ("a", 2, None)], "subject string, hop int, x double")
    whole = lambda name: json.loads((tmp_path / name / "array.json").read_text())
    sinks.json_array(d, str(tmp_path / "array"), "hop")
    assert whole("array") == [{"subject": "b", "hop": 1, "x": 0.5}, {"subject": "a", "hop": 2}]
    sinks.json_array(d.limit(0), str(tmp_path / "none"))
    assert whole("none") == []
    sinks.rows_csv(str(tmp_path / "csv"), d.select("subject", "hop"), d.select("x", "subject"))
    rows = [r.asDict() for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()]
    assert len(rows) == 4 and list(rows[0]) == ["subject", "hop", "x"] and {"subject": "b", "hop": None, "x": "0.5000"} in rows
    sinks.rows_csv(str(tmp_path / "empty"), d.limit(0))
    assert lines(tmp_path / "empty") == ["empty"]
    sinks.queue_snapshot(d, str(tmp_path / "snap"), d.withColumn("line_no", F.col("hop")), 1)
    assert [r["subject"] for r in whole("snap/queue")] == ["b", "a"] and len(whole("snap/articles")) == 1
    sinks.sorted_keys(d, "subject", str(tmp_path / "keys"))
    assert lines(tmp_path / "keys") == ["a", "b"]
    sinks.audit(d, d, d.limit(1), str(tmp_path / "audit"))
    assert (tmp_path / "audit" / "claims" / "subject=a").exists() and len(lines(tmp_path / "audit" / "manifest")) == 1
    e = spark.createDataFrame([(0, "Paris city", "light"), (1, "Rome", "city hills")], "id int, title string, snippet string")
    sinks.search_index(index.postings(e), str(tmp_path / "index"))
    assert {"token": "city", "part": 0, "ids": [0, 1]} in [json.loads(x) for x in lines(tmp_path / "index")]
    page = spark.createDataFrame([("A", "== One ==\n[[B]]", {"B": "b"}, "")], "t string, x string, m map<string,string>, g string").select(F.lit("a").alias("slug"), pages.rendered("t", "x", "m", "g").page.alias("page"))
    pages.written(page, str(tmp_path / "site"))
    assert '<a href="b.html">B</a>' in "\n".join(lines(tmp_path / "site" / "slug=a"))


def test_queue_metrics_of_all_stages(spark):
    from mosswork.operators import queue

    rows = spark.createDataFrame([("ner", 0, "done"), ("ner", 1, "pending"), ("sim", 0, "failed")], "stage string, hop int, status string")
    assert sorted(tuple(r) for r in queue.metrics(rows, 0, "stage").collect()) == [("ner", 1, 0, 1, 0), ("sim", 0, 0, 0, 1)]


def test_one_array_from_many_tasks(spark, tmp_path):
    """The bytes are those of one writer, and no task wrote them all."""
    d = spark.range(0, 20_000, 1, 7).select(F.xxhash64("id").alias("k"), F.concat(F.lit("é \"quoted\"\n"), "id").alias("text"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("maybe"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = []
    replaced, array.os.replace = array.os.replace, lambda a, b: (seen.append(json.loads(open(f"{os.path.dirname(a)}/parts.json").read())["parts"]), replaced(a, b))
    try:
        sinks.json_array(d, str(tmp_path / "a"), "k")
        sinks.json_array(d, f"file://{tmp_path}/b", "k")
    finally:
        array.os.replace = replaced
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = [r.j for r in d.sort("k").select(F.to_json(F.struct("k", "text", "maybe")).alias("j")).collect()]
    want = ("[\n" + ",\n".join(rows) + "\n]\n").encode()
    assert (tmp_path / "a" / "array.json").read_bytes() == want == (tmp_path / "b" / "array.json").read_bytes()
    assert all(len(parts) >= 4 and max(p["rows"] for p in parts) < 12_000 for parts in seen) and len(seen) == 2
    assert [x.name for x in tmp_path.iterdir() if "parts" in x.name] == []
    with pytest.raises(ValueError):
        sinks.json_array(d, "s3a://bucket/x", "k")


def test_run_folders_as_a_source(spark, tmp_path):
    """Files are chosen before they are opened, and lines are numbered as an editor does."""
    for run, log, text in (("a", "articles", '{"x": 1}\n\n{"x": 2\r\n{"x": 3}'), ("a/deep", "queue", '{"x": 4}\n[5]\n'), ("b", "articles", ""), ("b", "queue", "é\n" * 4500)):
        (tmp_path / run).mkdir(parents=True, exist_ok=True)
        (tmp_path / run / f"{log}.jsonl").write_bytes(text.encode())
    (tmp_path / "a" / "other.txt").write_text("x")
    read = folders.lines(spark, str(tmp_path))
    got = sorted((r.run, r.log, r.line_no, r.value) for r in read.filter("run <> 'b'").collect())
    assert got == [("a", "articles", 1, '{"x": 1}'), ("a", "articles", 2, ""), ("a", "articles", 3, '{"x": 2'), ("a", "articles", 4, '{"x": 3}'), ("a/deep", "queue", 1, '{"x": 4}'), ("a/deep", "queue", 2, "[5]")]
    assert [r.line_no for r in read.filter("run = 'b' and log = 'queue'").sort("line_no").collect()] == list(range(1, 4501))
    assert {tuple(r) for r in folders.counts(read).collect()} == {("a", "articles", 3, 2, 1), ("a/deep", "queue", 2, 1, 1), ("b", "queue", 4500, 0, 4500)}
    assert sorted(tuple(r) for r in folders.objects(read, "x int").collect()) == [("a", "articles", 1, 1), ("a", "articles", 4, 3), ("a/deep", "queue", 1, 4)]
    # one file of four is a partition where the filters choose it
    assert read.rdd.getNumPartitions() == 4 and folders.lines(spark, str(tmp_path), ["a", "zz"], ["articles"]).rdd.getNumPartitions() == 1
    os.chmod(tmp_path / "b" / "queue.jsonl", 0)
    assert folders.lines(spark, str(tmp_path), ["a"]).count() == 4
    assert folders.lines(spark, str(tmp_path), ["nowhere"]).count() == 0 == folders.lines(spark, str(tmp_path / "none")).count()
