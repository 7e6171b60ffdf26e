"""Ranked search from blocks of postings against a scan of all entries."""

import random

from mosswork.operators import index


def test_blocks_give_the_scan_and_skip_parts(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(300)] + ["cat", "concat", "scatter", "dog", "the"]
    rows = []
    for i in range(4000):
        title = " ".join(r.choice(words) for _ in range(r.randint(0, 4)))
        text = " ".join(r.choice(words[:300]) for _ in range(12))
        if 1000 <= i < 1040:  # a promising stretch
            title, text = f"Cat Dog {title}", f"{text} cat dog"
        rows.append((i, title.title() if i % 2 else title, text if i % 50 else None))
    entries = spark.createDataFrame(rows, "id long, title string, snippet string").repartition(6)
    made = index.blocks(entries, 32)
    for query, k in ((["cat", "dog"], 30), (["cat"], 50), (["w7", "w8", "w9"], 20), (["the", "w1"], 10), (["nowhere"], 10), (["cat", "dog", "cat"], 4000), ([], 5)):
        found = index.Ranked(made, query, k, first=3) if query else None
        want = [(x.id, x.score) for x in index.search(entries, list(dict.fromkeys(query)), k).collect()]
        got = [(x.id, x.score) for x in found.rows.collect()] if found else []
        assert got == want, query
        if query == ["cat", "dog"]:
            assert found.read < 0.25 * found.all, (found.read, found.all)
    assert made.agg({"n": "max"}).first()[0] <= 32
