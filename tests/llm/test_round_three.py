"""Merkle manifest, benchmark decontamination and spelling variants against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("mosswork.llm")
from mosswork.llm import decontamination, manifest, spelling  # noqa: E402


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Levels of a tree of eights."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_path(levels, i):
    out = []
    for nodes in levels[:-1]:
        lo = i // 8 * 8
        out.append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 8])))
        i //= 8
    return out


def plain_manifest(rows):
    """rows: (id, group, leaf) to a counter of (id, group, index, leaf, subroot, root, steps)."""
    groups = collections.defaultdict(list)
    for i, g, leaf in rows:
        groups[g].append((i is not None, i or 0, leaf, i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = plain_tree([trees[g][-1][0] for g in order])
    out = collections.Counter()
    for k, g in enumerate(order):
        for n, (*_, leaf, i) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            out[i, g, n, leaf, trees[g][-1][0], top[-1][0], tuple(plain_path(trees[g], n) + plain_path(top, k))] += 1
    return out


def shown(df):
    return collections.Counter((r.doc_id, r.grp, r.idx, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.steps)) for r in df.collect())


def test_manifest_of_hostile_rows(spark):
    r = random.Random(3)
    rows = [(r.choice([None, i, i // 2]), r.choice([None, "", "en", "é", "zz", "en"]), r.choice([None, "", "x" * 50_000, f"text {i} é"]), None, i, "clash") for i in range(300)]
    rows += rows[:9]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string, n_chars long, `grp` string").repartition(5)
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = plain_manifest([(i, g, sha(f(i), f(s), f(g), f(n), f(t))) for i, g, t, s, n, _ in rows])
    assert shown(manifest.manifest(docs)) == want
    assert manifest.manifest(docs.limit(0)).count() == 0
    one = manifest.manifest(docs.limit(1)).first()
    assert one.steps == [] and one.leaf == one.subroot == one.root


@pytest.mark.parametrize("most", [manifest.MOST_COUNTS, 0])
def test_manifest_of_one_large_group(spark, monkeypatch, most):
    """More than one block; with counts broadcast and joined."""
    monkeypatch.setattr(manifest, "MOST_COUNTS", most)
    n = 8 * manifest.BLOCK + 77
    docs = spark.range(0, n, 1, 7).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n - 3, "a").alias("lang"))
    made = manifest.manifest(docs, fields=("doc_id", "lang"))
    want = plain_manifest([(i, g, sha(f"{len(str(i))}:{i}", "1:a" if g else "-")) for i in range(n) for g in ["a" if i < n - 3 else None]])
    assert shown(made) == want
    held = made.select((manifest.fold(F.col("leaf"), F.col("steps")) == F.col("root")).alias("ok"), (manifest.fold(F.col("subroot"), F.col("steps")) == F.col("root")).alias("forged"))
    assert held.filter("ok").count() == n and held.filter("forged").count() == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(text, items):
    w, hit, found = plain_words(text), set(), set()
    for item, t in items:
        b = plain_words(t)
        n = min(10, len(b))
        wanted = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in wanted:
                hit.update(range(k, k + n))
                found.add("null" if item is None else str(item))
    spans = []
    for k in sorted(hit):
        if spans and spans[-1][1] == k:
            spans[-1][1] = k + 1
        else:
            spans.append([k, k + 1])
    return len(w), spans, sorted(found)


def leaky(seed, n=80):
    """Items of one word to forty, of equal windows, of no word; texts that hold parts of them, often, at their ends, in other case."""
    r = random.Random(seed)
    word = lambda: r.choice(["a", "B", "é", "x1", "ß9", "longer", "The", "日本", "q" * 30])
    passage = lambda k: "".join(word() + r.choice([" ", ", ", "\n", "-", "_"]) for _ in range(k))
    items = [(i, passage(r.choice([0, 3, 9, 10, 11, 25, 40]) if i else 4)) for i in range(24)]
    items += [(3, passage(12)), (None, passage(14)), (50, None), (51, " -- "), (52, items[5][1] + passage(15))]
    docs = []
    for i in range(n):
        parts = [passage(r.randrange(30))]
        for _ in range(r.randrange(3)):
            t = r.choice(items)[1] or ""
            parts += [t if i % 3 else t.upper().replace("É", "é").replace("SS", "ß"), passage(r.randrange(5))]
        docs.append((i if i % 9 else None, "".join(parts), i, "x"))
    return docs + [(500, None, 0, None), (501, "", 0, None), (501, "...", 0, None), (502, passage(4000) + items[7][1], 0, None), (502, passage(4000) + items[7][1], 0, None)], items


@pytest.mark.parametrize("most", [decontamination.MOST_WINDOWS, 40])
def test_decontamination_of_hostile_rows(spark, most):
    docs, items = leaky(5)
    table = spark.createDataFrame(docs, "doc_id long, text string, row long, docs string").repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, window int")
    want = collections.Counter()
    for i, t, *_ in docs:
        n, spans, found = plain_hits(t, items)
        want[i, n, tuple(map(tuple, spans)), tuple(found)] += 1
    index = decontamination.index(table)
    got = decontamination.search(index, bench, most=most)
    assert collections.Counter((r.doc_id, r.n_words, tuple((s.start, s.end) for s in r.spans), tuple(r["items"])) for r in got.collect()) == want
    assert sum(1 for k in want if k[2]) > 20
    assert {len(r.spans) for r in decontamination.search(index, bench.limit(0)).collect()} == {0}
    assert decontamination.search(decontamination.index(table.limit(0)), bench).count() == 0


def test_long_documents_are_cut(monkeypatch):
    """Shards far smaller than a document; the pieces' hits are those of the whole."""
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 37)
    docs, items = leaky(6)
    docs = [d for d in docs if len(d[1] or "") < 20_000]
    monkeypatch.setattr(decontamination.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    made = list(decontamination._indexed([pa.RecordBatch.from_pydict({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": [d[1] or "" for d in docs]})]))
    assert len(made) > 50
    pairs = {("null" if i is None else str(i), b" ".join(w[k : k + 10])) for i, t in items for w in [decontamination.words(t or "")] if w for k in range(max(1, len(w) - 9))}
    told = type("B", (), {"value": decontamination._Block(sorted(pairs))})
    hits = collections.defaultdict(lambda: [0, set(), set()])
    for b in decontamination._searcher(told)(made):
        for h in b.to_pylist():
            hits[h["row"]][0] = h["n_words"]
            hits[h["row"]][1].update(k for s in h["spans"] for k in range(s["start"], s["end"]))
            hits[h["row"]][2].update(h["items"])
    for k, (_, t, *_) in enumerate(docs):
        n, spans, found = plain_hits(t, items)
        assert hits[k] == [n, {x for a, b in spans for x in range(a, b)}, set(found)]


def test_suffixes_and_ranks():
    r = np.random.RandomState(2)
    for n in (1, 2, 50, 3000):
        s = np.append(r.randint(2, 5, n - 1) if n > 1 else [], 1).astype(np.int64)
        want = sorted(range(n), key=lambda i, s=s: s[i:].tolist())
        assert decontamination.suffixes(s).tolist() == want
    s = np.tile([7, 8], 5000)
    assert decontamination.suffixes(np.append(s, 1))[:3].tolist() == [10000, 9998, 9996]
    text = r.randint(0, 11, 777)
    made = decontamination.Wavelet.of(text, 4)
    symbols, places = r.randint(0, 11, 300), r.randint(0, 778, 300)
    got = made.rank(symbols, places) - made.rank(symbols, np.zeros(300, np.int64))
    assert got.tolist() == [int((text[:p] == c).sum()) for c, p in zip(symbols, places, strict=True)]
    assert made.access(places[places < 777])[0].tolist() == text[places[places < 777]].tolist()


def one_apart(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    p = 0
    while p < min(len(u), len(v)) and u[p] == v[p]:
        p += 1
    return u[p + (len(u) >= len(v)) :] == v[p + (len(v) >= len(u)) :]


def plain_variants(words, ratio=10):
    out = {}
    near = {u: [v for v in words if one_apart(u, v)] for u in words}
    form = {}
    for u, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[u] = best if best is not None and words[best] >= ratio * words[u] else None
    for u in words:
        root = u
        while form[root] is not None:
            root = form[root]
        out[u] = (form[u], root, words[u], len(near[u]), words[form[u]] if form[u] is not None else None)
    return out


def dictionary(seed, letters, n, sizes):
    r = random.Random(seed)
    words = {}
    for _ in range(n):
        w = "".join(r.choice(letters) for _ in range(r.choice(sizes)))
        for _ in range(r.randrange(3)):
            words[w] = int(10 ** (r.random() * 5)) + 1
            k = r.randrange(len(w) + 1)
            w = w[:k] + r.choice([w[k + 1 :], r.choice(letters) + w[k:], r.choice(letters) + w[k + 1 :]])
    return words


def test_variants_of_hostile_words(spark, monkeypatch):
    words = dictionary(1, "abé", 250, range(1, 9)) | dictionary(2, "ab日😀", 60, range(4, 7)) | {"": 3, "x" * 5000: 2, "x" * 4999 + "y": 400, "x" * 4998 + "y": 7}
    rows = [(w, n, 1) for w, n in words.items()] + [(None, 5, 1)]
    rows += [(w, 2, 1) for w in list(words)[:20]]
    words |= {w: words[w] + 2 for w in list(words)[:20]}
    table = spark.createDataFrame(rows, "word string, n long, root int")
    want = plain_variants(words)
    assert sum(1 for x in want.values() if x[1] != x[0] and x[0] is not None) > 5
    for most in (spelling.MOST_ROWS, 8):  # 8: nearly all blocks are subdivided before they are dealt out
        monkeypatch.setattr(spelling, "MOST_ROWS", most)
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group(table).collect()}
        assert got == want
    assert spelling.group(table.limit(0)).count() == 0


@pytest.mark.parametrize("pairs", [0, 3, 400])
def test_pairs_are_found_once(monkeypatch, pairs):
    """Whatever blocks are subdivided; small letters make every block skewed."""
    monkeypatch.setattr(spelling, "MOST_PAIRS", pairs)
    monkeypatch.setattr(spelling, "CHUNK_PAIRS", 50)
    words = sorted(dictionary(4, "ab", 900, range(1, 10)))
    for size in range(10):
        own = [w for w in words if len(w) in (size, size + 1)]
        want = collections.Counter(frozenset((u, v)) for u in own for v in own if len(u) == size and u < v and one_apart(u, v)) + collections.Counter(frozenset((u, v)) for u in own for v in own if len(u) == size < len(v) and v < u and one_apart(u, v))
        got = collections.Counter()
        for side in (0, 1):
            turned = [w[::-1] if side else w for w in own]
            keys = sorted({w[: size // 2] for w in turned})
            blocks = np.array([keys.index(w[: size // 2]) for w in turned], np.int64)
            for i, j in spelling.neighbours(turned, blocks, size, size // 2, 0, spelling.NO_CAP, size // 2 if side else spelling.NO_CAP) if own else ():
                got.update(frozenset((own[a], own[b])) for a, b in zip(i.tolist(), j.tolist(), strict=True))
        assert got == want


def test_runs(spark):
    got = spark.createDataFrame([("ÀÉlan x-Straße, ABCdef_gh日é",), (None,)], "t string").select(spelling.runs(F.col("t"), 2).alias("r")).collect()
    assert got[0].r == ["ÀÉlan", "straße", "abcdef", "gh"] and got[1].r is None


def test_a_long_conversation_is_rendered(spark):
    """Forty thousand turns: loss spans by running totals."""
    import time

    from mosswork.llm import chat_format

    n = 40_000
    rows = spark.range(0, n, 1, 4).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("é^"), "id").alias("text"))
    began = time.time()
    made = chat_format.render(chat_format.reconstruct(rows)).first()
    assert time.time() - began < 30
    assert len(made.loss_spans) == n // 2
    for k in (0, 1, 777, n // 2 - 1):
        s = made.loss_spans[k]
        assert made.formatted[s.start : s.start + s.length] == f"é^^{2 * k + 1}"
