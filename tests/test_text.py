from pyspark.sql import functions as F

from mosswork.functions import text as tx
from mosswork.functions import wikitext as wk
from mosswork.operators import salvage


def one(spark, value, f, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(f(F.col("x")).alias("y")).first().y


def test_canonical_keys_meet(spark):
    rows = spark.createDataFrame([(x,) for x in ("MIT", "mit", "M.I.T.", "COVID-19", "covid 19", "ﬁsh", "fish", None)], "t string")
    got = {r.t: r.canon_key for r in tx.with_canon_key(rows, "t").collect()}
    assert got["MIT"] == got["mit"] == got["M.I.T."] == "mit"
    assert got["COVID-19"] == got["covid 19"] == "covid 19"
    assert got["ﬁsh"] == got["fish"] and got[None] is None


def test_singular_and_plural(spark):
    for key, s, p in (("cities", "city", None), ("churches", "church", None), ("physics", None, None), ("big dogs", "big dog", None), ("dog", None, None), ("bird", None, "birds"), ("class", None, None), ("boxes", "box", None)):
        assert one(spark, key, tx.singular) == s and one(spark, key, tx.plural) == p, key


def test_titles_with_confidence(spark):
    assert tuple(one(spark, "A (0.97)", tx.title_and_confidence)) == ("A", 0.97)
    assert tuple(one(spark, "A (2.5)", tx.title_and_confidence)) == ("A (2.5)", None)


def test_links_and_sections(spark):
    text = "[[A (0.97)]] [[Star Wars: X]]\n== References ==\n[[D]]\n=== sub ===\n[[E]]"
    assert one(spark, text, wk.links) == ["A (0.97)", "D", "E"]
    assert one(spark, text, wk.links_outside) == ["A (0.97)", "E"]
    assert one(spark, text, wk.section_count) == 2


def test_excerpt_and_snippets(spark):
    assert one(spark, "{{a|{{b}}}}'''Bold''' [[X|link]] words here", lambda c: wk.excerpt(c, 3)) == "Bold link words"
    words = " ".join(map(str, range(350)))
    got = one(spark, words, wk.snippets)
    assert [g.split()[0] for g in got] == ["0", "100", "200", "300"][: len(got)] and got[-1].endswith("349")
    assert one(spark, "", wk.snippets) == [] and len(one(spark, "a b", wk.snippets)) == 1


def test_refusals_buckets_and_coercion(spark):
    assert one(spark, "Sorry, unable to GENERATE an article.", tx.is_refusal) and one(spark, None, tx.is_refusal) and not one(spark, "Paris is", tx.is_refusal)
    assert [one(spark, h, tx.hop_bucket, "x int") for h in (-1, 0, 4, 9)] == ["hop0", "hop0", "hop4", "hop5plus"]
    assert one(spark, "3.7", tx.as_int) in (0, 3) and one(spark, "x", tx.as_int) == 0


def test_salvage():
    assert salvage.first_object('```json\n{"a": [1, 2,]}\n```') == {"a": [1, 2]}
    assert salvage.first_object('x {"a": "b') == {"a": "b"}
    assert salvage.first_object("nothing") is None
    assert salvage.phrases("- Paris: true")[1] == "regex_simple"
    assert [v["verdict"] for v in salvage._verdicts({"verdicts": [{"idx": 1, "verdict": "True"}, {"idx": 1, "verdict": "false"}]}, 2)] == ["refuted", "insufficient"]
    assert salvage.first_object('{"a": 1, "b":') == {"a": 1} == salvage.first_object('{"a": 1 "b": 2}') and salvage.first_object('{"a": tru') == {}
    assert salvage.first_object('{"a": "line\nbreak", “b”: "c\\d",}') == {"a": "line\nbreak", "b": "c\\d"}
    assert salvage.first_object('{"x": ~' + "y" * 600 + '"verdict" {"idx": 2, "verdict": "True"}')["verdicts"][0]["idx"] == 2
    assert salvage.balanced('say {"a": "}"} or [1]') == {"a": "}"} and salvage.balanced("[1, 2] {bad}") == [1, 2] and salvage.balanced(None) == {}
    assert salvage.phrases('{"x": [{"phrases": [{"phrase": "A", "is_ne": 1}]}]}', True)[1] == "dict_nested" and salvage.phrases('{"phrases": [{"phrase": "A"}]}', True)[1] == "dict"
    assert salvage.phrases("Paris > true")[1] == "empty" and salvage.phrases('{"phrases": []}') == ([], "json")
    assert salvage.response_text({"output": [{"content": [{"text": "a"}, {"text": "b"}]}]}) == "ab" and salvage.response_text({"z": {"id": "a very long name", "y": ["text"]}}) == "text"


def test_pages():
    from mosswork.operators import pages

    assert pages.box("{{Infobox x|name=[[A|Ann]]|image=q.png|k={{d|1|2}}|w=20px|on=yes}} rest") == ([("name", "[[A|Ann]]"), ("k", "1, 2")], " rest")
    shown = {"{{ubl|a|{{lang|de|M}}|x=1}}": "a, M", "{{start date|1916|3|7}}": "7 March 1916", "{{convert|100|km|mi}}": "100 km", "{{cite web|x}}": "", "{{increase|5}}": "▲ 5", "{{coord|1|2|3|4|5}}": "1, 2, 3, 4...", "a {{open": "a open", "{{birth date|1900|x}}": "1900 x"}
    assert {k: pages.resolved(k) for k in shown} == shown
    assert pages.inline("'''B''' [[A|x]] [[Category:Cats]] [[gone]] ]]", {"A": "A", "cats": "C"}) == '<b>B</b> <a href="A.html">x</a> <a href="C.html">Category:Cats</a> gone '
    body, guessed = pages.blocks("== One ==\ntext\nmore\n\n== History The city is old\n=== Two ===\nx", {}, "City")
    assert guessed and body.split("\n") == ['<h2 id="one">One</h2>', "<p>text more</p>", '<h2 id="history">History</h2>', "<p>The city is old</p>", '<h3 id="two">Two</h3>', "<p>x</p>"] and len(pages.contents(body)) == 3


def test_small_settings(spark):
    assert [one(spark, u, tx.file_extension) for u in ("https://x.org/a.PNG?w=1", "https://x.org/a", "b.webp")] == [".png", ".jpg", ".webp"]
    now = F.lit("2026-01-01 10:00:00").cast("timestamp")
    told = ("Limit resets at: 2026-01-01 10:00:30 UTC", "x Limit resets at:2026-01-01 10:01:59", "Limit resets at: 2026-01-01 10:02:00", "Limit resets at: 2026-01-01 09:59:00", "retry in 2m", "Limit resets at: 2026-13-01 10:00:30")
    assert [one(spark, m, lambda c: tx.wait_seconds(c, now)) for m in told] == [30.5, 119.5, 8.0, 8.0, 8.0, 8.0]
    assert [one(spark, x, tx.slug) for x in (" a  b! ", "A (x)?!y")] == ["a__b_", "A_(x)_y"] and [one(spark, x, tx.safe_file_name) for x in (" a.b  c?? ", "x" * 200)] == ["a_b__c__", "x" * 120]
    assert one(spark, " ", lambda c: tx.first_setting(c, F.lit("global"))) == "global"


def test_page_text_and_legacy_claims(spark):
    assert salvage.page_text("<nav>menu</nav><article>A <b>b</b> &amp; c<script>x</script></article>tail") == "A b & c"
    assert salvage.page_text("<p>only</p>") == "only"
    row = spark.createDataFrame([([(" a ", "TRUE", 2.0, [3, 1, 3]), ("", "false", 0.1, None)],)], "x array<struct<claim:string,verdict:string,confidence:double,sources:array<int>>>")
    got = row.select(salvage.legacy_claims(F.col("x")).alias("y")).first().y
    assert [tuple(g) for g in got] == [("a", "true", 1.0, [1, 3])]


def test_templates_to_their_end(spark):
    """Random braces against removal one by one; deep nests and braces without a partner end soon."""
    import random
    import re
    import time

    r = random.Random(9)
    texts = ["".join(r.choice(["{", "{{", "}", "}}", "a", "b ", "\n", "[", "|"]) for _ in range(r.randrange(40))) for _ in range(3000)]
    texts += ["{{a" * 200 + "}}" * 200 + "end", "{{" * 50 + "x", "", None]

    def plain(t):
        while t is not None and (n := re.sub(r"\{\{[^{}]*\}\}", "", t)) != t:
            t = n
        return t

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    got = {x.i: x.w for x in df.select("i", wk.without_templates(F.col("t")).alias("w")).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]
    long = spark.createDataFrame([("{{ open " + "{{a}} text " * 20_000 + "} }} " * 20_000,)], "t string")
    began = time.time()
    assert long.select(F.length(wk.without_templates(F.col("t")))).first()[0] > 0 and time.time() - began < 20
