"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat_format, decontamination, exact_dedup, line_dedup, manifest, ngram_join, packing, quality, secret_scan, spelling, suffix_dedup

#: The folder of public vocabulary files is a parameter; the package that holds them names it.
WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return told.select("doc_id", "lang", "perplexity", "keep")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(_table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: count(lambda s: s.kind == k)
    return found.select(
        "doc_id",
        *(of_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(listed(F.filter("spans", lambda s: s.kind != "opaque")), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        count(lambda s: s.live).alias("n_live"),
        count(lambda s: ~s.live).alias("n_example"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_dedup(line_dedup.dedup(_table(spark, sf_dir, "documents")))


def op4_line_dedup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op4, with passages of one or two lines and over 50 words, which op4's SQL does not have."""
    return _line_dedup(line_dedup.dedup(_table(spark, sf_dir, "documents"), min_words=50))


def _line_dedup(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r.end - r.start)
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of", "n_links")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary(WORDS))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary(BYTES))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    log = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat_format.parse(chat_format.render(chat_format.reconstruct(log)))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(hit, F.translate("text", "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))).otherwise(F.col("text"))
    received = manifest.digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), changed)
    made = manifest.manifest(docs, also={"received": received})
    return made.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof_text(F.col("steps")), 256).alias("proof_sha256"), manifest.fold(F.col("received"), F.col("steps")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.search(decontamination.index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in 31 of a document has lost a code point, so that there are variants."""
    found = _table(spark, sf_dir, "documents").select("doc_id", F.explode(spelling.runs(F.col("text"), 7)).alias("w"))
    h, size = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("w")).cast("binary")), F.char_length("w")
    cut = (F.col("h") % size).cast("int")
    lost = F.concat(F.substring("w", F.lit(1), cut), F.substring("w", cut + 2, size))
    words = found.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, lost).otherwise(F.col("w")).alias("word")).filter(F.char_length("word") >= 7)
    return spelling.group(words.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_secret_scan, op3_exact_dedup, op4_line_dedup, op4_line_dedup_passages, op5_suffix_dedup, op6_ngram_join, op7_best_fit_packing, op8_bpe, op9_ann, op10_chat_format, op11_merkle_manifest, op12_benchmark_decontamination, op13_spelling_variants)}

def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of a string's UTF-8 bytes."""
    byte = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)"
    return f"xor(4294967295, list_reduce([4294967295::BIGINT] || {byte}, lambda a, b: {bits}))"


def _merkle_sql(levels: int = 8, tops: int = 3) -> str:
    """A level is a table of nodes with their siblings; 8 levels hold 2 * 10**6 rows of a language, three 64 languages or more."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    out = [f"""t AS (SELECT *, CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM documents)""",
        f"x AS (SELECT doc_id, coalesce('+' || lang, '') AS g, {leaf('text')} AS leaf, {leaf('changed')} AS received FROM t)",
        "n0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d, count(*) OVER (PARTITION BY g) AS m, doc_id, leaf, received FROM x)"]
    side = lambda a, b: f"coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN {a} AND {b}), '')"

    def levels_of(n: str, s: str, count: int) -> None:
        for k in range(count):
            out.append(f"{s}{k} AS (SELECT g, i, m, {side('UNBOUNDED PRECEDING', '1 PRECEDING')} AS b, {side('1 FOLLOWING', 'UNBOUNDED FOLLOWING')} AS a FROM {n}{k})")
            out.append(f"{n}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN any_value(m) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (any_value(m) + 7) // 8 AS m FROM {n}{k} GROUP BY g, i // 8)")

    def walk(s: str, first: str, count: int, to: str) -> None:
        for k in range(count):
            out.append(f"""{to}{k} AS (SELECT w.* EXCLUDE (folded, proof, i), w.i // 8 AS i, CASE WHEN s.m = 1 THEN folded ELSE sha256(s.b || folded || s.a) END AS folded, proof || s.b || s.a AS proof
                FROM {first if k == 0 else f'{to}{k - 1}'} w JOIN {s}{k} s ON s.g = w.g AND s.i = w.i)""")

    levels_of("n", "s", levels)
    out.append(f"u0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, count(*) OVER () AS m, g AS name FROM n{levels})")
    levels_of("u", "v", tops)
    out.append("w AS (SELECT g, i, doc_id, leaf, received AS folded, '' AS proof FROM n0)")
    walk("s", "w", levels, "p")
    out.append(f"y AS (SELECT '' AS g, u0.i, doc_id, leaf, u0.d AS subroot, folded, proof FROM p{levels - 1} q JOIN u0 ON u0.name = q.g)")
    walk("v", "y", tops, "q")
    return "WITH " + ", ".join(out) + f" SELECT doc_id, leaf, subroot, u{tops}.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u{tops}.d AS verified FROM q{tops - 1}, u{tops}"


ORACLE = {
    "op11_merkle_manifest": _merkle_sql(),
    "op13_spelling_variants": rf"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
        ), low AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM runs WHERE length(run) >= 7
        ), hashed AS (
            SELECT doc_id, w, h FROM low JOIN (SELECT doc_id, w, {_crc32("doc_id::VARCHAR || ':' || w")} AS h FROM (SELECT DISTINCT doc_id, w FROM low)) USING (doc_id, w)
        ), done AS (
            SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word FROM hashed
        ), d AS (
            SELECT word, count(*) AS n FROM done WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
        ), cut AS (
            SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM d)
        ), near AS (
            SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT cut.word, d.word FROM cut JOIN d ON d.word = rest UNION SELECT d.word, cut.word FROM cut JOIN d ON d.word = rest
        ), best AS (
            SELECT near.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS w, max(o.n) AS n FROM near JOIN d o ON o.word = other GROUP BY near.word
        ), forms AS (
            SELECT d.word, d.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * d.n THEN best.w END AS form, CASE WHEN best.n >= 10 * d.n THEN best.n END AS form_n FROM d LEFT JOIN best ON best.word = d.word
        ), walk AS (
            SELECT word, word AS led, 0 AS step FROM forms UNION ALL SELECT walk.word, form, step + 1 FROM walk JOIN forms ON forms.word = led WHERE form IS NOT NULL
        )
        SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(led, step) AS root FROM walk GROUP BY word) r ON r.word = forms.word""",
    "op12_benchmark_decontamination": r"""
        WITH w AS (
            SELECT 0 AS item, doc_id AS id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 1, item_id, 0, text FROM benchmark
        ), cut AS (
            SELECT item, id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM w
        ), starts AS (
            SELECT id AS item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM cut WHERE item = 1 AND len(w) > 0
        ), win AS (
            SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM starts
        ), places AS (
            SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM cut, (SELECT DISTINCT n FROM win) WHERE item = 0 AND len(w) >= n
        ), occ AS (
            SELECT p.r, p.k, p.n, win.item_id FROM (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS t FROM places) p JOIN win ON win.n = p.n AND win.t = p.t
        ), hit AS (
            SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS k FROM (SELECT DISTINCT r, k, n FROM occ)) GROUP BY r
        ), items AS (
            SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS i FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM occ) GROUP BY r
        )
        SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(i, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM cut LEFT JOIN hit ON hit.r = cut.r LEFT JOIN items ON items.r = cut.r WHERE item = 0""",
    "op3_exact_dedup": r"""
        WITH norm AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
        ), ranked AS (
            SELECT doc_id, n, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY n) AS group_size
            FROM norm WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
        )
        SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(n) AS text_sha256 FROM ranked""",
    "op4_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, str_split(coalesce(text, ''), chr(10)) AS l FROM documents
        ), ls AS (
            SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line, len(l) AS n FROM lines
        ), runs AS (
            SELECT doc_id, i, n, trim(line) AS a, lead(trim(line)) OVER w AS b, lead(trim(line), 2) OVER w AS c
            FROM ls WINDOW w AS (PARTITION BY doc_id ORDER BY i)
        ), first AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k FROM runs WHERE i + 3 <= n
        ), gone AS (
            SELECT DISTINCT doc_id, i + d AS i FROM first, (VALUES (0), (1), (2)) AS t(d) WHERE k > 1
        )
        SELECT ls.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
            coalesce(string_agg(gone.i::VARCHAR, ',' ORDER BY gone.i), '') AS removed,
            sha256(coalesce(string_agg(CASE WHEN gone.i IS NULL THEN line END, chr(10) ORDER BY ls.i), '')) AS kept_sha256
        FROM ls LEFT JOIN gone ON gone.doc_id = ls.doc_id AND gone.i = ls.i GROUP BY ls.doc_id""",
    "op10_chat_format": r"""
        WITH own AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), marked AS (
            SELECT *, regexp_replace(replace(text, '^', '^^'), '([<\[])(/?(?:s>|INST\]))', '\1^\2', 'g') AS escaped FROM own
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
            CAST(sum(length(role) + length(escaped) + 8) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id""",
}
