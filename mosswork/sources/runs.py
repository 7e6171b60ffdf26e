"""Runs as rows: which folders are runs, what their metadata says, in which order reports list them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

# Folders that hold no runs, and the order of models, prompts and reasoning efforts in ablation tables.
SKIPPED = ["analysis", "factuality_audit", "__pycache__", "batches", "parallelqueue", "online_api_responses"]
MODELS, PROMPTS, EFFORTS = ["gpt-5-mini", "gpt-5-nano"], ["baseline", "calibrated"], ["min", "low", "medium", "high"]


def listed(spark: SparkSession, root: str) -> DataFrame:
    """dir, name of every file below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return files(f, F.col("path"))


def files(paths: DataFrame, path: Column) -> DataFrame:
    return paths.select(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("dir"), F.substring_index(path, "/", -1).alias("name"))


def holding(found: DataFrame, *markers: tuple[str, ...]) -> DataFrame:
    """Folders that hold at least one file of each group of names."""
    has = F.lit(True)
    for names in markers:
        has = has & F.bool_or(F.col("name").isin(list(names)))
    return found.groupBy("dir").agg(has.alias("ok")).filter("ok").select("dir")


def outermost(dirs: DataFrame) -> DataFrame:
    """Folders that are not inside another of them."""
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inside = dirs.filter(F.instr("dir", "/") > 0).select("dir", F.explode(above).alias("up")).join(dirs.select(F.col("dir").alias("up")), "up").select("dir").distinct()
    return dirs.join(inside, "dir", "left_anti")


def run_dirs(found: DataFrame) -> DataFrame:
    """Folders with a queue and articles; nested ones are part of the outer run."""
    return outermost(holding(found, ("queue.json", "queue.jsonl"), ("articles_wikitext.jsonl",)))


def titled(c: Column) -> Column:
    """Each run of letters begins with a capital."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), 0), F.initcap), "")


def given(meta: Column, *paths: str) -> Column:
    """The first value of JSON paths that is neither missing nor empty."""
    return F.coalesce(*(F.nullif(F.get_json_object(meta, p), F.lit("")) for p in paths), F.lit(""))


def facts(path: Column, meta: Column) -> Column:
    """struct(model, topic, persona): what the metadata says if there are any, else what .../topic_runs/MODEL/TOPIC/PERSONA says."""
    part = lambda i: F.regexp_extract(path, r"(?:^|/)topic_runs/([^/]+)/([^/]+)/([^/]+)", i)
    told = {
        "model": (given(meta, "$.cascading_defaults.global_model_key", "$.args_raw.model_key"), part(1)),
        "topic": (given(meta, "$.seed"), titled(F.replace(part(2), F.lit("_"), F.lit(" ")))),
        "persona": (given(meta, "$.personas.elicit", "$.args_raw.persona"), part(3)),
    }
    return F.struct(*(F.when(meta.isNotNull(), strip(a)).otherwise(b).alias(k) for k, (a, b) in told.items()))


def analysed(found: DataFrame, meta: DataFrame, eval_file: str, articles_file: str) -> DataFrame:
    """Runs with results or articles, outside skipped and hidden folders, by topic, model and persona. meta: dir, meta (JSON). A run of which
    neither model nor topic is known is left out."""
    skipped = F.exists(F.split("dir", "/"), lambda d: d.isin(SKIPPED) | d.startswith("."))
    runs = holding(found.filter(~skipped), (eval_file, articles_file)).join(meta, "dir", "left").select("dir", facts(F.col("dir"), F.col("meta")).alias("f"))
    named = runs.select("dir", *(F.coalesce(F.nullif(f"f.{k}", F.lit("")), F.lit(other)).alias(k) for k, other in (("model", "unknown"), ("topic", "unknown"), ("persona", "neutral"))))
    return named.filter("model <> 'unknown' or topic <> 'unknown'").orderBy("topic", "model", "persona")


def model_facts(meta: Column) -> Column:
    """struct(topic, persona, model_key) of run metadata for the funnel: another precedence, the elicitation's model first."""
    return F.struct(
        given(meta, "$.seed", "$.args_raw.topic").alias("topic"), given(meta, "$.personas.elicit", "$.args_raw.persona").alias("persona"),
        given(meta, "$.args_raw.elicit_model_key", "$.cascading_defaults.global_model_key", "$.args_raw.model_key").alias("model_key"),
    )


def ablation(meta: Column) -> Column:
    """struct(model, self_rag, prompt, effort, display, cost) of run metadata; cost is of one article."""
    or_else = lambda c, d: strip(F.coalesce(F.nullif(c, F.lit("")), F.lit(d)))
    model = strip(given(meta, "$.cascading_defaults.global_model_key", "$.args_raw.model_key", "$.args_raw.elicit_model_key"))
    rag = F.coalesce(F.get_json_object(meta, "$.self_rag_enabled"), F.get_json_object(meta, "$.args_raw.self_rag"), F.lit("false")).isin("true", "1")
    prompt = or_else(given(meta, "$.elicitation_strategy", "$.args_raw.elicitation_strategy"), "baseline")
    effort = or_else(given(meta, "$.cascading_defaults.global_reasoning_effort", "$.args_raw.reasoning_effort"), "low")
    number = lambda p: F.get_json_object(meta, p).try_cast("double")
    cost = F.coalesce(number("$.total_cost_usd") / F.greatest(F.coalesce(number("$.n_articles_written"), F.lit(1.0)), F.lit(1.0)), number("$.cost_per_article_usd"), F.lit(0.0))
    display = F.concat(model, F.lit("/"), effort, F.lit("/"), prompt, F.when(rag, "_selfrag").otherwise("_noselfrag"))
    return F.struct(model.alias("model"), rag.alias("self_rag"), prompt.alias("prompt"), effort.alias("effort"), display.alias("display"), cost.alias("cost"))


def ranked(c: Column, order: list[str]) -> Column:
    """Place in a fixed order; 99 for all others."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), c) - 1, F.lit(-1)), F.lit(99))


def ablation_runs(configs: DataFrame, articles: DataFrame) -> DataFrame:
    """configs (dir, and the columns of `ablation`) with the number of their articles (dir, a row each), in the order of tables."""
    n = articles.groupBy("dir").agg(F.count("*").alias("n_subjects"))
    place = [ranked(F.col("model"), MODELS), F.col("self_rag").cast("int"), ranked(F.col("prompt"), PROMPTS), ranked(F.col("effort"), EFFORTS)]
    return configs.join(n, "dir").orderBy(*place, "dir")


def site_rows(runs: DataFrame, articles: DataFrame) -> DataFrame:
    """runs (dir, category, model_key, display, path) as rows of the site's list, with the number of their articles (dir, a row each)."""
    n = articles.groupBy("dir").agg(F.count("*").alias("article_count"))
    return runs.join(n, "dir", "left").withColumn("article_count", F.coalesce("article_count", F.lit(0)))


def whole_articles(articles: DataFrame) -> DataFrame:
    """Articles that have both a subject and a text."""
    return articles.filter("coalesce(subject, '') <> '' and coalesce(wikitext, '') <> ''")


def subjects(articles: DataFrame) -> DataFrame:
    return articles.filter("coalesce(subject, '') <> ''").select("subject").distinct()


def image_entry(raw: Column) -> Column:
    """An entry of an image cache as struct(store_path, image_url, source_url, license, artist, source): an object with a stored file, or a bare address of the
    old form; null for all others."""
    names = ("store_path", "image_url", "source_url", "license", "artist", "source")
    entry = lambda **v: F.struct(*(v.get(k, F.lit("")).alias(k) for k in names))
    member = {k: F.coalesce(F.get_json_object(raw, f"$.{k}"), F.lit("")) for k in names}
    address = F.regexp_extract(raw, r'^\s*"(.+)"\s*$', 1)
    return F.when(raw.rlike(r"^\s*\{") & (member["store_path"] != ""), entry(**member)).when(address != "", entry(image_url=address, source_url=address, source=F.lit("legacy")))


def merged_images(cache: DataFrame, resolved: DataFrame, subjects_of: DataFrame, force: bool = False) -> DataFrame:
    """Caches (run, subject, entry) with resolved entries (subject, entry) of the runs' own subjects (run, subject): missing ones only, or all with force."""
    new = subjects_of.select("run", "subject").distinct().join(resolved, "subject").select("run", "subject", "entry")
    if force:
        return cache.join(new.select("run", "subject"), ["run", "subject"], "left_anti").unionByName(new)
    return cache.unionByName(new.join(cache.select("run", "subject"), ["run", "subject"], "left_anti"))


def image_coverage(cache: DataFrame) -> DataFrame:
    """By run: total, found, missing, share in percent, and how many come from each source. cache: run, subject, entry (as `image_entry`)."""
    found = F.col("entry").isNotNull()
    whole = cache.groupBy("run").agg(F.count("*").alias("total"), F.count_if(found).alias("found"))
    n = cache.filter(found).groupBy("run", F.coalesce(F.nullif("entry.source", F.lit("")), F.lit("?")).alias("source")).agg(F.count("*").alias("n"))
    named = n.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "source", "n"))), lambda x: F.concat(x.source, F.lit(":"), x.n)), ", ").alias("sources"))
    return whole.join(named, "run", "left").select("run", "total", "found", (F.col("total") - F.col("found")).alias("missing"), F.round(F.lit(100.0) * F.col("found") / F.col("total"), 1).alias("pct"), F.coalesce("sources", F.lit("")).alias("sources"))


def missing_files(local: DataFrame, store: DataFrame) -> DataFrame:
    """Files (name, ...) that a store (name) lacks, the first of a name by path."""
    first = local.groupBy("name").agg(F.min("path").alias("path"))
    return first.join(store.select("name").distinct(), "name", "left_anti")
