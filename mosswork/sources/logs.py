"""Readers of runs: append-only JSON lines, single documents, CSV with aliases, run metadata from paths."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.salvage import salvaged

SCHEMAS = {
    "articles": "subject string, wikitext string, hop int, model string, overall_confidence double, parent_subject string, parent_hop int, created_at string",
    "articles_meta": "subject string, hop int, links array<string>, categories array<string>, links_from_markup array<string>, categories_from_markup array<string>, ner_candidates array<string>, diag boolean, stage string",
    "queue": "subject string, hop int, status string, retries int, created_at string, parent_subject string, parent_hop int, retry_at double",
    "queue_events": "ts string, event string, subject string, hop int, parent_subject string, parent_hop int, retries int, retry_at double, delay_s double, reason string, count int",
    "ner_decisions": "current_entity string, hop int, phrase string, is_ne boolean, confidence double, passed_threshold boolean, decision_reason string, source string, stage string, parse_mode string, parse_modes array<string>, pre_dedup_count int, post_dedup_count int, filtered_count int, chunk_failures int",
    "similarity_decisions": "stage string, candidate string, parent_entity string, hop int, max_similarity double, decision string, reason string, duplicate_of string",
    "embeddings": "entity string, canon_key string, hop int, embedding array<float>, provider string, model string, parent_subject string",
    "eval_results": "subject string, candidate string, hop int, persona string, topic string, generator_model string, candidate_found boolean, n_claims int, claims array<string>, wiki_subject_found boolean",
}


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log with `line_no`; blank, broken and non-object lines are left out. The line
    number orders rows of one file as written (it is not gapless)."""
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no")).filter(F.trim("value").startswith("{"))
    parsed = raw.select("line_no", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.filter("r is not null and r._corrupt is null").select("r.*", "line_no").drop("_corrupt")


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A single JSON document as one row; no row if there is no such file or it can't be read, so a caller's default is a left join away."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    parsed = whole.select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.filter("r is not null and r._corrupt is null").select("r.*").drop("_corrupt")


def first_existing(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """The JSON lines of the first path that is there; articles need both a subject and a text."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return json_lines(spark, path, schema)
    return spark.createDataFrame([], f"{schema}, line_no long")


def line_count(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "").agg(F.count("*").alias("lines"))


def titles(spark: SparkSession, path: str) -> DataFrame:
    """Seed titles: of a JSON document with `titles` or `topics`, or a list; else a title a line. White space is squeezed, blank ones go."""
    whole = spark.read.text(path, wholetext=True).select("value")
    array = "array<string>"
    listed = F.coalesce(F.from_json("value", array), F.from_json("value", "titles array<string>").titles, F.from_json("value", "topics array<string>").topics)
    is_json = F.col("value").rlike(r"^\s*[\[{]")
    rows = whole.select(F.posexplode(F.when(is_json, listed).otherwise(F.split("value", r"\r?\n"))).alias("line_no", "title"))
    return rows.select(F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), "line_no").filter("title <> ''")


def preload(titles_: DataFrame, seen: DataFrame, n: int, key) -> DataFrame:
    """The first n titles, those whose canonical key was seen left out; the limit is the feature."""
    first = titles_.orderBy("line_no").limit(n).withColumn("canon_key", key(F.col("title")))
    return first.join(seen, "canon_key", "left_anti")


def queue(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """The snapshot if it has rows, else event rows; the last write of each key counts."""
    cols = ["subject", "hop", "status", "parent_subject", "parent_hop", "line_no"]
    have = snapshot.agg((F.count("*") > 0).alias("have"))
    pick = lambda df, yes: df.select(*cols).crossJoin(F.broadcast(have)).filter(F.col("have") == yes).drop("have")
    every = pick(snapshot, True).unionByName(pick(events.filter("event is not null"), False))
    return every.groupBy("subject", "hop").agg(F.max_by(F.struct("status", "parent_subject", "parent_hop"), "line_no").alias("r")).select("subject", "hop", "r.*")


def aliased(df: DataFrame, **aliases: list[str]) -> DataFrame:
    """Counts of CSVs under any of their names; 0 counts as missing."""
    pick = lambda names: F.coalesce(*(F.nullif(F.col(n).try_cast("int"), F.lit(0)) for n in names if n in df.columns), F.lit(0))
    return df.withColumns({k: pick(v) for k, v in aliases.items()})


def answer_text(body: Column) -> Column:
    """Text of a recorded model response in either of its shapes."""
    return F.coalesce(*(F.get_json_object(body, p) for p in ("$.choices[0].message.content", "$.output_text", "$.output[0].content[0].text", "$.content[0].text", "$.text")))


def usage(body: Column) -> Column:
    n = lambda *ps: F.coalesce(*(F.nullif(F.get_json_object(body, p).try_cast("long"), F.lit(0)) for p in ps), F.lit(0))
    return F.struct(n("$.usage.input_tokens", "$.usage.prompt_tokens").alias("input_tokens"), n("$.usage.output_tokens", "$.usage.completion_tokens").alias("output_tokens"))


def custom_id(c: Column) -> Column:
    """struct(subject, hop, chunk, start, n) of the name of a named-entity request; null where it is no such name."""
    rx = r"(?s)^ner::(.*)::hop=(\d+)::chunk=(\d+)::start=(\d+)::n=(\d+)$"
    number = lambda i: F.regexp_extract(c, rx, i).try_cast("int")
    return F.when(c.rlike(rx), F.struct(F.regexp_extract(c, rx, 1).alias("subject"), *(number(i).alias(k) for i, k in enumerate(("hop", "chunk", "start", "n"), 2))))


def batch_answers(lines: DataFrame) -> DataFrame:
    """custom_id and the first object in the text of each line (value) of a batch's output; lines without an id or a text are left out."""
    body = F.coalesce(F.get_json_object("value", "$.response.body"), F.get_json_object("value", "$.body"))
    named = lines.select(F.get_json_object("value", "$.custom_id").alias("custom_id"), answer_text(body).alias("text")).filter("custom_id is not null and text is not null")
    return named.select("custom_id", salvaged("text").alias("object"))
