"""Writers. Spark's commit protocol makes them atomic; partitioned output needs no buffers or locks. What has to be one file is written by many
tasks, each at its place (`array`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import array


def json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Doubles with four places, nulls empty; columns in the given order, or sorted."""
    kinds = dict(df.dtypes)
    show = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit(""))
    df.select(*(show(c).alias(c) for c in columns or sorted(df.columns))).write.mode("overwrite").option("header", True).csv(path)


def per_subject(df: DataFrame, path: str, *by: str) -> None:
    """One folder per value, for audit trails."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def sorted_keys(df: DataFrame, key: str, path: str) -> None:
    df.select(key).distinct().sort(key).write.mode("overwrite").text(path)


def rows_csv(path: str, *parts: DataFrame) -> None:
    """Rows of several reports under one header: the columns of all, first seen first. No part at all is one line that says `empty`."""
    if not parts:
        raise ValueError("name the session's frames; for none write an empty one")
    columns = list(dict.fromkeys(c for p in parts for c in p.columns))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    if every.isEmpty():
        every.sparkSession.createDataFrame([("empty",)], "value string").coalesce(1).write.mode("overwrite").text(path)
    else:
        csv(every.select(*columns), path, columns)


def json_array(df: DataFrame, path: str, *order: str) -> str:
    """One JSON array of the rows, a row a line, in order: what a reader of a whole document expects of a log. The file is path/array.json."""
    return array.write(df, path, *order)


def queue_snapshot(rows: DataFrame, path: str, articles: DataFrame | None = None, most: int = 0) -> None:
    """The queue's rows by subject and hop, as one array; beside it the first articles by line, `most` of them (the snapshot's own limit)."""
    json_array(rows, f"{path}/queue", "hop", "subject")
    if articles is not None and most:
        json_array(articles.orderBy("line_no").limit(most), f"{path}/articles", "line_no")


def search_index(postings: DataFrame, path: str) -> None:
    """token, part and ids as JSON lines, in ranges of tokens."""
    postings.repartitionByRange("token").sortWithinPartitions("token", "part").write.mode("overwrite").json(path)


def audit(records: DataFrame, claims: DataFrame, manifest: DataFrame, path: str) -> None:
    """A run's audit trail: its manifest, claims and results, the latter two in a folder for each subject."""
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    per_subject(claims, f"{path}/claims", "subject")
    per_subject(records, f"{path}/results", "subject")
