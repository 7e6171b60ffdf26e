"""Folders of runs as a data source: a partition is a file, runs and logs are chosen before any file is opened, and line numbers are line numbers."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .array import local

SCHEMA = "run string, log string, line_no long, value string"
_ARROW = pa.schema([("run", pa.string()), ("log", pa.string()), ("line_no", pa.int64()), ("value", pa.string())])
#: Lines of a batch.
LINES = 2000


class File(InputPartition):
    def __init__(self, path: str, run: str, log: str):
        self.path, self.run, self.log = path, run, log


class FoldersReader(DataSourceReader):
    """Logs `*.jsonl` of all folders below a root; a run is a folder's path from the root. Files that a writer has dealt out by `run=` and `log=` are those of that run and log."""

    def __init__(self, root: str, wanted: dict[str, list[str]]):
        self.root, self.wanted = root, wanted

    def partitions(self) -> list[File]:
        out = []
        for folder, below, names in os.walk(self.root):
            below.sort()
            path = os.path.relpath(folder, self.root)
            told = dict(p.split("=", 1) for p in path.split(os.sep) if "=" in p)
            for name in sorted(n for n in names if n[0] not in "._" and ("log" in told or n.endswith(".jsonl"))):
                run, log = told.get("run", path), told.get("log", name.removesuffix(".jsonl"))
                if all(value in self.wanted.get(key, [value]) for key, value in (("run", run), ("log", log))):
                    out.append(File(os.path.join(folder, name), run, log))
        return out or [File("", "", "")]

    def read(self, file: File) -> Iterator[pa.RecordBatch]:
        if not file.path:
            return
        lines: list[str] = []
        first = 1
        with open(file.path, encoding="utf-8", errors="replace", newline="\n") as f:
            for line in f:
                lines.append(line.rstrip("\r\n"))
                if len(lines) == LINES:
                    yield self._batch(file, first, lines)
                    first, lines = first + len(lines), []
        if lines:
            yield self._batch(file, first, lines)

    def _batch(self, file: File, first: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([file.run] * n), pa.array([file.log] * n), pa.array(range(first, first + n), pa.int64()), pa.array(lines)], schema=_ARROW)


class Folders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FoldersReader:
        return FoldersReader(self.options["path"], json.loads(self.options.get("wanted", "{}")))


def lines(spark: SparkSession, root: str, runs: list[str] | None = None, logs: list[str] | None = None) -> DataFrame:
    """run, log, line_no (from 1, per file), value: every line of every log below root, or of these runs and logs, on a file system that all tasks see. The choice is made here
    and not by pushed filters: the engine keeps what one filter pushed for later reads of the same frame."""
    spark.dataSource.register(Folders)
    wanted = {k: v for k, v in (("run", runs), ("log", logs)) if v is not None}
    return spark.read.format("run_folders").option("wanted", json.dumps(wanted)).load(local(root))


def objects(read: DataFrame, schema: str) -> DataFrame:
    """run, log, line_no and the fields of schema; the lines that are objects. Blank, broken and other lines are left out."""
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = read.filter(F.trim("value").startswith("{")).select("run", "log", "line_no", parsed.alias("r"))
    return rows.filter("r is not null and r._corrupt is null").select("run", "log", "line_no", "r.*").drop("_corrupt")


def counts(read: DataFrame) -> DataFrame:
    """run, log, lines that are not blank, those that are objects, and those that are broken or something else."""
    text = F.trim("value")
    whole = text.startswith("{") & F.try_parse_json("value").isNotNull()
    filled = text != ""
    return read.groupBy("run", "log").agg(F.count_if(filled).alias("lines"), F.count_if(filled & whole).alias("objects"), F.count_if(filled & ~whole).alias("broken"))
