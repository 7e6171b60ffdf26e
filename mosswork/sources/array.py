"""One JSON array from many tasks: a data source writer with numbered parts and a commit that lays them behind each other."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: A task copies so many bytes at a time.
PIECE = 1 << 20


def local(path: str) -> str:
    """The folder that all tasks see under this name. A file is put together by writing at places of it, which shared file systems do and object stores do not."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"one array is written to a shared file system, not to {path}")
    return path


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    rows: int
    size: int


class ArrayWriter(DataSourceArrowWriter):
    """Tasks write their rows, a line each with a comma between; every attempt has a file of its own. The commit names the parts of the attempts that count, in order."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator) -> Part:
        context = TaskContext.get()
        name = f"{context.partitionId():08d}-{uuid.uuid4().hex}"
        os.makedirs(self.folder, exist_ok=True)
        rows = size = 0
        with open(os.path.join(self.folder, name), "wb") as out:
            for b in iterator:
                for value in b.column(0).to_pylist():
                    size += out.write((b",\n" if rows else b"") + value.encode())
                    rows += 1
        return Part(context.partitionId(), name, rows, size)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.number)
        told, at = [], len(b"[\n")
        for p in parts:
            told.append({"name": p.name, "rows": p.rows, "size": p.size, "at": at})
            at += p.size + len(b",\n")
        os.makedirs(self.folder, exist_ok=True)
        with open(os.path.join(self.folder, "parts.json"), "w") as out:
            json.dump({"parts": told, "size": at - len(b",\n") if told else len(b"[")}, out)

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m and os.path.exists(path := os.path.join(self.folder, m.name)):
                os.remove(path)


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_array_parts"

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"])


def write(df: DataFrame, path: str, *order: str) -> str:
    """The rows as one JSON array, a row a line, in order; the file that holds it. Tasks write parts in ranges of the order, then other tasks copy each part to its place in the
    file, which takes its name when it is whole. No task reads all rows, and none passes through the driver."""
    spark = df.sparkSession
    spark.dataSource.register(ArraySource)
    folder, target = f"{local(path)}.parts-{uuid.uuid4().hex}", os.path.join(local(path), "array.json")
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("row")
    if order:
        ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    else:
        ranged = df
    ranged.select(row).write.format("json_array_parts").mode("append").option("path", folder).save()
    with open(os.path.join(folder, "parts.json")) as f:
        told = json.load(f)
    os.makedirs(local(path), exist_ok=True)
    whole = f"{folder}/array.json"
    with open(whole, "wb") as out:
        out.write(b"[\n" if told["parts"] else b"[")
        out.truncate(told["size"])
        out.seek(told["size"])
        out.write(b"\n]\n" if told["parts"] else b"]\n")

    def copy(it):
        for b in it:
            for name, at, last in zip(b["name"], b["at"], b["last"], strict=True):
                with open(os.path.join(folder, name), "rb") as part, open(whole, "r+b") as out:
                    out.seek(int(at))
                    while piece := part.read(PIECE):
                        out.write(piece)
                    if not last:
                        out.write(b",\n")
            yield b[["name"]]

    if told["parts"]:
        rows = [(p["name"], p["at"], i == len(told["parts"]) - 1) for i, p in enumerate(told["parts"])]
        parts = spark.createDataFrame(rows, "name string, at long, last boolean")
        parts.repartition(min(len(rows), spark.sparkContext.defaultParallelism)).mapInPandas(copy, "name string").write.format("noop").mode("overwrite").save()
    os.replace(whole, target)
    for name in os.listdir(folder):
        os.remove(os.path.join(folder, name))
    os.rmdir(folder)
    return target


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of an array that `write` made, a row a line, so the file is split between tasks as a log is. Anything but a row or a bracket on a line raises."""
    lines = spark.read.text(path).filter(~F.trim("value").isin("[", "]", "[]", ""))
    row = F.when(F.col("value").endswith(","), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    return lines.select(F.from_json(row, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
