"""Benchmarks from files, of which some may not be readable: what fails is a row of its own, and the others are read."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from .registry import merged, without_binary

#: Characters of a message that are kept, and what reading a file may raise.
MESSAGE, UNREADABLE = 80, (PySparkException, Py4JJavaError)


def texts_of(rows: DataFrame, fields: list[str] | None = None) -> Column:
    """All texts of a row's fields, in their order, nested ones too; of all string fields unless fields are named. Absent fields have none."""
    picked = [f for f in rows.schema if (f.name in fields if fields else isinstance(f.dataType, T.StringType))]
    empty = F.array().cast("array<string>")

    def own(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            return F.array(c)
        return text.leaves_of(F.to_json(c)) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else empty

    return F.concat(empty, *[F.when(F.col(f"`{f.name}`").isNotNull(), own(f)).otherwise(empty) for f in picked])


def _reason(e: Exception) -> str:
    """The kind of an error and the beginning of what Spark says of it."""
    said = re.search(r"\[[A-Z_.]+\].*", str(e))
    return f"{type(e).__name__} {(said[0] if said else str(e).strip().splitlines()[0])[:MESSAGE]}"


def files_of(spark: SparkSession, path: str) -> list[str]:
    """Files at a path (a file, a folder with its subfolders, or a pattern), without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path).select("path")
    return sorted(r["path"] for r in found.collect())  # a benchmark's files


def load(spark: SparkSession, named: dict[str, str], fields: dict[str, list[str]] | None = None, format: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(eval, seq, texts) of all benchmarks that can be read, and (eval, failure) of what can't: a benchmark, or some of its files.

    named: a path by name; of a folder, all splits are read. A file whose footer or data can't be read is told apart by reading each
    file of a benchmark that fails on its own, so that the other files count. Columns of files that differ are merged; binary columns
    aren't read. Benchmarks are few and small beside the training data: their files are looked at one by one.
    """
    read, failed = [], []
    reader = lambda p: without_binary(spark.read.format(format).option("recursiveFileLookup", "true").load(p))

    def usable(path: str) -> DataFrame:
        rows = reader(path)
        rows.write.format("noop").mode("overwrite").save()  # footers alone don't tell that the data can be read
        return rows

    for name, path in named.items():
        try:
            parts = [usable(path)]
        except UNREADABLE as whole:
            parts = []
            try:
                files = files_of(spark, path)
            except UNREADABLE:
                failed.append((name, _reason(whole)))
                continue
            for file in files:
                try:
                    parts.append(usable(file))
                except UNREADABLE as e:
                    failed.append((name if len(files) == 1 else f"{name}/{file.rsplit('/', 1)[-1]}", _reason(e)))
        if parts:
            rows = merged(parts)
            read.append(rows.select(F.lit(name).alias("eval"), F.monotonically_increasing_id().alias("seq"), texts_of(rows, (fields or {}).get(name)).alias("texts")))
    nothing = spark.createDataFrame([], "eval string, seq long, texts array<string>")
    return merged(read) if read else nothing, spark.createDataFrame(failed, "eval string, failure string")
