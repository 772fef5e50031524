"""What the training-data operators share: the word rule, table access, cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether Spark removes a query's shuffle files at its end. A write's plan is its own, so nothing asks for them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lattico-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lattico-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends there, and a lost executor costs no recomputation.

    Shuffle files of the write go with it; else they stay on disk until the driver happens to collect its garbage.
    """
    path, conf = scratch(df.sparkSession, what), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def replace_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without columns of these names (compared as Spark does, without case), so that an operator's own columns may take them."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


class Sheltered:
    """df with its columns renamed out of the way (df), so that an operator's own names can't clash with any of them.

    of() is the inner name of a column (compared as Spark does, without case); back() restores the outer names.
    """

    PREFIX = "__user"

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.inner = [f"{self.PREFIX}{i}" for i in range(len(self.names))]
        self.df = df.toDF(*self.inner)

    def of(self, name: str) -> str:
        exact = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if len(exact) != 1:
            raise ValueError(f"{len(exact)} columns are named {name!r} among {self.names}")
        return self.inner[exact[0]]

    def back(self, df: DataFrame, *added: str) -> DataFrame:
        """df's sheltered columns under their own names, and the added ones, which replace columns of these names."""
        new = {a.lower() for a in added}
        kept = [F.col(i).alias(n) for i, n in zip(self.inner, self.names, strict=True) if n.lower() not in new and i in df.columns]
        return df.select(*kept, *added)


#: Rows that Spark hands to a Python worker at once, and bytes of text that a worker has in hand at once. Texts may be long, and
#: the default of 10,000 rows would hold tens of MB several times over, in the executor and in its workers.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1000, 1 << 20


def give_back() -> None:
    """At a task's end: a worker lives on for other stages, and what it had in hand shouldn't stay its own meanwhile."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def _slices(b: pa.RecordBatch, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= BYTES_AT_ONCE:
            yield b.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(sizes):
        yield b.slice(start)


def map_texts(df: DataFrame, text: str, fn: Callable[[list[bytes]], dict[str, pa.Array]], schema: str, keep: list[str]) -> DataFrame:
    """keep's columns of df beside the columns that fn makes, batch by batch, of the texts as UTF-8 bytes (null: empty)."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{k}`" for k in keep]).schema)
    own = text in keep and dict(df.dtypes)[text] == "string"  # a text that is kept travels once
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ROWS_AT_ONCE:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = pc.fill_null(pc.binary_length(whole.column(text if own else "__text")), 0).to_pylist()
            for b in _slices(whole, lengths):
                texts = [x or b"" for x in b.column(text if own else "__text").cast(pa.binary()).to_pylist()]
                made = fn(texts)
                yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + list(made.values()), names=[*keep, *made])
        give_back()

    sent = [F.col(f"`{k}`") for k in keep] + ([] if own else [F.col(f"`{text}`").cast("string").alias("__text")])
    return df.select(*sent).mapInArrow(run, f"{types}, {schema}" if keep else schema)
