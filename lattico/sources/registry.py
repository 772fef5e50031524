"""Where raw rows come from: readers by name, with splits, caps and the converter of each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keyed
from ..operators import sample


@dataclass(frozen=True)
class Source:
    """name, reader format and paths by split, converter, and how it is cut.

    A split named "x#train" or "x#eval" is a part of split x: by whole groups if `group` is given (the SHA-1 of its text), else a
    share of rows of exact size.
    """

    name: str
    convert: Callable[[DataFrame], DataFrame]
    paths: dict[str, str] = field(default_factory=dict)
    format: str = "parquet"
    reading: dict[str, str] = field(default_factory=dict)
    schema: str | None = None
    lang: str = "en"
    cap: int | None = None
    holdout: float = 0.0
    group: Column | None = None
    id: str = "rid"

    def load(self, spark: SparkSession, split: str) -> DataFrame:
        base, _, part = split.partition("#")
        reader = spark.read.format(self.format).options(**self.reading)
        rows = without_binary((reader.schema(self.schema) if self.schema else reader).load(self.paths[base]))
        rows = with_rid(rows, self.id)
        if not part:
            return rows
        held = rows.withColumn("held", keyed.in_holdout(self.group, self.holdout)) if self.group is not None else sample.holdout_rows(rows, self.id, self.holdout)
        return held.filter(F.col("held") if part == "eval" else ~F.col("held")).drop("held")

    def most(self, default: int, zh_times: float = 1.0) -> int:
        return int((self.cap or default) * (zh_times if self.lang == "zh" else 1))

    def decisions(self, spark: SparkSession, split: str, default: int, seed: str, zh_times: float = 1.0) -> DataFrame:
        """Converted rows, at most most() decisions: rows in keyed order, a row's decisions together, so that a row may be cut."""
        made = self.convert(self.load(spark, split))
        return sample.first_of(made, "grp", f"{seed}/{self.name}", most=self.most(default, zh_times)).filter("held").drop("held")


def with_rid(rows: DataFrame, id_: str = "rid") -> DataFrame:
    """rows with an id: where they have none, a digest of all columns, so that equal rows are one id wherever they lie."""
    return rows if id_ in rows.columns else rows.withColumn(id_, F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))


def without_binary(rows: DataFrame) -> DataFrame:
    """rows without binary columns (images), which the scan then doesn't read."""
    return rows.select([F.col(f"`{f.name}`") for f in rows.schema if not isinstance(f.dataType, T.BinaryType)])


def merged(parts: list[DataFrame]) -> DataFrame:
    """Files of differing columns as one table, absent columns null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def tiered(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """JSON lines of several files, with tier: the file's name without its ending."""
    return spark.read.schema(schema).json(glob).withColumn("tier", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)*$", 1))


class Registry:
    def __init__(self, *groups: dict[str, Source]):
        self.sources: dict[str, Source] = {}
        for g in groups:
            if clash := self.sources.keys() & g.keys():
                raise ValueError(f"names used twice: {sorted(clash)}")
            self.sources |= g

    def pick(self, names: list[str] | None = None) -> list[Source]:
        if unknown := set(names or ()) - self.sources.keys():
            raise KeyError(f"unknown sources: {sorted(unknown)}")
        return [s for n, s in self.sources.items() if names is None or n in names]
