"""Choices that depend on a key alone: the same whatever the partitions, the other rows or the order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str | int) -> Column:
    """MD5 of the parts joined by a slash."""
    return F.md5(F.concat_ws("/", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def number(*parts: Column | str | int) -> Column:
    """The digest's first 32 bits, as long."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    return number(*parts) / F.lit(float(1 << 32))


def pick(items: Column, *parts: Column | str | int) -> Column:
    return F.element_at(items, (F.pmod(number(*parts), F.size(items)) + 1).cast("int"))


def shuffled(items: Column, *parts: Column | str | int) -> Column:
    """An array in an order given by the parts and each item's place."""
    keyed = F.transform(items, lambda x, i: F.struct(digest(*parts, i).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def remainder_of_sha1(x: Column, n: int = 10_000) -> Column:
    """The SHA-1 of x as a 160-bit number, modulo n, folded over 16 bits at a time."""
    h = F.sha1(x)
    out = F.lit(0).cast("long")
    for i in range(1, 41, 4):
        out = (out * 65536 + F.conv(F.substring(h, i, 4), 16, 10).cast("long")) % n
    return out


def in_holdout(group: Column, share: float) -> Column:
    """Whether a group as a whole is held out."""
    return remainder_of_sha1(group) < int(share * 10_000)
