"""Arithmetic on distributions, as Columns over arrays of double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, with x worked out once however often body uses it: a lambda over one element is SQL's let."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def one_hot(k: Column, i: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.when(j == i, F.lit(1.0)).otherwise(F.lit(0.0)))


def uniform(k: Column) -> Column:
    return F.array_repeat(F.lit(1.0) / k, k)


def normalize(p: Column) -> Column:
    """Negatives clipped, divided by the sum; uniform if nothing is left."""
    shares = lambda c: bound(_sum(c), lambda total: F.when(total > 0, F.transform(c, lambda x: x / total)).otherwise(uniform(F.size(c))))
    return bound(F.transform(p, lambda x: F.greatest(x, F.lit(0.0))), shares)


def argmax(p: Column) -> Column:
    """Position from 0 of the first largest."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def gold_index(names: Column, target: Column, label: Column) -> Column:
    """Position of label among names, else the target's argmax."""
    at = F.array_position(names, label)
    return F.when(at > 0, at - 1).otherwise(F.array_position(target, F.array_max(target)) - 1).cast("int")


def confidence(p: Column) -> Column:
    """1 less the entropy's share of its most, at least 0; 1 for a single option."""
    entropy = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(F.greatest(x, F.lit(1e-300)))).otherwise(0.0))
    return F.when(F.size(p) < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(entropy, F.log(F.size(p).cast("double")))))


def interpolate(value: Column, k: Column) -> Column:
    """A value's mass on its two neighbouring levels of 0 .. k-1."""
    v = F.least(F.greatest(value, F.lit(0.0)), (k - 1).cast("double"))
    return bound(v, lambda v: F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.greatest(F.lit(0.0), 1 - F.abs(i - v))))


def votes(scores: Column, low: int, high: int) -> Column:
    """Share of votes on each level of low .. high."""
    counts = lambda s: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: F.size(F.filter(s, lambda x: x == k)).cast("double"))
    return normalize(bound(scores, counts))


def log_softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    return bound(F.transform(logits, lambda x: x / temperature), lambda z: bound(log_sum_exp_of(z), lambda total: F.transform(z, lambda x: x - total)))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    return F.transform(log_softmax(logits, temperature), F.exp)


def log_sum_exp_of(x: Column) -> Column:
    """For an x that is bound, or a column."""
    return bound(F.array_max(x), lambda top: top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))))


def log_sum_exp(x: Column) -> Column:
    return bound(x, log_sum_exp_of)


def brier(p: Column, t: Column) -> Column:
    return _sum(F.zip_with(p, t, lambda a, b: (a - b) * (a - b))) / F.size(t)


def kl(t: Column, p: Column) -> Column:
    return _sum(F.zip_with(t, p, lambda a, b: F.when(a > 0, a * (F.log(a + 1e-12) - F.log(b + 1e-12))).otherwise(0.0)))


def symmetric_kl(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: 0.5 * (x - y) * (F.log(F.greatest(x, F.lit(1e-12))) - F.log(F.greatest(y, F.lit(1e-12))))))


def soft_cross_entropy(logits: Column, t: Column, temperature: Column | float = 1.0) -> Column:
    return -_sum(F.zip_with(log_softmax(logits, temperature), t, lambda a, b: a * b))


def ranked_probability(p: Column, t: Column) -> Column:
    """Squared distance of the cumulative distributions over one less than their length."""
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"))
    step = lambda a, d: F.struct((a["c"] + d).alias("c"), (a["s"] + (a["c"] + d) * (a["c"] + d)).alias("s"))
    return F.aggregate(F.zip_with(p, t, lambda x, y: x - y), start, step, lambda a: a["s"]) / (F.size(t) - 1)


def smooth(t: Column, eps: float) -> Column:
    return F.transform(t, lambda x: (1 - eps) * x + eps / F.size(t))


def ordinal_smooth(t: Column, eps: float) -> Column:
    """A one-hot target gives eps to its neighbours; a soft one stays."""

    def moved(t: Column, g: Column) -> Column:
        beside = F.when((g == 0) | (g == F.size(t) - 1), F.lit(eps)).otherwise(F.lit(eps / 2))
        return F.transform(t, lambda x, i: F.when(i == g, 1 - F.lit(eps)).when(F.abs(i - g) == 1, beside).otherwise(0.0))

    stays = lambda t: (F.size(t) < 2) | (F.array_max(t) < 1 - 1e-9) | F.lit(eps <= 0)
    return bound(t, lambda t: F.when(stays(t), t).otherwise(bound(F.array_position(t, F.array_max(t)) - 1, lambda g: moved(t, g))))


def unpermute(x: Column, perm: Column) -> Column:
    """out[perm[j]] = x[j]."""
    return F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.element_at(x, F.array_position(perm, i).cast("int")))


def sizes_of_groups(k: int, most: int = 26) -> list[int]:
    """k options in the fewest groups of at most `most`, as even as may be, larger ones first."""
    n = -(-k // most)
    return [k // n + (g < k % n) for g in range(n)]


def composite_loss(logits: Column, target: Column, type_: Column, second: Column | None = None, rps_weight: float = 0.5, consistency: float = 0.5, eps: float = 0.0) -> Column:
    """Cross-entropy of the smoothed target, for scores the ranked probability on top, and where there are logits of a second view (null where not) their symmetric divergence."""
    p = softmax(logits)
    ranked = F.when(type_ == "score", ranked_probability(p, target)).otherwise(0.0)
    apart = F.lit(0.0) if second is None else F.when(second.isNotNull(), symmetric_kl(p, softmax(second))).otherwise(0.0)
    return soft_cross_entropy(logits, smooth(target, eps)) + rps_weight * ranked + consistency * apart
