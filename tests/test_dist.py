import math

import pytest
from pyspark.sql import functions as F

from lattico.functions import dist


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def near(a, b, tol=1e-6):
    assert len(a) == len(b) and all(abs(x - y) < tol for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("p, want", [((2, 1, 1), (0.5, 0.25, 0.25)), ((0, 0), (0.5, 0.5)), ((0.3, -0.1), (1, 0))])
def test_normalize(one, p, want):
    near(one(dist.normalize(arr(*p))), want)


@pytest.mark.parametrize("p, want", [((1, 0), 1.0), ((0.25,) * 4, 0.0), ((0.9, 0.1), 0.5310), ((1,), 1.0)])
def test_confidence(one, p, want):
    assert abs(one(dist.confidence(arr(*p))) - want) < 1e-4


def test_interpolate(one):
    near(one(dist.interpolate(F.lit(2.5), F.lit(6))), (0, 0, 0.5, 0.5, 0, 0))
    near(one(dist.interpolate(F.lit(3.25), F.lit(6))), (0, 0, 0, 0.75, 0.25, 0))
    near(one(dist.interpolate(F.lit(9.0), F.lit(3))), (0, 0, 1))


def test_votes(one):
    near(one(dist.votes(F.array(F.lit(-1), F.lit(-1), F.lit(-2)), -3, 3)), (0, 1 / 3, 2 / 3, 0, 0, 0, 0))


def test_brier_and_kl(one):
    assert abs(one(dist.brier(arr(0.8, 0.2), arr(1, 0))) - 0.04) < 1e-12
    assert abs(one(dist.brier(arr(0.4, 0.6), arr(1, 0))) - 0.36) < 1e-12
    assert abs(one(dist.kl(arr(1, 0), arr(0.8, 0.2))) - 0.22314355) < 1e-6


def test_ranked_probability(one):
    assert abs(one(dist.ranked_probability(arr(0, 0, 1, 0), arr(0, 0, 0, 1))) - 1 / 3) < 1e-12
    assert abs(one(dist.ranked_probability(arr(1, 0, 0, 0), arr(0, 0, 0, 1))) - 1) < 1e-12


def test_symmetric_kl(one):
    assert abs(one(dist.symmetric_kl(arr(0.8, 0.2), arr(0.5, 0.5))) - 0.2079) < 1e-3


def test_ordinal_smooth(one):
    near(one(dist.ordinal_smooth(arr(0, 0, 1, 0, 0), 0.2)), (0, 0.1, 0.8, 0.1, 0))
    near(one(dist.ordinal_smooth(arr(1, 0, 0, 0, 0), 0.2)), (0.8, 0.2, 0, 0, 0))
    near(one(dist.ordinal_smooth(arr(0.5, 0.5), 0.2)), (0.5, 0.5))


def test_unpermute_and_argmax(one):
    near(one(dist.unpermute(arr(10, 20, 30), F.array(F.lit(2), F.lit(0), F.lit(1)))), (20, 30, 10))
    assert one(dist.argmax(arr(0.4, 0.4, 0.2))) == 0


def test_softmax(one):
    e = [math.exp(x / 2) for x in (1, 2, 3)]
    near(one(dist.softmax(arr(1, 2, 3), 2.0)), [x / sum(e) for x in e])
    near(one(dist.softmax(arr(1000, 0))), (1, 0))
    assert abs(one(dist.log_sum_exp(arr(0, 0))) - math.log(2)) < 1e-12


def test_group_sizes():
    assert dist.sizes_of_groups(60) == [20, 20, 20]
    assert dist.sizes_of_groups(27) == [14, 13]
    assert dist.sizes_of_groups(151) == [26, 25, 25, 25, 25, 25]


def test_gold_index_prefers_the_label(one):
    names = F.array(F.lit("a"), F.lit("b"))
    assert one(dist.gold_index(names, arr(1, 0), F.lit("b"))) == 1
    assert one(dist.gold_index(names, arr(0, 1), F.lit("zzz"))) == 1
    assert one(dist.gold_index(names, arr(1, 0), F.lit(None).cast("string"))) == 0
