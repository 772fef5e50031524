"""The factorisation machine: its identity against all pairs, pairs that no single word tells, held-out accuracy, and odd rows."""

import itertools
import random

import numpy as np
import pytest

from lattico.llm import factors
from lattico.llm.common import table
from tests.conftest import DATA


def plain_margin(machine, places, values):
    total = machine.bias + sum(machine.weights[p] * v for p, v in zip(places, values, strict=True))
    for (p, v), (q, w) in itertools.combinations(list(zip(places, values, strict=True)), 2):
        total += float(machine.vectors[p] @ machine.vectors[q]) * v * w
    return total


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = factors.Machine(0.3, rng.normal(size=factors.PLACES), rng.normal(size=(factors.PLACES, factors.RANK)))
    x = factors.features([b"some words here, some twice", b"", b"one", "Änderung über alles ".encode() * 30], [27, None, 3, -5], {})
    got = machine.sums(x)[0]
    for i in range(4):
        part = slice(x.at[i], x.at[i + 1])
        assert abs(got[i] - plain_margin(machine, x.places[part], x.values[part].astype(float))) < 1e-6


def test_slopes_against_differences():
    """One step of a machine from a given state moves each parameter against its slope."""
    x, y = factors.features([b"a b c", b"b d", b"a d e e"], [1, 2, 3], {}), np.array([1.0, 0.0, 1.0])
    rng = np.random.default_rng(2)
    machine = factors.Machine(0.1, rng.normal(size=factors.PLACES), rng.normal(size=(factors.PLACES, factors.RANK)))
    loss = lambda m: float(np.mean(np.logaddexp(0, m.sums(x)[0]) - y * m.sums(x)[0]))
    margin, total, scaled = machine.sums(x)
    miss = (1 / (1 + np.exp(-margin)) - y) / len(y)
    for k in (0, 3, 5):
        p, f, eps = int(x.places[k]), k % factors.RANK, 1e-5
        at = np.flatnonzero(x.places == p)
        row = np.searchsorted(x.at, at, "right") - 1
        slope = float(np.sum(miss[row] * x.values[at] * (total[row, f] - scaled[at, f])))
        moved = [factors.Machine(machine.bias, machine.weights, machine.vectors.copy()) for _ in range(2)]
        moved[0].vectors[p, f] += eps
        moved[1].vectors[p, f] -= eps
        assert abs((loss(moved[0]) - loss(moved[1])) / (2 * eps) - slope) < 1e-4


def test_pairs_decide():
    """Good texts hold both words of a pair or neither: no word alone tells, so that weights alone can't and vectors can."""
    rng = random.Random(5)

    def text():
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [["north", "south"][a], ["east", "west"][b]] * 3
        rng.shuffle(words)
        return " ".join(words).encode(), int(a == b)

    rows = [text() for _ in range(1500)]
    x, y = factors.features([t for t, _ in rows], [5] * len(rows), {}), np.array([y for _, y in rows], np.float32)
    fresh = [text() for _ in range(500)]
    tested, want = factors.features([t for t, _ in fresh], [5] * len(fresh), {}), np.array([y for _, y in fresh])
    machine = factors.fit(x, y)
    right = lambda m: float(np.mean((m.score(tested) >= 0.5) == want))
    assert right(machine) > 0.99
    linear = factors.Machine(machine.bias, machine.weights, np.zeros_like(machine.vectors))
    assert right(linear) < 0.7


def test_held_out_documents(spark):
    got = factors.op13_factorisation_machine(spark, f"{DATA}/sf0.1")
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = got.join(table(spark, f"{DATA}/sf0.1", "labels"), "doc_id").filter("held_out").collect()
    assert got.count() == table(spark, f"{DATA}/sf0.1", "documents").count() and len(rows) > 700
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["predicted"] for r in good) > 0.99 * len(good) and sum(r["predicted"] for r in bad) < 0.05 * len(bad)
    assert min(sorted(r["score"] for r in good)[5:]) > max(sorted(r["score"] for r in bad)[:-5]) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


DOCS = "doc_id long, text string, n_chars long"


def test_odd_rows(spark):
    """Null and empty texts and sizes, repeated and null ids, equal texts, labels of both kinds or none, long texts, empty tables."""
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["fine", "plain", "words", "here"] if i % 2 else ["b@@d", "###", "j&nk", "$$"]) for _ in range(30)), 100) for i in range(200)]
    docs += [(None, None, None), (500, None, None), (501, "", 0), (1, docs[1][1], 100), (1, "another text", 12), (502, docs[1][1], 100), (503, "long " * 300_000, None), (504, "x", -3)]
    labels = [(i, i % 2, None) for i in range(200)] + [(3, 0, 0), (None, 1, 1), (500, None, 0), (501, 1, 0), (777, 1, 1)]
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trained = factors.training_rows(d, y).collect()
    ids = [r["doc_id"] for r in trained]
    assert len(ids) == len(set(ids)) and 3 not in ids and None not in ids and 500 not in ids and 777 not in ids and len({r["text"] for r in trained}) == len(trained)
    machine = factors.learn(d, y)
    got = factors.score(d.selectExpr("*", "'x' as Score", "1 as y"), machine)
    assert got.columns == ["doc_id", "n_chars", "y", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(docs) and len({r["score"] for r in rows if r["doc_id"] == 502} | {r["score"] for r in rows if r["doc_id"] == 1}) == 2
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in rows if r["doc_id"] is not None and r["doc_id"] < 200 and r["doc_id"] != 1) >= 195
    assert factors.score(d.limit(0), machine).collect() == []
    assert {r["score"] for r in factors.score(d, factors.learn(d, y.limit(0))).collect()} == {0.5}
    only = {round(r["score"], 6) for r in factors.score(d, factors.learn(d, y.filter("quality = 1 and doc_id <> 3"))).collect()}
    assert len(only) == 1 and only.pop() > 0.98


def test_the_sample_is_bounded(spark):
    d = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text", "id as n_chars")
    y = spark.range(4000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    n = factors.training_rows(d.unionByName(d), y, most=300).count()
    assert 200 < n < 400


@pytest.mark.parametrize("steps", [1, 50])
def test_learning_is_repeatable(steps):
    x, y = factors.features([b"a b", b"c d", b"a d"] * 30, [1] * 90, {}), np.array([1, 0, 1] * 30, np.float32)
    a, b = factors.fit(x, y, steps), factors.fit(x, y, steps)
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights) and np.array_equal(a.vectors, b.vectors)
