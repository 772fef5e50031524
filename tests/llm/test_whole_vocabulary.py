import math
import random
from collections import Counter

import pytest

from lattico.llm import crossentropy as ce


def slow(rows, sent):
    """Losses of every text by plain counts of all other texts, as the models are defined, whatever is sent."""
    words_of = lambda t: (t or "").encode().lower().split()
    grams_of = lambda t: list(zip(["", *words_of(t)[:-1]], words_of(t), strict=False))
    tokens = [sum(len(words_of(t)) for _, t, y in rows if y or k) for k in (0, 1)]
    scale = [1.0, tokens[0] / tokens[1]]
    words = [Counter(w for _, t, y in rows if y or k for w in words_of(t)) for k in (0, 1)]
    grams = [Counter(g for _, t, y in rows if y or k for g in grams_of(t)) for k in (0, 1)]
    starts = [sum(1 for _, t, y in rows if (y or k) and words_of(t)) for k in (0, 1)]

    def loss(k, text, marked):
        mine, own_words, own_grams, out = k or marked, Counter(words_of(text)), Counter(grams_of(text)), 0.0
        left = lambda counts, own, x: (counts[x] - own[x] * mine) * scale[k]
        for h, w in grams_of(text):
            p = (left(words[k], own_words, w) + ce.LEAST) / (tokens[k] * scale[k] + ce.LEAST * (len(words[1]) + 1))
            n_h = left(words[k], own_words, h) if h else (starts[k] - bool(mine)) * scale[k]
            out -= math.log((left(grams[k], own_grams, (h, w)) + ce.PRIOR * p) / (n_h + ce.PRIOR))
        return out / len(words_of(text)) if words_of(text) else None

    known = sum(n >= max(sent * tokens[1], 1) for n in words[1].values())
    return {i: (loss(0, t, bool(y)), loss(1, t, bool(y))) for i, t, y in rows}, known, len(words[1])


@pytest.mark.parametrize("sent, frequent, pair", [(ce.SENT_SHARE, ce.FREQUENT_SHARE, ce.PAIR_SHARE), (5e-4, 2e-3, 1e-3), (5e-4, 1.0, 1.0), (1.0, 1.0, 1.0)])
def test_against_plain_counts(spark, monkeypatch, sent, frequent, pair):
    """Losses are those of plain counts over all words and bigrams, whatever is sent."""
    monkeypatch.setattr(ce, "FLUSH", 50)
    monkeypatch.setattr("lattico.llm.common.BYTES_AT_ONCE", 600)  # many small batches
    rng = random.Random(1)
    rows = [(i, f"the word w{i} is W{i} here {rng.choice('abc')} {rng.choice('abc')} r{rng.randrange(300)} {' '.join(f'q{rng.randrange(40)}' for _ in range(4))}", i % 2 == 0) for i in range(600)]
    rows += [(9000, None, True), (9001, "", None), (9002, "the word", False), (9003, "the word", False), (9004, "word " * 3000, None), (9005, " \n", True), (9006, "long " * 200_000 + "w1 w2", True), (9007, "the word", True)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, target boolean, DIFFERENCE string").repartition(5)
    models = ce.train(docs, sent=sent, frequent=frequent, pair=pair)
    got = ce.score(docs, models).collect()
    want, known, vocabulary = slow(rows, sent)
    assert len(got) == len(rows) and models.kinds == vocabulary and len(models.words) == known
    for r in got:
        t, b = want[r["doc_id"]]
        assert (r["target_loss"] is None) == (t is None)
        assert t is None or abs(r["target_loss"] - t) < 1e-6 and abs(r["background_loss"] - b) < 1e-6 and abs(r["difference"] - (t - b)) < 1e-6, (r, t, b)
    by = {r["doc_id"]: r["difference"] for r in got}
    assert by[9000] is None and by[9001] is None and by[9002] == by[9003] != by[9007]


def test_documents_at_both_sizes(spark):
    """The given documents, and a table ten times as many words of them: equal to plain counts of all words and bigrams."""
    from lattico.llm.common import table
    from tests.conftest import DATA

    docs = ce.mark(table(spark, f"{DATA}/sf0.001", "documents").select("doc_id", "text"), table(spark, f"{DATA}/sf0.001", "labels").filter("quality = 1").select("doc_id"))
    more = docs.unionByName(table(spark, f"{DATA}/sf0.01", "documents").selectExpr("doc_id + 1000000 as doc_id", "text", "doc_id % 3 = 0 as target"))
    for d in (docs, more):
        rows = [(r["doc_id"], r["text"], r["target"]) for r in d.collect()]
        want, *_ = slow(rows, 1.0)
        for r in ce.score(d, ce.train(d)).collect():
            t, b = want[r["doc_id"]]
            assert abs(r["target_loss"] - t) < 1e-6 and abs(r["background_loss"] - b) < 1e-6


def test_shares_bound_what_is_sent():
    assert 1 / ce.SENT_SHARE <= 1_000_000.5 and 1 / ce.FREQUENT_SHARE <= 100_000.5 and 1 / ce.PAIR_SHARE <= 1_000_000.5


def test_bigrams_tell_order(spark):
    rows = [(i, "a b " * 30, True) for i in range(20)] + [(100 + i, "b a " * 29 + "a a b b", False) for i in range(20)] + [(200, "a b a b a b", None), (201, "b b a a b b a a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, target boolean")
    by = {r["doc_id"]: r["difference"] for r in ce.score(docs, ce.train(docs)).collect()}
    assert by[200] < by[201]


def test_no_target_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, "c", False)], "doc_id long, text string, target boolean")
    assert all(abs(r["difference"]) < 1e-12 for r in ce.score(docs, ce.train(docs)).collect())
    empty = docs.limit(0)
    assert ce.score(empty, ce.train(empty)).collect() == []


def test_marks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c"), (3, "d")], "doc_id long, text string")
    ids = spark.createDataFrame([(3,), (3,), (None,), (7,)], "doc_id long")
    for most in (ce.MOST_MARKS, 0):
        monkeypatch.setattr(ce, "MOST_MARKS", most)
        assert sorted((r["text"], r["target"]) for r in ce.mark(docs, ids).collect()) == [("a", False), ("b", False), ("c", True), ("d", True)]
