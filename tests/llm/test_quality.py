import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattico.llm import quality


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "#x", "\n", "\x1c", " ", "a b\n", "\t", "%"]), max_size=40))
def test_counts(parts):
    text = " ".join(parts)
    assert quality.text_statistics(text.encode())[:5] == slow(text)


def prose(rng, n, lexicon):
    return " ".join(rng.choice(lexicon) for _ in range(n)).capitalize() + "."


def docs(n=300):
    rng = random.Random(1)
    lexicon = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows = [(i, prose(rng, rng.randint(12, 300), lexicon), "en", "s") for i in range(n)]
    rows += [(1000 + i, " | ".join(rng.choice(lexicon) for _ in range(60)), "en", "s") for i in range(8)]
    rows += [(2000 + i, prose(rng, 80, lexicon).upper().replace(" ", "!! "), "en", "s") for i in range(8)]
    rows += [(3000, None, "en", "s"), (3001, "", None, None), (3002, "few words", "xx", None), (3003, prose(rng, 50, lexicon), None, "s"), (3004, "same five words over again " * 9, "en", "s"), (0, rows[0][1], "en", "s")]
    return rows


def test_outliers(spark):
    df = spark.createDataFrame([(*r, 7, "clash") for r in docs()], "doc_id long, text string, lang string, source string, n_words int, kept string")
    got = quality.judge(df).collect()
    assert len(got) == len(docs())
    for r in got:
        if r["doc_id"] < 1000 or r["doc_id"] == 3003:
            assert r["kept"] and not r["base_failed"], r
        else:
            assert not r["kept"], r
        assert r["base_failed"] == (r["doc_id"] in (3000, 3001, 3002, 3004))
    kept = quality.keep_documents(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])
    assert all(r["kept"] == "clash" and r["n_words"] == 7 for r in kept.collect())


def vectors(spark, rows):
    return spark.createDataFrame([("g", "s", *map(float, r)) for r in rows], "gl string, gs string, " + ", ".join(f"x{i} double" for i in range(quality.P)))


def slow_mcd(x, h=quality.H):
    """Concentration steps on sorted distances from the same kinds of start, by numpy alone; least determinant, then reweighted."""
    fit = lambda k, scale=1.0: quality.fitted(len(k), k.sum(0), np.array([(k[:, i] * k[:, j]).sum() for i, j in quality._PAIRS]), scale)
    far = lambda c, s: np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(s), x - c)
    best = None
    for made in (0 * x, np.tanh(x), x / np.sqrt((x * x).sum(1, keepdims=True) + 1e-12) * quality.P**0.5):
        c, s, least = np.zeros(quality.P), fit(made)[1], np.inf
        for _ in range(50):
            c2, s2 = fit(x[np.argsort(far(c, s))[: int(round(h * len(x)))]], quality.CONSISTENCY)
            det = np.linalg.slogdet(s2)[1]
            if det >= least - 1e-6:
                break
            c, s, least = c2, s2, det
        best = min(best or (np.inf, None, None), (least, c, s), key=lambda b: b[0])
    return fit(x[far(*best[1:]) <= quality.REWEIGHT])


def test_estimate_against_sorted_steps(spark):
    """A fifth of the rows lie off, some of them only against the correlation of two statistics."""
    rng = np.random.default_rng(2)
    mix = np.eye(quality.P)
    mix[0, 3] = mix[3, 0] = 0.95
    x = rng.multivariate_normal(np.zeros(quality.P), 2 * mix, 2000)
    off = rng.normal(9, 0.5, (300, quality.P))
    against = np.zeros((150, quality.P))
    against[:, 0], against[:, 3] = 2.0, -2.0
    rows = np.vstack([x, off, against + rng.normal(0, 0.1, (150, quality.P))])
    got = quality.estimate(vectors(spark, rows)).first()
    centre, cov = slow_mcd(rows)
    mine = np.linalg.inv(np.array(got["precision"]).reshape(quality.P, quality.P))
    assert np.abs(np.array(got["centre"]) - centre).max() < 0.05 and np.abs(mine - cov).max() < 0.08
    far = lambda v: (v - got["centre"]) @ np.array(got["precision"]).reshape(quality.P, quality.P) @ (v - got["centre"])
    odd = np.zeros(quality.P)
    odd[0], odd[3] = 2.5, -2.5
    assert far(odd) > quality.CUTOFF  # each statistic is within 1.8 deviations: the covariance alone tells
    assert (odd**2 / np.diag(mine)).sum() < quality.CUTOFF / 4
    assert sum(far(r) <= quality.CUTOFF for r in x) >= 1990


def test_covariance_decides(spark, monkeypatch):
    """Texts that are odd in no single statistic, but in how two of them go together, are rejected; not with the estimate's covariance taken out."""
    rng = random.Random(3)

    def text(long, marked, n=300):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice((6, 7, 8) if long else (3, 4, 5)))) for _ in range(n)]
        return " ".join(w + ("," if rng.random() < (0.35 if marked else 0.08) else "") for w in words)

    rows = [(i, text(i % 2, i % 2), "en", "s") for i in range(400)] + [(1000 + i, text(i % 2, 1 - i % 2), "en", "s") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    verdicts = lambda: {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    with_it = verdicts()
    assert not any(with_it[i] for i in range(1000, 1010)) and sum(with_it[i] for i in range(400)) >= 396
    real = quality.estimate

    def own(batches):
        """Each statistic by the covariance's own variance of it, and none with another."""
        for b in batches:
            b["precision"] = [np.diag(1 / np.diag(np.linalg.inv(np.array(p).reshape(quality.P, quality.P)))).ravel().tolist() for p in b["precision"]]
            yield b

    spread = lambda v: real(v).mapInPandas(own, "gl string, gs string, centre array<double>, precision array<double>")
    monkeypatch.setattr(quality, "estimate", spread)
    assert any(verdicts()[i] for i in range(1000, 1010))


def test_medians(spark):
    rng = random.Random(4)
    rows = [(lang, source, *[rng.random() for _ in range(quality.P)]) for lang, source, n in (("a", "x", 301), ("a", "y", 1), ("b", "x", 50)) for _ in range(n)]
    df = spark.createDataFrame(rows, "gl string, gs string, " + ", ".join(f"r{i} double" for i in range(quality.P)))
    got = {(r["gl"], r["gs"]): r["medians"] for r in quality.medians(df).collect()}
    mid = lambda keep, i: np.median([r[2 + i] for r in rows if keep(r)])
    for (gl, gs), found in got.items():
        own, lang, n, nl = [r for r in rows if r[:2] == (gl, gs)], [r for r in rows if r[0] == gl], 0, 0
        n, nl = len(own), len(lang)
        for i in range(quality.P):
            wide = (mid(lambda r: r[0] == gl, i) * nl + mid(lambda r: True, i) * 7) / (nl + 7)
            assert abs(found[i] - (mid(lambda r: r[:2] == (gl, gs), i) * n + wide * 7) / (n + 7)) < 0.02
    assert {r["medians"][0] for r in quality.medians(df.repartition(7)).collect()} == {m[0] for m in got.values()}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.judge(empty).collect() == [] and quality.keep_documents(empty).collect() == []
    short = spark.createDataFrame([(1, "x", "en", "s")], "doc_id long, text string, lang string, source string")
    assert [r["kept"] for r in quality.judge(short).collect()] == [False]
    assert quality.judge(short).select(F.col("distance")).count() == 1


def test_plans_stay_small(spark, monkeypatch):
    """The driver plans every step anew: neither a step's plan nor the verdicts' may hold the statistics' products written out."""
    size, sizes, real = lambda df: len(df._jdf.queryExecution().optimizedPlan().toJSON()), {}, quality.cut

    def cut(df, what):
        sizes.setdefault(what, []).append(size(df))
        return real(df, what)

    monkeypatch.setattr(quality, "cut", cut)
    df = spark.createDataFrame(docs(40), "doc_id long, text string, lang string, source string")
    assert size(quality.keep_documents(df)) < 250_000
    assert max(max(found) for found in sizes.values()) < 150_000


def test_partitions_and_groups(spark):
    """Packed rows and sums by task give the same estimates however the rows of several groups are dealt, and those of a group alone."""
    rng = np.random.default_rng(5)
    rows = [(g, s, *map(float, r)) for g, s, n in (("a", "x", 1300), ("a", "y", 3), ("b", "x", 700)) for r in rng.normal(0, 1 + len(g + s), (n, quality.P))]
    rng.shuffle(rows)
    frame = lambda keep: spark.createDataFrame([(*r[:2], *map(float, r[2:])) for r in rows if keep(r)], "gl string, gs string, " + ", ".join(f"x{i} double" for i in range(quality.P)))
    found = lambda df: {(r["gl"], r["gs"]): np.array(r["centre"] + r["precision"]) for r in quality.estimate(df).collect()}
    dealt, alone = found(frame(lambda r: True).repartition(7)), found(frame(lambda r: r[0] == "b").coalesce(1))
    whole = found(frame(lambda r: True).coalesce(1))
    assert dealt.keys() == whole.keys() == {("a", "x"), ("a", "y"), ("b", "x")}
    assert all(np.abs(dealt[k] - whole[k]).max() < 1e-9 for k in whole) and np.abs(alone["b", "x"] - whole["b", "x"]).max() < 1e-9
