import random

import corpus_pipeline
from lattico.llm import jaccard


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(rows):
    """The smallest id of each component of texts with a Jaccard similarity of 0.8 or more."""
    sets, left = {i: slow_set(t) for i, t in rows}, {i for i, _ in rows}
    kept = []
    while left:
        todo = [min(left)]
        kept.append(todo[0])
        left.discard(todo[0])
        while todo:
            a = sets[todo.pop()]
            near = {j for j in left if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0}
            left -= near
            todo += near
    return kept


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return words


def rows_of(rng):
    out, passage = [], [f"p{i}" for i in range(30)]
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 150))]
        out += [" ".join(words)] + [" ".join(changed(rng, words, n)) for n in (1, 2, 2, 3, 4, 5)]
    crowd = [f"c{i}" for i in range(120)]
    out += [" ".join(changed(rng, crowd, rng.randint(1, 2))) for _ in range(80)]
    out += [" ".join(passage + [f"w{rng.randrange(5000)}" for _ in range(40)]) for _ in range(60)]
    out += ["", None, " \n", "one", "ONE", "one two", "one two three four five", "one two three four five six"]
    return list(enumerate(out, 1))


def test_all_near_copies_go(spark):
    rows = rows_of(random.Random(5))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, "").collect())
    assert got == slow_kept(rows) and len(got) < len(rows) - 150


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"] for r in jaccard.near_copies(docs).collect() if r["doc_id"] == r["component_id"]}
    assert sorted(got) == slow_kept([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_bitmaps_bound_what_differs(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng, rows = np.random.default_rng(1), []
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = rng.choice(10**6, n, replace=False)
        b = np.unique(np.concatenate([a[int(rng.integers(0, n // 4 + 1)) :], rng.choice(10**6, int(rng.integers(0, n // 4 + 1)))]))
        hashed = [np.unique(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64) for x in (a, b)]
        rows.append((*[jaccard.parities(x).tolist() for x in hashed], len(set(a.tolist()) ^ set(b.tolist())), n))
    got = spark.createDataFrame([r for r in rows if max(len(r[0]), len(r[1])) <= 2 * min(len(r[0]), len(r[1]))], "am array<long>, bm array<long>, differ long, n long").select("differ", "n", F.expr(jaccard._APART).alias("apart")).collect()
    assert len(got) > 250 and all(r["apart"] <= r["differ"] and (r["apart"] - r["differ"]) % 2 == 0 for r in got) and sum(r["apart"] for r in got) > 0.5 * sum(r["differ"] for r in got)
