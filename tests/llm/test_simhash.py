import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64

from lattico.llm import simhash
from lattico.llm.components import components
from tests.conftest import DATA


def slow_print(text):
    words = [w for w in text.encode().lower().split()]
    pieces = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64(p, seed=42).intdigest() for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aB éÉ\n\t\x1c "), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_print(text)


def slow_classes(fps, radius=4):
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in fps}


def test_all_links_are_found(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for base in fps[:40]:
        for d in (1, 2, 3, 4, 4, 5, 6):
            fps.append(base ^ sum(1 << b for b in rng.sample(range(64), d)))
    crowd = rng.getrandbits(64)  # a crowd within a few bits, and a chain of steps of four bits
    fps += [crowd ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 5))) for _ in range(200)]
    for i in range(12):
        fps.append(crowd ^ ((1 << 4 * (i + 1)) - 1) << 12 & (2**64 - 1))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    got = {r["fp"]: r["cls"] for r in simhash.classes(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == slow_classes(signed)


def test_thresholds_add_up(spark):
    rows = spark.createDataFrame([(random.Random(i).getrandbits(63),) for i in range(300)], "fp long")
    found = simhash.plan(rows)
    assert sum(t + 1 for _, t in found) == simhash.RADIUS + 1 and len({b for g, _ in found for b in g}) == sum(len(g) for g, _ in found)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (101, 101), (100, 101), (7, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 300: 1, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(900_001, None), (900_002, ""), (900_003, " \n"), (900_003, " \n"), (None, "")], "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.unionByName(extra).collect()]
    prints = [int(np.uint64(slow_print(t or "")).view(np.int64)) for _, t in rows]
    cls = slow_classes(prints)
    least = {}
    for (i, _), f in zip(rows, prints, strict=True):
        if i is not None:
            least[cls[f]] = min(least.get(cls[f], i), i)
    got = simhash.near_duplicates(docs.unionByName(extra)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, f"{f & (2**64 - 1):016x}", least[cls[f]]) for (i, _), f in zip(rows, prints, strict=True)), key=key)
    kept = simhash.keep_one(docs.unionByName(extra)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(least.values()))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp int")
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []


def test_one_id_with_two_texts(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b)], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.keep_one(rows).collect()) == [(1, a), (5, b)]
