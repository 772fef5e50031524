"""The pipeline at the smallest scale, each stage against what its operator says row by row."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
from lattico.llm import bpe, mixing, quality, simhash, toxicity
from lattico.llm.common import table
from tests.conftest import DATA
from tests.llm.test_jaccard import slow_kept, slow_set

SF = f"{DATA}/sf0.001"


def test_stages(spark):
    docs, seen = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.cut(stage(spark, docs, SF), "stage")
        seen[name] = (before.collect(), docs.collect())
        assert docs.columns == corpus_pipeline.COLUMNS or name == corpus_pipeline.STAGES[-1][0]
    before, after = seen["toxicity"]
    scorer = toxicity.learn(table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels"))
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if scorer.score(r["text"] or "") < 0.5)
    before, after = seen["quality rules"]
    kept = {r["doc_id"] for r in quality.judge(spark.createDataFrame(before, table(spark, SF, "documents").schema)).filter("kept").collect()}
    assert {r["doc_id"] for r in after} == kept and 0 < len(after) < len(before)
    before, after = seen["simhash near-dedup"]
    assert sorted(r["doc_id"] for r in after) == slow_kept([(r["doc_id"], r["text"]) for r in before])
    before, after = seen["mixing"]
    times, words = Counter(r["doc_id"] for r in after), {r["doc_id"]: len((r["text"] or "").encode().split()) for r in before}
    source = {r["doc_id"]: r["source"] for r in before}
    sizes, taken = Counter(), Counter()
    for i, s in source.items():
        sizes[s] += words[i]
        taken[s] += words[i] * times[i]
    rows = [("=" + s, s, n) for s, n in sizes.items()]
    target = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "skey string, source string, source_size long")).collect()}
    longest = {s: max(words[i] for i in words if source[i] == s) for s in sizes}
    assert max(times.values()) <= 3 and all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in sizes)
    before, after = seen["byte-level bpe"]
    codec = bpe.Codec(bpe.read_ranks(bpe.default_vocabulary()[0]), bpe.default_vocabulary()[1])
    want = Counter((r["doc_id"], len(ids := codec.encode(r["text"])), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()) for r in before)
    assert Counter(tuple(r) for r in after) == want


def test_run(spark):
    a, b = (sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert a == b and len(a) > 50


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, docs, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [], [])).collect() == []


def test_nulls_repeated_rows_and_long_texts(spark, tmp_path):
    """Null and short texts fail the base rule; a repeated row is one; null ids, languages and sources go through; one id with two texts is two documents."""
    plain = [" ".join(f"w{(i * 37 + j * j) % 911}" for j in range(60)) for i in range(6)]
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "few words", "en", "s", 9), (None, plain[0], None, None, None), (4, plain[1], "en", "s", 1), (4, plain[1], "en", "s", 1), (5, plain[2], "en", None, 1), (5, plain[3], None, "s", 1)]
    rng = random.Random(1)
    rows += [(6, " ".join(f"w{rng.randrange(911)}" for j in range(60_000)), "en", "s", 1)]
    got = corpus_pipeline.run(spark, write(spark, tmp_path, rows, [(1, None, None), (None, 1, 1), (4, 1, 0)])).collect()
    assert {r["doc_id"] for r in got} == {None, 4, 5, 6} and {r["n_tokens"] > 100_000 for r in got if r["doc_id"] == 6} == {True}
    assert len({r["decoded_sha256"] for r in got if r["doc_id"] == 5}) == 2


def test_copies_by_fingerprint_and_by_shingles(spark):
    """Texts that only their fingerprints link, texts that only their sets of shingles link, and what leads from one to the other."""
    line, tails = " ".join(f"line{i}" for i in range(11)), [" ".join(f"{x}{i}" for i in range(60)) for x in "abc"]
    texts = {1: f"{line} {tails[1]}", 2: f"{line} " * 40 + tails[1], 3: f"{line} " * 40 + tails[0], 4: tails[2]}
    near = lambda a, b: len(slow_set(texts[a]) & slow_set(texts[b])) / len(slow_set(texts[a]) | slow_set(texts[b])) >= 0.8
    apart = lambda a, b: (simhash.fingerprint(texts[a].encode()) ^ simhash.fingerprint(texts[b].encode())).bit_count()
    assert near(1, 2) and apart(1, 2) > 4 and not near(2, 3) and apart(2, 3) <= 4 and not near(1, 3) and apart(1, 3) > 4
    kept = lambda ids: sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, spark.createDataFrame([(i, texts[i], "en", "s", 1) for i in ids], DOCS), "").collect())
    assert kept([2, 3, 4]) == [2, 4] and kept([1, 2, 4]) == [1, 4] and kept([1, 2, 3, 4]) == [1, 4]
