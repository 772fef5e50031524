"""Every operator on a table whose other columns have names that clash with whatever operators call theirs, with nulls and repeated rows."""

import random
import re
from pathlib import Path

import pytest

from lattico.llm import bpe, crossentropy, factors, fim, jaccard, licenses, mixing, quality, sharding, simhash, toxicity, whitening
from lattico.llm.common import Sheltered

#: Every name that any operator's source puts in quotes, and then some.
NAMES = sorted({n for p in Path(simhash.__file__).parent.glob("*.py") for n in re.findall(r"[\"']([A-Za-z_][A-Za-z_0-9]{0,20})[\"']", p.read_text())} - {"text", "doc_id", "lang", "source", "target", "path"})


def crossentropy_scores(df):
    marked = df.selectExpr("*", "doc_id % 2 = 0 as target")
    return crossentropy.score(marked, crossentropy.train(marked)).drop("target")


RUNS = {
    "mixing.draw": (mixing.draw, ["size", "source_size", "target", "draws"], None),
    "mixing.mix": (mixing.mix, ["shard", "position"], False),
    "quality.judge": (quality.judge, list(quality._ADDED), None),
    "quality.keep_documents": (quality.keep_documents, [], False),
    "sharding.assign": (lambda d: sharding.assign(d, limit=40), ["bytes", "shard"], None),
    "licenses.scan": (lambda d: licenses.scan(d, path="source"), ["license", "cosine", "line", "origin", "licence_file"], None),
    "toxicity.score": (lambda d: toxicity.score(d, toxicity.Scorer({"=b": 3.0})), ["score", "predicted", "clauses"], None),
    "simhash.keep_one": (simhash.keep_one, [], False),
    "simhash.keep_one, near copies": (lambda d: simhash.keep_one(d, near=jaccard.near_copies), [], False),
    "crossentropy.score": (crossentropy_scores, ["n_tokens", "target_loss", "background_loss", "difference"], None),
    "fim.transform": (fim.transform, ["n", "form", "prefix_chars", "middle_chars", "output"], None),
    "fim.restore": (lambda d: fim.restore(d.withColumnRenamed("text", "output"), form="lang"), ["restored"], None),
    "factors.score": (lambda d: factors.score(d, factors.constant(0.4), size="doc_id"), ["score", "predicted"], None),
    "whitening.whiten": (lambda d: whitening.whiten(d.selectExpr("*", "array(coalesce(doc_id, 0) * 0.5D, coalesce(length(text), 0) * 0.25D) as vector"), "vector").filter("component = 1"), ["component", "n", "deviation", "whitened", "explained", "identity_error"], None),
    "bpe.encode": (lambda d: bpe.encode(d, *bpe.default_vocabulary()), ["ids"], None),
}


@pytest.mark.parametrize("seed", [0])
@pytest.mark.parametrize("run", list(RUNS))
def test_clashing_names(spark, run, seed):
    fn, added, keeps_fewer = RUNS[run]
    rng = random.Random(f"{run}{seed}")
    extra = rng.sample(NAMES, 25) + [rng.choice(["Shard", "KEY", "N", "H"])]
    extra = [n for n in {n.lower(): n for n in extra}.values() if n.lower() not in {"text", "doc_id", "lang", "source", "target", "path"}]
    rows = [(i if i else None, rng.choice([None, "", "a b c", "word " * 30, f"text {i} of many words and more of them b"]), rng.choice(["en", None]), rng.choice(["s/x", "t", None]), *[rng.choice([None, j]) for j in range(len(extra))]) for i in range(30)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in extra))
    out = fn(df)
    dropped = {"text"} if run in ("licenses.scan", "crossentropy.score", "quality.judge", "fim.transform", "fim.restore", "factors.score") else set()
    kept = [c for c in df.columns if c.lower() not in {a.lower() for a in added} | dropped]
    assert out.columns == [*kept, *added]
    got, given = out.collect(), df.collect()
    if keeps_fewer is None:
        assert len(got) == len(rows)
    values = lambda rs: {tuple(r[c] for c in kept) for r in rs}
    assert values(got) <= values(given) and (keeps_fewer is False or values(got) == values(given))
    assert fn(df.limit(0)).collect() == []


def test_sheltered(spark):
    user = Sheltered(spark.createDataFrame([(1, 2)], "`a.b` int, Text int"))
    assert user.of("text") == user.of("Text") and user.back(user.df.withColumn("text", user.df[user.of("a.b")]), "text").first().asDict() == {"a.b": 1, "text": 1}
    with pytest.raises(ValueError, match="0 columns"):
        user.of("missing")
