"""Fill-in-middle against a plain version, text by text, over any batches."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattico.llm import fim
from lattico.llm.common import table
from tests.conftest import DATA

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def slow(text, h):
    tokens = TOKEN.findall(text)
    one, two = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (tokens[:one], tokens[one:two], tokens[two:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def numbers(id_):
    digest = hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


#: Pieces that meet tokens' edges, marks and their parts, and code points of one to four bytes.
PIECES = st.text(alphabet=st.sampled_from(list("aZ<PSM> \n9é漢😀\0")), max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), PIECES), max_size=9), st.randoms(use_true_random=False), st.integers(0, 3))
def test_kernel(texts, rng, skip):
    column = pa.array(texts, pa.string())[min(skip, len(texts)) :]  # a slice's buffers begin before it
    texts = [t or "" for t in column.to_pylist()]
    h = np.array([[rng.randrange(2**32) for _ in range(4)] for _ in texts], np.int64).reshape(len(texts), 4)
    made = fim.cut_batch(*fim.buffers(column), h)
    outputs = fim.as_strings(made["output"], made["output_at"])
    got = [(n, f, None if f == "plain" else p, None if f == "plain" else m, o) for n, f, p, m, o in zip(made["n"].tolist(), fim.FORMS[made["form"]].tolist(), made["prefix_chars"].tolist(), made["middle_chars"].tolist(), outputs.to_pylist(), strict=True)]
    assert got == [slow(t, x.tolist()) for t, x in zip(texts, h, strict=True)]
    assert fim.as_strings(*fim.join_batch(*fim.buffers(outputs), made["form"])).to_pylist() == texts


def test_query_against_the_plain_version(spark):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in table(spark, f"{DATA}/sf0.01", "documents").select("doc_id", "text").collect():
        *rest, output = slow(r["text"] or "", numbers(r["doc_id"]))
        want.append((r["doc_id"], *rest, digest(output), digest(r["text"] or "")))
    out = fim.op12_fill_in_middle(spark, f"{DATA}/sf0.01")
    assert dict(out.dtypes) == {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"}
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and {w[2] for w in want} == {"plain", "psm", "spm"}


def test_rows(spark):
    """Null and empty texts, marks, null and repeated ids, repeated rows, very long texts, and names that clash."""
    rng = random.Random(4)
    long = "".join(rng.choice(["word", " ", "\n", "é", "漢字", "😀", "<P", "S>"]) for _ in range(400_000))
    rows = [(1, None), (2, ""), (3, "a <S> b"), (None, "some text here"), (4, "twice told"), (4, "twice told"), (4, "other text, same id"), (5, long), (6, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' as Form", "7 as other")
    made = fim.transform(df)
    assert made.columns == ["doc_id", "other", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted([tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()], key=repr)
    assert got == sorted([(i, *slow(t or "", numbers(i))) for i, t in rows], key=repr)
    back = fim.restore(made)
    assert sorted((r["restored"] for r in back.collect())) == sorted(t or "" for _, t in rows)
    assert fim.transform(df.limit(0)).collect() == [] and fim.restore(made.limit(0)).collect() == []


def test_outputs_without_marks_fail(spark):
    bad = spark.createDataFrame([("psm", "<P>only one")], "form string, output string")
    with pytest.raises(Exception, match="three marks"):
        fim.restore(bad).collect()
    assert [r["restored"] for r in fim.restore(spark.createDataFrame([(None, None), ("plain", "<P>")], "form string, output string")).collect()] == ["", "<P>"]
