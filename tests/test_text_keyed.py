import hashlib

from pyspark.sql import functions as F

from lattico.functions import keyed, text


def test_clip(one):
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")
    assert one(text.clip_marked(letters, 10)) == "abcdefg …[16 chars omitted]… xyz"
    assert one(text.clip_plain(letters, 10)) == "abcdefg…yz"
    assert one(text.clip_marked(F.lit("short"), 10)) == "short"


def test_normal_and_fragments(one):
    assert one(text.normal(F.lit(" A　b\n C "))) == "a b c"
    long = "x" * 60
    assert one(text.fragments(F.lit(f"{long}. {long}!short? {long}y"))) == [long + ".", long, long + "y"]
    assert one(text.fragments(F.lit(""))) == []


def test_languages_differ(one):
    t = F.lit("aaaaaaaaaaaaaaaaaaaaa中")
    assert one(text.language_by_share(t)) == "en"
    assert one(text.language_by_any(t)) == "zh"
    assert one(text.language_by_share(F.lit(""))) == "en"


def test_option_lines(one):
    o = F.array(F.struct(F.lit("true").alias("name"), F.lit("d").alias("desc")), F.struct(F.lit("false").alias("name"), F.lit("").alias("desc")))
    assert one(text.option_lines(o, F.lit("noul"))) == ["A. Yes: d", "B. No"]
    assert one(text.option_lines(o, F.lit("choice"))) == ["A. true: d", "B. false"]
    assert text.labels()[25:28] == ["Z", "AA", "AB"] and len(text.labels()) == 255


def test_description_cap(one):
    n = F.array(*map(F.lit, (10, 50, 30)))
    assert one(text.description_cap(n, 60, 5)) == 25
    assert one(text.description_cap(n, 90, 5)) == 50
    assert one(text.description_cap(n, 9, 5)) == 0


def test_common_prefix(one):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(text.common_prefix(a(1, 2, 3), a(1, 2, 4, 5))) == 2
    assert one(text.common_prefix(a(1, 2), a(1, 2, 4))) == 2
    assert one(text.common_prefix(a(7), a(1))) == 0


def test_sha1_remainder_is_the_big_number(one):
    for x in ("", "a", "group-17", "é中"):
        assert one(keyed.remainder_of_sha1(F.lit(x))) == int(hashlib.sha1(x.encode()).hexdigest(), 16) % 10_000


def test_shuffled_is_a_permutation(spark):
    rows = spark.range(50).select(keyed.shuffled(F.array(*map(F.lit, "abcdef")), "s", F.col("id")).alias("x")).collect()
    assert all(sorted(r["x"]) == list("abcdef") for r in rows) and len({tuple(r["x"]) for r in rows}) > 20


def test_leaves(spark):
    deep = '{"d":' * 60 + '["end", {"e": "more"}, 1, null, true]' + "}" * 60
    docs = spark.createDataFrame([(1, '{"a":["x",{"b":"y"}],"c":3}'), (2, "[]"), (3, None), (4, "not json"), (5, deep), (6, '"[{alone"'), (7, '{"k":"","l":["z","z"]}')], "id long, doc string")
    got = sorted((r["id"], r["leaf"]) for r in docs.select("id", F.explode(text.leaves("doc")).alias("leaf")).collect())
    assert got == [(1, "x"), (1, "y"), (5, "end"), (5, "more"), (6, "[{alone"), (7, ""), (7, "z"), (7, "z")]


def test_leaves_of_many_documents(spark):
    """Two million values in all: more than a recursive query takes."""
    docs = spark.range(400_000).select(F.format_string('{"a":["x%d",{"b":"y"}],"c":3}', "id").alias("doc"))
    assert docs.select(F.explode(text.leaves("doc"))).count() == 800_000
