"""Overlap of texts with benchmarks: full texts and sentence fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

FULL_LEAST, FRAGMENT_LEAST, SHARE = 20, 60, 0.2


def index(benchmarks: DataFrame, lenient: tuple[str, ...] = ()) -> DataFrame:
    """(kind, x, strict) of benchmark texts (benchmark, text): full texts and fragments; those of lenient benchmarks aren't strict."""
    strict = ~F.col("benchmark").isin(*lenient) if lenient else F.lit(True)
    full = benchmarks.select(F.lit("full").alias("kind"), T.normal(F.col("text")).alias("x"), strict.alias("strict")).filter(F.length("x") >= FULL_LEAST)
    frag = benchmarks.select(F.lit("frag").alias("kind"), F.explode(T.fragments(F.col("text"), FRAGMENT_LEAST)).alias("x"), strict.alias("strict"))
    return full.unionByName(frag).groupBy("kind", "x").agg(F.bool_or("strict").alias("strict"))


def _digest(x: Column) -> Column:
    """128 bits that stand for a text where texts meet: equal texts alone have equal digests, for any number of texts that fits a disk."""
    return F.unhex(F.md5(x))


#: Digests that are sent to every task, at most (some 60 MB); beyond, texts' digests are moved to the index.
MOST_SENT = 1_000_000


def digested(found: DataFrame) -> DataFrame:
    """(kind, x, strict) of an index of texts or of digests, one row for each digest."""
    x = F.col("x") if dict(found.dtypes)["x"] == "binary" else _digest(F.col("x"))
    return found.select("kind", x.alias("x"), "strict").groupBy("kind", "x").agg(F.bool_or("strict").alias("strict"))


def contamination(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(id, n_frags, hits, full_hit, strict_hit, contaminated) of each id in texts (id, source, text); ids may have several texts.

    Contaminated: a whole text in the index, a strict fragment, or a fifth of the fragments. Sources that begin with gen_ never are.
    Texts become digests in the scan, which is read once, and don't move: digests are told apart by a join with the index, which is
    sent to the tasks while it has at most MOST_SENT, and gathered as sets by id, first within each task.
    """
    frags = F.transform(T.fragments(F.col("text"), FRAGMENT_LEAST), lambda x: F.struct(F.lit("frag").alias("kind"), _digest(x).alias("x")))
    asked = F.array_append(frags, F.struct(F.lit("full").alias("kind"), _digest(T.normal(F.col("text"))).alias("x")))
    made = texts.select("id", F.startswith(F.col("source"), F.lit("gen_")).alias("generated"), F.explode(F.coalesce(asked, F.array().cast("array<struct<kind:string,x:binary>>"))).alias("a"))
    index_ = digested(found)
    index_ = F.broadcast(index_) if index_.count() <= MOST_SENT else index_
    met = made.select("id", "generated", "a.*").join(index_.withColumn("hit", F.lit(True)), ["kind", "x"], "left")
    frag, hit = F.col("kind") == "frag", F.coalesce("hit", F.lit(False))
    by = met.groupBy("id").agg(
        F.size(F.collect_set(F.when(frag, F.col("x")))).cast("long").alias("n_frags"), F.size(F.collect_set(F.when(frag & hit, F.col("x")))).cast("long").alias("hits"),
        F.bool_or(~frag & hit).alias("full_hit"), F.bool_or(frag & hit & F.coalesce("strict", F.lit(False))).alias("strict_hit"), F.bool_or("generated").alias("generated"))
    enough = (F.col("n_frags") > 0) & (F.coalesce(F.try_divide(F.col("hits"), F.col("n_frags")), F.lit(0.0)) >= SHARE)
    contaminated = ~F.coalesce("generated", F.lit(False)) & (F.col("full_hit") | F.col("strict_hit") | enough)
    return by.select("id", "n_frags", "hits", "full_hit", "strict_hit", contaminated.alias("contaminated"))


#: Format of stored indexes: rows of another one count as absent.
FORMAT = 2
STORED = "benchmark string, kind string, x binary, strict boolean, format int"


def stored_index(spark: SparkSession, path: str, benchmarks: dict[str, Callable[[], DataFrame]], lenient: tuple[str, ...] = ()) -> DataFrame:
    """(benchmark, kind, x, strict) of these benchmarks: digests kept as Parquet at path, sorted by digest within files.

    benchmarks: a loader of (text) rows by name. Only the loaders of benchmarks that the stored index lacks are called, and what they
    give is added to it; a run that asks for nothing new reads no benchmark. Rows of an older format, without a mark of strictness
    among them, count as absent, so that their benchmarks are loaded anew. A benchmark without any text long enough is kept as a
    row of its own that meets nothing. Writers that add the same benchmark at once do no harm: equal digests are one.
    """

    def there() -> DataFrame:
        empty = spark.createDataFrame([], STORED)
        try:
            found = spark.read.option("mergeSchema", "true").parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return empty
            raise
        if not set(empty.columns) <= set(found.columns):
            return empty
        return found.select(*empty.columns).filter((F.col("format") == FORMAT) & F.col("strict").isNotNull())

    known = {r["benchmark"] for r in there().select("benchmark").distinct().collect()}  # names of benchmarks
    missing = [name for name in benchmarks if name not in known]
    for name in missing:
        rows = digested(index(benchmarks[name]().select(F.lit(name).alias("benchmark"), "text"), lenient))
        mark = spark.createDataFrame([("none", b"", False)], "kind string, x binary, strict boolean")
        made = rows.unionByName(mark).select(F.lit(name).alias("benchmark"), "kind", "x", "strict", F.lit(FORMAT).alias("format"))
        made.repartition("x").sortWithinPartitions("x").write.mode("append").parquet(path)
    return there().filter(F.col("benchmark").isin(*benchmarks) & (F.col("kind") != "none")).select("benchmark", "kind", "x", "strict")


def _fragment_digests(text: str) -> Column:
    return F.transform(T.fragments(F.col(text), FRAGMENT_LEAST), _digest)


def seen_by(rows: DataFrame, train: DataFrame, least: int = FRAGMENT_LEAST) -> DataFrame:
    """rows (id, text, ...) with seen: whether a fragment also occurs in train's texts. Digests of fragments meet; a null id is seen by none."""
    digests = lambda c: F.explode(F.transform(T.fragments(c, least), _digest)).alias("x")
    keys = train.select(digests(F.col("text"))).distinct()
    hits = rows.select("id", digests(F.col("text"))).join(keys, "x", "left_semi").select("id").distinct().withColumn("seen", F.lit(True))
    return rows.join(hits, "id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def report(evals: DataFrame, train: DataFrame, top: int = 4) -> DataFrame:
    """(eval, full_rows, frag_rows, source, hits, place): rows of each evaluation set that overlap, and the training sources with most hits.

    evals: (eval, id, text); train: (source, text). Each side's texts are read once, as digests of whole texts and of fragments; a
    fragment is paired with each source that has it once, and only fragments that both sides have are kept for all three counts.
    """
    def pieces(rows: DataFrame, keys: list[str]) -> DataFrame:
        norm = T.normal(F.col("text"))
        full = F.when(F.length(norm) >= FULL_LEAST, F.array(F.struct(F.lit("full").alias("kind"), _digest(norm).alias("x")))).otherwise(F.array().cast("array<struct<kind:string,x:binary>>"))
        frags = F.transform(_fragment_digests("text"), lambda x: F.struct(F.lit("frag").alias("kind"), x.alias("x")))
        return rows.select(*keys, F.explode(F.concat(frags, full)).alias("p")).select(*keys, "p.*").distinct()

    shared = pieces(evals, ["eval", "id"]).join(pieces(train, ["source"]), ["kind", "x"])
    by_row = shared.groupBy("eval", "kind").agg(F.count_distinct("id").alias("rows"))
    counts = by_row.groupBy("eval").agg(F.max(F.when(F.col("kind") == "full", F.col("rows"))).alias("full_rows"), F.max(F.when(F.col("kind") == "frag", F.col("rows"))).alias("frag_rows"))
    by_source = shared.filter("kind = 'frag'").groupBy("eval", "source").agg(F.count("*").alias("hits"))
    place = F.row_number().over(Window.partitionBy("eval").orderBy(F.desc("hits"), "source"))
    best = by_source.withColumn("place", place).filter(F.col("place") <= top)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return evals.select("eval").distinct().join(counts, "eval", "left").join(best, "eval", "left").select("eval", zero("full_rows"), zero("frag_rows"), "source", "hits", "place")


def benchmark_report(evals: DataFrame, train: DataFrame, failed: DataFrame | None = None, top: int = 4) -> DataFrame:
    """(eval, rows, full_rows, frag_rows, sources, example, failure): a row for each benchmark, those that couldn't be read among them.

    evals: (eval, seq, texts array) in the order of seq; train: (source, text); failed: (eval, failure). sources: the training
    sources that most texts and fragments hit, with their counts. example: of the first row that overlaps, its first whole text or
    else the least fragment of its first such text, 80 characters of it, with slashes for bars. Only digests of train meet; a hit text goes along with its digest.
    """
    norm = lambda c: T.normal(c)
    each = evals.select("eval", "seq", F.posexplode("texts").alias("at", "text"))
    shown = lambda c: F.replace(F.left(c, F.lit(80)), F.lit("|"), F.lit("/")).alias("shown")
    full = each.select("eval", "seq", "at", F.lit(0).alias("kind"), norm(F.col("text")).alias("n"), shown(F.col("text"))).filter(F.length("n") >= FULL_LEAST)
    full = full.select("eval", "seq", "at", "kind", _digest(F.col("n")).alias("x"), "shown")
    frag = each.select("eval", "seq", "at", F.lit(1).alias("kind"), F.explode(T.fragments(F.col("text"), FRAGMENT_LEAST)).alias("f"))
    frag = frag.select("eval", "seq", "at", "kind", _digest(F.col("f")).alias("x"), shown(F.col("f")))
    n = norm(F.col("text"))
    whole = F.when(F.length(n) >= FULL_LEAST, F.array(F.struct(F.lit(0).alias("kind"), _digest(n).alias("x"))))
    parts = F.transform(_fragment_digests("text"), lambda x: F.struct(F.lit(1).alias("kind"), x.alias("x")))
    mine = train.select("source", F.explode(F.concat(parts, F.coalesce(whole, F.array().cast("array<struct<kind:int,x:binary>>")))).alias("p")).select("source", "p.*").distinct()
    met = full.unionByName(frag).join(mine, ["kind", "x"])
    by_source = met.groupBy("eval", "source").agg(F.count("*").alias("hits"))
    place = F.row_number().over(Window.partitionBy("eval").orderBy(F.desc("hits"), "source"))
    best = by_source.withColumn("place", place).filter(F.col("place") <= top).groupBy("eval").agg(F.array_sort(F.collect_list(F.struct("place", F.format_string("%s(%d)", "source", "hits").alias("s")))).alias("l"))
    best = best.select("eval", F.array_join(F.col("l")["s"], ", ").alias("sources"))
    rows = met.groupBy("eval", "seq").agg(F.bool_or(F.col("kind") == 0).alias("full"), F.bool_or(F.col("kind") == 1).alias("frag"), F.min_by("shown", F.struct("kind", "at", "shown")).alias("shown"))
    counts = rows.groupBy("eval").agg(F.count_if("full").alias("full_rows"), F.count_if("frag").alias("frag_rows"), F.min_by("shown", "seq").alias("example"))
    size = evals.groupBy("eval").agg(F.count("*").alias("rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    made = size.join(counts, "eval", "left").join(best, "eval", "left").select("eval", "rows", zero("full_rows"), zero("frag_rows"), "sources", "example", F.lit(None).cast("string").alias("failure"))
    return made if failed is None else made.unionByName(failed.select("eval", "failure"), allowMissingColumns=True)
