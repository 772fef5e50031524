"""The decision record: a state, a question, options, and a distribution over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

OPTION = "struct<name:string,desc:string>"
DECISION = (
    "id string, source string, type string, lang string, grp string, state string, instructions string, "
    f"options array<{OPTION}>, target array<double>, question_id string, gold_label string, annotators_agree boolean, "
    "meta map<string,string>, seq long"
)
PREDICTION = "id string, probs array<double>"

#: Decision types, limits and default descriptions.
NOUL, CHOICE, SCORE = "noul", "choice", "score"
MAX_CHOICES, MIN_LEVELS, MAX_LEVELS = 255, 2, 10
NOUL_TEXT = {
    "en": ("Yes, the statement holds.", "No, the statement does not hold."),
    "zh": ("是，该陈述成立。", "否，该陈述不成立。"),
}


def options(names: list[str], descs: list[str] | None = None) -> Column:
    """A literal array of options."""
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("desc")) for n, d in zip(names, descs or [""] * len(names), strict=True)])


def noul_options(lang: str = "en") -> Column:
    return options(["true", "false"], list(NOUL_TEXT[lang]))


def invalid_reason(tolerance: float = 1e-3) -> Column:
    """The first rule that a decision breaks, in the order in which they are checked; null if it is valid.

    A rule that can't be decided for a null (no type, options or target, an option without a name, a missing probability) counts as broken.
    """
    names, k = F.col("options")["name"], F.size("options")
    total = F.aggregate("target", F.lit(0.0), lambda a, x: a + x)
    fails = lambda broken: F.coalesce(broken, F.lit(True))
    return (
        F.when(fails(~F.col("type").isin(NOUL, CHOICE, SCORE)), "type")
        .when((F.col("type") == NOUL) & fails(F.array_sort(names) != F.array(F.lit("false"), F.lit("true"))), "noul options")
        .when((F.col("type") == CHOICE) & fails(~k.between(2, MAX_CHOICES)), "choice size")
        .when((F.col("type") == SCORE) & fails(~k.between(MIN_LEVELS, MAX_LEVELS)), "score size")
        .when(fails(F.exists(names, lambda n: n.isNull())), "option without a name")
        .when(fails(F.size(F.array_distinct(names)) != k), "duplicate options")
        .when(fails(F.size("target") != k), "target size")
        .when(fails(F.exists("target", lambda p: p.isNull() | F.isnan(p) | (p < 0)) | (F.abs(total - 1) > tolerance)), "target not a distribution")
    )


def valid(decisions: DataFrame) -> DataFrame:
    return decisions.filter(invalid_reason().isNull())


def checked(decisions: DataFrame) -> DataFrame:
    """decisions as they are; an invalid one fails the job that reads it."""
    reason = invalid_reason()
    fail = F.raise_error(F.concat(F.coalesce("id", F.lit("a decision without an id")), F.lit(": "), reason)).cast("string")
    return decisions.withColumn("id", F.when(reason.isNull(), F.col("id")).otherwise(fail))


def read_decisions(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are passed over. `group` in files is `grp` here. Strict: a line that isn't a JSON object of these types fails the job."""
    reader = spark.read.schema(DECISION.replace("grp string", "`group` string, grp string")).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.json(path).withColumn("grp", F.coalesce("grp", "group")).drop("group")


def write_decisions(decisions: DataFrame, path: str) -> int:
    """JSON lines with targets rounded to 6 places, replacing what is there; returns how many were written."""
    seen = Observation()
    counted = decisions.withColumn("target", F.transform("target", lambda p: F.bround(p, 6))).observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).json(path)


def with_predictions(decisions: DataFrame, predictions: DataFrame) -> DataFrame:
    """decisions with probs; a decision without a prediction fails the job."""
    missing = F.raise_error(F.concat(F.lit("no prediction for "), F.col("id"))).cast("array<double>")
    return decisions.join(predictions, "id", "left").withColumn("probs", F.coalesce("probs", missing))
