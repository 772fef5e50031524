"""Business rules over joined tables: prioritized cases, range and next-value lookups, business hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def refund(window: Column, extension: Column, damage_days: Column) -> Column:
    """Of an order (tier, days, damaged, report_days, clearance, category, opened): the first rule that applies."""
    limit = window + F.when(F.col("tier") == "gold", extension).otherwise(0)
    return (
        F.when(F.col("damaged") & (F.col("report_days") <= damage_days), "full_refund").when(F.col("clearance"), "no_refund").when(F.col("days") > limit, "no_refund")
        .when((F.col("category") == "electronics") & F.col("opened"), "partial_refund").otherwise("full_refund")
    )


def invoice_match(lines: DataFrame, paid: DataFrame, tolerance: float) -> DataFrame:
    """(invoice, action) from lines (invoice, ordered_price, received, billed, billed_price) and paid (invoice): a three-way match."""
    by = lines.groupBy("invoice").agg(
        F.bool_and(F.col("billed") <= F.col("received")).alias("qty_ok"), F.bool_and(F.col("billed_price") <= F.col("ordered_price") * (1 + tolerance) + 1e-9).alias("price_ok"))
    again = by.join(paid.select("invoice", F.lit(True).alias("again")).distinct(), "invoice", "left")
    action = F.when(F.col("again"), "reject_duplicate").when(~F.col("qty_ok"), "hold_quantity").when(~F.col("price_ok"), "hold_price").otherwise("approve")
    return again.select("invoice", action.alias("action"))


def contract_status(terms: DataFrame) -> DataFrame:
    """terms (start, init_months, renew_months, notice_days, amended, amended_days, notice, query) with effective, status and renewed.

    All ends are counted from the first, so that a month's end doesn't drift, and as many as lie about a notice, however late. A notice ends the contract at the next end if it
    comes early enough, else at the one after; one given after the query date doesn't count.
    """
    t = terms.withColumn("end0", F.add_months("start", F.col("init_months")))
    t = t.withColumn("given", F.when(F.col("notice") <= F.col("query"), F.col("notice")))
    passed = F.floor(F.months_between("given", "end0") / F.greatest(F.col("renew_months"), F.lit(1))).cast("int")
    first = F.greatest(F.lit(0), F.coalesce(passed, F.lit(0)) - 1)
    t = t.withColumn("ends", F.transform(F.sequence(first, first + 4), lambda k: F.add_months(F.col("end0"), F.col("renew_months") * k)))
    days = F.when(F.col("amended").isNotNull() & (F.col("given") >= F.col("amended")), F.col("amended_days")).otherwise(F.col("notice_days"))
    t = t.withColumn("later", F.filter("ends", lambda e: e > F.col("given"))).withColumn("need", days)
    effective = F.when(F.datediff(F.get("later", F.lit(0)), "given") >= F.col("need"), F.get("later", F.lit(0))).otherwise(F.get("later", F.lit(1)))
    t = t.withColumn("effective", F.when(F.col("given").isNotNull(), effective))
    status = F.when(F.col("query") >= F.col("effective"), "terminated").when(F.col("query") < F.col("end0"), "initial_term").otherwise("renewal_term")
    renewed = (F.col("query") >= F.col("end0")) & (F.col("effective").isNull() | (F.col("effective") > F.col("end0")))
    return t.withColumns({"status": status, "renewed": renewed}).drop("end0", "ends", "given", "later", "need")


#: Who may approve, and who may ask, in rising order.
APPROVERS = ("manager", "director", "vp", "cfo")
LEVELS = ("staff", "manager", "director", "vp")


def approver(usd: Column, thresholds: Column, level: Column, hospitality: Column) -> Column:
    """The first approver whose threshold covers the amount; hospitality (a condition) needs a vp; always above the asker's level."""
    covering = F.filter(F.sequence(F.lit(0), F.size(thresholds) - 1), lambda i: usd <= F.element_at(thresholds, i + 1))
    base = F.coalesce(F.array_min(covering), F.lit(3))
    asker = F.array_position(F.array(*map(F.lit, APPROVERS)), level).cast("int")  # a manager, at 1, needs place 1 from 0
    need = F.least(F.lit(3), F.greatest(base, F.when(hospitality, 2).otherwise(0), F.coalesce(asker, F.lit(0))))
    return F.element_at(F.array(*map(F.lit, APPROVERS)), need + 1)


def business_hours(begin: Column, end: Column, holidays: Column, opens: int = 9, closes: int = 18) -> Column:
    """Hours from begin to end within opens .. closes of Mondays to Fridays that aren't in holidays (an array of dates)."""
    day = lambda d, h: F.unix_timestamp(d.cast("timestamp")) + h * 3600
    a, b = F.unix_timestamp(begin), F.unix_timestamp(end)
    days = F.filter(F.sequence(begin.cast("date"), end.cast("date")), lambda d: (F.weekday(d) < 5) & ~F.array_contains(holidays, d))
    total = F.aggregate(days, F.lit(0).cast("long"), lambda s, d: s + F.greatest(F.lit(0).cast("long"), F.least(b, day(d, closes)) - F.greatest(a, day(d, opens))))
    return F.when(end <= begin, 0.0).otherwise(total / 3600.0)


# Fixed values below: the shares and counts at which a deadline is at risk and a conversation escalates.
def sla_status(used: Column, limit: Column) -> Column:
    return F.when(used <= limit, "met").when(used - limit <= 4, "breached_minor").otherwise("breached_major")


def escalation(messages: DataFrame, by: str, order: str, customer: Column, angry: Column, legal: Column, last: int = 10) -> DataFrame:
    """(by, legal, angry_n, anger): mood from each conversation's last messages of the customer alone, the opening one aside."""
    first = F.row_number().over(Window.partitionBy(by).orderBy(order)) == 1
    mine = messages.withColumn("__first", first).filter(customer & ~F.col("__first"))
    late = mine.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("__n") <= last)
    found = late.groupBy(by).agg(F.bool_or(legal).alias("legal"), F.count_if(angry & ~legal).alias("angry_n"))
    anger = F.when(F.col("legal") & (F.col("angry_n") >= 1), 3).when(F.col("legal") | (F.col("angry_n") >= 2), 2).when(F.col("angry_n") == 1, 1).otherwise(0)
    return found.withColumn("anger", anger)


def security(events: DataFrame, user: str = "user", ts: str = "ts", event: str = "event", place: str = "country", home: str = "home", failures: int = 5, travel: str = "1 hour") -> DataFrame:
    """(user, compromised, severity 0..3) from events fail, success and admin.

    Likely compromised: a success in an unusual country after at least `failures` failures from it, or successes in two countries
    within the travel time. The second is a range window over each user's successes, not a join of pairs.
    """
    unusual = F.col(place) != F.col(home)
    before = Window.partitionBy(user, place).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("fails", F.coalesce(F.sum(F.when(F.col(event) == "fail", 1).otherwise(0)).over(before), F.lit(0)))
    e = e.withColumn("t", F.unix_micros(F.col(ts).cast("timestamp")))
    hour = Window.partitionBy(user, F.col(event) == "success").orderBy("t").rangeBetween(-3600 * 1_000_000, Window.currentRow)
    places = F.max(F.col(place)).over(hour) != F.min(F.col(place)).over(hour)
    e = e.withColumn("hit", (F.col(event) == "success") & ((unusual & (F.col("fails") >= failures)) | places))
    first = F.min(F.when(F.col("hit"), F.col("t"))).over(Window.partitionBy(user))
    e = e.withColumn("first", first)
    by = e.groupBy(user).agg(
        F.bool_or("hit").alias("compromised"), F.bool_or((F.col(event) == "admin") & (F.col("t") >= F.col("first"))).alias("raised"),
        F.max(F.when(unusual & (F.col(event) == "fail"), F.col("fails") + 1)).alias("most_fails"))
    severity = F.when(F.col("compromised") & F.coalesce("raised", F.lit(False)), 3).when(F.col("compromised"), 2).when(F.coalesce("most_fails", F.lit(0)) >= failures, 1).otherwise(0)
    return by.select(user, "compromised", severity.alias("severity"))


# Fixed values below: days of sick leave without a certificate and of tenure for parental leave; the limits of each triage level.
def leave(kind: Column, tenure: Column, probation: Column, balance: Column, days: Column, notice: Column, needed: Column, certificate: Column) -> Column:
    annual = F.when(tenure < probation, "reject").when(balance < days, "reject").when(notice < needed, "needs_manager").otherwise("approve")
    sick = F.when((days <= 3) | certificate, "approve").otherwise("reject")
    return F.when(kind == "annual", annual).when(kind == "sick", sick).otherwise(F.when(tenure >= 365, "approve").otherwise("reject"))


def triage(age: Column, spo2: Column, sbp: Column, temp: Column, pain: Column, chest_pain: Column, confused: Column) -> Column:
    """1 (at once) to 4."""
    return (
        F.when((spo2 < 90) | (sbp < 90) | confused | (chest_pain & (age >= 40)), 1).when(((temp >= 39) & (age >= 75)) | (pain >= 8), 2).when((temp >= 38) | (pain >= 4), 3).otherwise(4)
    )


def missing_parameters(required: Column, provided: Column) -> Column:
    """What a tool requires and a call doesn't give."""
    return F.array_except(required, provided)


def balanced(rows: DataFrame, family: str, label: str, key: Column, per_family: int) -> DataFrame:
    """At most per_family // labels + 1 rows of each label of a family."""
    labels = rows.groupBy(family).agg(F.count_distinct(label).alias("__l"))
    n = F.row_number().over(Window.partitionBy(family, label).orderBy(key))
    return rows.withColumn("__n", n).join(labels, family).filter(F.col("__n") <= F.floor(F.lit(per_family) / F.col("__l")) + 1).drop("__n", "__l")
