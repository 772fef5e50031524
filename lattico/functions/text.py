"""Text normalization, fragments, clipping and prompts, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dist

#: Where a text is cut into fragments, which letters count as Chinese, and what a prompt says of each type.
FRAGMENT_END = r"[\n。！？!?]|(?<=[.;])\s"
CJK = "[一-鿿]"
CJK_WIDE = "[㐀-鿿぀-ヿ가-힯]"
HINTS = {
    "noul": "Decide whether the statement holds.",
    "choice": "Pick the single best option.",
    "score": "Pick the level that best fits; levels are ordered from lowest to highest.",
}


def normal(t: Column) -> Column:
    """Lower case, runs of (Unicode) white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(t), r"(?U)\s+", " "))


def fragments(t: Column, least: int = 60) -> Column:
    """Distinct normalized sentences of at least `least` characters."""
    return F.array_distinct(F.filter(F.transform(F.split(t, FRAGMENT_END), normal), lambda x: F.length(x) >= least))


def clip_marked(t: Column, limit: int) -> Column:
    """Seven tenths of the limit from the start, the rest from the end, and how much is left out between."""
    head = int(limit * 0.7)
    return F.when(F.length(t) <= limit, t).otherwise(
        F.concat(F.substring(t, 1, head), F.lit(" …["), (F.length(t) - limit).cast("string"), F.lit(" chars omitted]… "), F.right(t, F.lit(limit - head))))


def clip_plain(t: Column, limit: int) -> Column:
    """As clip_marked, but with an ellipsis alone, which counts against the limit."""
    head = int(limit * 0.7)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, head), F.lit("…"), F.right(t, F.lit(limit - head - 1))))


def cjk_share(t: Column) -> Column:
    return F.coalesce(F.try_divide(F.regexp_count(t, F.lit(CJK)), F.length(t)), F.lit(0.0))


def language_by_share(t: Column) -> Column:
    return F.when(cjk_share(t) > 0.1, "zh").otherwise("en")


def language_by_any(t: Column) -> Column:
    return F.when(t.rlike(CJK_WIDE), "zh").otherwise("en")


def humanize(t: Column) -> Column:
    return F.trim(F.replace(t, F.lit("_"), F.lit(" ")))


def labels(k: int = 255) -> list[str]:
    """A .. Z, then AA, AB, ..."""
    letters = [chr(65 + i) for i in range(26)]
    return (letters + [a + b for a in letters for b in letters])[:k]


def option_lines(options: Column, type_: Column) -> Column:
    """A line for each option: label, name (Yes and No for yes/no questions) and description."""
    table = F.array(*map(F.lit, labels()))

    def line(o: Column, i: Column) -> Column:
        name = F.when((type_ == "noul") & (o["name"] == "true"), "Yes").when((type_ == "noul") & (o["name"] == "false"), "No").otherwise(o["name"])
        tail = F.when(F.coalesce(o["desc"], F.lit("")) != "", F.concat(F.lit(": "), o["desc"])).otherwise("")
        return F.concat(F.element_at(table, (i + 1).cast("int")), F.lit(". "), name, tail)

    return F.transform(options, line)


def user_message(state: Column, instructions: Column, options: Column, type_: Column) -> Column:
    """The prompt of one decision. Its literals are what models were trained on."""
    hint = F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv])[type_]
    word = F.when(F.size(options) <= 26, "letter").otherwise("code")
    return F.concat(
        F.lit("You are a decision model. Read the state and answer the question by picking exactly one option.\n\n### State\n"), state,
        F.lit("\n\n### Question\n"), instructions, F.lit("\n"), hint, F.lit("\n\n### Options\n"), F.array_join(option_lines(options, type_), "\n"),
        F.lit("\n\nReply with the "), word, F.lit(" of the best option only."))


def description_cap(lengths: Column, budget: Column | int, least: int) -> Column:
    """The largest cap under which all descriptions, cut to it, fit the budget; 0 (drop them all) if that is below least.

    Of sorted lengths, the first i stay whole and the others get equal parts of what is left. The first i whose next length doesn't
    fit that part gives the cap: one sort and one pass, whatever the lengths.
    """

    def of(sorted_: Column, left: Column | int) -> Column:
        k = F.size(sorted_)
        most = F.coalesce(F.element_at(sorted_, -1), F.lit(0))
        start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(None).cast("long").alias("cap"))

        def step(a: Column, x: Column) -> Column:
            rest = k - x["i"]
            part = F.floor((F.lit(left) - a["used"]) / rest)
            return F.struct((a["used"] + x["n"]).alias("used"), F.coalesce(a["cap"], F.when(x["n"] > part, part)).cast("long").alias("cap"))

        found = F.aggregate(F.transform(sorted_, lambda n, i: F.struct(n.cast("long").alias("n"), i.alias("i"))), start, step, lambda a: a["cap"])
        cap = F.greatest(F.coalesce(found, most.cast("long")), F.lit(0))
        return dist.bound(cap, lambda cap: F.when((cap < least) & (cap < most), 0).otherwise(cap).cast("int"))

    return F.when(F.size(lengths) > 0, dist.bound(F.array_sort(lengths), lambda s: of(s, budget))).otherwise(0)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of two arrays' common beginning."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(a, i) != F.element_at(b, i))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.array_min(differ) - 1, n))


def _one_quote(json: Column) -> Column:
    """JSON text whose quotes and backslashes within strings are written by number, so that each quote left begins or ends a string."""
    return F.replace(F.replace(json, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))


def leaves(doc: str) -> Column:
    """leaves_of a column by its name."""
    return leaves_of(F.col(doc))


def leaves_of(json: Column) -> Column:
    """All string leaves of JSON texts, at any depth and in the order of the text, as an array; empty where it isn't JSON or null.

    What stands between quotes and isn't followed by a colon is a leaf, so that the walk is one scan of the text, depth first as it
    is written, whatever the nesting. A text that repeats a key within an object doesn't count as JSON.
    """
    whole = F.try_parse_json(json).isNotNull()
    strings = F.filter(F.regexp_extract_all(_one_quote(json), F.lit(r'"[^"]*"(?:[ \t\r\n]*:)?'), F.lit(0)), lambda x: ~F.endswith(x, F.lit(":")))
    found = F.from_json(F.concat(F.lit("["), F.array_join(strings, ","), F.lit("]")), "array<string>")
    return F.when(whole, found).otherwise(F.array().cast("array<string>"))


def compact(json: Column) -> Column:
    """JSON text without white space between its parts, members in the order of the text."""
    tight = F.regexp_replace(_one_quote(json), r'("[^"]*")|[ \t\r\n]+', "$1")
    return F.replace(F.replace(tight, F.lit("\\u0022"), F.lit('\\"')), F.lit("\\u005c"), F.lit("\\\\"))


def state_text(state: Column) -> Column:
    """A state as text: a string as it is, a struct, map or array as compact JSON that keeps nulls and letters as they are.

    state is a variant, or any column that to_json takes.
    """
    return F.when(F.schema_of_variant(state) == "STRING", F.try_variant_get(state, "$", "string")).otherwise(F.to_json(state))


def decision_texts(state: str, instructions: str, options: str) -> Column:
    """The texts of a decision's columns, in order: the leaves of its state where that is a JSON object or list, else the state itself; instructions; descriptions that aren't empty."""
    own = F.when(F.col(state).rlike(r"^\s*[\[{]") & F.try_parse_json(state).isNotNull(), leaves(state)).otherwise(F.array(F.coalesce(state, F.lit(""))))
    descs = F.filter(F.transform(options, lambda o: o["desc"]), lambda d: F.coalesce(d, F.lit("")) != "")
    return F.concat(own, F.array(F.coalesce(instructions, F.lit(""))), F.coalesce(descs, F.array().cast("array<string>")))


def leaf_fragments(doc: str, least: int = 40) -> Column:
    """Distinct normalized leaves of a JSON text of at least `least` characters, whole: leaves aren't cut into sentences."""
    return F.array_distinct(F.filter(F.transform(leaves(doc), normal), lambda x: F.length(x) >= least))


def numbered(items: Column) -> Column:
    """A numbered list, a line each."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def markdown_table(header: list[str], rows: Column) -> Column:
    """A Markdown table of rows, arrays of text."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    top = F.array(line(F.array(*map(F.lit, header))), F.lit("|" + "---|" * len(header)))
    return F.array_join(F.concat(top, F.transform(rows, line)), "\n")


def written_date(d: Column, lang: Column) -> Column:
    """A date as texts in a language write it."""
    return F.when(lang == "zh", F.concat(F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.day(d).cast("string"), F.lit("日"))).otherwise(d.cast("string"))


def encoder_layout(prefix: Column, instructions: Column, names: Column, descs: Column, state: Column, max_len: int, max_instr: int, max_options: int, min_desc: int) -> Column:
    """Where a decision's parts lie in a sequence of max_len tokens, from the parts' lengths in tokens (names and descs: arrays, of the options).

    A struct of head (a token to begin with, 8 of the prefix, max_instr of the instructions, a token to end with), budget (tokens of all
    options: max_options, or what their names and marks alone take, and never more than is left), cap (of each description), markers
    (each option's place), room (tokens of the state), truncated, length, and error: whether the names alone don't fit, which makes
    all but head and budget null.
    """
    head = F.lit(2) + F.least(prefix, F.lit(8)) + F.least(instructions, F.lit(max_instr))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)

    def laid(x: Column) -> Column:
        """x: head, bare (what names and their marks take)."""
        limit = F.lit(max_len) - x["head"] - 2
        budget = F.least(F.greatest(F.lit(max_options), x["bare"]), limit)
        fits = x["bare"] <= budget
        return dist.bound(F.when(fits, description_cap(descs, budget - x["bare"], min_desc)), lambda cap: placed(x, budget, fits, cap))

    def placed(x: Column, budget: Column, fits: Column, cap: Column) -> Column:
        sizes = F.zip_with(names, descs, lambda n, d: F.lit(1) + n + F.least(d, cap))
        start = F.struct(x["head"].cast("long").alias("at"), F.array().cast("array<bigint>").alias("markers"))
        walk = F.aggregate(sizes, start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["markers"], a["at"]).alias("markers")))

        def ended(w: Column) -> Column:
            room = F.lit(max_len) - w["at"] - 2
            return F.struct(
                x["head"].cast("int").alias("head"), budget.cast("int").alias("budget"), cap.alias("cap"), F.when(fits, w["markers"]).alias("markers"), F.when(fits, room.cast("int")).alias("room"),
                F.when(fits, state > room).alias("truncated"), F.when(fits, (w["at"] + F.least(state, room) + 2).cast("int")).alias("length"), (~fits).alias("error"))

        return dist.bound(walk, ended)

    return dist.bound(F.struct(head.alias("head"), (F.size(names) + total(names)).alias("bare")), laid)
