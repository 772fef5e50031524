"""Toxicity by a weighted finite-state grammar of clauses.

Tokens become classes: parts of insults with learned weights, threats, targets, negations, reporting words, others. Five transducers
read a clause, each what the one before it wrote. The insult transducer recognises single insults and phrases of two words that
insult only together; the others mark what holds around an insult or a threat: negation and reported speech before it, a target
beside it, and the target that a threat is aimed at, on either side. Their composition is one deterministic transducer; one more
reads its output from the end, for a reporter that follows. A clause's weight is that of its best-weighted symbol, under factors for
its marks, and a text's score is a logistic function of its clauses.

All weights are learned from labelled rows: the insults by evidence from occurrences that no mark weakens, threats beside the fixed
ones by evidence from occurrences that are aimed, the marks' factors and the threats' weight together with the logistic function, by
likelihood under a prior around their usual values. Separated verbs ("bringe dich um") aren't known as threats.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sheltered, cut, map_texts, table

#: Labelled rows to learn from: at most about this many, picked by a hash of the id.
TRAIN_DOCS = 8_000
#: Lengths of the word beginnings that may enter the lexicon beside whole words.
BEGINNINGS = (3, 4, 5, 6, 7)
#: The share of a lexicon entry's documents that must be toxic, and least toxic documents.
PRECISION, LEAST_TOXIC = 0.9, 3
#: Words of the fixed classes, in English, German, French and Spanish.
THREATS = (
    "kill kills killing hurts hurting destroy destroys destroying beat beats beating stab stabs stabbing shoot shoots shooting murder murders murdering "
    "töten töte tötet umbringen umbringe verletzen verletze vernichten vernichte tuer tue tuerai frapper frappe détruire détruirai "
    "matar mataré herir heriré destruir destruiré golpear golpearé"
)
TARGETS = "you your yourself they them he she him her du dir sie ihr tu toi votre ils elles tú usted ustedes ellos ellas"
NEGATIONS = "not no never without cannot nicht kein keine keinen nie niemals ohne ne pas jamais sans nunca sin jamás"
REPORTS = "said says say told wrote writes claims claimed quoted called sagte sagt schrieb behauptet zitiert dit disait écrit affirme cité dijo dice escribió afirma citó"
#: Forms of threats that are passive after a target: "you should be killed".
PARTICIPLES = "killed hurt destroyed beaten stabbed shot murdered getötet umgebracht verletzt vernichtet tué tués tuée frappé frappée détruit matado herido destruido golpeado"
#: Threats that hold their target.
AIMED_FORMS = "matarte matarlo matarla matarlos herirte herirlo destruirte destruirlo golpearte golpearlo"
#: Targets that are objects wherever they stand, so that a threat after them is aimed at them.
OBJECTS = "dich euch ihn te vous os"
#: Auxiliaries of the passive.
PASSIVES = "be been being get gets getting werden wird wirst être ser"
#: Words that end what a negation, a target and a threat reach.
BREAKS = "but before after while when because unless aber sondern bevor nachdem während wenn weil mais avant après pendant quand parce pero sino antes después mientras cuando porque"
#: How far, in tokens, a negation and a target reach, and how far a threat may lie before its target or after its object.
NEGATION_REACH, TARGET_REACH, AIM_REACH, OBJECT_REACH = 8, 4, 3, 4
#: In how many last tokens of a clause the reporting word of "..., she said" lies, and how many tokens may stand before it.
REPORTER_LAST, REPORTER_BEFORE = 3, 2
#: What a negated, reported or targeted symbol's weight is multiplied by, and what a threat weighs: usual values, from which rows move them.
USUAL = {"-": 0.6, "'": 0.7, "+": 1.2, "threat": 0.5}
#: Values that are tried for them, as powers of two of the usual one, and how strongly the prior holds them, in nats for a factor of two, squared.
TRIED, HOLD = (-6, -3, -2, -1, -0.5, 0, 0.5, 1, 2), 0.5
#: Words that a worker remembers the class of.
REMEMBERED = 50_000

OTHER, INSULT, THREAT_WORD, TARGET, NEGATION, REPORT, OPENS, CLOSES, BOTH = "o", "i", "h", "t", "n", "r", "(", ")", "x"
PARTICIPLE, AIMED, OBJECT, PASSIVE, BREAK, PAUSE = "p", "a", "j", "b", "k", ","
#: What the insult transducer reads (OPENS, CLOSES, BOTH: words that begin or end a phrase, or may do either).
TOKENS = (OTHER, INSULT, THREAT_WORD, TARGET, NEGATION, REPORT, OPENS, CLOSES, BOTH, PARTICIPLE, AIMED, OBJECT, PASSIVE, BREAK)
#: Classes without which a clause weighs nothing.
WEIGHTY = frozenset((INSULT, THREAT_WORD, PARTICIPLE, AIMED, OPENS, CLOSES, BOTH))
#: What marks are added to.
MARKED = (INSULT, THREAT_WORD, PARTICIPLE, AIMED)
MARKS = "-'+"
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
#: A clause ends at these, but not inside the end of a quotation whose reporter follows: '"You fool!" she said'.
_CLAUSE = re.compile(r"(?:[.!?…]++(?![\"'’“”»]\s+(?:\S+\s+){0,%d}(?:%s)\b)|[;\n]|:(?!\s))+" % (REPORTER_BEFORE, "|".join(REPORTS.split())))
_PAUSES = (*",\"“”»", *(mark + quote for mark in ",.!?" for quote in "'’"))


class Transducer(dict):
    """Deterministic: step(state, symbol) -> (state, symbol), a class letter followed by marks. An arc is worked out when it is first taken."""

    def __init__(self, start, step):
        super().__init__()
        self.start, self.step = start, step

    def __missing__(self, arc):
        self[arc] = made = self.step(*arc)
        return made

    def compose(self, after: Transducer) -> Transducer:
        """This transducer with after reading its output."""

        def step(state, s):
            mine, out = self[state[0], s]
            other, out = after[state[1], out]
            return (mine, other), out

        return Transducer((self.start, after.start), step)


def _reach(opens: str, mark: str, reach: int) -> Transducer:
    """Adds mark to symbols that follow one of the classes opens within reach tokens and no BREAK (0: anywhere after it in the clause)."""

    def step(left: int, s: str) -> tuple[int, str]:
        out = s + mark if left and s[0] in MARKED else s
        if s[0] in opens:
            return reach or 1, out
        return (left if not reach else 0 if s == BREAK else max(0, left - 1)), out

    return Transducer(0, step)


def insults() -> Transducer:
    """Insults of one word stay; a word that ends a phrase becomes an insult right after one that begins it, and any other phrase word nothing.

    Whether the two words are a phrase that was learned is looked up where a weight is given; a pair that wasn't weighs nothing.
    """

    def step(open_: bool, s: str) -> tuple[bool, str]:
        out = INSULT if s in (CLOSES, BOTH) and open_ else OTHER if s in (OPENS, CLOSES, BOTH) else s
        return s in (OPENS, BOTH), out

    return Transducer(False, step)


def aims() -> Transducer:
    """A threat counts where it is aimed, and all other threats become nothing.

    It is aimed at a target that follows within AIM_REACH tokens, whose symbol then becomes the threat's; at an object at most
    OBJECT_REACH tokens before ("dich töten"); at a target before it if it is a participle beside a passive ("you should be killed",
    "du solltest getötet werden"); or by its form ("matarte"). A BREAK ends all reach.
    """
    idle = ("", 0, 0, False)  # the threat that waits for a target, tokens left for it, tokens left of an object, passive just read

    def step(state: tuple, s: str) -> tuple[tuple, str]:
        held, left, object_, passive = state
        kind, marks = s[0], s[1:]
        if kind == BREAK:
            return idle, s
        if kind == AIMED or (kind in (THREAT_WORD, PARTICIPLE) and object_) or (kind == PARTICIPLE and passive and "+" in marks):
            return idle, THREAT_WORD + marks
        if kind in (THREAT_WORD, PARTICIPLE):
            return (s, AIM_REACH, 0, False), OTHER
        if held and (kind in (TARGET, OBJECT) or (kind == PASSIVE and held[0] == PARTICIPLE and "+" in held and left == AIM_REACH)):
            return idle, THREAT_WORD + held[1:]
        left = max(0, left - 1)
        return (held if left else "", left, OBJECT_REACH if kind == OBJECT else max(0, object_ - 1), kind == PASSIVE), s

    return Transducer(idle, step)


@cache
def grammar() -> Transducer:
    """insult . negation . reported speech . target . threat over token classes, composed; reads a clause from left to right."""
    whole = insults()
    for after in (_reach(NEGATION, "-", NEGATION_REACH), _reach(REPORT, "'", 0), _reach(TARGET + OBJECT, "+", TARGET_REACH), aims()):
        whole = whole.compose(after)
    return whole


@cache
def reporters() -> Transducer:
    """Reads the grammar's output from right to left and marks all before a reporter at the clause's end as reported: '"You fool", she said'.

    A reporter is a reporting word in the last REPORTER_LAST tokens, with a PAUSE at most REPORTER_BEFORE tokens before it.
    """

    def step(state: tuple[str, int], s: str) -> tuple[tuple[str, int], str]:
        what, left = state
        if what == "all":
            return state, s[0] + "".join(m for m in MARKS if m in s or m == "'") if s[0] in MARKED else s
        if s == PAUSE:
            return (("all", 0) if what == "word" else state), s
        if what == "end" and s[0] == REPORT and left:
            return ("word", REPORTER_BEFORE), s
        return ((what, left - 1) if left else ("none", 0)), s

    return Transducer(("end", REPORTER_LAST), step)


def parse(kinds: list[str], ends: list[str]) -> list[str]:
    """The output symbol of each token of a clause, under the grammar and then the reporters. ends: what its token ends with, PAUSE, a colon or nothing.

    A colon, and a PAUSE before a target, end what a negation, a target and a threat reach: "you aren't nice, you fool".
    """
    machine, out, end = grammar(), [], ""
    state = machine.start
    for kind, after in zip(kinds, ends, strict=True):
        if end == ":" or (end and kind in (TARGET, OBJECT)):
            state = machine[state, BREAK][0]
        state, symbol = machine[state, kind]
        out.append(symbol)
        end = after
    if REPORT not in kinds[-REPORTER_LAST:]:
        return out
    back = reporters()
    state = back.start
    for i in range(len(out) - 1, -1, -1):
        if ends[i] == PAUSE:
            state = back[state, PAUSE][0]
        state, out[i] = back[state, out[i]]
    return out


def word_of(token: str) -> tuple[str, str]:
    """A token's word, and what it ends with: PAUSE (a comma or the end of a quotation), a colon or nothing."""
    end = PAUSE if token.endswith(_PAUSES) else ":" if token.endswith(":") else ""
    word = token if token.isalpha() else _EDGE.sub("", token.replace("\u2019", "'"))
    return word, end


#: All output symbols that may weigh something, in the order of a clause's profile.
SYMBOLS = tuple(kind + "".join(m for k, m in enumerate(MARKS) if i >> k & 1) for kind in (INSULT, THREAT_WORD) for i in range(1 << len(MARKS)))


class Scorer:
    """Scores texts in one process. lexicon: weight by word ("=word"), word beginning ("begin-"), phrase ("=two words") or threat ("@word")."""

    def __init__(self, lexicon: dict[str, float], bias: float = 0.0, slopes: tuple[float, float] = (1.0, 1.0), factors: dict[str, float] = USUAL):
        self.lexicon, self.bias, self.slopes, self.factors = lexicon, bias, slopes, dict(factors)
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _start(self):
        lexicon = {k: v for k, v in self.lexicon.items() if " " not in k and k[0] != "@"}
        phrases = {k[1:]: v for k, v in self.lexicon.items() if " " in k}
        threats = {k[1:]: v for k, v in self.lexicon.items() if k[0] == "@"}
        first, last = {k.split(" ")[0] for k in phrases}, {k.split(" ")[1] for k in phrases}

        weighty = {k[1:] for k in lexicon if k[0] == "="} | first | last | threats.keys() | {w for w, kind in _fixed_classes().items() if kind in WEIGHTY}
        starts = {k[:-1] for k in lexicon if k[0] != "="}
        lengths = sorted({len(k) for k in starts})

        class Weighty(dict):
            """Whether a token may be of a weighty class; most words of a corpus are rare, and few may."""

            def __missing__(self, token: str) -> bool:
                if len(self) > REMEMBERED:
                    self.clear()
                w = word_of(token)[0]
                self[token] = made = w in weighty or any(w[:k] in starts for k in lengths)
                return made

        class Known(dict):
            """Class and weight of a token, the word itself, and what it ends with."""

            weighty = Weighty()

            def __missing__(self, token: str) -> tuple[str, float, str, str]:
                if len(self) > REMEMBERED:
                    self.clear()
                w, end = word_of(token)
                weight = max([lexicon.get(f, 0.0) for f in features_of(w)], default=0.0)
                part = BOTH if w in first and w in last else OPENS if w in first else CLOSES if w in last else ""
                kind = INSULT if weight > 0 else fixed_class(w) or (THREAT_WORD if w in threats else part or OTHER)
                self[token] = made = (kind, weight if kind == INSULT else threats.get(w, 1.0), w, end)
                return made

        self._ready = Known(), phrases
        return self._ready

    def weight_of(self, symbol: str, weight: float) -> float:
        """Weight of an output symbol; weight is the lexicon's, or 1 for a threat of the fixed list."""
        if symbol[0] not in (INSULT, THREAT_WORD):
            return 0.0
        x = weight if symbol[0] == INSULT else weight * self.factors["threat"]
        return x * math.prod(self.factors[mark] for mark in MARKS if mark in symbol)

    def symbols(self, text: str) -> list[tuple[str, dict[str, float]]]:
        """The clauses of a text that hold an insult or an aimed threat, each with the largest weight of each output symbol."""
        known, phrases = self._ready or self._start()
        out, text = [], text.lower()
        if not any(map(known.weighty.__getitem__, text.split())):
            return out
        for clause in _CLAUSE.split(text):
            words = clause.split()
            if not any(map(known.weighty.__getitem__, words)):
                continue
            tokens = [known[t] for t in words]
            kinds = [t[0] for t in tokens]
            found: dict[str, float] = {}
            before, threat = "", 0.0
            for symbol, (kind, weight, w, _) in zip(parse(kinds, [t[3] for t in tokens]), tokens, strict=True):
                if kind in (THREAT_WORD, PARTICIPLE, AIMED):
                    threat = weight
                if symbol[0] in (INSULT, THREAT_WORD):
                    weight = threat if symbol[0] == THREAT_WORD else weight if kind == INSULT else phrases.get(f"{before} {w}", 0.0)
                    if weight > found.get(symbol, 0.0):
                        found[symbol] = weight
                before = w
            if found:
                out.append((clause.strip(), found))
        return out

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """The matched clauses of a text and their weights."""
        made = ((c, max(self.weight_of(s, w) for s, w in found.items())) for c, found in self.symbols(text))
        return [(c, w) for c, w in made if w > 0]

    def score_clauses(self, found: list[tuple[str, float]]) -> float:
        weights = [w for _, w in found]
        x = self.bias + (self.slopes[0] * max(weights) + self.slopes[1] * math.log1p(sum(weights)) if weights else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    def score(self, text: str) -> float:
        return self.score_clauses(self.clauses(text))


@cache
def _fixed_classes() -> dict[str, str]:
    lists = ((THREAT_WORD, THREATS), (PARTICIPLE, PARTICIPLES), (AIMED, AIMED_FORMS), (TARGET, TARGETS), (OBJECT, OBJECTS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (PASSIVE, PASSIVES), (BREAK, BREAKS))
    return {w: c for c, ws in lists for w in ws.split()}


def fixed_class(word: str) -> str:
    """The fixed class of a word, or nothing. Contractions: "aren't" and "n'es" negate; "you're" is a target."""
    fixed = _fixed_classes()
    if word in fixed or "'" not in word:
        return fixed.get(word, "")
    head, _, tail = word.partition("'")
    if head == "n" or (tail == "t" and head.endswith("n")):
        return NEGATION
    return TARGET if head == "t" or fixed.get(head) == TARGET else ""


def features_of(word: str) -> list[str]:
    return [f"={word}", *(f"{word[:k]}-" for k in BEGINNINGS if len(word) > k)] if word else []


def evidence(text: str) -> set[str]:
    """The words of a text, its pairs of words, and as "@word" those that would be an aimed threat, but for what a negation or report marks wherever it occurs.

    The grammar says which: each word that isn't of a fixed class passes through it as an insult would.
    """
    out = set()
    for clause in _CLAUSE.split(text.lower()):
        tokens = [word_of(t) for t in clause.split()]
        words = [w for w, _ in tokens]
        kinds = [fixed_class(w) or INSULT for w in words]
        before = ""
        for i, (w, kind, symbol) in enumerate(zip(words, kinds, parse(kinds, [e for _, e in tokens]), strict=True)):
            if w and kind == INSULT and "-" not in symbol and "'" not in symbol:
                out.add(w)
                if before:
                    out.add(f"{before} {w}")
                behind, ahead = kinds[max(0, i - OBJECT_REACH) : i], kinds[i + 1 : i + 1 + AIM_REACH]
                if aimed_at(behind[::-1], OBJECT) or aimed_at(ahead, TARGET + OBJECT):
                    out.add(f"@{w}")
            before = w if w and kind == INSULT else ""
    return out


def aimed_at(kinds: list[str], targets: str) -> bool:
    """Whether one of targets comes before any BREAK."""
    return next((k in targets for k in kinds if k in targets or k == BREAK), False)


def held_out(id_: Column) -> Column:
    """Every fifth id by CRC-32 of its decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sketch(text: str, n: int = 4, width: int = 5) -> list[int]:
    """n minimum hashes of the text's word shingles."""
    from xxhash import xxh64_intdigest

    words = text.split()
    pieces = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    base = np.array([xxh64_intdigest(p) for p in pieces], np.uint64)
    mix = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93][:n], np.uint64)
    with np.errstate(over="ignore"):
        h = base[:, None] * mix[None, :]
        return (h ^ (h >> np.uint64(29))).min(axis=0).view(np.int64).tolist()


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, text, y): labelled rows that aren't held out, at most about most of them, one of each group of near copies.

    A document with labels of both kinds, or none, is left out; so is one that shares a minimum hash of its shingles with a
    document of smaller id, so that copies of one text don't pass for evidence of many.
    """
    y = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("z"))
    y = y.filter((F.col("y") == F.col("z")) & ~held_out(F.col("doc_id"))).select("doc_id", "y")
    share = min(1.0, most / max(1, y.count()))
    y = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.filter("text is not null").join(F.broadcast(y), "doc_id").select("doc_id", "text", "y")

    def fn(texts: list[bytes]) -> dict[str, pa.Array]:
        return {"sketch": pa.array([_sketch(t.decode().lower()) for t in texts], pa.list_(pa.int64()))}

    rows = cut(map_texts(rows.withColumn("copy", F.col("text")), "text", fn, "sketch array<long>", ["doc_id", "copy", "y"]).withColumnRenamed("copy", "text"), "training")
    keys = rows.select("doc_id", F.posexplode("sketch"))
    first = keys.groupBy("pos", "col").agg(F.min("doc_id").alias("first"))
    copies = keys.join(first, ["pos", "col"]).filter("doc_id > first").select("doc_id").distinct()
    return rows.join(copies, "doc_id", "left_anti").dropDuplicates(["doc_id"]).select("doc_id", "text", "y")


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Scorer:
    """A scorer learned from training_rows. Without rows of both kinds its lexicon is empty and it scores every text alike."""
    rows = cut(training_rows(docs, labels, most), "training")
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        return Scorer({}, math.log((n_pos + 0.5) / (n_neg + 0.5)), (0.0, 0.0))

    def count(batches):
        seen: tuple[Counter, Counter] = Counter(), Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([f for c in seen for f in c]), pa.array([v for v in seen[0].values()] + [0] * len(seen[1]), pa.int64()), pa.array([0] * len(seen[0]) + [v for v in seen[1].values()], pa.int64())], names=["f", "neg", "pos"])
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                found = evidence(text)
                seen[y].update({f for w in found for f in ([w] if w[0] == "@" else [f"={w}"] if " " in w else features_of(w))})
                if len(seen[0]) + len(seen[1]) > 1_000_000:
                    yield flush()
                    seen[0].clear(), seen[1].clear()
        yield flush()

    counts = rows.select("text", "y").mapInArrow(count, "f string, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    counts = cut(counts.filter(F.col("pos") + F.col("neg") >= LEAST_TOXIC), "features")
    # evidence in nats that a feature's documents are toxic beyond the common rate; chance alone reaches ln(features tried)
    p, q = n_pos / (n_pos + n_neg), n_neg / (n_pos + n_neg)
    total = F.col("pos") + F.col("neg")
    nats = F.col("pos") * F.log(F.col("pos") / (total * p)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (total * q))).otherwise(0.0)
    picked = counts.filter((F.col("pos") >= LEAST_TOXIC) & (F.col("pos") >= PRECISION * total)).withColumn("nats", nats).filter(F.col("nats") >= math.log(max(counts.count(), 2)))
    entries = picked.orderBy(F.desc("nats"), "f").collect()  # features of three toxic training rows or more: their rows bound them
    words = {r["f"][1:]: r["pos"] for r in entries if r["f"][0] == "=" and " " not in r["f"]}
    by_start: dict[str, int] = {}
    for w, pos in words.items():
        for k in BEGINNINGS:
            by_start[w[:k]] = max(by_start.get(w[:k], 0), pos)
    # a beginning that stands for one word alone says no more than the word
    entries = [r for r in entries if r["f"][0] in "=@" or by_start.get(r["f"][:-1], 0) < 0.9 * r["pos"]]
    starts = {r["f"][:-1] for r in entries if r["f"][0] not in "=@"}
    alone = lambda w: w in words or any(w[:k] in starts for k in BEGINNINGS if len(w) > k)
    entries = [r for r in entries if " " not in r["f"] or not any(map(alone, r["f"][1:].split(" ")))]  # nor a phrase one of whose words insults by itself
    # a word is a threat if it is toxic where it is aimed, and neither by itself nor in a phrase
    paired = {w for r in entries if " " in r["f"] for w in r["f"][1:].split(" ")}
    entries = [r for r in entries if r["f"][0] != "@" or not (alone(r["f"][1:]) or r["f"][1:] in paired)]
    lexicon = {r["f"]: math.log((r["pos"] + 0.5) / (n_pos + 1)) - math.log((r["neg"] + 0.5) / (n_neg + 1)) for r in entries}
    scorer = Scorer({f: w for f, w in lexicon.items() if w > 0})

    def measure(texts: list[bytes]) -> dict[str, pa.Array]:
        profiles = [Counter(tuple(found.get(s, 0.0) for s in SYMBOLS) for _, found in scorer.symbols(t.decode())) for t in texts]
        each = pa.list_(pa.struct([("w", pa.list_(pa.float64())), ("n", pa.int64())]))
        return {"profiles": pa.array([[{"w": list(w), "n": k} for w, k in c.items()] for c in profiles], each)}

    # at most about most rows, of the different clause profiles of each
    sample = map_texts(rows, "text", measure, "profiles array<struct<w:array<double>,n:bigint>>", ["y"]).collect()
    y = np.array([r["y"] for r in sample], float)
    flat = [(i, c["w"], c["n"]) for i, r in enumerate(sample) for c in r["profiles"]]
    doc, times = np.array([f[0] for f in flat], int), np.array([f[2] for f in flat], float)
    scorer.factors, scorer.bias, scorer.slopes = fit_grammar(doc, np.array([f[1] for f in flat], float).reshape(-1, len(SYMBOLS)), times, y)
    return scorer


def clause_features(doc: np.ndarray, profiles: np.ndarray, times: np.ndarray, n: int, factors: dict[str, float]) -> np.ndarray:
    """Largest clause weight and logarithm of their sum, for each of n documents, under factors."""
    by = np.array([(factors["threat"] if s[0] == THREAT_WORD else 1.0) * math.prod(factors[m] for m in MARKS if m in s) for s in SYMBOLS])
    out = np.zeros((n, 2))
    if len(doc):
        weight = (profiles * by).max(axis=1)
        np.maximum.at(out[:, 0], doc, weight)
        np.add.at(out[:, 1], doc, weight * times)
    out[:, 1] = np.log1p(out[:, 1])
    return out


def fit_grammar(doc: np.ndarray, profiles: np.ndarray, times: np.ndarray, y: np.ndarray, rounds: int = 3) -> tuple[dict[str, float], float, tuple[float, float]]:
    """The marks' factors and a threat's weight, with the logistic function's bias and slopes: one factor after another, by penalised likelihood."""
    factors = dict(USUAL)

    def cost(now: dict[str, float]) -> tuple[float, tuple]:
        x = clause_features(doc, profiles, times, len(y), now)
        bias, slopes = fit_logistic(x, y)
        z = np.clip(bias + x @ np.array(slopes), -30, 30)
        loss = float(np.sum(np.logaddexp(0, z) - y * z))
        return loss + sum(HOLD * math.log2(now[k] / USUAL[k]) ** 2 for k in USUAL), (bias, slopes)

    best, fit = cost(factors)
    for _ in range(rounds):
        before = best
        for k in USUAL:
            for power in TRIED:
                tried = factors | {k: USUAL[k] * 2.0**power}
                now, found = cost(tried)
                if now < best - 1e-9:
                    best, fit, factors = now, found, tried
        if best == before:
            break
    return factors, *fit


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[float, tuple[float, float]]:
    """Bias and slopes by Newton's method with a small ridge on the slopes, which are kept from going below zero."""
    design, use = np.column_stack([np.ones(len(x)), x]), [0, 1, 2]
    while True:
        beta, keep = np.zeros(3), np.array(use)
        for _ in range(steps):
            z = design[:, keep]
            p = 1 / (1 + np.exp(-np.clip(z @ beta[keep], -30, 30)))
            pull = np.where(keep > 0, ridge, 1e-6)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-9), z.T @ (p - y) + pull * beta[keep])
            beta[keep] -= np.clip(step, -2, 2)
        if (bad := [i for i in use[1:] if beta[i] < 0]) == []:
            return float(beta[0]), (float(beta[1]), float(beta[2]))
        use = [i for i in use if i not in bad[:1]]


def score(df: DataFrame, scorer: Scorer, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns of df (all others, unless given) with score, predicted and clauses (array of struct clause, weight).

    Whole texts are scored; null and empty ones match no clause and get the base score. Repeated rows get equal scores. Columns
    of df with the names added here are replaced; others may have any name. The scorer is broadcast: its lexicon has at most the
    features of the training rows that at least LEAST_TOXIC toxic ones hold.
    """
    user = Sheltered(df if keep is None else df.select(*[F.col(f"`{k}`") for k in dict.fromkeys([*keep, text])]))
    shared = df.sparkSession.sparkContext.broadcast(scorer)

    def fn(texts: list[bytes]) -> dict[str, pa.Array]:
        s = shared.value
        found = [s.clauses(t.decode()) for t in texts]
        scores = [s.score_clauses(c) for c in found]
        return {
            "score": pa.array(scores, pa.float64()),
            "predicted": pa.array([int(x >= 0.5) for x in scores], pa.int32()),
            "clauses": pa.array([[{"clause": a, "weight": b} for a, b in c] for c in found], pa.list_(pa.struct([("clause", pa.string()), ("weight", pa.float64())]))),
        }

    inner = user.inner if keep is None else [user.of(k) for k in keep]
    made = map_texts(user.df, user.of(text), fn, "score double, predicted int, clauses array<struct<clause:string,weight:double>>", inner)
    return user.back(made, "score", "predicted", "clauses")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, scorer, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
