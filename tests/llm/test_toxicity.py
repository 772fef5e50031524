import random
import zlib

from pyspark.sql import functions as F

from lattico.llm import toxicity
from tests.conftest import DATA

SCORER = toxicity.Scorer({"=idiot": 4.0, "vequ-": 5.0, "=waste space": 3.0}, -2.0, (1.0, 0.0))
NEGATED, REPORTED, TARGETED, THREAT = (toxicity.USUAL[k] for k in ("-", "'", "+", "threat"))


def weight(text):
    return max([w for _, w in SCORER.clauses(text)], default=0.0)


def test_clauses():
    assert weight("What a fine day.") == 0 and weight("") == 0
    assert weight("Some idiot wrote it.") == 4.0
    assert weight("Un vequtré ici.") == 5.0 and weight("Un vequ ici.") == 0.0  # a beginning needs more to follow
    assert weight("You idiot!") == 4.0 * TARGETED
    assert weight("He is not an idiot.") == 4.0 * NEGATED * TARGETED
    assert weight("She said idiot") == 4.0 * REPORTED * TARGETED
    assert weight("They said no such thing. Some idiot did.") == 4.0  # marks end with the clause
    assert weight("not one two three four five six seven eight idiot") == 4.0
    assert weight("IDIOT%%%") == 4.0
    assert weight("A waste space!") == 3.0 and weight("Space, waste.") == 0.0 and weight("waste. space") == 0.0 and weight("waste of space") == 0.0
    assert weight("Not a waste space") == 3.0 * NEGATED
    assert weight("I will kill you") == THREAT and weight("They kill time") == 0.0


def test_negations_reach_over_contractions_and_end_with_their_part():
    for text in ("I see you aren\u2019t an idiot", "You aren't an idiot", "You don't look like an idiot", "not one two three four five six idiot", "You cannot be such an idiot", "Tu n'es rien qu'un idiot"):
        assert weight(text) in (4.0 * NEGATED, 4.0 * NEGATED * TARGETED), text
    for text in ("You aren't nice, you idiot", "kein Freund, sondern ein idiot", "not now: an idiot", "He isn't here but an idiot is"):
        assert weight(text) in (4.0, 4.0 * TARGETED), text


def test_reporters_on_either_side():
    for text in ('"You are an idiot", she said', "'You are an idiot,' he said", '"You are an idiot!" she said.', "She wrote: you are an idiot", "She said: idiot", '"Du idiot", sagte der Mann', "\u201cYou idiot,\u201d said John."):
        assert weight(text) in (4.0 * REPORTED, 4.0 * REPORTED * TARGETED), text
    for text in ('"You idiot said nothing"', "You are an idiot. She said so.", '"You are an idiot!" Then she left.', "An idiot, one of many that nobody said anything good about"):
        assert weight(text) in (4.0, 4.0 * TARGETED), text


def test_threats_are_aimed_on_either_side():
    threats = (
        "I'm killing you", "he killed them", "you should be killed", "they deserve to be shot", "I will hurt your family", "kill all of you",
        "Ich werde dich töten", "du solltest getötet werden", "je vais te tuer", "je vais vous tuer", "tu devrais être tué", "voy a matarte", "te voy a matar", "Ich werde euch alle vernichten",
    )
    for text in threats:
        assert weight(text) in (THREAT, THREAT * TARGETED), text
    for text in ("kill the process before you restart it", "They kill time", "you have killed time", "We were hurt", "Die Zeit töten", "tuer le temps", "kill one two three you", "stab when you can"):
        assert weight(text) == 0, text
    assert weight("I won't kill you") == THREAT * NEGATED and weight('"I will kill you", he said') == THREAT * REPORTED
    assert weight("I will not zap you") == 0 and toxicity.Scorer({"@zap": 3.0}).clauses("I will zap you. Zap it.") == [("i will zap you", 3.0 * THREAT)]


def by_hand(line):
    """What the machines say of a clause's token classes, each by plain loops over the whole clause."""
    out, before = [], ""
    for s in line:  # insult
        out.append("i" if s in ")x" and before in ("(", "x") else "o" if s in "()x" else s)
        before = s

    def reach(i, opens, far):
        near = out[max(0, i - far) : i][::-1] if far else out[:i]
        return any(s in opens for s in (near[: near.index("k")] if far and "k" in near else near))

    marks = [("-", "n", 8), ("'", "r", 0), ("+", "tj", 4)]
    made = [s + "".join(m for m, opens, far in marks if s in "ihpa" and reach(i, opens, far)) for i, s in enumerate(out)]
    final, since = list(made), 0  # threats: since is where the last one that was aimed, or the last break, lies
    held = None
    for i, s in enumerate(made):
        before = made[since:i]
        if s[0] == "k":
            held, since = None, i + 1
        elif s[0] in "hpa":
            fresh = [x[0] for x in before]  # objects are forgotten where a threat has been waiting since
            last = max((j for j, x in enumerate(fresh) if x in "hp"), default=-1)
            free = fresh[last + 1 :]
            if s[0] == "a" or "j" in free[-4:] or (s[0] == "p" and "+" in s and free[-1:] == ["b"]):
                final[i], held, since = "h" + s[1:], None, i + 1
            else:
                final[i], held = "o", i
        elif held is not None and i - held <= 3 and (s[0] in "tj" or (s[0] == "b" and i == held + 1 and made[held][0] == "p" and "+" in made[held])):
            final[i], held, since = "h" + made[held][1:], None, i + 1
    return final


def test_composition_is_the_transducers_in_turn():
    machine, rng = toxicity.grammar(), random.Random(0)
    for _ in range(20000):
        line = [rng.choice("oitnrh()xpajbk") for _ in range(rng.randint(1, 14))]
        state, one = machine.start, []
        for s in line:
            state, out = machine[state, s]
            one.append(out)
        assert one == by_hand(line), line


def test_reporters_by_hand():
    """The machine that reads from the right marks all before the last pause that has a reporting word near behind it and near the end."""
    rng = random.Random(1)
    for _ in range(20000):
        line = [rng.choice("oir") for _ in range(rng.randint(1, 9))]
        ends = [rng.choice(("", "", ",")) for _ in line]
        said = next((i for i in range(len(line) - 1, max(-1, len(line) - 4), -1) if line[i] == "r"), None)
        pause = None if said is None else next((j for j in range(said - 1, max(-1, said - 4), -1) if ends[j] == ","), None)
        got = toxicity.parse(line, ends)
        for i, s in enumerate(line):
            want = s == "i" and ("r" in line[:i] or (pause is not None and i <= pause))
            assert ("'" in got[i]) == want, (line, ends, got)


def marked_rows(n=1200):
    """Insults are toxic, but not where they are negated or reported; two words insult together alone; a threat at someone is toxic."""
    rng = random.Random(7)
    plain = ["".join(rng.choice("bcdfglmpt") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    some = lambda k: " ".join(rng.choice(plain) for _ in range(k))
    kinds = [
        (1, lambda: f"you zogbert {some(2)}"), (0, lambda: f"you not zogbert {some(2)}"), (0, lambda: f"she said {some(2)} zogbert"), (1, lambda: f"{some(2)} plank head {some(1)}"),
        (0, lambda: f"plank {some(3)}"), (0, lambda: f"head {some(3)}"), (1, lambda: f"hurt you {some(2)}"), (0, lambda: f"hurt {some(3)}"), (1, lambda: f"zogging {some(1)} you"), (0, lambda: f"zogging {some(3)}"), (0, lambda: f"you {some(5)}"), (0, lambda: some(6)),
    ]
    rows = []
    for i in range(n):
        y, make = kinds[i % len(kinds)]
        rows.append((i, f"{some(rng.randint(5, 12))}. {make()}. {some(rng.randint(5, 12))}.", y))
    return rows


def test_the_grammar_decides(spark):
    """Held out, marked insults come out clean and phrases toxic; the same lexicon without marks, phrases or threats gets them wrong."""
    rows = marked_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    scorer = toxicity.learn(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    wrong = lambda s: sum((s.score(t) >= 0.5) != y for _, t, y in held)
    assert wrong(scorer) <= 0.02 * len(held), (wrong(scorer), scorer.factors, scorer.lexicon)
    assert [f for f in scorer.lexicon if f[0] == "@"] == ["@zogging"]
    assert scorer.factors["-"] < toxicity.USUAL["-"] and scorer.factors["'"] < toxicity.USUAL["'"]
    unmarked = toxicity.Scorer(scorer.lexicon, scorer.bias, scorer.slopes, dict.fromkeys("-'+", 1.0) | {"threat": scorer.factors["threat"]})
    assert wrong(unmarked) >= 0.15 * len(held)
    assert wrong(toxicity.Scorer({k: v for k, v in scorer.lexicon.items() if " " not in k}, scorer.bias, scorer.slopes, scorer.factors)) >= 0.05 * len(held)
    assert wrong(toxicity.Scorer(scorer.lexicon, scorer.bias, scorer.slopes, scorer.factors | {"threat": 0.0})) >= 0.05 * len(held)


def test_learning_and_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.learn(docs.select("doc_id", "text"), labels)
    got = toxicity.score(docs.join(labels, "doc_id"), scorer, keep=["doc_id", "toxic"])
    test = [(r["toxic"], r["predicted"]) for r in got.filter(toxicity.held_out(F.col("doc_id"))).collect()]
    hits, pos, said = sum(t and p for t, p in test), sum(t for t, _ in test), sum(p for _, p in test)
    assert hits >= 0.85 * pos and hits >= 0.9 * said, (hits, pos, said)


def test_held_out_labels_are_not_learned(spark):
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, f"plain zzword {i}") for i in ids], "doc_id long, text string")
    scorer = toxicity.learn(docs, spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int"))
    assert scorer.lexicon == {} and scorer.slopes == (0.0, 0.0)


def test_copies_are_one_piece_of_evidence(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(600)]
    copy = " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, copy + f" {i}", 1) for i in range(200)] + [(1000 + i, " ".join(rng.choice(words) for _ in range(60)), 0) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels).filter("y = 1").count() < 10


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (3, "idiot", "z"), (3, "idiot", "z"), (4, "word " * 50_000 + "idiot", "z")], "doc_id long, text string, SCORE string")
    got = toxicity.score(df, SCORER).collect()
    assert len(got) == 5 and sorted(r["predicted"] for r in got) == [0, 0, 1, 1, 1] and all(0 <= r["score"] <= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    nothing = toxicity.learn(empty, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert toxicity.score(empty, nothing).collect() == [] and abs(nothing.score("anything") - 0.5) < 1e-9
