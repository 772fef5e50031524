import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lattico.llm import licenses


def test_template_matches():
    t = licenses.Templates()
    for line, want in (
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("# SPDX-License-Identifier: MIT", "MIT"), ("Released under the MIT License.", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("GNU General Public License, version 2", "GPL-2.0"), ("Licensed under CC BY 4.0", "CC-BY-4.0"),
        ("Mit.", None), ("He lives in the general area, under the bridge.", None), ("version 2.0", None),
    ):
        assert t.scan("first\n" + line + "\nlast")[0] == want, line


def test_nearest_directory_counts(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License.\n" + "text " * 500), ("a/x.txt", "no license"), ("a/b/c/y.txt", "none here"), ("a/b/COPYING", "Licensed under the Apache License, Version 2.0"),
        ("a/b/own.txt", "words " * 50 + "\nLicensed under CC BY 4.0"), ("z.txt", "nothing"), ("d/short.txt", "Licensed under CC BY-NC 4.0"), ("./d//e.txt", None), (None, "text"), ("d/e.txt", ""), ("d/e.txt", ""),
    ]
    df = spark.createDataFrame([(p, t, "x") for p, t in rows], "path string, text string, license string")
    got = licenses.scan(df, keep=["path"])
    by = {r["path"]: (r["license"], r["origin"], r["licence_file"]) for r in got.collect()}
    assert got.count() == len(rows)
    assert by["a/x.txt"] == ("MIT", "inherited", "a/LICENSE") and by["a/b/c/y.txt"] == ("Apache-2.0", "inherited", "a/b/COPYING")
    assert by["a/b/own.txt"] == ("CC-BY-4.0", "header", None) and by["z.txt"] == (None, "none", None) and by[None] == (None, "none", None)
    assert by["./d//e.txt"] == by["d/e.txt"] == ("CC-BY-NC-4.0", "inherited", "d/short.txt")
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).collect() == []


def test_equal_licence_files_go_by_path(spark):
    df = spark.createDataFrame([("d/NOTICE", "Licensed under CC BY 4.0"), ("d/LICENSE", "Released under the MIT License."), ("d/f", "x"), ("LICENSE", "MPL 2.0")], "path string, text string")
    by = {r["path"]: r["license"] for r in licenses.scan(df).filter(F.col("origin") == "inherited").collect()}
    assert by == {"d/f": "MIT"}


def test_filter_loses_no_line():
    t = licenses.Templates()
    for line, want in (("GNU General Public, version 3", "GPL-3.0"), ("under the terms of the MIT", "MIT"), ("GNU General Public v3", "GPL-3.0"), ("Mozilla Public, v. 2.0", "MPL-2.0")):
        assert t.best(line)[0] >= licenses.THRESHOLD and t.scan("first\n" + line)[0] == want


def test_surrounded_wrapped_and_whole_licenses():
    t = licenses.Templates()
    isc, mit, bsd, unlicense = (licenses.PASSAGES[k] for k in ("ISC", "MIT", "BSD-2-Clause", "Unlicense"))
    wrap = lambda x: "Copyright (c) 2019 Jane Doe\n\n" + "\n".join(" ".join(x.split()[i : i + 9]) for i in range(0, len(x.split()), 9))
    for text, want in (
        ("Copyright (c) 2019 Jane Doe. Licensed under the MIT License.", "MIT"), ("All text by Jane Doe, 2020, released under the MIT License, see the file LICENSE for details.", "MIT"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this", "MPL-2.0"),
        ("it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or", "GPL-3.0"),
        ("it under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or", "GPL-2.0"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-2.0"), ("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007", "GPL-3.0"), (wrap(mit[0]), "MIT"), (wrap(isc[0]), "ISC"), (wrap(" ".join(bsd)), "BSD-2-Clause"),
        (wrap(" ".join(bsd) + " " + licenses.ENDORSE), "BSD-3-Clause"), (wrap(" ".join(unlicense)), "Unlicense"), ("Er kam mit dem Zug und ging mit ihr.", None), ("the public was granted a copy of the terms by the general", None),
    ):
        assert t.scan("first\n" + text + "\nlast")[0] == want, (text, t.scan(text))


def test_denied_and_lone_names():
    t = licenses.Templates()
    for text, want in (
        ("This is not licensed under the Apache License 2.0", None), ("It was never released under the MIT License.", None), ("This is licensed under the Apache License 2.0", "Apache-2.0"), ("MIT", "MIT"), ("# ISC", "ISC"),
        ("Unlicense", "Unlicense"), ("mit", None), ("It isn't under the GPL version 2, but is released under the MIT License.", "MIT"),
    ):
        assert t.scan("first\n" + text + "\nlast")[0] == want, (text, t.scan(text))


def slow_cosine(p, a, b):
    v = lambda ts: {t: n * p.idf.get(t, p.unknown) for t, n in Counter(ts).items()}
    x, y = v(a), v(b)
    norm = lambda z: math.sqrt(sum(w * w for w in z.values()))
    return sum(w * y.get(t, 0.0) for t, w in x.items()) / (norm(x) * norm(y)) if x and y else 0.0


def test_passages_against_all_stretches():
    """Texts made of passages with words changed, among noise: the best cosine over every stretch, by brute force, is the one found."""
    p, rng = licenses.Passages(), random.Random(3)
    whole = [(k, x) for k, xs in licenses.PASSAGES.items() for x in xs]
    noise = "the of license copy under terms software binary rain cloud public free version house river grants notice".split()
    hits = 0
    for _ in range(120):
        license_, passage = rng.choice(whole)
        words = [w if rng.random() > rng.choice((0, 0.1, 0.3)) else rng.choice(noise) for w in passage.split()]
        ts = [rng.choice(noise) for _ in range(rng.randint(0, 30))] + words + [rng.choice(noise) for _ in range(rng.randint(0, 30))]
        text = "\n# ".join(" ".join(ts[i : i + 8]) for i in range(0, len(ts), 8))
        found = licenses.terms(text)
        best = max((slow_cosine(p, licenses.terms(x), found[i : i + len(licenses.terms(x))]), k) for k, x in whole for i in range(len(found)))
        score, got, _ = p.find(text)
        if best[0] >= licenses.PASSAGE + 1e-6:
            hits += 1
            assert abs(score - best[0]) < 1e-6 and p.filter.search(text.lower()), (best, score, got, text)
        else:
            assert score == 0.0
    assert 40 < hits < 120


def test_headers_and_files_of_every_license():
    t = licenses.Templates()
    for want, passages in licenses.PASSAGES.items():
        for x in passages:
            words = x.split()
            wrapped = "\n".join(" * " + " ".join(words[i : i + 7]) for i in range(0, len(words), 7))
            assert t.scan("/*\n * Copyright 2020 Jane Doe\n *\n" + wrapped + "\n */\nint main;")[0] == want, (want, x, t.scan(wrapped))


def test_ancestors_by_brute_force(spark):
    rng = random.Random(4)
    kinds = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0", "CC0-1.0": "Licensed under CC0 1.0", None: "plain words"}
    rows = {}
    for _ in range(250):
        depth = rng.randint(0, 5)
        where = "/".join(rng.choice("abc") for _ in range(depth))
        name = rng.choice(["LICENSE", "COPYING.txt", "x.c", "y.c", "z.c", "w.txt"])
        kind = rng.choice(list(kinds))
        rows[f"{where}/{name}".lstrip("/")] = ("word " * rng.choice((0, 40)) + "\n" + kinds[kind], kind)
    got = {r["path"]: (r["license"], r["origin"], r["licence_file"]) for r in licenses.scan(spark.createDataFrame([(p, t) for p, (t, _) in rows.items()], "path string, text string")).collect()}
    scanned = {p: licenses.Templates().scan(t) for p, (t, _) in rows.items()}
    for path, (_, kind) in rows.items():
        assert scanned[path][0] == kind
        want = (kind, "header", None) if kind else (None, "none", None)
        here = path.split("/")[:-1]
        while not kind:
            holders = [(-scanned[p][1], p) for p in rows if p.split("/")[:-1] == here and scanned[p][0] and (p.split("/")[-1] in ("LICENSE", "COPYING.txt") or scanned[p][3] >= licenses.PART)]
            if holders:
                want = (scanned[min(holders)[1]][0], "inherited", min(holders)[1])
                break
            if not here:
                break
            here = here[:-1]
        assert got[path] == want, path
