"""License scans: TF-IDF cosine of headers and licence files to templates, then the nearest licence file of a directory above.

Templates are phrases that name a license, in the ways that headers and licence files put it, and passages of headers and licence
files. Stretches of a whole text are compared with them by sparse TF-IDF cosine, and the best above THRESHOLD is the text's own
license; a license that is denied isn't. Stretches are passed over only where they hold no term without which the threshold can't
be reached. A file is its directory's licence file if it is named as one or if its license line makes up a good part of it. Files
without a license of their own take that of the nearest directory above which has one, by joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sheltered, cut, map_texts, table

#: Least cosine, and the part of a file's words that its license line must be for a licence file without a licence file's name.
THRESHOLD, PART = 0.6, 0.25
#: Names of licence files.
FILE_NAME = r"(?i)^(un)?(licen[cs]e|copying|copyright|notice)([.-].*)?$"
#: License identifiers, and the names that texts give them.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD-3-Clause"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "CC0-1.0": ("Creative Commons Zero 1.0 Universal", "CC0 1.0", "CC0-1.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL version 2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL version 3", "GPL-3.0"),
    "ISC": ("ISC License", "ISC"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL version 3", "LGPL-3.0"),
    "MIT": ("MIT License", "MIT"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"),
    "Unlicense": ("Unlicense",),
}
#: The phrases around a name.
FRAMES = ("{}", "Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "Distributed under the terms of the {}", "SPDX-License-Identifier: {}")

#: Passages of headers and licence files, which tell their license whether or not they name it.
PASSAGES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    "CC-BY-4.0": ("By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License",),
    "CC-BY-NC-4.0": ("By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License",),
    "CC-BY-SA-4.0": ("By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License",),
    "CC0-1.0": ("Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's Copyright and Related Rights",),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "\"Covered Software\" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ),
}
#: The clause that makes three of BSD's two.
ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
#: Least cosine to a passage, and lines that a name and its version may be wrapped over.
PASSAGE, LINES = 0.75, 12
#: Terms that say the contrary of a license named within so many terms after them.
DENIALS, DENIAL_REACH = frozenset("not never no nor isn wasn aren neither without unless".split()), 4
#: Names that stand alone on a line, as they are written.
ALONE = {name: k for k, names in NAMES.items() for name in names if len(re.findall(r"\w+", name)) == 1}
#: Terms one of which a window of a longer line must hold beside a telling one.
NAMING = frozenset("license licensed licence spdx released distributed terms public gpl lgpl mpl apache bsd cc unlicense".split())
#: Licenses that a number tells apart: family, and how the number is written. A BSD license's number is that of its clauses.
NUMBERED = {
    "Apache-2.0": ("Apache", ("2.0", "2")), "BSD-2-Clause": ("BSD", ("2", "two")), "BSD-3-Clause": ("BSD", ("3", "three")), "CC-BY-4.0": ("CC-BY", ("4.0", "4")), "CC-BY-NC-4.0": ("CC-BY-NC", ("4.0", "4")), "CC-BY-SA-4.0": ("CC-BY-SA", ("4.0", "4")),
    "CC0-1.0": ("CC0", ("1.0", "1")), "GPL-2.0": ("GPL", ("2", "2.0")), "GPL-3.0": ("GPL", ("3", "3.0")), "LGPL-3.0": ("LGPL", ("3", "3.0")), "MPL-2.0": ("MPL", ("2.0", "2")),
}
#: Terms of other licenses of the same kind, which a stretch near a license's name doesn't hold if the license is meant.
_NO_MORE = frozenset("nd noderivatives noderivs derivatives".split())
FOREIGN = {
    "Apache-2.0": frozenset(), "BSD-2-Clause": frozenset("zero four original clear patent lbnl attribution 0 1 4".split()), "BSD-3-Clause": frozenset("zero four original clear patent lbnl attribution nuclear 0 1 4".split()),
    "CC-BY-4.0": _NO_MORE | frozenset("nc noncommercial commercial sa sharealike alike".split()), "CC-BY-NC-4.0": _NO_MORE | frozenset("sa sharealike alike".split()), "CC-BY-SA-4.0": _NO_MORE | frozenset("nc noncommercial commercial".split()),
    "CC0-1.0": _NO_MORE | frozenset("bsd clause by attribution".split()), "GPL-2.0": frozenset("affero lesser library agpl lgpl".split()), "GPL-3.0": frozenset("affero lesser library agpl lgpl".split()),
    "ISC": frozenset(), "LGPL-3.0": frozenset("affero library agpl".split()), "MIT": frozenset("modern attribution advertising".split()), "MPL-2.0": frozenset("netscape sun eclipse".split()), "Unlicense": frozenset(),
}
#: Terms beside a stretch that are looked at for another license's, before and after it, and those that end the name.
BESIDE, NAME_ENDS = (2, 3), frozenset("or and with".split())
#: Terms after a name in which its number stands: of the families whose headers wrap, and of the others.
NUMBER_WITHIN, WRAPPED = 6, {"GPL": 40, "LGPL": 40}
#: A name within other words is a grant only if its line, or the one before, has one of these terms; so many before it say that it isn't.
GRANTS = frozenset("license licensed licence licenced licensing released distributed under terms permission spdx identifier subject governed available redistribute redistributed copyright".split())
MENTIONS, MENTION_REACH = frozenset("formerly previously compared compare comparing unlike versus vs than incompatible instead about discuss discusses called history".split()), 6
#: The share of its line's terms from which on a name is a heading, and grants by itself.
HEADING = 0.6
#: What tells texts of the BSD kind that are neither of the two.
_OTHER_BSD = re.compile(r"(?is)advertising\s+materials\s+mentioning|apache\s+software\s+(license|foundation)|this\s+software\s+is\s+not\s+designed")
_SPDX = re.compile(r"(?i)spdx-license-identifier:?[ \t]*([^\n]*)")
_IDENTIFIERS = {k.lower(): k for k in NAMES}


def by_identifier(line: str) -> tuple[bool, str | None]:
    """Whether a line has an SPDX expression, and the license if all of that is one known identifier, its later versions included."""
    found = _SPDX.search(line)
    if not found:
        return False, None
    ids = re.findall(r"[A-Za-z0-9.+-]*[A-Za-z0-9+]", found[1])
    first = ids[0].lower() if ids else ""
    several = any(x.upper() in ("OR", "AND") for x in ids[1:])
    return True, None if several else _IDENTIFIERS.get(re.sub(r"(-only|-or-later|\+)$", "", first))


def meant(license_: str, part: list[str], before: list[str], after: list[str], bare: bool = True) -> str | None:
    """The license that a stretch like license_'s means: itself, another of its family by its number, or none of those known.

    bare: whether a number without the word version before it tells a license apart, as it does in names.
    """
    beside = []
    for t in reversed(before[-BESIDE[0] :]):
        if t in NAME_ENDS:
            break
        beside.append(t)
    for t in after[: BESIDE[1]]:
        if t in NAME_ENDS:
            break
        beside.append(t)
    if FOREIGN[license_].intersection(part) or FOREIGN[license_].intersection(beside):
        return None
    if license_ not in NUMBERED:
        return license_
    family, _ = NUMBERED[license_]
    if family == "BSD":
        near = [*before[-2:], *part, *after[:3]]
        stated = next((a for a, b in zip(near, near[1:], strict=False) if b in ("clause", "clauses") and not a.isalpha() or b == "clause" and a in ("two", "three", "zero", "four")), None)
    else:
        near = [*part, *after[: WRAPPED.get(family, NUMBER_WITHIN)]]
        number = lambda t: t[0].isdigit() and 0 < float(".".join(t.split(".")[:2])) < 10  # noqa: E731  years are none, nor is CC0's own
        said = (b for a, b in zip(near, near[1:], strict=False) if a in ("version", "v") and number(b))
        stated = next(said, None) or next((t for t in [*part, *after[:2]] if bare and number(t)), None)
    if stated is None:
        return license_
    return next((k for k, (f, ways) in NUMBERED.items() if f == family and stated in ways), None)


_TERM = re.compile(r"[a-z]+|\d+(?:\.\d+)*")


def terms(line: str) -> list[str]:
    return _TERM.findall(line.lower())


class Templates:
    """Unit TF-IDF vectors of all frames of all names, as postings."""

    def __init__(self, names: dict[str, tuple[str, ...]] = NAMES, frames: tuple[str, ...] = FRAMES):
        found = [(license_, Counter(terms(f.format(n)))) for license_, ns in names.items() for n in ns for f in frames]
        df = Counter(t for _, c in found for t in c)
        self.idf = {t: math.log((1 + len(found)) / (1 + n)) + 1 for t, n in df.items()}
        self.unknown = math.log(1 + len(found)) + 1
        self.ids, self.postings = [license_ for license_, _ in found], {}
        for i, (_, c) in enumerate(found):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items()))
            for t, n in c.items():
                self.postings.setdefault(t, []).append((i, n * self.idf[t] / norm))
        # terms of names, one of which a line must hold to be near a template; frames alone say no license
        framing = {t for f in frames for t in terms(f.format(""))} | {"version", "license", "the", "general", "public", "new", "by"}
        self.telling = {t for ns in names.values() for n in ns for t in terms(n) if t not in framing and not t[0].isdigit()}
        # skips a line only if it holds no telling term, so that best() would give it 0
        self.filter = re.compile("|".join(sorted(self.telling)))

    def best(self, line: str) -> tuple[float, str | None]:
        """The best cosine and its license; ties go to the first identifier."""
        c = Counter(terms(line))
        if not self.telling.intersection(c) or sum(t in self.idf for t in c) < 2:  # "mit" alone is a German word
            return 0.0, None
        norm = math.sqrt(sum((n * self.idf.get(t, self.unknown)) ** 2 for t, n in c.items()))
        sums: dict[int, float] = {}
        for t, n in c.items():
            for i, w in self.postings.get(t, ()):
                sums[i] = sums.get(i, 0.0) + n * self.idf[t] * w
        i = max(sums, key=lambda i: (round(sums[i], 12), -i))
        return sums[i] / norm, self.ids[i]

    def window(self, line: list[str], after: list[str]) -> tuple[float, str | None]:
        """The best cosine of a stretch of a line, for surrounding words dilute that of the whole; after: terms of it and the lines that follow.

        A stretch counts as the license that it means by its number and the terms beside it, which may be none; and only where it is
        most of its line, or the line grants.
        """
        top: tuple[float, str | None] = (0.0, None)
        grants = not GRANTS.isdisjoint(line)
        for i in range(len(line)):
            for j in range(i + 2, min(len(line), i + LONGEST) + 1):
                part = line[i:j]
                if NAMING.intersection(part) and part[0] in self.idf and part[-1] in self.idf and not DENIALS.intersection(line[max(0, i - DENIAL_REACH) : j]):
                    score, license_ = self.best(" ".join(part))
                    if score > top[0] + 1e-12 and score >= THRESHOLD:
                        if MENTIONS.intersection(line[max(0, i - MENTION_REACH) : j]) or not (j - i >= HEADING * len(line) or grants and not self.only_named(line, i, j)):
                            continue
                        license_ = meant(license_, part, line[:i], after[j:])
                        top = (score, license_) if license_ else (score, None)
        return top if top[1] else (0.0, None)

    def only_named(self, line: list[str], i: int, j: int) -> bool:
        """Whether no term but the name's own grants: a license that is spoken of is called by its name as well."""
        return GRANTS.isdisjoint(line[:i] + line[j:]) and GRANTS.isdisjoint(t for t in line[i:j] if t not in ("license", "licence"))

    def scan(self, text: str) -> tuple[str | None, float, str | None, float]:
        """License, cosine, line (the first of the best), and the line's part of the text's words."""
        top: tuple[float, str | None, str | None] = (0.0, None, None)
        low = text.lower()
        if self.filter.search(low):
            lines = text.split("\n")
            for at, line in enumerate(lines):
                if self.filter.search(line.lower()):
                    own = terms(line)
                    naming = NAMING.intersection(own)
                    identified, by_id = by_identifier(line)
                    if identified:
                        score, license_ = (1.0, by_id) if by_id else (0.0, None)
                    elif line.strip(" \t\r#*/;.") in ALONE:
                        score, license_ = 1.0, ALONE[line.strip(" \t\r#*/;.")]
                    elif not naming:
                        score, license_ = (0.0, None) if DENIALS.intersection(own) or MENTIONS.intersection(own) else self.best(line)
                        if license_ and score >= THRESHOLD:
                            license_ = meant(license_, own, [], [])
                            score = score if license_ else 0.0
                    else:
                        after = own + terms(" ".join(lines[at + 1 : at + LINES]))
                        joined = own if len(own) > LONGEST else after[: len(own) + LONGEST // 2]
                        score, license_ = max((self.window(x, after) for x in (own, joined)), key=lambda x: x[0]) if self.telling.intersection(own) else (0.0, None)
                    if score > top[0] + 1e-12:
                        top = (score, license_, line.strip())
        if _PASSAGES.filter.search(low):
            top = max(_PASSAGES.find(text), top, key=lambda x: x[0])  # a passage tells more than the name in it
        if top[0] < THRESHOLD:
            return None, top[0], None, 0.0
        return top[1], top[0], top[2], len(top[2].split()) / max(1, len(text.split()))


def necessary(v: dict[str, float], threshold: float, common: frozenset[str]) -> frozenset[str]:
    """Terms of a unit vector one of which any vector of that cosine to it must hold.

    What isn't matched can't add to the cosine, so the squares of the matched weights sum to threshold squared at least; terms whose
    squares sum to more than the rest can't all be missing. Terms that other texts hardly hold come first, so that few texts pass.
    """
    out, mass = set(), 0.0
    for t in sorted(v, key=lambda t: (t in common, -v[t], t)):
        if mass > 1 - threshold**2 + 1e-9:
            break
        out.add(t)
        mass += v[t] ** 2
    return frozenset(out)


#: Terms that most texts hold: they serve to skip a text only where a passage has too few others.
COMMON = frozenset("a above all and any are as at be by can defined file files for form free from have if in is it its later may means most of on one or other others out person program provided purpose public sell shall share software source subject take terms that the this through to under use used version was with without work works you your".split())


class Passages:
    """Unit TF-IDF vectors of passages, compared with every stretch of their length that holds one of their necessary terms, whatever its lines."""

    def __init__(self):
        found = [(k, terms(p)) for k, ps in PASSAGES.items() for p in ps] + [("", terms(ENDORSE))]
        df = Counter(t for _, ts in found for t in set(ts))
        self.idf = {t: math.log((1 + len(found)) / (1 + n)) + 1 for t, n in df.items()}
        self.unknown = math.log(1 + len(found)) + 1
        vectors = [(k, len(ts), self.unit(Counter(ts))) for k, ts in found]
        self.found = [(k, n, v, necessary(v, PASSAGE, COMMON)) for k, n, v in vectors]
        self.needed = frozenset().union(*[h for *_, h in self.found])
        self.filter = re.compile(r"(?<![a-z])(?:" + "|".join(sorted(map(re.escape, self.needed))) + r")(?![a-z])")

    def unit(self, c: Counter) -> dict[str, float]:
        v = {t: n * self.idf.get(t, self.unknown) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    def best_stretch(self, ts: list[str], starts: list[int], n: int, v: dict[str, float]) -> tuple[float, int]:
        """The best cosine to v of the stretches of n terms from these starts (sorted), and the first start that has it. Sums move along with the stretch."""
        top, at, c, dot, square, left, right = 0.0, 0, Counter(), 0.0, 0.0, 0, 0
        for start in starts:
            if start >= right:
                c, dot, square, left, right = Counter(), 0.0, 0.0, start, start
            for i in range(right, min(len(ts), start + n)):
                w = self.idf.get(ts[i], self.unknown)
                square += w * w * (2 * c[ts[i]] + 1)
                dot += w * v.get(ts[i], 0.0)
                c[ts[i]] += 1
            right = max(right, min(len(ts), start + n))
            for i in range(left, start):
                w = self.idf.get(ts[i], self.unknown)
                c[ts[i]] -= 1
                square -= w * w * (2 * c[ts[i]] + 1)
                dot -= w * v.get(ts[i], 0.0)
            left = start
            score = dot / math.sqrt(square) if square > 1e-9 else 0.0
            if score > top + 1e-9:
                top, at = score, start
        return top, at

    def find(self, text: str) -> tuple[float, str | None, str | None]:
        """The best cosine of PASSAGE or more, its license and the stretch."""
        spans = list(_TERM.finditer(text.lower()))
        ts = [m[0] for m in spans]
        where: dict[str, list[int]] = {}
        for i, t in enumerate(ts):
            if t in self.needed:
                where.setdefault(t, []).append(i)
        top: tuple[float, str | None, str | None] = (0.0, None, None)
        endorses = False
        for license_, n, v, needed in self.found:
            starts = sorted({start for t in needed for i in where.get(t, ()) for start in range(max(0, i - n + 1), i + 1)})
            score, start = self.best_stretch(ts, starts, n, v) if starts else (0.0, 0)
            if score >= PASSAGE and not license_:
                endorses = True
            elif score >= PASSAGE and score > top[0] + 1e-12:
                own = meant(license_, ts[start : start + n], ts[max(0, start - 2) : start], [], license_.startswith("CC")) if license_ not in ("BSD-2-Clause", "MIT", "ISC") else license_
                if own and not (own == "BSD-2-Clause" and _OTHER_BSD.search(text)):
                    top = (score, own, " ".join(text[spans[start].start() : spans[min(len(spans), start + n) - 1].end()].split()))
        return (top[0], "BSD-3-Clause", top[2]) if endorses and top[1] == "BSD-2-Clause" else top


_PASSAGES = Passages()
#: Terms of the longest template.
LONGEST = max(len(terms(f.format(n))) for f in FRAMES for ns in NAMES.values() for n in ns)


def _directory(path: Column) -> Column:
    """The directory of a path, "" at the top; doubled, leading and dot steps don't count."""
    return F.array_join(F.slice(_steps(path), F.lit(1), F.greatest(F.size(_steps(path)) - 1, F.lit(0))), "/")


def _steps(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))


def scan(files: DataFrame, path: str = "path", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns of files (all others than the text, unless given) with license, cosine, line, origin and licence_file.

    origin is header (the file's own text), inherited (from the licence file at the path licence_file) or none. Of several
    licence files in a directory that of the best cosine counts, then the smallest path. Null and empty texts have no license of
    their own; a null path inherits none. Repeated rows get equal results. An empty table gives an empty result. Columns of
    files with the names added here are replaced; others may have any name.
    """
    user = Sheltered(files)
    path, text = user.of(path), user.of(text)
    inner = [c for c in user.inner if c != text] if keep is None else [user.of(k) for k in keep]
    templates = Templates()

    def fn(texts: list[bytes]) -> dict[str, pa.Array]:
        rows = [templates.scan(t.decode()) for t in texts]
        return {"own": pa.array([r[0] for r in rows], pa.string()), "cosine": pa.array([r[1] for r in rows], pa.float64()), "line": pa.array([r[2] for r in rows], pa.string()), "part": pa.array([r[3] for r in rows], pa.float64())}

    rows = user.df.withColumn("path", F.col(path).cast("string"))
    rows = map_texts(rows, text, fn, "own string, cosine double, line string, part double", [*inner, "path"])
    rows = cut(rows.withColumn("dir", _directory(F.col("path"))), "licenses")
    named = F.element_at(_steps(F.col("path")), -1).rlike(FILE_NAME)
    holders = rows.filter(F.col("own").isNotNull() & F.col("dir").isNotNull() & (named | (F.col("part") >= PART)))
    by_dir = holders.groupBy("dir").agg(F.min_by(F.struct("own", "path"), F.struct(-F.col("cosine"), F.col("path"))).alias("h"))
    by_dir = by_dir.select(F.col("dir").alias("above"), F.col("h.own").alias("lent"), F.col("h.path").alias("lender"))
    # each directory's ancestors, itself included, once for all its files
    steps = F.split("dir", "/")
    dirs = rows.filter(F.col("own").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    ancestors = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(steps)))).alias("depth"))
    ancestors = ancestors.withColumn("above", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
    nearest = ancestors.join(by_dir, "above").groupBy("dir").agg(F.max_by(F.struct("lent", "lender"), "depth").alias("n"))
    joined = rows.join(nearest, "dir", "left")
    own = F.col("own").isNotNull()
    made = joined.withColumns({
        "license": F.coalesce("own", "n.lent"), "origin": F.when(own, "header").when(F.col("n.lent").isNotNull(), "inherited").otherwise("none"),
        "licence_file": F.when(~own, F.col("n.lender")),
    })
    return user.back(made, "license", "cosine", "line", "origin", "licence_file")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source / language / hundred of ids / id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs.select("doc_id", "text", path.alias("path")))
