"""License scan by patience alignment.

Text and license templates are compared word by word (letters and digits, lower case). Where a stretch of
the text shares enough words with a template, the two are aligned by patience: words that occur once in
both are anchors, the longest increasing subsequence of the anchors' places is kept, and the gaps between
them are aligned in turn; equal words at the ends of a gap are matched first. Coverage is the share of the
template's words that are matched. A match needs MIN_COVERAGE and all the words that tell the license's
name, and none that tells a sibling's. Of overlapping matches the one with more matched words, then more coverage stays.

Only documents that hold a template's telling words and one of its trigger words are split into words: triggers are its longest
words, so many that a text without any of them can't reach MIN_COVERAGE. A stretch is looked at if its
words can make up the coverage, so nothing is skipped that could match. Texts are read whole.

Result: per document the number of matches and ``matches``, ``license:start:end:coverage`` joined by
commas (code points, end exclusive; coverage in per cent, rounded down) in text order. Null and empty texts
have none. Equal rows have equal results. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm.common import arrow_batches, table
from carelake.llm.license_texts import TEXTS

MIN_COVERAGE = 0.85
SLACK = 0.25  # a stretch may be so much longer than its template

LONG = 200  # words from which on a template's stretches are tried apart

# Names, telling words and texts of public licenses and of the notices that refer to them. A
# word after "-" must not stand in the match: it tells a sibling.
TEMPLATES = [
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT License."),
    ("Apache-2.0", "apache 2 0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "gnu 3 -lesser -affero", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "gnu 2 -lesser -affero -library", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "gnu lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "gnu affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "mozilla 2 0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSD-3-Clause", "bsd 3", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "bsd 2", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "cc by 4 0 -nc -sa -nd", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "cc by sa 4 0 -nc -nd", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "cc by nc 4 0 -sa -nd", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "cc by nd 4 0 -nc -sa", "Licensed under CC BY-ND 4.0."),
    ("proprietary", "rights reserved", "All rights reserved."),
    ("MIT", "permission granted sublicense", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software."""),
    ("ISC", "permission granted fee", """Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies."""),
    ("BSD-3-Clause", "redistribution endorse", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain
the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written
permission."""),
    ("BSD-2-Clause", "redistribution -endorse", """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce
the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""),
    ("Apache-2.0", "apache compliance", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-or-later", "gnu redistribute 3 -lesser -affero -library", """This program is free software: you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version."""),
    ("MPL-2.0", "mozilla source", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If
a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", "unencumbered", """This is free and unencumbered software released into the public domain. Anyone is free
to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("proprietary", "reproduced permission", "No part of this publication may be reproduced without prior written permission."),
]

# Standard headers of files: the program or library, the license's name and version.
HEADER = """This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as
published by the Free Software Foundation{either} version {version} of the License, or (at your option) any later version."""
ONLY = """This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {version}
as published by the Free Software Foundation."""
for _id, _name, _version, _tell in (
        ("GPL-2.0", "General Public License", "2", "2 -lesser -affero"), ("GPL-3.0", "General Public License", "3", "3 -lesser -affero"),
        ("LGPL-2.0", "Library General Public License", "2", "2 -lesser -affero"), ("LGPL-2.1", "Lesser General Public License", "2.1", "lesser 2 1"),
        ("LGPL-3.0", "Lesser General Public License", "3", "lesser 3"), ("AGPL-3.0", "Affero General Public License", "3", "affero 3")):
    _tell = f"gnu redistribute {_tell}" + (" library" if _id == "LGPL-2.0" else " -library" if _id[0] == "G" else "")
    for _what in ("program", "library") if _id[0] == "L" else ("program",):
        TEMPLATES.append((f"{_id}-or-later", f"{_tell} later", HEADER.format(what=_what, colon=":", name=_name, either=", either", version=_version)))
        TEMPLATES.append((f"{_id}-only", f"{_tell} -later", ONLY.format(what=_what, name=_name, version=_version)))

# Short notices: each wording with each name of a license.
NOTICES = ("Licensed under {}", "Released under {}", "Distributed under {}", "Available under {}", "Provided under {}", "Published under {}",
           "Covered by {}", "Subject to {}", "Licensed under the terms of {}", "Distributed under the terms of {}", "The license is {}")
_CC = {"BY": "", "BY-SA": "-ShareAlike", "BY-NC": "-NonCommercial", "BY-ND": "-NoDerivatives", "BY-NC-SA": "-NonCommercial-ShareAlike",
       "BY-NC-ND": "-NonCommercial-NoDerivatives"}
_GNU = (("GPL-2.0", "General Public License", "2", "-lesser -affero -library"), ("GPL-3.0", "General Public License", "3", "-lesser -affero"),
        ("LGPL-2.1", "Lesser General Public License", "2.1", "lesser"), ("LGPL-3.0", "Lesser General Public License", "3", "lesser"),
        ("AGPL-3.0", "Affero General Public License", "3", "affero"))
NAMES = [
    ("MIT", "mit", "MIT", "the MIT License"), ("ISC", "isc", "ISC", "the ISC License"), ("Unlicense", "unlicense", "the Unlicense"),
    ("Apache-2.0", "apache 2 0", "Apache 2.0", "the Apache License 2.0", "the Apache License, Version 2.0"),
    ("MPL-2.0", "2 0 mpl", "MPL 2.0"), ("MPL-2.0", "mozilla 2 0", "the Mozilla Public License 2.0", "the Mozilla Public License, Version 2.0"),
    ("BSD-3-Clause", "bsd 3", "BSD 3-Clause", "the 3-Clause BSD License", "the BSD 3-Clause License"),
    ("BSD-2-Clause", "bsd 2", "BSD 2-Clause", "the 2-Clause BSD License", "the BSD 2-Clause License"),
    ("CC0-1.0", "cc0 1 0", "CC0 1.0"), ("CC0-1.0", "cc0", "CC0"),
]
for _id, _name, _version, _tell in _GNU:
    _v, _short = _version.split("."), _id.split("-")[0]
    NAMES.append((_id, f"gnu {' '.join(_v)} {_tell}", f"the GNU {_name} {_version}", f"the GNU {_name}, version {_version}"))
    NAMES.append((_id, f"gnu v{' '.join(_v)} {_tell}", f"the GNU {_name} v{_version}"))
    NAMES.append((_id, f"{_short.lower()} {' '.join(_v)}", f"{_short} {_version}", f"the {_short} version {_version}"))
    NAMES.append((_id, f"{_short.lower()}v{' '.join(_v)}", f"{_short}v{_version}", f"the {_short}v{_version}"))
for _short, _long in _CC.items():
    _words, _all = _short.lower().split("-"), {"nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
    _other = [w for w in _all if w not in _words]
    NAMES.append((f"CC-{_short}-4.0", " ".join(["cc", *_words, "4", "0", *("-" + w for w in _other)]), f"CC {_short} 4.0", f"a CC {_short} 4.0 license"))
    NAMES.append((f"CC-{_short}-4.0", " ".join(["attribution", "4", "0", *(_all[w] for w in _words[1:]), *("-" + _all[w] for w in _other)]),
                  f"Creative Commons Attribution{_long} 4.0", f"a Creative Commons Attribution{_long} 4.0 International License"))
TEMPLATES += [(i, tell, wording.format(name)) for i, tell, *names in NAMES for name in names for wording in NOTICES]
TEMPLATES += [(i, "spdx " + " ".join(dict.fromkeys(re.findall(r"[^\W_]+", i.lower()))), f"SPDX-License-Identifier: {i}")
              for i in dict.fromkeys(t[0] for t in TEMPLATES) if i != "proprietary"]

# Whole texts.
TELLING = {"Apache-2.0": "apache contributor", "GPL-2.0": "gnu program", "GPL-3.0": "gnu conveying -remote",
           "LGPL-2.1": "gnu lesser library",
           "LGPL-3.0": "gnu lesser 3", "MPL-2.0": "mozilla secondary", "CC0-1.0": "cc0 waiver", "CC-BY-SA-4.0": "sharealike adapted",
           "ISC": "permission granted fee", "MIT": "permission granted sublicense", "BSD-2-Clause": "redistribution -endorse",
           "BSD-3-Clause": "redistribution endorse", "Unlicense": "unencumbered"}
TEMPLATES += [(i, TELLING[i], text) for i, text in TEXTS.items()]

WORD = re.compile(r"[^\W_]+")


class Template(NamedTuple):
    license: str
    words: list[str]
    need: int
    must: frozenset
    never: frozenset
    counts: Counter
    triggers: tuple[str, ...]


def template(license_id: str, must: str, text: str, min_coverage: float = MIN_COVERAGE) -> Template:
    words = [w.lower() for w in WORD.findall(text)]
    need = math.ceil(min_coverage * len(words))
    counts = Counter(words)
    triggers, held = [], 0
    for w in sorted(counts, key=lambda w: (-len(w), w)):  # a match misses at most len - need words
        triggers.append(w)
        held += counts[w]
        if held > len(words) - need:
            break
    told = must.split()
    return Template(license_id, words, need, frozenset(w for w in told if w[0] != "-"), frozenset(w[1:] for w in told if w[0] == "-"),
                    counts, tuple(triggers))


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (i in a, j in b), increasing in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a.get(w) == 1}
        anchors = [(i, place[a[i]]) for i in range(a0, a1) if a[i] in place]
        anchors = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


def stretches(words: list[str], t: Template):
    """Starts of stretches whose words can make up the template's coverage."""
    width = len(t.words) + int(SLACK * len(t.words)) + 1
    hits = [i for i, w in enumerate(words) if w in t.counts]
    have: Counter = Counter()
    good = right = 0
    for left, at in enumerate(hits):
        while right < len(hits) and hits[right] < at + width:
            w = words[hits[right]]
            have[w] += 1
            good += have[w] <= t.counts[w]
            right += 1
        if good >= t.need:
            yield at, at + width
        w = words[at]
        good -= have[w] <= t.counts[w]
        have[w] -= 1


def find(words: list[str], t: Template) -> list[tuple[int, int, int]]:
    """(matched words, first word, last word) of the template's matches, leftmost first, apart."""
    out: list[tuple[int, int, int]] = []
    free = 0
    for a, b in stretches(words, t):
        if a < free:
            continue
        pairs = patience(t.words, words[a:b])
        if len(pairs) >= t.need and t.must <= {t.words[i] for i, _ in pairs}:
            first, last = a + pairs[0][1], a + pairs[-1][1]
            if t.never.isdisjoint(words[first:last + 1]):
                out.append((len(pairs), first, last))
                free = last + 1
        elif len(t.words) > LONG:  # each word further on adds one match at most
            free = a + max(t.need - len(pairs), 1)
    return out


def scan(text: str | None, templates: list[Template]) -> tuple[int, str]:
    if not text:
        return 0, ""
    low = text.lower()
    held: dict[str, bool] = {}

    def has(w: str) -> bool:
        if w not in held:
            held[w] = w in low
        return held[w]

    wanted = [t for t in templates if len(low) >= t.need and all(map(has, t.must)) and any(map(has, t.triggers))]
    if not wanted:
        return 0, ""
    places = [m.span() for m in WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in places]
    known = set(words)
    wanted = [t for t in wanted if len(words) >= t.need and t.must <= known]
    found = [(n / len(t.words), n, t.license, first, last) for t in wanted for n, first, last in find(words, t)]
    kept: list = []
    for x in sorted(found, key=lambda x: (-x[1], -x[0], x[2], x[3])):
        if all(x[4] < y[3] or x[3] > y[4] for y in kept):
            kept.append(x)
    kept.sort(key=lambda x: x[3])
    return len(kept), ",".join(f"{name}:{places[a][0]}:{places[b][1]}:{int(100 * c)}" for c, _, name, a, b in kept)


FOUND = T.StructType([T.StructField("n_matches", T.LongType()), T.StructField("matches", T.StringType())])


def scan_licenses(docs: DataFrame, text: str = "text", id_col: str = "doc_id", templates=None) -> DataFrame:
    """doc_id, n_matches, matches of every row; ``templates``: (license, telling words, text), as TEMPLATES."""
    arrow_batches(docs.sparkSession)
    known = [template(*t) for t in (TEMPLATES if templates is None else templates)]

    @F.arrow_udf(FOUND)
    def matches(texts: pa.Array) -> pa.Array:
        rows = [scan(x, known) for x in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.string())],
                                          FOUND.names)

    return docs.select(F.col(id_col).alias("doc_id"), matches(F.col(text)).alias("x")).select("doc_id", "x.*")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
