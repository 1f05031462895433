"""License notices in texts by patience alignment.

Words unique to both a stretch of text and a template anchor the alignment: the longest increasing run of anchors is
kept, and the gaps between them are aligned the same way. Coverage is the share of template words that are matched.
Names and version numbers, which tell sibling licenses apart, have to be among them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.")
_NAMES = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
          "without specific prior written permission.")
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""
#: Public license notices. Siblings differ in the NAMES and digits that they hold.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                         "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                         "either express or implied.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                      "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
                 "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
                 "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause-text": f"{_BSD} {_AS_IS}",
    "BSD-3-Clause-text": f"{_BSD} {_NAMES} {_AS_IS}",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "ISC": "Licensed under the ISC License.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
                 "the above copyright notice and this permission notice appear in all copies.",
    "MPL-1.1": "Licensed under the Mozilla Public License, Version 1.1.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                      "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
            "arising from the use of this software.",
}
for _name, _title, _versions in (("GPL", "GNU", ("2.0", "3.0")), ("LGPL", "GNU Lesser", ("2.1", "3.0")), ("AGPL", "GNU Affero", ("3.0",))):
    for _v in _versions:
        _said = _v.removesuffix(".0")
        TEMPLATES.setdefault(f"{_name}-{_v}", f"This work is licensed under the {_title} General Public License, version {_said}.")
        TEMPLATES.setdefault(f"{_name}-{_v}-header", f"This program is free software: you can redistribute it and/or modify it under the terms of the {_title} "
                             "General Public License as published by the Free Software Foundation, either "
                             f"version {_said} of the License, or (at your option) any later version.")
for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
    for _name in ("", "-SA", "-NC", "-ND", "-NC-SA", "-NC-ND"):
        _long = _name.replace("-SA", "-ShareAlike").replace("-NC", "-NonCommercial").replace("-ND", "-NoDerivatives")
        TEMPLATES[f"CC-BY{_name}-{_v}"] = f"Licensed under CC BY{_name} {_v}."
        TEMPLATES[f"CC-BY{_name}-{_v}-title"] = f"This work is licensed under a Creative Commons Attribution{_long} {_v} License."
LEAST = 0.8                       # coverage that makes a notice
#: Template words that must be matched, as all digits must: in short templates at each place, in longer ones once.
NAMES = frozenset("mit apache bsd boost eclipse isc mozilla gnu lesser affero cc nc nd sa noncommercial noderivatives sharealike creative attribution "
                  "endorse unencumbered waived".split())
#: Words that make another license of a template without them, when they stand within its stretch.
OTHERS = frozenset("lesser affero nc nd sa noncommercial noderivatives sharealike endorse".split())
SHORT = 16
WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def rising(values: list[int]) -> list[int]:
    """Indexes of the longest increasing subsequence."""
    tails, ends, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched index pairs of two word lists, increasing in both."""
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict = {}
        for x in range(a0, a1):
            once[a[x]] = -1 if a[x] in once else x
        places: dict = {}
        for y in range(b0, b1):
            if once.get(b[y], -1) >= 0:
                places[b[y]] = -1 if b[y] in places else y
        anchors = sorted((once[w], y) for w, y in places.items() if y >= 0)
        kept = [anchors[i] for i in rising([y for _, y in anchors])]
        at_a, at_b = a0, b0
        if not kept:
            continue
        for x, y in kept:
            open_.append((at_a, x, at_b, y))
            found.append((x, y))
            at_a, at_b = x + 1, y + 1
        open_.append((at_a, a1, at_b, b1))
    return sorted(found)


class Scanner:
    """Finds templates in texts; ``find`` gives the best stretch per template with its coverage."""

    def __init__(self, templates: dict[str, str], least: float):
        self.templates = {name: words(t) for name, t in templates.items()}
        self.least = {name: max(1, math.ceil(Fraction(str(least)) * len(t))) for name, t in self.templates.items()}
        # A match leaves out so few words that it must have one of these, the longest of the template,
        self.needed = {name: sorted(set(t), key=lambda w: (-len(w), w))[:len(t) - self.least[name] + 1] for name, t in self.templates.items()}
        # and all of these.
        self.telling = {name: frozenset(w for w in t if w in NAMES or w.isdigit()) for name, t in self.templates.items()}

    def aligned(self, name: str, some: list[str]) -> list[tuple[int, int]]:
        """Index pairs of ``some`` and the template, none if that is no notice of this license."""
        template = self.templates[name]
        pairs = patience(some, template)
        if len(pairs) < self.least[name]:
            return []
        matched = [template[y] for _, y in pairs if template[y] in self.telling[name]]
        wanted = sum(w in self.telling[name] for w in template) if len(template) <= SHORT else len(self.telling[name])
        if (len(matched) if len(template) <= SHORT else len(set(matched))) < wanted:
            return []
        strange = OTHERS.difference(template)
        return [] if any(w in strange for w in some[pairs[0][0]:pairs[-1][0]]) else pairs

    def find(self, text: str) -> list[tuple[str, float, int, int]]:
        all_words, out = words(text), []
        present = set(all_words)
        for name, template in self.templates.items():
            if not self.telling[name] <= present or present.isdisjoint(self.needed[name]):
                continue
            n, reach = len(template), len(template) + len(template) // 2 + 4       # a stretch that may hold a notice with insertions
            known, best = set(template), None
            hits = np.concatenate(([0], np.cumsum([w in known for w in all_words])))
            starts = np.arange(max(1, len(all_words) - reach + 1))
            full = hits[np.minimum(starts + reach, len(all_words))] - hits[starts] >= self.least[name]
            for start in starts[full].tolist():
                pairs = self.aligned(name, all_words[start:start + reach])
                if pairs and (best is None or len(pairs) / n > best[1]):
                    best = (name, len(pairs) / n, start + pairs[0][0], start + pairs[-1][0] + 1)
                    if len(pairs) == n:
                        break
            if best:
                out.append(best)
        return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, license, coverage, start_word, end_word, licenses) per row of ``docs`` (doc_id, text); other columns are not read.

    ``licenses`` are all templates that some stretch of the text covers by ``least`` or more, with all names and digits of
    the template and no name that makes a sibling of it, sorted and comma-joined;
    the others describe the one of most matched words (then the first by name). Without any, which holds for null
    and empty texts, they are null and ``licenses`` is empty. Words are letters a-z and digits, lower-cased.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            rows = []
            for i in range(0, batch.num_rows, 256):
                for text in batch.column("text").slice(i, 256).to_pylist():
                    found = scanner.find(text) if text else []
                    top = min(found, key=lambda f: (-round(f[1] * len(scanner.templates[f[0]])), f[0]), default=(None,) * 4)
                    rows.append((*top, ",".join(sorted(f[0] for f in found))))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "license", "coverage", "start_word", "end_word", "licenses"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, license string, coverage double, start_word long, end_word long, licenses string")
