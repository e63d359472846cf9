"""Licence texts and notices in documents, by Dice coefficient over word bigrams. Only column functions.

Every line, every paragraph of several lines and every text of several paragraphs is a unit. A
unit is normalised (lower case, letters a-z and digits, single spaces) and compared with licence
templates by the sets of their word bigrams. A Dice coefficient of at least ``threshold`` bounds
the number of bigrams of the unit from both sides, which prunes the templates it is compared with.
It also means that a template and the unit share at least ``t / (2 - t)`` of the template's
bigrams, so if some words of a template cover more than the rest of them, the unit has one of those words:
texts and units without any are left before they are taken apart.

Null and empty texts have no units. Repeated rows give their own result rows. Of templates that
are equally near, the first name wins. Other columns do not matter.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Texts of public licences and the notices they recommend.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT (notice)": "Released under the MIT License.",
    "MIT (notice 2)": "Licensed under the MIT License.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."
    ),
    "Apache-2.0 (header)": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0 (header)": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version."
    ),
    "GPL-3.0 (header)": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 (notice)": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 (notice)": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 (notice)": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0 (header)": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def anchors(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which any unit that is near enough to one of the templates has at least one.

    For each template, its longest words until those bigrams with none of them are fewer than what
    template and unit must share.
    """
    chosen: set[str] = set()
    for text in templates.values():
        bigrams = template_bigrams(text)
        must = threshold / (2 - threshold) * len(bigrams)
        for word in sorted(Counter(template_words(text)), key=lambda w: (w not in chosen, -len(w), w)):
            if sum(chosen.isdisjoint(b.split()) for b in bigrams) < must:
                break
            chosen.add(word)
    return sorted(chosen)


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbours."""
    last = F.size(words) - 1
    pairs = F.zip_with(F.slice(words, 1, F.greatest(last, F.lit(0))), F.slice(words, 2, F.greatest(last, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def once(value: Column) -> Column:
    """``value`` by way of a generator, so that later expressions read it instead of computing it again."""
    return F.explode(F.array(value))


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, unit, number, license, dice, n_bigrams``: the nearest template of each unit that has one.

    ``unit`` is line, paragraph or document, ``number`` counts those of a document from 0.
    """
    known = [{"name": n, "bigrams": template_bigrams(t)} for n, t in sorted(templates.items())]
    known = F.from_json(F.lit(json.dumps(known)), "array<struct<name:string,bigrams:array<string>>>")
    any_anchor = f"(?<![a-z0-9])(?:{'|'.join(anchors(templates, threshold))})(?![a-z0-9])"

    text = F.col("text")
    lines, paragraphs = F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n\s*")
    unit = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("number"), x.alias("part"))
    units = F.concat(
        F.transform(lines, unit("line")),
        F.filter(F.transform(paragraphs, unit("paragraph")), lambda u: F.contains(u["part"], F.lit("\n"))),
        F.filter(F.array(unit("document")(text, F.lit(0))), lambda u: F.size(paragraphs) > 1),
    )
    parts = docs.where(F.lower(text).rlike(any_anchor)).select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.*")
    parts = parts.where(F.lower("part").rlike(any_anchor)).select("doc_id", "unit", "number", once(bigrams(words(F.col("part")))).alias("own"))

    n = F.size("own")
    size = lambda t: F.size(t["bigrams"])
    within = F.filter(known, lambda t: (2 * F.least(n, size(t)) >= threshold * (n + size(t))) & (n > 0))
    near = F.transform(
        within,
        lambda t: F.struct(
            (2.0 * F.size(F.array_intersect("own", t["bigrams"])) / (n + size(t))).alias("dice"),
            (-F.array_position(F.transform(known, lambda k: k["name"]), t["name"])).alias("order"), t["name"].alias("name"),
        ),
    )
    best = parts.select("doc_id", "unit", "number", n.alias("n_bigrams"), once(F.array_max(near)).alias("best"))
    return best.where(F.col("best.dice") >= threshold).select(
        "doc_id", "unit", "number", F.col("best.name").alias("license"), F.col("best.dice").alias("dice"), "n_bigrams"
    )
