"""Licence scans: normalised text against licence templates by the Dice coefficient over distinct word bigrams.

A text is cut into segments at line feeds and after marks that end a sentence; segments without words do not count, and
are numbered from 1. A unit is a run of consecutive segments of at most as many words as the largest template's size
bound allows, that begins and ends with segments that hold a bigram of some template. So a notice is found on a line of
its own, inside a line, or wrapped over lines, in a text of any length. Of units that overlap the best one counts: the
highest coefficient, then the first, then the shortest; of templates with equal coefficients the one listed first.

Two prunings come before any comparison, and neither can lose a match: a coefficient of ``t`` needs bigram counts within
``t / (2 - t)`` of each other; and since that many shared bigrams are needed, a unit must hold at least one of a few
anchor words of each template, chosen so that the bigrams without any of them are too few. The anchors are looked for in
the raw text first, so that most texts are never cut into words.

Everything is a DataFrame expression. Null and empty texts match nothing; repeated rows give their matches each; extra
columns, of any name, are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices by which works state their licence.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License version 3 or later."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced without permission."),
]
LEAST = 0.8
#: White space as the normalised form knows it: everything but letters and digits.
_GAP = r"[^\p{L}\p{N}]+"


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def anchors(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Words of which any unit that matches some template must hold one."""
    every = [bigrams_of(t) for _, t in templates]
    spread = Counter(w for b in every for w in {x for y in b for x in y.split()})
    chosen: set[str] = set()
    for b in every:
        need = math.ceil(least * (len(b) + math.ceil(len(b) * least / (2 - least))) / 2 - 1e-9)
        for w in sorted({x for y in b for x in y.split()}, key=lambda w: (w not in chosen, -len(w), -spread[w], w)):
            if sum(not chosen & set(y.split()) for y in b) < need:
                break
            chosen.add(w)
    return sorted(chosen)


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), _GAP, " ")), " ")


def _bigrams(w: Column) -> Column:
    return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def longest_unit(templates: list[tuple[str, str]], least: float) -> int:
    """Words of the longest unit: one more than the largest size bound of bigrams."""
    return max(math.floor(len(bigrams_of(t)) * (2 - least) / least + 1e-9) for _, t in templates) + 1


#: Where a segment ends besides line feeds: after these marks, before blanks.
_STOP = r"([.!?:;])[ \t\r\f]+"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, unit, last, licence, dice`` of each unit that counts and whose best template reaches ``least``; ``unit`` and ``last`` are its first and last segment. A narrow map: no shuffle."""
    templates = templates or TEMPLATES
    sets = [bigrams_of(t) for _, t in templates]
    low = min(math.ceil(len(b) * least / (2 - least) - 1e-9) for b in sets)
    most = longest_unit(templates, least)
    some = anchors(templates, least)
    known = F.array(*[F.lit(x) for x in sorted({x for b in sets for x in b})])

    def best(b: Column) -> Column:
        scores = []
        for i, ((name, _), own) in enumerate(zip(templates, sets, strict=True)):
            near = F.size(b).between(math.ceil(len(own) * least / (2 - least) - 1e-9), math.floor(len(own) * (2 - least) / least + 1e-9))
            dice = 2 * F.size(F.array_intersect(b, F.array(*[F.lit(x) for x in own]))) / (F.size(b) + len(own))
            scores.append(F.struct(F.when(near, dice).otherwise(0.0).alias("dice"), F.lit(-i).alias("i"), F.lit(name).alias("licence")))
        return F.greatest(*scores)

    body = F.col(f"`{text}`").cast("string")
    # an anchor that holds another one need not be looked for
    least_of = [x for x in some if not any(y != x and y in x for y in some)]
    hit = _let(F.lower("t"), lambda low: reduce(lambda a, b: a | b, [low.contains(x) for x in least_of]))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), body.alias("t")).filter(hit)
    # one expression, in which each step is bound once: columns of their own would be worked out again wherever they are used
    segments = F.filter(F.transform(F.split(F.regexp_replace("t", _STOP, "$1\n"), "\n", -1), _words), lambda w: w[0] != "")
    none = F.array().cast("array<string>")
    kind = "array<struct<dice:double,i:int,licence:string,unit:int,last:int>>"

    def marked(s: Column) -> Column:
        """Segments with whether they hold a bigram of a template (one across two segments belongs to both) and an anchor."""
        around = lambda w, i: F.concat(F.when(i > 0, F.slice(F.get(s, i - 1), -1, 1)).otherwise(none), w, F.slice(F.coalesce(F.get(s, i + 1), none), 1, 1))
        return F.transform(s, lambda w, i: F.struct(w.alias("w"), F.arrays_overlap(_bigrams(around(w, i)), known).alias("known"), F.arrays_overlap(w, F.array(*[F.lit(x) for x in some])).alias("anchor")))

    def units(i: Column, ahead: Column) -> Column:
        """The units from segment ``i`` on that reach ``least``; ``ahead`` are the segments from there on."""
        empty = F.struct(none.alias("w"), i.alias("at"), F.lit(False).alias("anchor"), F.lit(True).alias("open"), F.array().cast(kind).alias("out"))

        def step(s: Column, x: Column) -> Column:
            def grown(w: Column) -> Column:
                fits = F.size(w) <= most
                anchor = s["anchor"] | x["anchor"]
                found = _let(F.array_distinct(_bigrams(w)), lambda b: F.when(F.size(b) >= low, _let(best(b), lambda m: F.when(m["dice"] >= least, F.array(F.struct(m["dice"].alias("dice"), m["i"].alias("i"), m["licence"].alias("licence"), (i + 1).alias("unit"), (s["at"] + 1).alias("last")))))))
                out = F.when(fits & anchor & x["known"], F.concat(s["out"], F.coalesce(found, F.array().cast(kind)))).otherwise(s["out"])
                return F.struct(F.when(fits, w).otherwise(s["w"]).alias("w"), (s["at"] + 1).alias("at"), anchor.alias("anchor"), fits.alias("open"), out.alias("out"))

            return F.when(s["open"], _let(F.concat(s["w"], x["w"]), grown)).otherwise(s)

        return F.aggregate(ahead, empty, step, lambda s: s["out"])

    def matched(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i)["known"])
        each = F.transform(starts, lambda i: _let(F.slice(s, i + 1, most), lambda ahead: F.when(F.exists(ahead, lambda x: x["anchor"]), units(i, ahead)).otherwise(F.array().cast(kind))))
        return F.when(F.size(s) > 0, F.flatten(each)).otherwise(F.array().cast(kind))

    over = lambda x, y: (y["unit"] <= x["last"]) & (y["last"] >= x["unit"])
    better = lambda x, y: (y["dice"] > x["dice"]) | (y["dice"] == x["dice"]) & ((y["unit"] < x["unit"]) | (y["unit"] == x["unit"]) & (y["last"] < x["last"]))
    kept = _let(_let(_let(segments, marked), matched), lambda m: F.filter(m, lambda x: ~F.exists(m, lambda y: over(x, y) & better(x, y))))
    # "outer", as the planner would work the array out once more to leave out texts without matches
    rows = rows.select("doc_id", F.explode_outer(kept).alias("x")).filter("x is not null")
    return rows.select("doc_id", "x.unit", "x.last", "x.licence", F.round("x.dice", 6).alias("dice"))


def oracle_sql(templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> str:
    """The same by DuckDB: each unit against each template within the size bounds, without anchors. Texts that share no bigram with any template are left out."""
    templates = templates or TEMPLATES
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    sets = [bigrams_of(t) for _, t in templates]
    known = ", ".join(f"({i}, {lit(n)}, [{', '.join(lit(x) for x in b)}])" for i, ((n, _), b) in enumerate(zip(templates, sets, strict=True)))
    every = ", ".join(lit(x) for x in sorted({x for b in sets for x in b}))
    pairs = lambda w: f"[{w}[k] || ' ' || {w}[k + 1] FOR k IN range(1, len({w}))]"
    return f"""
WITH known(i, licence, tb) AS (VALUES {known}),
cut AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(text, '([.!?:;])[ \\t\\r\\f]+', '\\1' || chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
worded AS (SELECT r, doc_id, list_filter(list_transform(ls, lambda x: string_split(trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')), lambda w: w[1] <> '') AS s FROM cut),
held AS (SELECT r, doc_id, s, flatten(s) AS w FROM worded WHERE len(s) > 0),
sharing AS (SELECT r, doc_id, s FROM held WHERE list_has_any({pairs('w')}, [{every}])),
parts AS (SELECT r, doc_id, CAST(unnest(generate_series(1, len(s))) AS INTEGER) AS pos, s FROM sharing),
near AS (SELECT r, doc_id, pos, s, list_concat(CASE WHEN pos > 1 THEN [s[pos - 1][-1]] ELSE [] END, s[pos], CASE WHEN pos < len(s) THEN [s[pos + 1][1]] ELSE [] END) AS x FROM parts),
flagged AS (SELECT r, doc_id, pos, s[pos] AS w, sum(len(s[pos])) OVER (PARTITION BY r ORDER BY pos) AS upto, list_has_any({pairs('x')}, [{every}]) AS known FROM near),
units AS (SELECT a.r, a.doc_id, a.pos AS unit, z.pos AS last FROM flagged a JOIN flagged z ON z.r = a.r AND z.pos >= a.pos AND z.upto - a.upto + len(a.w) <= {longest_unit(templates, least)} WHERE a.known AND z.known),
whole AS (SELECT u.r, u.doc_id, unit, last, flatten(h.s[unit:last]) AS w FROM units u JOIN sharing h ON h.r = u.r),
paired AS (SELECT r, doc_id, unit, last, list_distinct({pairs('w')}) AS b FROM whole WHERE len(w) > 1),
scored AS (SELECT r, doc_id, unit, last, licence, i, 2.0 * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice FROM paired, known WHERE len(b) <= len(tb) * {2 - least} / {least} + 0.000001 AND len(tb) <= len(b) * {2 - least} / {least} + 0.000001),
best AS (SELECT *, row_number() OVER (PARTITION BY r, unit, last ORDER BY dice DESC, i) AS k FROM scored WHERE dice >= {least}),
m AS (SELECT * FROM best WHERE k = 1)
SELECT doc_id, unit, last, licence, round(dice, 6) AS dice FROM m x WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.r = x.r AND y.unit <= x.last AND y.last >= x.unit AND (y.dice > x.dice OR y.dice = x.dice AND (y.unit < x.unit OR y.unit = x.unit AND y.last < x.last)))"""
