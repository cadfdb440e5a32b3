"""Licence scan: text units compared with licence templates by Dice over word bigrams.

A unit is a line, a block between blank lines, the whole text, or a window: as many words as a
template has, laid so that a chosen pair of the template (see below) stands where the template has
it, whatever lines and blank lines lie between.  Words are runs of letters and digits in lower
case; a unit and a template are the sets of their neighbouring word pairs.
Two exact bounds prune before any comparison:

* size: Dice of at least t needs the unit's set between t/(2-t) and (2-t)/t times the template's;
* prefix: such a unit shares at least |T| - p + 1 pairs with the template, so one of any p chosen
  pairs must occur.  Per template the p pairs with the most letters are chosen (long words are
  rare in prose); a document without one of them is settled by a single test a pair, and a unit is
  compared only with the templates of which it holds one.

Long licences are one template a paragraph (``license_texts``; not headings of under
``LEAST_WORDS`` words, nor paragraphs that two licences share word for word, which name neither).
Of neighbouring windows of one licence that overlap by more than half only the better is kept, and
none whose pairs all lie in a line, block or whole text that matches itself.

Everything happens inside the row: no shuffle, no Python.

Edge cases: null and empty text match nothing; of equal Dice the licence first in the alphabet
wins; a text or unit of one word has no pair and matches nothing; repeated rows give equal rows;
extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from fractions import Fraction
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
    " documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this"
    " software without specific prior written permission. "
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED"
    " TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR"
    " CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,"
    " PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF"
    " LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS"
    " SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(work: str, name: str, version: str) -> str:
    return (
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published"
        f" by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


def _cc(name: str) -> str:
    return f"This work is licensed under a Creative Commons {name} 4.0 International License."


# Licence notices and short licence texts.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may"
        " obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or"
        " implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [_BSD_HEAD + _BSD_SOURCE + _BSD_BINARY + _BSD_TAIL, _BSD_HEAD + "1. " + _BSD_SOURCE + "2. " + _BSD_BINARY + _BSD_TAIL],
    "BSD-3-Clause": [
        _BSD_HEAD + _BSD_SOURCE + _BSD_BINARY + _BSD_NAMES + _BSD_TAIL,
        _BSD_HEAD + "1. " + _BSD_SOURCE + "2. " + _BSD_BINARY + "3. " + _BSD_NAMES + _BSD_TAIL,
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        " (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial"
        " portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED"
        " TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT"
        " HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR"
        " IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the"
        " above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL"
        " WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE"
        " LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
        " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS"
        " SOFTWARE.",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _gnu("program", "", "3")],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _gnu("program", "", "2")],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", _gnu("library", "Lesser", "2.1")],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", _gnu("library", "Lesser", "3")],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _gnu("program", "Affero", "3")],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this"
        " file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", _cc("Attribution")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", _cc("Attribution-ShareAlike")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", _cc("Attribution-NonCommercial")],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", _cc("Attribution-NonCommercial-ShareAlike")],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", _cc("Attribution-NoDerivatives")],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved."],
}

THRESHOLD = Fraction(4, 5)
LEAST_WORDS = 12


def pairs(text: str) -> list[str]:
    """Distinct neighbouring word pairs of a template, as the Spark expressions cut them."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _add_paragraphs() -> None:
    """The paragraphs of the long licences, each a template of its own."""
    found = {}
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        blocks = re.split(r"\n[^\w\n]*\n", path.read_text(encoding="ascii"))
        own = {frozenset(pairs(x)): " ".join(x.split()) for x in blocks if len(re.findall(r"[^\W_]+", x)) >= LEAST_WORDS}
        found[path.stem] = {k: x for k, x in own.items() if k not in {frozenset(pairs(y)) for y in TEMPLATES[path.stem]}}
    seen = Counter(k for own in found.values() for k in own)
    for name, own in found.items():
        TEMPLATES[name] += [x for k, x in own.items() if seen[k] == 1]


_add_paragraphs()


def _constant(value: object, kind: str) -> str:
    """SQL of a constant, written as one literal so that a long one is parsed and folded fast."""
    return "from_json('" + json.dumps(value, ensure_ascii=False).replace("\\", "\\\\").replace("'", "\\'") + f"', '{kind}')"


def _prepared(templates: dict[str, list[str]], threshold: Fraction) -> tuple[str, str, list[str]]:
    """SQL array of templates with their size bounds, SQL map from each chosen prefix pair to its
    templates and places in them, and the chosen pairs."""
    rows, chosen = [], {}
    for name in sorted(templates):
        for text in templates[name]:
            own, words = pairs(text), re.findall(r"[^\W_]+", text.lower())
            least = -(-threshold * len(own) // (2 - threshold))  # unit's least size, and least overlap
            most = (2 - threshold) * len(own) // threshold
            prefix = set(sorted(own, key=lambda p: (-len(p), p))[: len(own) - int(least) + 1])
            for q, pair in enumerate(map(" ".join, zip(words, words[1:]))):
                if pair in prefix:
                    chosen.setdefault(pair, []).append({"k": len(rows), "q": q})
            rows.append({"license": name, "lo": int(least), "hi": int(most), "len": len(words) - 1, "pairs": own})
    known = _constant(rows, "array<struct<license:string,lo:int,hi:int,len:int,pairs:array<string>>>")
    return known, _constant(chosen, "map<string,array<struct<k:int,q:int>>>"), list(chosen)


_PLAIN = r"regexp_replace(lower(body), r'[^\p{L}\p{N}\n\x20][^\p{L}\p{N}\n]*|\x20[^\p{L}\p{N}\n]+', ' ')"
_WORDS = "filter(split({u}, r'[\\x20\\n]'), x -> x <> '')"
_PAIRS = "transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))"


def _pairs_of(unit: str) -> str:
    return f"element_at(transform(array({_WORDS.format(u=unit)}), w -> if(size(w) < 2, cast(array() as array<string>), {_PAIRS})), 1)"


def _dice(pairs: str, template: str) -> str:
    return f"2.0D * size(array_intersect({pairs}, {template}.pairs)) / (size({pairs}) + size({template}.pairs))"


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row a document: ``license`` and ``dice`` of its best unit, ``n_matches`` different units
    that reach the threshold, and ``matches``, each as licence and Dice."""
    known, places, prefix = _prepared(TEMPLATES if templates is None else templates, threshold)
    t = f"{threshold.numerator}.0D / {threshold.denominator}.0D"
    # windows by licence and place of the first pair (below 0 if cut off), with their own Dice
    laid = f"array_distinct(flatten(transform(marks, i -> transform(element_at({places}, run[i]), e -> named_struct('k', e.k, 'at', i - e.q)))))"
    cut = f"transform({laid}, s -> named_struct('at', s.at, 't', {known}[s.k], 'b', array_distinct(slice(run, greatest(s.at, 0) + 1, {known}[s.k].len + least(s.at, 0)))))"
    close = f"array_sort(filter(transform({cut}, s -> named_struct('license', s.t.license, 'at', s.at, 'end', s.at + s.t.len, 'd', {_dice('s.b', 's.t')}, 'b', s.b)), s -> s.d >= {t}))"
    overlap = "get(w, {j}).license = x.license and 2 * (least(get(w, {j}).end, x.end) - greatest(get(w, {j}).at, x.at)) > least(get(w, {j}).end - get(w, {j}).at, x.end - x.at)"
    worse = f"coalesce({overlap} and get(w, {{j}}).d {{than}} x.d, false)"
    alone = f"filter(w, (x, i) -> not {worse.format(j='(i - 1)', than='>=')} and not {worse.format(j='(i + 1)', than='>')})"
    windows = f"element_at(transform(array({close}), w -> array_distinct(transform({alone}, x -> array_sort(x.b)))), 1)"
    # the smallest of (minus Dice, licence): of equal Dice the first in the alphabet
    near = f"array_distinct(flatten(transform(array_intersect(b, held), x -> transform(element_at({places}, x), e -> e.k))))"
    fits = f"filter(transform({near}, k -> {known}[k]), t -> size(b) between t.lo and t.hi)"
    best = f"array_min(transform({fits}, t -> named_struct('minus', -{_dice('b', 't')}, 'license', t.license)))"
    judged = lambda sets: f"filter(transform({sets}, b -> named_struct('best', {best}, 'b', b)), x -> -x.best.minus >= {t})"
    units = "array_distinct(concat(split(plain, '\n'), split(plain, r'\\n\\x20*\\n'), array(plain)))"
    units = f"array_distinct(transform({units}, u -> array_sort(array_distinct({_pairs_of('u')}))))"
    inside = "exists(whole, u -> size(array_except(b, u.b)) = 0)"
    none = "cast(array() as array<struct<best:struct<minus:double,license:string>,b:array<string>>>)"
    return (
        docs.select("doc_id", text_of().alias("body"))
        .withColumn("plain", F.expr(_PLAIN))
        .withColumn("run", F.expr(_pairs_of("plain")))
        .withColumn("marks", F.expr(f"filter(transform(run, (x, i) -> if(x in ({', '.join(map(repr, prefix))}), i, -1)), i -> i >= 0)"))
        .withColumn("held", F.expr("array_distinct(transform(marks, i -> run[i]))"))
        .withColumn("whole", F.expr(f"if(size(marks) > 0, {judged(units)}, {none})"))
        .withColumn("parts", F.expr(f"if(size(marks) > 0, {judged(f'filter({windows}, b -> not {inside})')}, {none})"))
        .withColumn("found", F.expr("transform(concat(whole, parts), x -> x.best)"))
        .withColumn("best", F.array_min("found"))
        .select(
            "doc_id", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("dice"),
            F.size("found").cast("long").alias("n_matches"),
            F.expr("concat_ws(',', array_sort(transform(found, x -> concat(x.license, ':', cast(round(-x.minus, 4) as decimal(5,4))))))").alias("matches"),
        )
    )
