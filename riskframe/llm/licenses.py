"""License scans: lines, whole texts and windows of words against licence templates, by the Dice coefficient of their word bigrams.

Dice is twice the shared bigrams by the sum of both counts, over distinct bigrams. A template can only reach the
threshold t on a text of b bigrams if its own count lies between b * t / (2 - t) and b * (2 - t) / t: others are
pruned by size. Everything stays in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short notices by which works name their licence, and openings of common licence texts.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS{} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_CC = "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution{} 4.0 International Public License"
#: Whole sentences, headers and texts, for windows. The SQL has only TEMPLATES. Licences of thousands of words are here by a title or sentence of their own.
TEXTS = {
    "MIT": [_MIT, f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY.format(' OR COPYRIGHT HOLDERS')}"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."],
    "GPL-3.0": [(_GNU + _GNU_REST).format("General Public License", 3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-2.0": [(_GNU + _GNU_REST).format("General Public License", 2), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."],
    "LGPL-3.0": [_GNU.format("Lesser General Public License", 3), (_GNU + _GNU_REST).format("Lesser General Public License", 3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."],
    "AGPL-3.0": [_GNU.format("Affero General Public License", 3), (_GNU + _GNU_REST).format("Affero General Public License", 3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."],
    "BSD-2-Clause": [_BSD.format("")],
    "BSD-3-Clause": [_BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")],
    "ISC": [_ISC, _ISC + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "Unlicense": [_UNLICENSE],
    "CC-BY-4.0": [_CC.format("")],
    "CC-BY-SA-4.0": [_CC.format("-ShareAlike")],
    "CC-BY-NC-4.0": [_CC.format("-NonCommercial")],
    "CC0-1.0": ["The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database (each, a \"Work\")."],
}
#: Lengths of windows, by that of the template.
WINDOWS = (0.7, 0.8, 0.9, 1.0, 1.1, 1.25, 1.45)
THRESHOLD = 0.8


def normalised(text: Column) -> Column:
    """Lower-case A-Z, other ASCII but digits as one space between words."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))


def template_bigrams(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, int, list[str]]]:
    """(licence, number of the notice, its distinct bigrams)."""
    import re

    out = []
    for name, notices in templates.items():
        for k, notice in enumerate(notices):
            words = re.sub(r"[^a-z0-9]+", " ", notice.lower()).split()
            out.append((name, k, sorted({f"{a} {b}" for a, b in zip(words, words[1:])})))
    return out


#: Words too common to tell anything, unless a template has no others.
_COMMON = frozenset(
    "a an and any are as at author be by can mit code copies copy each either file for form free from general has holder in including is it its june law library list may more name names not notice of "
    "on or option other out owner parts party person persons possible program project provided public purpose related released rights see shall software some source sources subject such terms that "
    "the their this to under use used using version was which will with without work works you your all above accept action agree been before below conditions created creation distributed event "
    "express following found hope must obtain only own part permit publish receive respect same sell specific then these they those useful whether where writing written".split()
)


def telling_words(grams: list[list[str]], threshold: float) -> list[str]:
    """Words of which any text that reaches the threshold with a template has one.

    Such a text shares at least threshold * (1 + t / (2 - t)) / 2 of the template's m bigrams. So if bigrams with one of some words are more than the rest of m, one of
    these is shared. Long words are taken first, by what they cover of what is still wanted, since few other texts have them.
    """
    share = threshold * (1 + threshold / (2 - threshold)) / 2
    wanted = [len(g) - math.ceil(len(g) * share - 1e-9) + 1 for g in grams]
    left = [[x.split(" ") for x in g] for g in grams]
    out: list[str] = []
    for common in (False, True):  # common ones only where the others don't suffice
        while any(n > 0 for n in wanted):
            gain: dict[str, int] = {}
            for n, g in zip(wanted, left):
                for w in {w for pair in g for w in pair} if n > 0 else ():
                    if common or w not in _COMMON and len(w) > 1:
                        gain[w] = gain.get(w, 0) + min(n, sum(w in pair for pair in g))
            if not gain:
                break
            best = min(gain, key=lambda w: (-gain[w] * max(1, len(w) - 4) ** 2, w))
            out.append(best)
            for i, g in enumerate(left):
                wanted[i] -= sum(best in pair for pair in g)
                left[i] = [pair for pair in g if best not in pair]
    return out


def beginning(words: list[str]) -> str:
    """A regular expression for texts in which a word begins with one of these, in either case; letters that words share are tried once."""

    def tree(rest: list[str]) -> str:
        if "" in rest:
            return ""
        by = {c: tree([w[1:] for w in rest if w[0] == c]) for c in sorted({w[0] for w in rest})}
        return "(?:" + "|".join(c + x for c, x in by.items()) + ")"

    return f"(?i)(?:^|[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]){tree(words)}"


def window_templates(templates: dict[str, list[str]], texts: dict[str, list[str]]) -> list[tuple[str, int, list[str], list[int]]]:
    """(licence, number of the notice, its distinct bigrams, the lengths of its windows in bigrams); texts are numbered after the licence's templates."""
    short, full = template_bigrams(templates), template_bigrams(texts)
    return [(name, k, g, sorted({max(1, round(len(g) * r)) for r in WINDOWS})) for name, k, g in [*short, *[(name, k + len(templates.get(name, [])), g) for name, k, g in full]]]


def window_hits(rows: DataFrame, threshold: float, grams: list[tuple[str, int, list[str], list[int]]]) -> DataFrame:
    """Replaces _w (words of the whole text) and _s (its distinct bigrams that any template has) by _v, array<struct<start, rank, end, license, notice, dice>>:
    windows that reach the threshold and don't overlap, in their order, as swept() keeps the better ones. Better is more shared bigrams times Dice.

    A window begins at one of the template's bigrams; the one before it that has none would only lower Dice. Only a text that
    shares m * t / (2 - t) of a template's m bigrams can hold a window of it.
    """
    known = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(k).alias("notice"), F.array(*map(F.lit, g)).alias("g"), F.array(*map(F.lit, sizes)).alias("sizes")) for name, k, g, sizes in grams])
    low = threshold / (2 - threshold)
    least = min(len(g) for _, _, g, _ in grams) * low
    here = F.when(F.size("_s") >= least, F.filter(known, lambda t: F.size(F.array_intersect("_s", t["g"])) >= F.size(t["g"]) * low))
    others = [c for c in rows.columns if c not in ("_w", "_s")]
    rows = rows.select(*others, "_w", here.alias("_h"))
    # A column of its own: an expression would be made anew for each window.
    bigrams = F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get("_w", i + 1)))
    rows = rows.select(*others, "_h", F.when(F.size("_h") > 0, bigrams).alias("_b"))

    def found(t: Column) -> Column:
        def dice(n: Column) -> Column:
            return 2.0 * n["both"] / (n["size"] + F.size(t["g"]))

        def measured(i: Column, size: Column) -> Column:
            unit = F.array(F.array_distinct(F.slice("_b", i + 1, size)))
            counts = F.transform(unit, lambda u: F.struct(i.alias("start"), (i + size).alias("end"), F.size(u).alias("size"), F.size(F.array_intersect(u, t["g"])).alias("both")))
            return F.get(counts, F.lit(0))

        starts = F.filter(F.transform("_b", lambda b, i: F.when(F.array_contains(t["g"], b), i)), lambda i: i.isNotNull())
        counts = F.flatten(F.transform(starts, lambda i: F.filter(F.transform(t["sizes"], lambda size: measured(i, size)), lambda n: dice(n) >= threshold)))
        return F.transform(counts, lambda n: F.struct(n["start"].alias("start"), (-n["both"] * dice(n)).alias("rank"), n["end"].alias("end"), t["license"].alias("license"), t["notice"].alias("notice"), dice(n).alias("dice")))

    rows = rows.select(*others, F.array_sort(F.flatten(F.transform("_h", found))).alias("_v"))
    rows = rows.select(*others, "_v", swept(F.col("_v")).alias("_k"))
    # What the sweep gave up for a window that gave way itself, and that nothing kept overlaps.
    taken = F.flatten(F.transform("_k", lambda k, i: F.concat(F.array_repeat(F.lit(False), k["start"] - F.when(i == 0, 0).otherwise(F.get("_k", i - 1)["end"] + 1)), F.array_repeat(F.lit(True), k["end"] - k["start"] + 1))))
    rows = rows.select(*others, "_v", "_k", F.when(F.size("_k") > 0, taken).alias("_t1"))
    free = F.filter("_v", lambda v: ~F.coalesce(F.array_contains(F.slice("_t1", v["start"] + 1, v["end"] - v["start"] + 1), True), F.lit(False)))
    return rows.select(*others, "_k", F.when(F.size("_k") > 0, free).alias("_f")).select(*others, F.when(F.size("_k") > 0, F.array_sort(F.concat("_k", F.when(F.size("_f") > 0, swept(F.col("_f"))).otherwise(_no_windows())))).alias("_v"))


_WINDOW = "struct<start: int, rank: double, end: int, license: string, notice: int, dice: double>"


def _no_windows() -> Column:
    return F.array().cast(f"array<{_WINDOW}>")


def swept(windows: Column) -> Column:
    """Of windows in the order of their starts some that don't overlap: each is compared with the one before it that is still kept, and the better stays, the first of equals.
    One pass: what is settled is only added to."""
    nothing = F.struct(_no_windows().alias("done"), F.lit(None).cast(_WINDOW).alias("last"))
    settled = lambda a: F.when(a["last"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["last"])))
    state = lambda done, last: F.struct(done.alias("done"), last.alias("last"))
    apart = lambda a, x: a["last"].isNull() | (a["last"]["end"] < x["start"])
    return F.aggregate(windows, nothing, lambda a, x: F.when(apart(a, x), state(settled(a), x)).otherwise(state(a["done"], F.when(x["rank"] < a["last"]["rank"], x).otherwise(a["last"]))), settled)


def license_hits(docs: DataFrame, *, threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES, texts: dict[str, list[str]] = TEXTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and hits, array<struct<line, license, notice, dice>>; a row for each row of docs.

    Compared are each line (from 0), each sentence of a line, and the whole text (line -1); a hit is the best template that a
    line or one of its sentences reaches. Null and empty texts have no hits; nor have units of one word.
    Windows of words, wherever lines end, are compared with the templates and with whole texts; a hit of a window is put on its first line. It's
    left out where it overlaps a line (or the whole text) that is a hit of the same licence, or one as high.
    A unit's bigrams are bigrams of its text, so texts that hold fewer of any template's than a hit needs are done with.
    """
    grams = template_bigrams(templates)
    sizes = [len(g) for _, _, g in grams]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = int(min(sizes) * low), int(max(sizes) * high) + 1
    need = max(1, int(threshold * min(sizes) * (1 + low) / 2))
    known = sorted({x for _, _, g in grams for x in g})
    wide = window_templates(templates, texts)
    words = telling_words([g for _, _, g, _ in wide], threshold)
    # One search through the text as it is says of nearly all that no template can be reached; the rest isn't done for them.
    t = F.coalesce(F.col(text), F.lit(""))
    t = F.when(t.rlike(beginning(words)), t).otherwise("") if words else t
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("_t"))
    rows = rows.select("doc_id", "_t", F.split(normalised(F.col("_t")), " +").alias("_w"))
    shared = F.filter(F.transform("_w", lambda w, i: F.concat_ws(" ", w, F.get("_w", i + 1))), lambda g: g.isin(sorted({x for _, _, g, _ in wide for x in g})))
    rows = rows.select("doc_id", "_t", "_w", shared.alias("_s"))
    rows = rows.select("doc_id", F.when(F.size(F.filter("_s", lambda g: g.isin(known))) >= need, F.col("_t")).alias("_t"), F.col("_t").alias("_all"), "_w", F.array_distinct("_s").alias("_s"))
    rows = window_hits(rows, threshold, wide)
    # The line of each word.
    places = F.flatten(F.transform(F.split("_all", "\n"), lambda x, i: F.array_repeat(i, F.when(normalised(x) == "", 0).otherwise(F.size(F.split(normalised(x), " +"))))))
    rows = rows.select("doc_id", "_t", "_v", F.when(F.size("_v") > 0, places).alias("_l"))
    rows = rows.select("doc_id", "_t", F.transform("_v", lambda v: F.struct(F.get("_l", v["start"]).alias("line"), F.coalesce(F.get("_l", v["end"]), F.get("_l", F.size("_l") - 1)).alias("last"), v["license"].alias("license"), v["notice"].alias("notice"), v["dice"].alias("dice"))).alias("_v"))
    lines = F.split("_t", "\n")
    unit = lambda line, x: F.struct(line.alias("line"), x.alias("x"))
    each = F.flatten(F.transform(lines, lambda x, i: F.transform(F.array_distinct(F.concat(F.array(x), F.split(x, "(?<=[.!?]) +"))), lambda y: unit(i, y))))
    # Words are a character and a blank at least: shorter units go before they are normalised.
    units = F.filter(F.concat(F.array(unit(F.lit(-1), F.col("_t"))), each), lambda u: F.length(u["x"]) > 2 * least)
    rows = rows.select("doc_id", "_v", F.transform(units, lambda u: F.struct(u["line"].alias("line"), F.split(normalised(u["x"]), " +").alias("w"))).alias("_u"))
    rows = rows.select("doc_id", "_v", F.filter("_u", lambda u: F.size(u["w"]) > 1).alias("_u"))
    bigrams = lambda w: F.array_distinct(F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))
    rows = rows.select("doc_id", "_v", F.transform("_u", lambda u: F.struct(u["line"].alias("line"), bigrams(u["w"]).alias("g"))).alias("_g"))
    # With the size of a unit and the bigrams that any template has; size bounds say which templates are compared.
    rows = rows.select("doc_id", "_v", F.transform(F.filter("_g", lambda u: F.size(u["g"]).between(least, most)), lambda u: F.struct(u["line"].alias("line"), F.size(u["g"]).alias("n"), F.filter(u["g"], lambda g: g.isin(known)).alias("g"))).alias("_g"))
    rows = rows.select("doc_id", "_v", F.filter("_g", lambda u: F.size(u["g"]) >= need).alias("_g"))

    def compared(u: Column) -> Column:
        tried = []
        for name, k, g in grams:
            dice = 2.0 * F.size(F.array_intersect(u["g"], F.array(*map(F.lit, g)))) / (u["n"] + len(g))
            fits = (u["n"] >= len(g) * low) & (u["n"] <= len(g) * high)
            tried.append(F.when(fits, F.struct(u["line"].alias("line"), F.lit(name).alias("license"), F.lit(k).alias("notice"), dice.alias("dice"))))
        return F.filter(F.array(*tried), lambda x: x["dice"] >= threshold)

    rows = rows.select("doc_id", "_v", F.flatten(F.transform("_g", compared)).alias("_h"))
    # Of the hits in a line the highest; ties go to the first template.
    ordered = F.array_sort(F.transform("_h", lambda a, i: F.struct(a["line"].alias("line"), (-a["dice"]).alias("less"), i.alias("i"), a["license"].alias("license"), a["notice"].alias("notice"), a["dice"].alias("dice"))))
    rows = rows.select("doc_id", "_v", ordered.alias("_h"))
    firsts = F.filter("_h", lambda a, i: (i == 0) | (F.get("_h", i - 1)["line"] != a["line"]))
    none = F.array().cast("array<struct<line: int, license: string, notice: int, dice: double>>")
    rows = rows.select("doc_id", "_v", F.coalesce(F.transform(firsts, lambda a: F.struct(a["line"].alias("line"), a["license"].alias("license"), a["notice"].alias("notice"), a["dice"].alias("dice"))), none).alias("hits"))
    # By line, -1 first and null where a line is no hit, up to the last that is: a window then meets the hits of its own lines alone.
    filled = F.flatten(F.transform("hits", lambda h, i: F.concat(F.array_repeat(F.lit(None).cast("struct<line: int, license: string, notice: int, dice: double>"), h["line"] - F.when(i == 0, -1).otherwise(F.get("hits", i - 1)["line"] + 1)), F.array(h))))
    rows = rows.select("doc_id", "_v", "hits", F.when((F.size("_v") > 0) & (F.size("hits") > 0), filled).alias("_n"))
    covers = lambda v, h: F.coalesce((h["license"] == v["license"]) | (h["dice"] >= v["dice"]), F.lit(False))
    covered = lambda v: F.coalesce(covers(v, F.get("_n", F.lit(0))) | F.exists(F.slice("_n", v["line"] + 2, v["last"] - v["line"] + 1), lambda h: covers(v, h)), F.lit(False))
    more = F.filter("_v", lambda v: ~covered(v))
    more = F.transform(more, lambda v: F.struct(v["line"].alias("line"), v["license"].alias("license"), v["notice"].alias("notice"), v["dice"].alias("dice")))
    return rows.select("doc_id", F.concat("hits", F.coalesce(more, none)).alias("hits"))


def licenses(docs: DataFrame, *, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_hits (lines, windows, and the whole text where it is a hit), license and dice of the best hit (ties: first by name; null where none), licenses
    (names of all hits, sorted, comma-joined); a row for each row of docs."""
    rows = license_hits(docs, threshold=threshold, doc_id=doc_id, text=text)
    best = F.element_at(F.array_sort(F.transform("hits", lambda h: F.struct((-h["dice"]).alias("d"), h["license"].alias("l")))), 1)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ",")
    some = F.size("hits") > 0
    return rows.select("doc_id", F.size("hits").cast("long").alias("n_hits"), F.when(some, best["l"]).alias("license"), F.when(some, -best["d"]).alias("dice"), names.alias("licenses"))
