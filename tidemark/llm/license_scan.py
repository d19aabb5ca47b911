"""License scans: normalised text against license templates, by word bigrams.

A unit (a line, a paragraph, or the whole text) holds a template if the Dice
coefficient of their bigram sets reaches the threshold; a license that no unit
holds is looked for in windows of words, wherever lines begin and end. As 2m / (a + b) can't
reach s unless the smaller set has s / (2 - s) of the larger one's size, sizes
prune the templates that a unit is compared with. Only DataFrame code.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import once, text_of

DICE = 0.8

#: Public license notices and texts (fixed values).
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-3-Clause notice": "Released under the 3-Clause BSD License.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All rights reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def _list(text: str) -> list[str]:
    w = re.findall("[a-z0-9]+", text.lower())
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a text, as the scan normalises it: lower
    case, words of ASCII letters and digits."""
    return list(dict.fromkeys(_list(text)))


def anchors(templates: dict[str, str], dice: float) -> list[str]:
    """Bigrams of which any text holding a template has at least one: at most
    a - ceil(a * dice / (2 - dice)) of a template's a bigrams can be missing,
    so one more than that will do; the longest are the rarest."""
    found: set[str] = set()
    for t in templates.values():
        b = sorted(bigrams(t), key=lambda x: (-len(x), x))
        found.update(b[: len(b) - math.ceil(len(b) * dice / (2 - dice) - 1e-9) + 1])
    return sorted(found)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    """The distinct bigrams of an array column of words."""
    return F.array_distinct(_pairs(words, lambda a, b: F.concat(a, F.lit(" "), b)))


def _pairs(words: Column, f) -> Column:
    """f of every two adjacent words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), f)


def _hash(bigram: str) -> int:
    """What xxhash64(first word, second word) gives."""
    a, b = bigram.split(" ")
    h = xxh64_intdigest(b, xxh64_intdigest(a, 42))
    return h - (1 << 64) if h >> 63 else h


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, dice: float = DICE) -> DataFrame:
    """`(id, license, dice, n_units)`: each license that a unit is most like, with the
    best coefficient, rounded to 6 places, and the number of units that hold it;
    of a license that no unit holds, but a window, the number of windows.

    A null or empty text and one of a single word hold none; equal units of a
    text count once; of two rows with one id, the units add up. No row for texts
    without a license. Texts without any anchor are dropped first, which loses
    nothing (see anchors()). Templates are a parameter and sit in the plan.
    """
    templates = TEMPLATES if templates is None else templates
    sets = {k: b for k, v in templates.items() if (b := bigrams(v))}
    if not sets:
        return df.select(F.col(id_col), F.lit("").alias("license"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("n_units")).where("false")
    sure = F.array(*(F.lit(_hash(a)).cast("long") for a in anchors({k: templates[k] for k in sets}, dice)))
    d = once(df.select(F.col(id_col), text_of(df, text).alias("_t")), "_w", _words(F.col("_t")))
    d = d.where(F.arrays_overlap(_pairs(F.col("_w"), lambda a, b: F.xxhash64(a, b)), sure))
    windows = _windows(d.select(id_col, "_w"), sets, {k: len(_list(templates[k])) for k in sets}, dice)
    d = d.drop("_w")
    units = F.array_distinct(F.concat(F.split("_t", "\n"), F.split("_t", r"\n\s*\n"), F.array("_t")))
    d = once(d.select(id_col, F.explode(units).alias("_u")), "_b", _bigrams(_words(F.col("_u"))))
    d = d.withColumn("_n", F.size("_b")).where("_n > 0")
    rows = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(len(b)).alias("n"), F.array(*map(F.lit, b)).alias("b")) for k, b in sets.items()))
    least = dice / (2 - dice) - 1e-9
    fits = F.filter(rows, lambda t: (F.col("_n") >= t["n"] * least) & (t["n"] >= F.col("_n") * least))
    # a unit holds the template that it is most like, of equals the last by name
    alike = F.transform(fits, lambda t: F.struct((2 * F.size(F.array_intersect("_b", t["b"])) / (F.col("_n") + t["n"])).alias("dice"), t["license"].alias("license")))
    d = once(d, "_best", F.array_max(alike)).where(F.col("_best.dice") >= dice - 1e-12)
    found = d.select(id_col, F.col("_best.license").alias("license"), F.col("_best.dice").alias("_d"), F.lit(True).alias("_unit")).unionByName(windows)
    of = lambda f, x: F.coalesce(f(F.when(F.col("_unit"), x)), f(x))
    n = F.count_if("_unit")
    return found.groupBy(id_col, "license").agg(F.round(of(F.max, F.col("_d")), 6).alias("dice"), F.when(n > 0, n).otherwise(F.count("*")).alias("n_units"))


def _windows(d: DataFrame, sets: dict[str, list[str]], lengths: dict[str, int], dice: float) -> DataFrame:
    """`(id, license, _d, _unit)`: a row for each window of words that holds a
    template, of those that overlap the one that shares most bigrams.

    A window begins and ends with bigrams of the template, as any best one does,
    and has at most (2 - dice) / dice as many bigrams as the template in words.
    Bigrams are met in order from every beginning; one that occurred since the
    beginning isn't counted again. Texts with too few of a template's bigrams
    are left out, which loses nothing.
    """
    id_col = d.columns[0]
    least = dice / (2 - dice) - 1e-9
    d = once(d, "_h", _pairs(F.col("_w"), lambda a, b: F.xxhash64(a, b))).drop("_w")
    hashes = lambda b: F.array(*(F.lit(_hash(x)).cast("long") for x in b))
    rows = F.array(
        *(
            F.struct(F.lit(k).alias("license"), F.lit(len(b)).alias("n"), F.lit(math.ceil(len(b) * least)).alias("need"), F.lit(math.floor(lengths[k] / least)).alias("span"), hashes(b).alias("b"))
            for k, b in sets.items()
        )
    )
    near = F.filter(rows, lambda t: F.size(F.array_intersect("_h", t["b"])) >= t["need"])
    d = once(d, "_near", near).where(F.size("_near") > 0).withColumn("_row", F.monotonically_increasing_id())
    # where each bigram stood before, -1 if nowhere
    at = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = once(d, "_at", at)
    before = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(-1).alias("i"))), F.slice("_at", 1, F.size("_at") - 1))
    prev = F.array_sort(F.zip_with("_at", before, lambda x, y: F.struct(x["i"].alias("i"), F.when(x["h"] == y["h"], y["i"]).otherwise(-1).alias("p"))))
    d = once(d, "_prev", prev).drop("_at")
    d = d.select(id_col, "_h", "_prev", "_row", F.explode("_near").alias("_t"))
    marks = F.zip_with("_h", "_prev", lambda h, x: F.struct(x["i"].alias("i"), x["p"].alias("p"), F.array_contains("_t.b", h).alias("hit")))
    d = once(d, "_z", marks).drop("_h", "_prev")
    zero = F.struct(F.lit(0).alias("b"), F.lit(0).alias("m"), F.lit(0.0).alias("d"), F.lit(0).alias("best"), F.lit(-1).alias("end"))

    def window(z: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            new = x["p"] < z["i"]
            b, m = s["b"] + F.when(new, 1).otherwise(0), s["m"] + F.when(new & x["hit"], 1).otherwise(0)
            value = 2 * m / (b + F.col("_t.n"))
            up = x["hit"] & (value > s["d"])
            pick = lambda a, c: F.when(up, a).otherwise(c)
            return F.struct(b.alias("b"), m.alias("m"), pick(value, s["d"]).alias("d"), pick(m, s["best"]).alias("best"), pick(x["i"], s["end"]).alias("end"))

        done = lambda s: F.struct(s["best"].alias("m"), s["d"].alias("d"), F.col("_t.license").alias("license"), z["i"].alias("start"), s["end"].alias("end"))
        return F.aggregate(F.slice("_z", z["i"] + 1, F.col("_t.span")), zero, step, done)

    d = once(d, "_c", F.filter(F.transform(F.filter("_z", lambda z: z["hit"]), window), lambda c: c["d"] >= dice - 1e-12))
    d = d.where(F.size("_c") > 0).groupBy("_row", id_col).agg(F.array_sort(F.flatten(F.collect_list("_c"))).alias("_c"))
    none = F.filter("_c", lambda c: F.lit(False))
    free = lambda got, c: ~F.exists(got, lambda g: (g["start"] <= c["end"]) & (c["start"] <= g["end"]))
    held = F.aggregate(F.reverse("_c"), none, lambda got, c: F.when(free(got, c), F.concat(got, F.array(c))).otherwise(got))
    return d.select(id_col, F.explode(held).alias("_c")).select(id_col, F.col("_c.license").alias("license"), F.col("_c.d").alias("_d"), F.lit(False).alias("_unit"))
