"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment of
five-word shingles verifies them.

A template of s shingles is sought in windows of 2 * 2^k shingles at a stride of 2^k, where 2^k is
the least power of two that is s or more: every occurrence lies whole inside a window, and the
Jaccard similarity of the two is 0.19 or more at a containment of 0.8. With bands of one row, BANDS of
them miss such a pair with a probability below 0.81^32 = 0.0012. Window and template share band j only
if the window holds the shingle that gives the template its least hash of band j. So the templates'
signatures, these shingles alone, are looked up in the texts, and the bands of a window without any of
them are not computed, as they could not meet. Templates' other shingles serve only to verify.
"""

from __future__ import annotations

import math
import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrid.llm.common import quoted

SHINGLE, BANDS = 5, 32

#: Signature shingles looked for in one reading of the texts, at most.
MOST_SIGNS = 20_000

# Whole texts or standard notices of public licenses, and the short notices in use.
_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", _PERMISSION),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _FREE.format("General Public License", 3)),
    ("GPL-2.0", _FREE.format("General Public License", 2)),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL-3.0", _FREE.format("Lesser General Public License", 3)),
    ("LGPL-2.1", _FREE.format("Lesser General Public License", "2.1")),
    ("AGPL-3.0", _FREE.format("Affero General Public License", 3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSD-3-Clause", " ".join([_REDISTRIBUTION, _ENDORSE, _AS_IS])),
    ("BSD-2-Clause", " ".join([_REDISTRIBUTION, _AS_IS])),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", _ISC),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
]

SPLIT = "[^\\p{L}\\p{N}]+"


def plain_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def chained(words: list[str]) -> int:
    """Spark's xxhash64 of several strings: each is hashed with the hash so far as its seed."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def signature(hashes: list[int]) -> list[int]:
    """The shingles' hashes that are least under each band's hash."""
    return sorted({min(hashes, key=lambda h: chained_longs(h, j)) for j in range(1, BANDS + 1)})


def chained_longs(h: int, j: int) -> int:
    """Spark's xxhash64 of a long and an int."""
    first = xxhash.xxh64_intdigest((h % (1 << 64)).to_bytes(8, "little"), 42)
    found = xxhash.xxh64_intdigest(j.to_bytes(4, "little"), first)
    return found - (1 << 64) if found >> 63 else found


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """Rows key, template (its number), license, containment: the highest share of a template's
    shingles that a window of the key's texts holds, where that is `least` or more.

    Words are runs of letters and digits, lower-cased. Null and empty texts, and texts shorter than a
    shingle, match nothing; long texts are read whole; rows with one key count together; an empty
    table gives an empty result; other columns are ignored. Templates need five words at least; many
    templates are sought in several readings of the texts, each for at most MOST_SIGNS signatures.
    """
    chosen, groups, signs = [], [], 0
    for i, (name, wording) in enumerate(templates or TEMPLATES):
        w = plain_words(wording)
        shingles = sorted({" ".join(w[j : j + SHINGLE]) for j in range(len(w) - SHINGLE + 1)})
        if not shingles:
            raise ValueError(f"template {i} has fewer than {SHINGLE} words")
        hashes = [chained(x.split(" ")) for x in shingles]
        if signs + BANDS > MOST_SIGNS:
            groups.append(chosen)
            chosen, signs = [], 0
        chosen.append((i, name, 1 << math.ceil(math.log2(len(shingles))), shingles, hashes))
        signs += BANDS
    found = None
    for group in (*groups, chosen):
        part = _scan(df, key, text, group, least)
        found = part if found is None else found.unionByName(part)
    return found


def _scan(df: DataFrame, key: str, text: str, chosen: list[tuple], least: float) -> DataFrame:
    # One row per template and band, MOST_SIGNS at most, each with the template's shingles.
    known = df.sparkSession.createDataFrame(chosen, "template int, license string, stride int, shingles array<string>, hashes array<long>")
    every = sorted({h for t in chosen for h in signature(t[4])})
    strides = sorted({t[2] for t in chosen})
    least_hash = lambda shingles, j: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, j)))
    bands = lambda hashes: F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda j: least_hash(hashes, j))
    signs = known.select("template", "stride", F.posexplode(bands(F.col("hashes"))).alias("band", "sign"))

    # A generator keeps the optimizer from copying a costly column into what uses it.
    once = lambda c: F.explode(F.array(c))
    own = df.select(quoted(key).alias("key"), once(F.split(F.trim(F.regexp_replace(F.lower(quoted(text)), SPLIT, " ")), " ")).alias("words"))
    joined = lambda i: F.concat_ws(" ", F.slice("words", i, SHINGLE))
    # One hash per place, each over the words from there on; the last places have too few.
    hashed = F.transform("words", lambda w, i: F.xxhash64(w, *[F.get("words", i + j) for j in range(1, SHINGLE)]))
    hashed = F.slice(hashed, F.lit(1), F.size("words") - (SHINGLE - 1))
    own = own.filter(F.size("words") >= SHINGLE).select("key", "words", once(hashed).alias("hashes"))
    # Places of the signatures, and from them the windows that hold one.
    places = F.filter(F.transform("hashes", lambda h, i: F.when(h.isin(every), i)), lambda i: i.isNotNull())
    own = own.select("key", "words", "hashes", once(places).alias("places")).filter(F.size("places") > 0)
    own = own.withColumn("stride", F.explode(F.array(*[F.lit(s) for s in strides])))
    near = lambda back: F.transform("places", lambda i: (F.floor(i / F.col("stride")) - back).cast("int"))
    numbers = F.array_distinct(F.filter(F.concat(near(0), near(1)), lambda k: k >= 0))
    first = lambda k: k * F.col("stride") + 1
    cut = lambda k: F.struct(first(k).alias("first"), F.slice("words", first(k), 2 * F.col("stride") + (SHINGLE - 1)).alias("words"), F.slice("hashes", first(k), 2 * F.col("stride")).alias("hashes"))
    windows = own.select("key", "stride", F.explode(F.transform(numbers, cut)).alias("w"))
    windows = windows.select("key", "stride", "w.first", "w.words", bands(F.col("w.hashes")).alias("signs"))
    # A window meets a template once, on whichever bands.
    found = windows.select("key", "stride", "words", F.posexplode("signs").alias("band", "sign")).join(F.broadcast(signs), ["stride", "band", "sign"])
    found = found.select("key", "words", "template").join(F.broadcast(known.select("template", "license", "shingles")), "template")
    inside = F.transform(F.sequence(F.lit(1), F.size("words") - (SHINGLE - 1)), joined)
    share: Column = F.size(F.array_intersect("shingles", inside)) / F.size("shingles")
    checked = found.select("key", "template", "license", share.alias("containment")).filter(F.col("containment") >= least)
    return checked.groupBy("key", "template", "license").agg(F.max("containment").alias("containment")).select(F.col("key").alias(key), "template", "license", "containment")
