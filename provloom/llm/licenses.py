"""License scans by a positional rare-token index (operator 3): DataFrame functions only.

Templates of licences are word sequences with a mandatory key phrase.  One pass splits each text into
words and notes which words of key phrases it has; the words themselves are kept only where they can
hold a whole phrase, as files with a licence are few.  From what was noted comes the inverse document
frequency of these words over the whole corpus.  In each file left its licence words are ranked by
it; of each template the highest-ranking ones are looked up in the file's postings (word, position),
the postings are intersected by position relative to the template, and each place left is verified
against the whole key phrase and compared with the whole template.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words of a key phrase that are looked up.
RARE_WORDS = 2

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    """``words``: the template; ``at``, ``key``: where the key phrase stands in it, and its words."""

    label: str
    words: tuple[str, ...]
    at: int
    key: tuple[str, ...]
    base: bool = False


def template(label: str, text: str, key: str, base: bool = False) -> Template:
    words, k = (tuple(re.findall(_WORD, x.lower())) for x in (text, key))
    at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
    return Template(label, words, at, k, base)


BASE = (
    template("cc-by", "cc by", "cc by", True),
    template("gpl", "general public license", "general public license", True),
    template("reserved", "all rights reserved", "all rights reserved", True),
)

# Texts of public licences and of the notices that they ask for.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution. """
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER
OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you
must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would
be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software
Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
_GNU_KEY = "GNU {0} as published by the Free Software Foundation, either version {1} of the License"
_CREATIVE = "This work is licensed under a Creative Commons {0} International License"


def _gnu(label: str, name: str, version: str) -> Template:
    return template(label, _GNU.format(name, version), _GNU_KEY.format(name, version))


def _creative(label: str, name: str) -> Template:
    return template(label, _CREATIVE.format(name), f"Creative Commons {name} International")


#: Openings, by which a family of licences is known, and whole texts, by phrases that tell versions apart.
MORE = (
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    template("apache", "licensed under the apache license version 2 0", "apache license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    template("lgpl", "gnu lesser general public license", "lesser general public license"),
    template("agpl", "gnu affero general public license", "affero general public license"),
    template("gpl", "redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    template("cc-by", "creative commons attribution", "creative commons attribution"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    template("mit", _MIT, "shall be included in all copies or substantial portions of the Software"),
    template("bsd-2-clause", _BSD_CLAUSES + _BSD_END, "provided with the distribution. THIS SOFTWARE IS PROVIDED BY"),
    template("bsd-3-clause", _BSD_CLAUSES + _BSD_THIRD + _BSD_END, "without specific prior written permission. THIS SOFTWARE IS PROVIDED BY"),
    template("isc", _ISC, "provided that the above copyright notice and this permission notice appear in all copies"),
    template("zlib", _ZLIB, "altered source versions must be plainly marked as such"),
    template("unlicense", _UNLICENSE, "either in source code form or as a compiled binary"),
    template("apache-2.0", _APACHE, "Apache License, Version 2.0"),
    template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License, v. 2.0"),
    template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0.", "Boost Software License, Version 1.0"),
    template("cc0", "Creative Commons CC0 1.0 Universal", "Creative Commons CC0"),
    _gnu("gpl-2.0", "General Public License", "2"),
    _gnu("gpl-3.0", "General Public License", "3"),
    _gnu("lgpl-2.1", "Lesser General Public License", "2.1"),
    _gnu("lgpl-3.0", "Lesser General Public License", "3"),
    _gnu("agpl-3.0", "Affero General Public License", "3"),
    _creative("cc-by-4.0", "Attribution 4.0"),
    _creative("cc-by-sa-4.0", "Attribution-ShareAlike 4.0"),
    _creative("cc-by-nc-4.0", "Attribution-NonCommercial 4.0"),
    _creative("cc-by-nd-4.0", "Attribution-NoDerivatives 4.0"),
)


def words_of(text: Column) -> Column:
    """The words of a text with A-Z in lower case.

    ``lower`` also folds other letters, which no template has; the one that would become an ASCII
    letter (U+212A) is put out of the way first.
    """
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("K"), F.lit("ĸ"))), F.lit(_WORD), F.lit(0))


def _strings(words: tuple[str, ...] | list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def by_rarity(noted: DataFrame, vocabulary: list[str]) -> list[str]:
    """A fixed list of words by inverse document frequency, the highest first; one row per word comes back."""
    counts = {r["w"]: r["n"] for r in noted.select(F.explode("_have").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    idf = {w: -math.log(1 + counts.get(w, 0)) for w in vocabulary}
    return sorted(vocabulary, key=lambda w: (-idf[w], w))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = BASE + MORE) -> DataFrame:
    """Places and labels of licences in each text.

    Returns ``id_col``, n_words and ``found``: an array of (label, base, start, coverage), one for
    each place of a key phrase; start counts words from 0, coverage is the share of the template's
    words that stand where the template has them.  Overlapping places of one or several templates
    all count.  One row per input row; no shuffle of texts, which are split into words once.

    Null and empty texts have no words and no places.  Whole texts are scanned.  Repeated rows give
    repeated results, a null id stays null, an empty table gives none, other columns are not read.
    """
    vocabulary = sorted({w for t in templates for w in t.key})
    worded = df.select(df[id_col].alias("_id"), F.coalesce(words_of(df[text_col]), F.array().cast("array<string>")).alias("_words"))
    noted = worded.select("_id", "_words", F.array_distinct(F.filter("_words", lambda w: w.isin(vocabulary))).alias("_have"))
    can_hold = F.lit(False)
    for key in sorted({tuple(sorted(set(t.key))) for t in templates}):
        can_hold = can_hold | (F.size(F.array_except(_strings(key), F.col("_have"))) == 0)
    noted = cut(noted.select("_id", F.size("_words").cast("long").alias("n_words"), "_have", F.when(can_hold, F.col("_words")).alias("_words")), "licenses-words")

    # An intersection keeps the order of its first side: the file's licence words, rarest first.
    ranked = noted.withColumn("_rank", F.when(F.col("_words").isNotNull(), F.array_intersect(_strings(by_rarity(noted, vocabulary)), F.col("_have"))))
    looked = ranked.withColumn("_look", F.array(*[F.slice(F.array_intersect(F.col("_rank"), _strings(t.key)), 1, RARE_WORDS) for t in templates]))
    posted = looked.withColumn("_post", F.filter(F.transform("_words", lambda w, i: F.when(F.exists("_look", lambda x: F.array_contains(x, w)), F.struct(w.alias("w"), i.alias("i")))), lambda p: p.isNotNull()))

    def places(n: int, t: Template) -> Column:
        key, words = _strings(t.key), _strings(t.words)

        def starts_by(word: Column) -> Column:
            return F.transform(F.filter("_post", lambda p: p["w"] == word), lambda p: p["i"] - F.array_position(key, word).cast("int") + 1)

        look = F.get("_look", F.lit(n))
        both = F.aggregate(F.slice(look, 2, RARE_WORDS), starts_by(F.get(look, F.lit(0))), lambda left, word: F.array_intersect(left, starts_by(word)))
        is_key = lambda s: F.when(s >= 0, F.slice("_words", F.greatest(s + 1, F.lit(1)), len(t.key)) == key).otherwise(False)

        def place(s: Column) -> Column:
            there = F.filter(F.sequence(F.lit(0), F.lit(len(t.words) - 1)), lambda k: (s - t.at + k >= 0) & (F.get("_words", s - t.at + k) == F.get(words, k)))
            return F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), s.cast("long").alias("start"), (F.size(there) / F.lit(float(len(t.words)))).alias("coverage"))

        return F.transform(F.filter(both, is_key), place)

    found = F.when(F.size("_post") > 0, F.concat(*[places(n, t) for n, t in enumerate(templates)]))
    return posted.select(F.col("_id").alias(id_col), "n_words", F.coalesce(found, F.array().cast("array<struct<label:string,base:boolean,start:bigint,coverage:double>>")).alias("found"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, places and labels as the query returns them."""
    base = F.filter("found", lambda p: p["base"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return scanned.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda p: p["coverage"])), F.lit(0.0)).alias("score"),
    )
