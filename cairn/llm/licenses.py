"""License scans with a positional rare-token index; only DataFrame expressions.

Templates are the word sequences of licence texts and notices, some of whose words are a mandatory key phrase. Every
text is reduced to the places of its licence words (words of some template; of long templates only the longer words and
those of the phrase). A word's rarity is its inverse document frequency over all texts. Each template is indexed under
the rarest words of its mandatory phrase only, which every accepted place holds; a text's licence words are looked up
there, each hit proposing the template at the relative position text place - template place, and the postings of the
template's other words are intersected at that same relative position. A template of the base kind must be there word
for word; another needs its mandatory phrase word for word and most of its words.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class Template:
    """words: the licence's text; phrase: what must be there word for word; label: what it says; base: counts places."""

    words: str
    phrase: str
    label: str
    base: bool = False

    def split(self) -> list[str]:
        """The text's words, as texts are cut into them."""
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", self.words.translate(_LOWER))

    def place(self) -> int:
        """Where the phrase starts in the words; ValueError if it isn't there."""
        words, must = self.split(), self.phrase.split()
        for i in range(len(words) - len(must) + 1):
            if must and words[i : i + len(must)] == must:
                return i
        raise ValueError(f"{self.phrase!r} isn't in the template of {self.label}")

    def counted(self) -> list[int]:
        """Places of the words that are looked for: all of a short template, the longer ones and the phrase of a long one."""
        words, at = self.split(), self.place()
        must = range(at, at + len(self.phrase.split()))
        return [i for i, w in enumerate(words) if len(words) <= SHORT or len(w) >= LONGER or i in must]


#: Words up to which a template is short; letters from which a long template's words are looked for.
SHORT, LONGER = 40, 7
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: The base phrases.
BASE = (
    Template("under the mit license", "under the mit license", "mit", True),
    Template("apache license version 2", "apache license version 2", "apache-2", True),
    Template("cc by nc", "cc by nc", "cc-by-nc", True),
)

#: Common notices, reduced to their words.
NOTICES = (
    Template("this work is licensed under the gnu general public license version 3", "gnu general public license version 3", "gpl-3"),
    Template("this work is licensed under the gnu general public license version 2", "gnu general public license version 2", "gpl-2"),
    Template("licensed under the gnu lesser general public license", "gnu lesser general public license", "lgpl"),
    Template("subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2 0", "mpl-2"),
    Template("permission is hereby granted free of charge to any person obtaining a copy of this software", "granted free of charge to any person", "mit"),
    Template("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms", "bsd"),
    Template("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee", "isc"),
    Template("licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0", "cc-by-4"),
)

#: Texts of common licences, without names and years.
TEXTS = (
    Template("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "to deal in the software without restriction", "mit"),
    Template("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "disclaims all warranties with regard to this software", "isc"),
    Template("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""", "redistributions of source code must retain", "bsd"),
    Template("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""", "altered source versions must be plainly marked", "zlib"),
    Template("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", "unless required by applicable law or agreed to in writing", "apache-2"),
    Template("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", "either version 3 of the license", "gpl-3"),
)

#: The share of an additional template's words that must stand at their places.
SHARE = 0.6


def _normal(text: Column) -> Column:
    """The words joined by single spaces: A-Z as a-z, every run of other ASCII than letters and digits a space.

    lower() maps two characters beyond ASCII to ASCII letters, of which only the Kelvin sign becomes a whole one;
    it is replaced first, so that only A-Z count as lower-case letters.
    """
    folded = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ue000")))
    return F.trim(F.regexp_replace(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def places(docs: DataFrame, vocabulary: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns k, row (unique), n_words, hits: array of (w, pos), the words of the vocabulary and where they stand."""
    listed = docs.select(F.col(key).alias("k"), _normal(F.col(text)).alias("n")).select("k", F.when(F.col("n") == "", F.array().cast("array<string>")).otherwise(F.split("n", " ")).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("w"), i.alias("pos")))), lambda h: h.isNotNull())
    return listed.select("k", F.monotonically_increasing_id().alias("row"), F.size("words").cast("long").alias("n_words"), hits.alias("hits"))


def scan(docs: DataFrame, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES + TEXTS, anchors: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns key, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per input row.

    Null texts count as empty: no words, no places, empty labels, score 0. n_base counts the places of base
    templates, first_word and last_word their least and largest start (null without any). labels hold the base
    labels and those of the notices found. score: the largest share of a found template's words, so 1 with a base
    place. ValueError for a template without its phrase. anchors: how many of the rarest words of a notice's mandatory phrase index it; any one of them proposes the template.
    """
    templates = base + notices
    split, counted, starts = [t.split() for t in templates], [t.counted() for t in templates], [t.place() for t in templates]
    vocabulary = sorted({words[i] for words, some in zip(split, counted, strict=True) for i in some})
    index = materialize(places(docs, vocabulary, text, key), "places")
    seen = index.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    frequency = {r["w"]: r["n"] for r in seen.collect()}  # a row for each template word at most
    idf = {w: math.log((2 + max(frequency.values(), default=0)) / (1 + frequency.get(w, 0))) for w in vocabulary}
    posted, rare = [], set()
    for t, (template, words, some, at) in enumerate(zip(templates, split, counted, starts, strict=True)):
        must = range(at, at + len(template.phrase.split()))
        by_rarity = sorted(must, key=lambda i: (-idf[words[i]], i))
        anchor = {words[i] for i in by_rarity[: 1 if template.base else anchors]}
        rare |= anchor
        posted += [(words[i], t, i, i in must, words[i] in anchor) for i in some]
    facts = [(t, x.label, x.base, len(some), len(x.phrase.split())) for t, (x, some) in enumerate(zip(templates, counted, strict=True))]
    spark = docs.sparkSession
    posted = spark.createDataFrame(posted, "w string, t int, tpos int, must boolean, anchor boolean")  # bounded by the templates, as facts is
    facts = spark.createDataFrame(facts, "t int, label string, base boolean, size int, needed int")
    rows = index.filter(F.exists("hits", lambda h: h["w"].isin(sorted(rare)))).select("row", F.explode("hits").alias("h")).select("row", "h.w", "h.pos")
    votes = (
        rows.join(F.broadcast(posted), "w")
        .groupBy("row", "t", (F.col("pos") - F.col("tpos")).alias("start"))
        .agg(F.count("*").alias("votes"), F.count_if("must").alias("musts"), F.max("anchor").alias("anchored"))
        .filter("anchored")
    )
    found = votes.join(F.broadcast(facts), "t").filter((F.col("musts") == F.col("needed")) & (F.col("votes") >= F.ceil(F.col("size") * F.when(F.col("base"), 1.0).otherwise(SHARE))))
    per_row = found.groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("b"),
        F.collect_set("label").alias("l"),
        F.max(F.col("votes") / F.col("size")).alias("score"),
    )
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return index.select("row", "k", "n_words").join(per_row, "row", "left").select(
        F.col("k").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        listed("b").alias("base_labels"), listed("l").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
