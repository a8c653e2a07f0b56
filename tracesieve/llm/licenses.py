"""Licence scan: each text's rarest licence words are looked up in an index of template words, and templates are verified where they line up."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# What parts words, the letters that are lower-cased, and the base phrases with their labels.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))

#: Words of a template in the index, the rarest over all documents; the first leads to the template.
ANCHORS = 3
#: A place in the index: a template's number times ``_STRIDE``, plus ``_MIDDLE``, less the word's position in the template.
_STRIDE, _MIDDLE = 1 << 32, 1 << 31


def _cut(text: str) -> tuple[str, ...]:
    """The words of a template's own text."""
    return tuple(w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w)


@dataclass(frozen=True)
class Template:
    """A label, the template's words, and the mandatory phrases in it as (position, words)."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]

    @staticmethod
    def of(label: str, text: str, *phrases: str) -> "Template":
        words, keys = _cut(text), []
        for phrase in phrases or (text,):
            own = _cut(phrase)
            keys.append((next(i for i in range(len(words)) if words[i : i + len(own)] == own), own))
        return Template(label, words, tuple(keys))


# The public texts of common licences, without their copyright lines.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""
UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of
this software must not be misrepresented; you must not claim that you wrote the original software."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
BSL_TEXT = """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or
organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and
this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all
copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are
solely in the form of machine-executable object code generated by a source language processor."""

TEMPLATES = tuple(Template.of(label, phrase) for label, phrase in BASE)
MORE = (
    Template.of("cc-by-nc", "cc by nc"),
    Template.of("cc-by-sa", "cc by sa"),
    Template.of("cc-by-nd", "cc by nd"),
    Template.of("lgpl", "gnu lesser general public license"),
    Template.of("agpl", "gnu affero general public license"),
    Template.of("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    Template.of("cc-by", "this work is licensed under a creative commons attribution", "creative commons attribution"),
    Template.of("apache", APACHE_NOTICE, "unless required by applicable law or agreed to in writing", "distributed on an as is basis"),
    Template.of("mit", MIT_TEXT, "permission is hereby granted free of charge", "of this software and associated documentation files"),
    Template.of("bsd", BSD_TEXT, "redistribution and use in source and binary forms", "provided that the following conditions are met"),
    Template.of("isc", ISC_TEXT, "permission to use copy modify and or distribute this software", "fee is hereby granted"),
    Template.of("unlicense", UNLICENSE_TEXT, "free and unencumbered software released into the public domain"),
    Template.of("zlib", ZLIB_TEXT, "the origin of this software must not be misrepresented"),
    Template.of("gpl", GPL_NOTICE, "gnu general public license as published by the free software foundation"),
    Template.of("bsl", BSL_TEXT, "boost software license", "machine executable object code generated by a source language processor"),
)


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; a null text has none."""
    parts = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN)
    return F.filter(parts, lambda w: w != "")


def document_counts(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows of ``words`` each word of the vocabulary stands; the vocabulary bounds what the driver gets."""
    known = F.array(*map(F.lit, vocabulary))
    found = words.select(F.explode(F.array_intersect("words", known)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r["word"]: r["n"] for r in found.collect()}


def _anchors(template: Template, counts: dict[str, int]) -> list[tuple[int, str]]:
    """The template's mandatory words of highest IDF, as (position, word), the rarest first; the last one fills up a short list."""
    ranked = sorted({(k + i, w) for k, own in template.keys for i, w in enumerate(own)}, key=lambda p: (counts.get(p[1], 0), p[0]))
    return (ranked + [ranked[-1]] * ANCHORS)[:ANCHORS]


def _constant(value: object, kind: str) -> Column:
    """A constant that the optimizer folds into one literal, however large it is."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = MORE) -> DataFrame:
    """Per row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    A template counts where all its mandatory phrases stand at their relative positions; a base template is a phrase, and every
    place of it counts.  ``score`` is the largest share of a found template's words that stand in place, 0 without labels.
    ``templates`` are sought beside the base ones.  An index holds each template's ``ANCHORS`` mandatory words of highest IDF over
    all documents.  A text that has the rarest word of some template looks up where its indexed words stand; a template is a
    candidate where the postings of all its anchors agree on one start, and its phrases are verified there alone.
    Index and templates are literals, so a plan is the same for any number of templates.
    Whole texts are read, twice, and nothing but those counts is shuffled.
    A null or empty text has no words; null keys and repeated rows stay; other columns are not read.
    """
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    every = TEMPLATES + tuple(templates)
    counts = document_counts(words, sorted({w for t in every for _, own in t.keys for w in own}))
    index: dict[str, list[list[int]]] = {}
    for n, template in enumerate(every):
        for rank, (at, word) in enumerate(_anchors(template, counts)):
            index.setdefault(word, [[] for _ in range(ANCHORS)])[rank].append(n * _STRIDE + _MIDDLE - at)
    leading = _constant(sorted((w for w, ranks in index.items() if ranks[0]), key=lambda w: (counts.get(w, 0), w)), "array<string>")
    postings = _constant(index, "map<string,array<array<bigint>>>")
    known = _constant(
        [{"label": t.label, "words": t.words, "keys": [{"at": k, "words": own} for k, own in t.keys]} for t in every],
        "array<struct<label:string,words:array<string>,keys:array<struct<at:int,words:array<string>>>>>",
    )

    stands = F.filter(F.transform("words", lambda w, i: F.when(w.isin(list(index)), F.struct(w.alias("word"), i.alias("at")))), lambda p: p.isNotNull())
    none = F.array().cast("array<struct<word:string,at:int>>")
    looked = words.withColumn("own", F.when(F.arrays_overlap("words", leading), stands).otherwise(none))

    def starts(rank: int) -> Column:
        """Where the templates start that have an anchor of this rank at a looked-up place."""
        return F.flatten(F.transform("own", lambda h: F.transform(F.get(F.element_at(postings, h["word"]), F.lit(rank)), lambda o: o + h["at"])))

    agreed = starts(0)
    for rank in range(1, ANCHORS):
        agreed = F.array_intersect(agreed, starts(rank))
    placed = F.transform(agreed, lambda c: F.struct(F.shiftright(c, 32).cast("int").alias("t"), (F.pmod(c, F.lit(_STRIDE)) - _MIDDLE).cast("int").alias("start")))

    def verified(p: Column) -> Column:
        def phrase(key: Column) -> Column:
            at = p["start"] + key["at"]
            inside = (at >= 0) & (at + F.size(key["words"]) <= F.size("words"))
            return inside & (F.slice("words", F.greatest(at, F.lit(0)) + 1, F.size(key["words"])) == key["words"])

        return F.forall(F.get(known, p["t"])["keys"], phrase)

    def share(p: Column) -> Column:
        text = F.get(known, p["t"])["words"]
        same = F.filter(F.transform(text, lambda w, i: F.coalesce(F.get("words", p["start"] + i) == w, F.lit(False))), lambda x: x)
        return F.size(same).cast("double") / F.size(text)

    def labels(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda p: F.get(known, p["t"])["label"]))), ",")

    found = looked.select("doc_id", "words", F.filter(placed, verified).alias("found"))
    base = F.filter("found", lambda p: p["t"] < len(TEMPLATES))
    at = F.transform(base, lambda p: p["start"])
    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", share)), F.lit(0.0)).alias("score"),
    )
