"""License scans: a positional index of rare licence words finds templates at a consistent position, then key phrases decide."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.llm.common import PLAIN_WORD, ascii_lower, let, words_of
from presslake.session import staged

# Phrases that settle a label wherever they stand.
BASE_PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}


class Template(NamedTuple):
    label: str
    text: str
    key_phrase: str


# Notices and texts of well-known licences as they are published, each with the phrase that must stand in it.
TEMPLATES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "any person obtaining a copy of this software"),
    Template("mit", """
        the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or
        sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the
        above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software
        is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
        fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages
        or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use
        or other dealings in the software""", "merge publish distribute sublicense and or sell copies of the software"),
    Template("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license version 2"),
    Template("apache-2", """
        you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses
        license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is
        basis without warranties or conditions of any kind either express or implied see the license for the specific language governing
        permissions and limitations under the license""", "www apache org licenses license 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    Template("bsd", """
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission this
        software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to
        the implied warranties of merchantability and fitness for a particular purpose are disclaimed""", "redistributions in binary form must reproduce the above copyright notice"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    Template("isc", """
        with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the
        software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any
        damages whatsoever resulting from loss of use data or profits""", "the author disclaims all warranties with regard to this software"),
    Template("zlib", """
        this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
        arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
        applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be
        misrepresented you must not claim that you wrote the original software""", "the origin of this software must not be misrepresented"),
    Template("boost-1", """
        permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative
        works of the software""", "use reproduce display distribute execute and transmit the software"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-3", """
        this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by
        the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope
        that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
        see the gnu general public license for more details""", "gnu general public license as published by the free software foundation either version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-2", """
        this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by
        the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope
        that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
        see the gnu general public license for more details""", "gnu general public license as published by the free software foundation either version 2"),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    Template("agpl-3", """
        this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as
        published by the free software foundation either version 3 of the license or at your option any later version""",
             "gnu affero general public license as published by the free software foundation either version 3"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("mpl-2", """
        this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
        file you can obtain one at http mozilla org mpl 2 0""", "source code form is subject to the terms of the mozilla public license"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "public domain dedication"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template("unlicense", """
        anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for
        any purpose commercial or non commercial and by any means""", "source code form or as a compiled binary for any purpose"),
    Template("proprietary", "all rights reserved", "all rights reserved"),
]
#: Highest-IDF licence words of a file that are looked up, besides the rarest word of each key phrase.
TOP_WORDS = 8
#: Share of a template's words that must stand at their places.
LEAST_SHARE = 0.5
#: Words by which a word may have moved from its place relative to the key phrase, as others were put in or left out between.
TOLERANCE = 4


def _vocabulary(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()})


def _first(template: Template) -> int:
    """Offset of the key phrase in its template."""
    parts, key = template.text.split(), template.key_phrase.split()
    return next(i for i in range(len(parts)) if parts[i:i + len(key)] == key)


def _at(word: Column, i: Column) -> Column:
    return F.struct(word.alias("word"), i.alias("at"))


def _rarest(phrase: str, idf: dict[str, float]) -> str:
    """The word of a phrase with the highest IDF; words that no document holds come first."""
    return min(phrase.split(), key=lambda w: (-idf.get(w, math.inf), w))


def _standing(words: Column, hits: Column, asked: list[tuple[str, Column, int]], idf: dict[str, float]) -> Column:
    """array<struct<what, at>>: where the phrases of `asked` (phrase, what, words before it) stand; `hits` are the places (word, at) of rarest words."""
    def row(phrase: str, what: Column, before: int) -> Column:
        rare, parts = _rarest(phrase, idf), phrase.split()
        behind = parts.index(rare)
        return F.struct(F.lit(rare).alias("rare"), F.lit(behind).alias("behind"), F.array(*[F.lit(w) for w in parts]).alias("parts"),
                        what.alias("what"), F.lit(behind + before).alias("shift"))

    table = F.array(*[row(*one) for one in asked])

    def at_hit(hit: Column) -> Column:
        def stands(r: Column) -> Column:
            near = (r["rare"] == hit["word"]) & (hit["at"] >= r["behind"])
            return F.when(near, F.slice(words, hit["at"] - r["behind"] + 1, F.size(r["parts"])) == r["parts"]).otherwise(False)

        return F.transform(F.filter(table, stands), lambda r: F.struct(r["what"].alias("what"), (hit["at"] - r["shift"]).alias("at")))

    return F.flatten(F.transform(hits, at_hit))


def word_idf(docs: DataFrame, templates: list[Template] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES) -> dict[str, float]:
    """IDF of each word of the licences and phrases over all whole texts; at most as many numbers as these have words."""
    asked = F.array(*[F.lit(w) for w in sorted({*_vocabulary(templates), *(w for p in phrases.values() for w in p.split())})])
    words = words_of(ascii_lower(F.col("text")), PLAIN_WORD)
    # A document counts once under null and once under each word that it holds.
    held = docs.select(F.explode(F.array_append(F.array_intersect(asked, words), F.lit(None).cast("string"))).alias("word"))
    counts = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    n = counts.pop(None, 0)
    return {w: math.log((1 + n) / (1 + c)) for w, c in counts.items()}


def read_words(docs: DataFrame, idf: dict[str, float], templates: list[Template] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """The texts as the scan needs them, written down: doc_id, row_key, n_words, places (of base phrases), keys, found.

    Phrases are looked for around their rarest words only. `keys` are the (template, start) whose key phrase stands in full, and `found`
    holds the position of each licence word, for texts with such a key; no template can match the others, and their words stay where they are.
    """
    vocabulary = F.array(*[F.lit(w) for w in _vocabulary(templates)])
    signs = F.array(*[F.lit(w) for w in sorted({_rarest(p, idf) for p in [*phrases.values(), *(t.key_phrase for t in templates)]})])

    def read(words: Column) -> Column:
        return let(F.filter(F.transform(words, _at), lambda x: F.array_contains(signs, x["word"])), lambda hits: around(words, hits))

    def around(words: Column, hits: Column) -> Column:
        places = _standing(words, hits, [(phrase, F.lit(label), 0) for label, phrase in phrases.items()], idf)
        keys = _standing(words, hits, [(t.key_phrase, F.lit(k), _first(t)) for k, t in enumerate(templates)], idf)
        return F.struct(F.size(words).cast("long").alias("n_words"), places.cast("array<struct<label:string,at:int>>").alias("places"),
                        keys.cast("array<struct<template:int,start:int>>").alias("keys"), words.alias("words"))

    words = words_of(ascii_lower(F.col("text")), PLAIN_WORD)
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), let(words, read).alias("_read"))
    licence = F.filter(F.transform("_read.words", _at), lambda x: F.array_contains(vocabulary, x["word"]))
    found = F.when(F.size("_read.keys") > 0, licence).otherwise(F.array().cast("array<struct<word:string,at:int>>"))
    return staged(rows.select("doc_id", "row_key", "_read.n_words", "_read.places", "_read.keys", found.alias("found")))


def template_matches(read: DataFrame, idf: dict[str, float], templates: list[Template] = TEMPLATES, top_words: int = TOP_WORDS,
                     least_share: float = LEAST_SHARE, tolerance: int = TOLERANCE) -> DataFrame:
    """(doc_id, row_key, label, at, share): templates that begin at position `at`, with the share of their words in place.

    The `top_words` licence words of highest IDF in a file, and the rarest word of each key phrase, are looked up in the
    postings (word, template, offset). Each pair of a file position and a posting votes for the relative position where the
    template would begin. At positions with votes the mandatory key phrase must stand in full; as its rarest word always
    votes, no template is missed, however common its words are. The other words are in place up to `tolerance` words
    before or after the place that the key phrase gives them, so put-in or left-out words do not end a match.
    """
    ranked = sorted(idf, key=lambda w: (-idf[w], w))
    licence_words = F.array(*[F.lit(w) for w in ranked]).cast("array<string>")
    always = F.array(*[F.lit(w) for w in sorted({_rarest(t.key_phrase, idf) for t in templates})])
    spark = read.sparkSession
    postings = F.broadcast(spark.createDataFrame(  # as many rows as the templates have words
        [(w, k, i) for k, t in enumerate(templates) for i, w in enumerate(t.text.split())], "word string, template int, offset int"))
    in_file = F.transform("found", lambda x: x["word"])
    top = F.array_union(F.slice(F.array_intersect(licence_words, in_file), 1, top_words), F.array_intersect(always, in_file))
    present = read.where(F.size("keys") > 0).select("doc_id", "row_key", "found")
    looked = present.select("doc_id", "row_key", let(top, lambda t: F.filter("found", lambda x: F.array_contains(t, x["word"]))).alias("found"))

    def met(rows: DataFrame) -> DataFrame:
        each = rows.select("doc_id", "row_key", F.explode("found").alias("x")).select("doc_id", "row_key", "x.word", "x.at")
        return each.join(postings, "word").select("doc_id", "row_key", "template", (F.col("at") - F.col("offset")).alias("start"), "offset")

    votes = met(looked).select("doc_id", "row_key", "template", "start")
    # Every word of the file that a template has: the postings of all words.
    placed = met(present)

    def equal(names: list[str]) -> Column:
        test = F.col("p.doc_id").eqNullSafe(F.col("v.doc_id"))
        for name in names:
            test = test & (F.col(f"p.{name}") == F.col(f"v.{name}"))
        return test

    keys = read.select("doc_id", "row_key", F.explode("keys").alias("x")).select("doc_id", "row_key", "x.*").distinct()
    whole = keys.alias("p").join(votes.alias("v"), equal(["row_key", "template", "start"]), "left_semi")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("template"))
    # Neighbouring starts meet by an equi-join of ranges: those of the anchor, and the ones before and after.
    width = max(1, tolerance)
    near = whole.select("doc_id", "row_key", "template", F.col("start").alias("anchor"), F.explode(
        F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.floor(F.col("start") / width) + k)).alias("range"))
    ranged = placed.withColumn("range", F.floor(F.col("start") / width))
    close = ranged.alias("p").join(near.alias("v"), equal(["row_key", "template", "range"]) & (F.abs(F.col("p.start") - F.col("v.anchor")) <= tolerance))
    shares = close.groupBy("p.doc_id", "p.row_key", "p.template", "v.anchor").agg(F.size(F.collect_set("p.offset")).alias("in_place"))
    share = F.col("in_place") / pick([float(len(t.text.split())) for t in templates])
    return shares.where(share >= least_share).select("doc_id", "row_key", pick([t.label for t in templates]).alias("label"), F.col("anchor").alias("at"), share.alias("share"))


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES, **settings) -> DataFrame:
    """Per document: doc_id, n_words, places, base_labels, matches (label, at, share), labels, score.

    `places` are all places of the base phrases (word numbers from 0), `base_labels` their labels; `labels` adds those of
    verified templates. `score` is 1 with a base label, else the largest share of a matched template, else 0. Label
    arrays are distinct and sorted. Null and empty texts have no words, no labels and score 0. Repeated rows
    get equal results, once per row. Other columns are not read. The texts are read twice: for the IDF, then for phrases and
    the words of texts that hold one.
    """
    idf = word_idf(docs, templates, phrases)
    read = read_words(docs, idf, templates, phrases)
    matches = template_matches(read, idf, templates, **settings).groupBy(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key")).agg(
        F.sort_array(F.collect_set(F.struct("label", "at", "share"))).alias("matches"))
    joined = read.join(matches, read["doc_id"].eqNullSafe(matches["_doc"]) & (read["row_key"] == matches["_key"]), "left")
    none = F.array().cast("array<struct<label:string,at:int,share:double>>")
    told = joined.select("doc_id", "n_words", "places", F.coalesce("matches", none).alias("matches"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    more = F.transform("matches", lambda m: m["label"])
    told = told.withColumn("base_labels", base).withColumn("labels", F.array_sort(F.array_union("base_labels", more)))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return told.withColumn("score", F.when(F.size("base_labels") > 0, F.lit(1.0)).otherwise(best))
