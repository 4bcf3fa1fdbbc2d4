"""License scan by a positional index of rare tokens.

Each text's licence words (words of the templates that aren't common ones) are
found with their places.  How many documents hold each word is counted over all
documents; a template is indexed under its words of highest inverse document
frequency, each with its position in the template, one of the key phrase among
them.  A text's licence words are looked up, and each posting tells where its
template would begin; these starts are intersected: a start counts where `agree`
postings or more say the same and the template's key phrase stands there word
for word.  The score is the largest share of a template's words that stand at
their places.  Templates may be of any length, and starts before a text's first
word are starts like others.

Three base phrases are found exactly, by their rarest word and its neighbours.

Cases: a null or empty text has no words, no places, empty labels and score 0;
null ids stay; repeated rows are scanned each; an empty table gives no rows;
other columns are not read.  Letters A to Z are lower-cased and no others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import written

#: A word in a text whose letters A to Z count as a to z.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The base phrases, their labels, and the word of each by which it is found.
BASE = (("cc by", "cc-by", "cc"), ("general public license", "gpl", "general"), ("all rights reserved", "reserved", "reserved"))
#: Too common to be looked up.
COMMON = frozenset("a and any are by for form from in is it may not of or the this to use used with without you version work released under 0 1 2 3 4 all new file free".split())


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        key = self.key.split()
        return next(k for k in range(len(self.words)) if self.words[k : k + len(key)] == key)


#: Notices by which well-known licences are named; the key phrase must stand whole.
TEMPLATES = (
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistribution and use in source and binary forms"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template("epl-2.0", "under the terms of the eclipse public license v 2 0", "eclipse public license"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "redistribute it and or modify it under the terms of the gnu general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "permission is hereby granted free of charge to any person obtaining a copy"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    Template("proprietary", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", "unauthorized copying of this file"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "free and unencumbered software"),
)


def lowered(word: Column) -> Column:
    return F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def licence_words(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words if w not in COMMON} | {x[2] for x in BASE})


def occurrences(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """row, id, words, and hits: each licence word w with its place p, in order."""
    d = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(TOKEN), F.lit(0)).alias("words"))
    words = F.col("words")
    # F.lower is quick but also lowers letters beyond A to Z; lowered() settles the few words found
    places = F.filter(F.transform(words, lambda w, i: F.when(F.lower(w).isin(vocabulary), i)), lambda i: i.isNotNull())
    d = d.select("id", "words", places.alias("places"))
    hit = lambda i: F.struct(lowered(F.get(F.col("words"), i)).alias("w"), i.alias("p"))
    return d.select(F.monotonically_increasing_id().alias("row"), "id", "words", F.filter(F.transform("places", hit), lambda h: h["w"].isin(vocabulary)).alias("hits"))


def stands(at: Column, phrase: list[str]) -> Column:
    """The phrase's words are those of `words` from place `at` (from 0) on; asked word by word, so that no other word is touched."""
    return reduce(lambda a, b: a & b, [F.coalesce(lowered(F.get("words", at + k)) == w, F.lit(False)) for k, w in enumerate(phrase)])


def may_hold_a_key(templates: tuple[Template, ...]) -> Column:
    """Of a row with hits: two licence words that follow each other in a key phrase do so here, or there is the only one of a phrase. No text with a key phrase is without."""
    pairs, alone = set(), set()
    for t in templates:
        at = [(k, w) for k, w in enumerate(t.key.split()) if w not in COMMON]
        pairs |= {f"{v} {j - i} {w}" for (i, v), (j, w) in zip(at, at[1:], strict=False)}
        alone |= {at[0][1]} if len(at) == 1 else set()
    after = lambda i: F.get("hits", i + 1)
    key = lambda h, i: F.concat_ws(" ", h["w"], (after(i)["p"] - h["p"]).cast("string"), after(i)["w"])
    follows = F.exists(F.transform("hits", key), lambda x: x.isin(sorted(pairs)))
    return follows | F.exists("hits", lambda h: h["w"].isin(sorted(alone))) if alone else follows


def base(found: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """found with n_words, n_base, first_word, last_word and base_labels (an array); the words stay where a key phrase may be."""
    def places(phrase: str, anchor: str) -> Column:
        words = phrase.split()
        k = words.index(anchor)
        return F.transform(F.filter("hits", lambda h: (h["w"] == anchor) & stands(h["p"] - k, words)), lambda h: h["p"] - k)

    starts = [(places(phrase, anchor), label) for phrase, label, anchor in BASE]
    found = found.withColumn("starts", F.concat(*[s for s, _ in starts])).withColumn("labels", F.filter(F.array(*[F.when(F.size(s) > 0, F.lit(x)) for s, x in starts]), lambda x: x.isNotNull()))
    return found.select(
        "row", "id", F.size("words").cast("long").alias("n_words"), "hits", F.when(may_hold_a_key(templates), F.transform("words", lowered)).alias("words"),
        F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"), F.col("labels").alias("base_labels"),
    )


def rare_words(hits: DataFrame, templates: tuple[Template, ...], most: int) -> list[tuple[int, int, str]]:
    """(template, position, word) of each template's `most` words that the fewest documents hold; always one of the key phrase."""
    counts = hits.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).groupBy("w").count()
    held = dict(counts.collect())  # at most a row for each word of the templates
    out = []
    for t, template in enumerate(templates):
        known = sorted((held.get(w, 0), k, w) for k, w in enumerate(template.words) if w not in COMMON)
        span = range(template.key_at, template.key_at + len(template.key.split()))
        first = next(x for x in known if x[1] in span)
        out += [(t, k, w) for _, k, w in [first, *[x for x in known if x != first][: most - 1]]]
    return out


def starts_of(postings: list[tuple[int, int, str]], agree: int) -> tuple[Column, Column]:
    """Of a row with hits each start (template t, start) that a posting (template, position, word) tells, in order; and by template how many must agree: `agree`, or all postings of a template that has fewer."""
    by_word: dict[str, list[tuple[int, int]]] = {}
    for t, k, w in postings:
        by_word.setdefault(w, []).append((t, k))
    index = F.create_map(*[x for w, found in sorted(by_word.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, k in found]))])
    none = F.array().cast("array<struct<t:int,k:int>>")
    starts = F.flatten(F.transform("hits", lambda h: F.transform(F.coalesce(F.element_at(index, h["w"]), none), lambda x: F.struct(x["t"].alias("t"), (h["p"] - x["k"]).alias("start")))))
    of = [sum(t == k for t, _, _ in postings) for k in range(1 + max(t for t, _, _ in postings))]
    need = F.array(*[F.lit(min(agree, n)) for n in of])
    # equal starts stand together in order, and each posting says each start once at most
    return F.array_sort(starts), need


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, most: int = 64, agree: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels and score of each text."""
    found = written(base(occurrences(docs, licence_words(templates), id_col, text_col), templates), "licences")
    some = found.where("words is not null")
    starts, need = starts_of(rare_words(found.where(F.size("hits") > 0), templates, most), agree)
    # a table, so that the starts of a text are made once and not again in each expression that asks for them
    held = written(some.select("row", "words", starts.alias("starts")), "starts")
    same = lambda x, i: (F.get("starts", i) == x)
    agreed = F.filter("starts", lambda x, i: same(x, i + F.get(need, x["t"]) - 1) & ~F.coalesce(same(x, i - 1), F.lit(False)))
    held = held.select("row", "words", agreed.alias("starts"))
    words = F.array(*[F.array(*[F.lit(w) for w in t.words]) for t in templates])
    checked = reduce(lambda c, t: c.when(F.col("x.t") == t[0], stands(F.col("x.start") + t[1].key_at, t[1].key.split())), enumerate(templates), F.when(F.lit(False), F.lit(False)))
    at = F.col("x.start")
    share = F.size(F.filter(F.get(words, F.col("x.t")), lambda w, k: F.when(at + k >= 0, F.get("words", at + k) == w))) / F.size(F.get(words, F.col("x.t")))
    labels = F.array(*[F.lit(t.label) for t in templates])
    met = held.select("row", "words", F.explode("starts").alias("x")).where(checked).select("row", F.get(labels, F.col("x.t")).alias("label"), share.alias("share"))
    by_row = met.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    none = F.array().cast("array<string>")
    with_more = some.join(by_row, "row", "left").unionByName(found.where("words is null"), allowMissingColumns=True)
    return with_more.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
