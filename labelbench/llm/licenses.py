"""Licence scan: base phrases, and a positional index of the licences' words.

All of it is DataFrame functions.  A text's words are those of its lower-cased form.

*Base.*  Places where the words of a phrase stand one after the other.

*Index.*  Every licence template is a list of words; its postings are (word, template, position).  The
inverse document frequency of the templates' words is counted over all documents.  Words are ranked
by it and none is left out for being frequent, so a licence that stands in every document is found as
well.  A template is found where words that agree on a relative position weigh (by IDF) at least ``SHARE`` of the
template's own ``LOOKED_UP`` rarest words, and one of its mandatory key phrases stands in the text.  The steps:

1. *Rare words.*  Of a template's words by falling IDF, those after the first p cannot reach ``SHARE`` by any
   ``LOOKED_UP`` of them, for the smallest such p (``rare_words``): whatever is found has one of the first p.  A document's
   rare words are looked up in the postings and name its candidate templates.
2. *Bound.*  A candidate is looked up by the ``LOOKED_UP`` rarest of its words that the document has, whatever other
   licences the text holds; it goes if these weigh too little together.
3. *Relative positions.*  A posting and a place in the document vote for the template at a relative position; the
   votes that agree in (template, relative position) are the intersected postings.
4. *Key phrases* are verified last, on the templates that are left, in the texts kept for them.

Steps 1 and 2 lose nothing, so they change no result.

Defined cases: null and empty texts have no words, labels are empty strings and the score 0;
repeated rows get the same result each, null ids stay null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut_lineage

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label, words of the licence's notice, and its mandatory key phrases (one must stand in the document).
TEMPLATES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0", "creative commons attribution 3 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0 1 0 universal", ["cc0 1 0", "waived all copyright and related or neighboring rights"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]

#: Words looked up; least share of their weight.
LOOKED_UP, SHARE = 8, 0.6
#: What sums of doubles may be off; bounds are that much looser.
SLACK = 1e-6
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the lower-cased text.  Lower case beyond A-Z changes neither the words' bounds nor
    their number; the one sign outside A-Z that turns into a plain letter is the Kelvin sign, a k,
    which no base phrase holds."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD), "")


def places(found: Column, phrase: str) -> Column:
    """Starts of the phrase's words in the array of words, counted from 0."""
    parts = phrase.split(" ")

    def at(i):
        same = F.get(found, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(found, i + k) == part)
        return same

    none = F.array().cast("array<int>")
    there = F.size(found) >= len(parts)
    for part in dict.fromkeys(parts):
        there = there & F.array_contains(found, part)
    return F.when(there, F.filter(F.sequence(F.lit(0), F.size(found) - len(parts)), at)).otherwise(none)


def inverse_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """IDF of every template word over all documents; at least 1, however many documents have the word."""
    vocabulary = sorted({w for _, t, _ in templates for w in t.split(" ")})
    lit = F.array(*map(F.lit, vocabulary))
    there = docs.select(F.explode(F.array_append(F.array_intersect(words(F.col("text")), lit), F.lit(""))).alias("word"))
    counts = {r.word: r.n for r in there.groupBy("word").agg(F.count("*").alias("n")).collect()}
    n = counts.get("", 0)  # one empty word for each document
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary}


def by_rarity(text: str, idf: dict[str, float]) -> list[str]:
    """The different words of a template, highest IDF first."""
    return sorted(set(text.split(" ")), key=lambda w: (-idf[w], w))


def rare_words(text: str, idf: dict[str, float]) -> list[str]:
    """The shortest beginning of ``by_rarity`` without which no ``LOOKED_UP`` words weigh ``SHARE`` of the template."""
    ranked = by_rarity(text, idf)
    weigh = lambda first: sum(idf[w] for w in ranked[first:first + LOOKED_UP])
    return ranked[:next(p for p in range(1, len(ranked) + 1) if weigh(p) < SHARE * weigh(0) - SLACK)]


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row for each row of ``docs``.
    ``templates`` lists (label, words of the notice, key phrases) as ``TEMPLATES`` does."""
    spark = docs.sparkSession
    idf = inverse_frequencies(docs, templates)
    ranked = [by_rarity(text, idf) for _, text, _ in templates]
    total = [sum(idf[w] for w in own[:LOOKED_UP]) for own in ranked]
    named: dict[str, list[int]] = {}
    for t, (_, text, _) in enumerate(templates):
        for word in rare_words(text, idf):
            named.setdefault(word, []).append(t)

    strings = lambda xs: F.array(*map(F.lit, xs))
    weight = F.create_map(*[F.lit(x) for item in idf.items() for x in item])
    posted = F.create_map(*[x for word, ts in named.items() for x in (F.lit(word), F.array(*map(F.lit, ts)))])
    words_of, whole = F.array(*map(strings, ranked)), F.array(*map(F.lit, total))

    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    split = docs.select(doc_id, F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    w = F.col("w")
    split = split.select("*", F.array_intersect(strings(sorted(idf)), w).alias("known"), *[places(w, p).alias(f"b{k}") for k, p in enumerate(BASE)])
    rare = F.array_intersect(strings(sorted(named)), F.col("known"))
    split = split.select("*", F.array_distinct(F.flatten(F.transform(rare, lambda x: F.element_at(posted, x)))).alias("candidates"))
    # the template's words go first, so that the rarest words are the first of the intersection
    looked_up = F.transform("candidates", lambda t: F.struct(
        t.alias("template"), F.slice(F.array_intersect(F.element_at(words_of, t + 1), F.col("known")), 1, LOOKED_UP).alias("rarest")))
    heavy = F.filter(looked_up, lambda k: F.aggregate(k["rarest"], F.lit(0.0), lambda s, x: s + F.element_at(weight, x))
                     >= F.element_at(whole, k["template"] + 1) * SHARE - SLACK)
    split = split.select("*", heavy.alias("keys"))
    split = split.select("*", F.array_distinct(F.flatten("keys.rarest")).alias("wanted"))
    found_at = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(F.col("wanted"), x), F.struct(x.alias("word"), i.alias("at")))), lambda x: x.isNotNull())
    empty = F.array().cast("array<struct<word:string,at:int>>")
    some = F.size("wanted") > 0
    table = cut_lineage(split.select(
        "doc_id", "h", F.size(w).cast("long").alias("n_words"), *[f"b{k}" for k in range(len(BASE))], "keys",
        F.when(some, found_at).otherwise(empty).alias("places"),
        F.when(some, F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))).alias("line")))

    # votes: one row for each looked-up word's place, template and relative position
    votes = table.where(F.size("keys") > 0).select("doc_id", "h", "places", F.explode("keys").alias("k"))
    votes = votes.select("doc_id", "h", "k.template", F.explode(F.filter("places", lambda p: F.array_contains(F.col("k.rarest"), p["word"]))).alias("p"))
    postings = [(t, word, p, idf[word]) for t, (_, text, _) in enumerate(templates) for p, word in enumerate(text.split(" "))]
    index = spark.createDataFrame(postings, "template int, word string, pos int, weight double")
    agreed = votes.select("doc_id", "h", "template", "p.word", "p.at").join(F.broadcast(index), ["template", "word"])
    # a word that a template repeats counts once at one relative position
    once = agreed.groupBy("doc_id", "h", "template", (F.col("at") - F.col("pos")).alias("shift"), "word").agg(F.max("weight").alias("weight"))
    sums = once.groupBy("doc_id", "h", "template", "shift").agg(F.sum(F.floor(F.col("weight") * 2**40).cast("long")).alias("weight"))
    share = F.least(F.lit(1.0), F.col("weight") / 2**40 / F.element_at(whole, F.col("template") + 1))
    found = sums.select("doc_id", "h", "template", share.alias("share")).where(F.col("share") >= SHARE)
    found = found.groupBy("doc_id", "h", "template").agg(F.max("share").alias("share"))  # a notice may stand many times
    found = found.groupBy(F.col("doc_id").alias("fd"), F.col("h").alias("fh")).agg(F.collect_list(F.struct("template", "share")).alias("agreed"))

    joined = table.join(found, F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("h") == F.col("fh")), "left")
    phrases = F.array(*[strings([f" {p} " for p in ps]) for _, _, ps in templates])
    verified = F.filter("agreed", lambda a: F.exists(F.element_at(phrases, a["template"] + 1), lambda p: F.contains(F.col("line"), p)))
    joined = joined.withColumn("sure", F.coalesce(verified, F.array().cast("array<struct<template:int,share:double>>")))
    more = F.transform("sure", lambda a: F.element_at(strings([t[0] for t in templates]), a["template"] + 1))
    starts = F.concat(*[F.col(f"b{k}") for k in range(len(BASE))])
    base = F.array_compact(F.array(*[F.when(F.size(f"b{k}") > 0, F.lit(v)) for k, v in enumerate(BASE.values())]))
    return joined.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("sure.share"), F.lit(0.0))).alias("score"))
