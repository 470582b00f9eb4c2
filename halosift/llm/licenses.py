r"""License scan: fixed phrases, and an exact containment join with license notices.

Base: the places where a phrase's words stand one after another. Method: a text
block is any run of consecutive words, over line breaks, of at most ``SPAN``
percent of a notice's own number of words; the notice is found if some such run
holds at least ``PERCENT`` of its distinct words. So wrapped and commented notices are
found, and words scattered over a longer stretch are not.

A text is cut into words once. Its runs are grouped in cells of ``CELL`` words,
each with as many of the words behind it as the longest run needs, so every run
is whole in the cell it begins in. Only words of notices matter for a join of cells
and notices; they are set in global order, the rarest of all cells first. By the
prefix filter a cell that reaches the threshold c shares one of the first
|notice| - c + 1 words of the notice, among its own first |cell| - c + 1, and
the first word they share is such a one. The length filter asks |cell| >= c, the
positional filter that enough words are left behind the shared one on both sides.
What passes is compared in full, and then run by run, so the result is exact. All
of it stays in the row of the cell; only what was found is shuffled.

The notices are a fixed list, so what is broadcast (their words) is bounded. The
length of a text sets the number of its cells, and a cell is bounded, so work
grows in proportion to the words, also in very long texts.

Null and empty texts have no words and no blocks. Repeated words count once in
a block. Equal documents are alike; rows equal in doc_id and text get the same
result, a null doc_id is a value like others. Other columns do not matter to
`report`, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halosift.llm.secrets import keys
from halosift.llm.tables import pin

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # between words of any case
PERCENT, SPAN = 80, 150
CELL = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Label and words of the notices, from the licenses' own texts and their usual statements.
NOTICES = [
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("apache-file", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit-notice", "released under the mit license"),
    ("mit-permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("cc-by-notice", "licensed under cc by nc 4 0"),
    ("cc-by-work", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


def notices() -> list[tuple[str, list[str], int, int]]:
    """Label, distinct words, the number of them that a run must hold, and the most words of a run."""
    out = []
    for label, text in NOTICES:
        words = sorted(set(text.split()))
        out.append((label, words, -(-PERCENT * len(words) // 100), -(-SPAN * len(text.split()) // 100)))
    return out


def cells(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, cell, n_words, hits) of cells 0, 1, ... of every text; hits are (at, w) of known words."""
    known = notices()
    vocabulary = sorted({w for _, words, _, _ in known for w in words} | {w for p, _ in PHRASES for w in p.split()})
    reach = max(span for *_, span in known) - 1  # words behind the cell that a run may need
    assert reach >= max(len(p.split()) for p, _ in PHRASES) - 1
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), GAP), "")  # as written: only known words are lower-cased
    cut = docs.select("doc_id", *keys(), words.alias("words"))
    cut = cut.select("doc_id", "k1", "k2", "words", F.size("words").alias("n"))

    def own(k: Column) -> Column:
        last = F.least(k * CELL + CELL + reach, F.col("n")) - 1
        # `lower` also turns some other letters into a-z; what it lets through is looked at again
        places = F.filter(F.sequence(k * CELL, last), lambda i: F.lower(F.get("words", i)).isin(*vocabulary))
        found = F.transform(places, lambda i: F.struct(i.alias("at"), F.translate(F.get("words", i), UPPER, LOWER).alias("w")))
        return F.filter(found, lambda x: x["w"].isin(*vocabulary))

    first = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CELL).cast("int"))
    hits = F.when(F.col("n") > 0, F.transform(first, own)).otherwise(F.array(F.array().cast("array<struct<at:int,w:string>>")))
    return cut.select("doc_id", "k1", "k2", F.col("n").cast("long").alias("n_words"), F.posexplode(hits).alias("cell", "hits"))


def phrase_places(parts: DataFrame) -> DataFrame:
    """(k1, k2, at, label) of all phrases in cells; at is the place of the first word."""
    def stands(x: Column, j: Column, phrase: str) -> Column:
        first, *others = phrase.split()
        here = x["w"] == first
        for k, word in enumerate(others, 1):
            then = F.get("hits", j + k)
            here = here & (then["w"] == word) & (then["at"] == x["at"] + k)
        return here

    def label(x: Column, j: Column) -> Column:
        return F.coalesce(*[F.when(stands(x, j, phrase), F.lit(name)) for phrase, name in PHRASES])

    placed = F.transform("hits", lambda x, j: F.struct(x["at"].alias("at"), label(x, j).alias("label")))
    begins = F.filter(placed, lambda x: x["label"].isNotNull() & (x["at"] < (F.col("cell") + 1) * CELL))
    found = parts.select("k1", "k2", F.explode(begins).alias("x"))
    return found.select("k1", "k2", F.col("x.at").cast("long").alias("at"), "x.label").distinct()


def notice_blocks(parts: DataFrame) -> DataFrame:
    """(k1, k2, label, share) of notices in cells; share is that of the best run of the cell."""
    known = notices()
    vocabulary = sorted({w for _, words, _, _ in known for w in words})
    least = min(c for _, _, c, _ in known)
    own = F.array_intersect(F.col("hits.w"), F.array(*map(F.lit, vocabulary)))
    blocks = parts.select("k1", "k2", "hits", own.alias("own")).filter(F.size("own") >= least)
    counts = {r["w"]: r["n"] for r in blocks.select(F.explode("own").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # words of notices
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    place = {w: k for k, w in enumerate(order)}
    prefix = []
    for label, words, c, span in known:
        ranked = sorted(words, key=place.get)
        prefix += [(ranked[i], label, i, c, span, ranked) for i in range(len(ranked) - c + 1)]
    index = parts.sparkSession.createDataFrame(prefix, "w string, label string, i int, c int, span int, notice array<string>")
    ordered = blocks.select("k1", "k2", "hits", F.array_intersect(F.array(*map(F.lit, order)), F.col("own")).alias("own"))
    heads = F.array_intersect(F.slice("own", F.lit(1), F.size("own") - least + 1), F.array(*map(F.lit, sorted({w for w, *_ in prefix}))))
    met = ordered.select("k1", "k2", "hits", "own", F.explode(heads).alias("w")).join(F.broadcast(index), "w")
    left = F.size("own") - F.array_position("own", F.col("w"))  # own words behind the shared one
    met = met.filter((F.size("own") >= F.col("c")) & (left >= F.col("c") - 1) & (F.size("notice") - F.col("i") >= F.col("c")))
    both = F.array_intersect("own", "notice")
    met = met.filter((F.size(both) >= F.col("c")) & (F.get(both, F.lit(0)) == F.col("w")))  # once, at the first shared word
    met = met.withColumn("hits", F.filter("hits", lambda x: F.array_contains("notice", x["w"])))

    def held(x: Column) -> Column:
        run = F.filter("hits", lambda y: (y["at"] >= x["at"]) & (y["at"] < x["at"] + F.col("span")))
        return F.size(F.array_distinct(F.transform(run, lambda y: y["w"])))

    best = met.select("k1", "k2", "label", "c", F.size("notice").alias("size"), F.array_max(F.transform("hits", held)).alias("best"))
    return best.filter("best >= c").select("k1", "k2", "label", (F.col("best") / F.col("size")).alias("share"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document, see the module's text; score is the best share of a notice, 0.5 at least with a phrase."""
    parts = pin(cells(docs.select("doc_id", "text")))  # places of known words, not texts
    places = phrase_places(parts).groupBy("k1", "k2").agg(
        F.count("*").alias("n_base"), F.min("at").alias("first_word"), F.max("at").alias("last_word"), F.collect_set("label").alias("base"))
    notes = notice_blocks(parts).groupBy("k1", "k2").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    both = places.join(notes, ["k1", "k2"], "full")
    rows = parts.filter("cell = 0").select("doc_id", "k1", "k2", "n_words")
    none = F.array().cast("array<string>")
    base, more = F.coalesce("base", none), F.coalesce("more", none)
    return rows.join(both, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.concat_ws(",", F.array_sort(base)).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base, more))).alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"))
