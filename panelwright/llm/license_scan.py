"""License scans by diagonal voting, in DataFrame operations alone.

Templates and texts are cut to rolling word k-grams. A hash join of the k-grams gives (text position,
template position) hits; hits of one copy share their offset, the diagonal. Hits are counted by
diagonal, diagonals that a small insertion or deletion has shifted apart are merged, and the span that
they mark is verified word by word against the template.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

# Phrases and labels of the contract.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Characteristic wordings of licenses, with the label that each gives, words that every copy holds, and words that no copy holds.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0", "apache", ""),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "", ""),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "", ""),
    ("mit", "released under the mit license", "mit", ""),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu", "lesser library affero"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu", "lesser library affero"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser", "affero"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "", ""),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla", ""),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "attribution", "noncommercial sharealike noderivatives noderivs"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "attribution", "noncommercial sharealike noderivatives noderivs"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "nc", "sa nd"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial", "noncommercial", "sharealike noderivatives noderivs"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike", "sharealike", "noncommercial"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "", ""),
    ("proprietary", "all rights reserved no part of this publication may be reproduced", "", ""),
)
GRAM = 3
#: Neighbouring diagonals at most so far apart, or a fifth of the template's words if that is more, belong to one copy.
DIAGONAL_GAP = 3
#: Share of a template's words that its span must hold in order.
COVER = 0.8
#: Words of a template at most, as many as bits of a fold's state; longer wordings are cut to pieces of about equal length.
PIECE = 60
#: Anchor words and k-grams up to which a table of templates is sent along; with more, all texts keep their words and the join shuffles.
ANCHORS, BROADCAST_GRAMS = 1_000, 100_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def spared(size: int) -> int:
    """Words of a template that a copy may lack."""
    return size - math.ceil(COVER * size - 1e-9)


def pieces(templates: tuple) -> list[tuple[str, list[str], list[list[str]], list[str]]]:
    """(label, words, needs, bars) of every template, whole license texts among them: one of more than PIECE words becomes several.

    A needed word is asked of the piece that holds it, and beside a word that stands beside it there: ``needs`` has the pairs of which
    a copy holds one. Barred words are barred from all pieces.
    """
    out = []
    for label, wording, needs, bars in templates:
        found = wording.split()
        n = -(-len(found) // PIECE)
        for k in range(n):
            part = found[k * len(found) // n : (k + 1) * len(found) // n]
            if len(part) >= GRAM:
                pairs = [" ".join(p) for p in zip(part, part[1:])]
                out.append((label, part, [[p for p in pairs if w in p.split()] for w in needs.split() if w in part], bars.split()))
    return out


def _anchors(cut: list) -> list[str]:
    """Words of which every copy and every phrase holds at least one.

    A copy lacks at most ``spared`` words of its template, so one more of them, the longest, can't all be missing.
    """
    found = {max(p.split(), key=len) for p, _ in PHRASES}
    for _, wording, _, _ in cut:
        longest = sorted(wording, key=len, reverse=True)
        found.update(longest[: spared(len(longest)) + 1])
    return sorted(found)


def template_grams(spark: SparkSession, cut: list) -> DataFrame:
    """(template, label, size, places, needs, bars, least_votes, reach, at, gram): all k-grams of the templates.

    Each word that a copy lacks spoils at most k of its k-grams, each word put in between k - 1, which gives the least number of votes for
    as many of either as a copy may lack. ``places`` maps a word to the bits of its places.
    """
    rows = []
    for t, (label, found, needs, bars) in enumerate(cut):
        n = len(found)
        least, reach = max(1, n - GRAM + 1 - (2 * GRAM - 1) * spared(n)), max(DIAGONAL_GAP, n // 5)
        places = {w: sum(1 << i for i, x in enumerate(found) if x == w) for w in found}
        rows += [(t, label, n, places, needs, bars, least, reach, at, found[at : at + GRAM]) for at in range(n - GRAM + 1)]
    shape = "template int, label string, size int, places map<string, bigint>, needs array<array<string>>, bars array<string>, least_votes int, reach int, at int, gram array<string>"
    gram = F.xxhash64(*[F.get("gram", k) for k in range(GRAM)])
    return spark.createDataFrame(rows, shape).withColumn("gram", gram)


def _grams(found: Column) -> Column:
    places = F.sequence(F.lit(0), F.size(found) - GRAM)
    grams = F.transform(places, lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(GRAM)]))
    return F.when(F.size(found) >= GRAM, grams).otherwise(F.array().cast("array<bigint>"))


def _phrase_places(found: Column, phrase: str) -> Column:
    """Places (from 0) where the phrase's words stand consecutively."""
    parts = phrase.split()

    def stands(i: Column) -> Column:
        same = [F.coalesce(F.get(found, i + k) == word, F.lit(False)) for k, word in enumerate(parts)]
        out = same[0]
        for one in same[1:]:
            out = out & one
        return out

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(found) - len(parts), F.lit(0))), stands)


def common_words(span: Column, places: Column, size: Column) -> Column:
    """Length of the longest common subsequence of a span and a template of at most PIECE words.

    The row of the usual table is one number with a bit for each word of the template, 0 where the length grows; a word of the span
    changes it by one addition.
    """
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), size) - 1

    def step(row: Column, word: Column) -> Column:
        met = row.bitwiseAND(F.coalesce(F.element_at(places, word), F.lit(0).cast("bigint")))
        return (row + met).bitwiseOR(row - met).bitwiseAND(full)

    return F.aggregate(span, full, step, lambda row: size - F.bit_count(row))


def license_spans(marked: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """(row, words) -> (row, label, cover): verified copies of the templates in a text.

    A copy holds at least COVER of a template's words in order, one k-gram of it whole, all words that the template
    needs, each beside a neighbour of its, and none that it bars. A text's hits with one template are few unless the text repeats it, and are
    aggregated by diagonal at once; only diagonals, never pairs of hits, are compared. The span of a copy reaches
    from its first diagonal to its last and some words beyond either (``reach``); barred words count between the diagonals.
    """
    cut = pieces(templates)
    grams = template_grams(marked.sparkSession, cut)
    facts = grams.select("template", "label", "size", "places", "needs", "bars", "reach").dropDuplicates(["template"])
    few = sum(len(c[1]) for c in cut) <= BROADCAST_GRAMS
    sent = F.broadcast if few else lambda df: df
    hits = marked.select("row", F.posexplode(_grams(F.col("words"))).alias("place", "gram"))
    hits = hits.join(sent(grams.select("template", "least_votes", "reach", "at", "gram")), "gram")
    of = ["row", "template", "least_votes", "reach"]
    votes = hits.groupBy(*of, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    votes = votes.withColumn("copy", F.sum(F.when(gap <= F.col("reach"), 0).otherwise(1)).over(order))
    copies = votes.groupBy(*of, "copy").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"))
    copies = copies.where(F.col("votes") >= F.col("least_votes")).select("row", "template", "low", "high")
    spans = copies.join(marked, "row").join(sent(facts), "template")
    begin, inner = F.greatest(F.col("low") - F.col("reach"), F.lit(0)), F.greatest(F.col("low"), F.lit(0))
    spans = spans.withColumns({
        "span": F.slice("words", begin + 1, F.col("high") + F.col("size") + F.col("reach") - begin),
        "core": F.slice("words", inner + 1, F.greatest(F.col("high") + F.col("size") - inner, F.lit(0))),
    })
    beside = F.transform(F.sequence(F.lit(1), F.size("span") - 1), lambda k: F.concat_ws(" ", F.get("span", k - 1), F.get("span", k)))
    held = F.forall("needs", lambda pairs: F.arrays_overlap(pairs, beside)) & ~F.arrays_overlap("bars", "core")
    spans = spans.where(held).withColumn("common", common_words(F.col("span"), F.col("places"), F.col("size")))
    return spans.select("row", "label", (F.col("common") / F.col("size")).alias("cover")).where(F.col("common") >= F.ceil(F.col("size") * COVER - 1e-9))


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """documents -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 for a text with a base phrase, else the best cover of a template (0: none). Null and
    empty texts have no words, no labels (empty strings) and null places. Rows that repeat an id are
    scanned each by itself. Very long texts are scanned whole; an empty table gives no rows; other columns
    play no part.
    """
    found = docs.select("doc_id", license_words(F.col("text")).alias("words"))
    anchors = _anchors(pieces(templates))
    marked = F.arrays_overlap("words", F.array(*map(F.lit, anchors))) if len(anchors) <= ANCHORS else F.lit(True)
    rows = found.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.when(marked, F.col("words")).alias("words")
    )
    rows = materialize(rows, "license-rows")
    spans = license_spans(rows.where("words is not null").select("row", "words"), templates)
    by_row = spans.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("cover").alias("cover"))

    none = F.array().cast("array<string>")
    out = rows.select("row", "doc_id", "n_words", *[F.when(F.col("words").isNotNull(), _phrase_places(F.col("words"), p)).alias(f"p{k}") for k, (p, _) in enumerate(PHRASES)])
    sizes = [F.coalesce(F.size(f"p{k}"), F.lit(0)) for k in range(len(PHRASES))]
    sizes = [F.greatest(s, F.lit(0)) for s in sizes]
    places = F.array_compact(F.array(*[F.array_min(f"p{k}") for k in range(len(PHRASES))]))
    lasts = F.array_compact(F.array(*[F.array_max(f"p{k}") for k in range(len(PHRASES))]))
    base = F.array_compact(F.array(*[F.when(sizes[k] > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    out = out.select(
        "row", "doc_id", "n_words", sum(sizes[1:], sizes[0]).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(lasts).cast("long").alias("last_word"),
        F.array_sort(base).alias("base"),
    )
    out = out.join(by_row, "row", "left")
    both = F.array_sort(F.array_union("base", F.coalesce("found", none)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )


op6 = scan
