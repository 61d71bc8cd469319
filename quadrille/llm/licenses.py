"""Licence scans by a positional index of rare licence words.

The index holds, for each word of the licence templates, the templates and places where it stands. A file looks up its
rarest licence words (by document frequency over the whole corpus); each hit votes for (template, shift between the
place in the file and in the template). Words of one template that keep their relative places share a shift. A
template whose best shift has enough of the looked-up words is then verified: its mandatory phrase must stand in the
file. A file with a mandatory phrase looks up all its licence words too, so that a template is found whatever else
stands in the file. Base labels (phrases that stand in the file word by word) are exact and always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_of

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Label, mandatory phrase, template (the words that carry the licence's grant or notice).
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("lgpl", "gnu lesser general public license", "redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("isc", "permission to use copy modify and or distribute", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
]
#: Words that never are looked up.
COMMON = "the of a an to in is it and or for by with any this that you may not be are as at 0 2 3 4 v".split()
#: Rare words that a file looks up first; the share of a template's looked-up words that must agree on one shift.
RARE, AGREE = 12, 0.75


def postings() -> list[tuple[str, int, int]]:
    """(word, template, place), without common words."""
    return [(w, t, i) for t, (_, _, words) in enumerate(TEMPLATES) for i, w in enumerate(words.split()) if w not in COMMON]


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _stands(norm: str, phrase: str) -> Column:
    return F.contains(F.col(norm), F.lit(f" {phrase} "))


def licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a base phrase stands, else the best verified template's share of agreeing words, else 0. Rows are
    scored one by one, so repeated rows get equal results. Null texts count as empty; extra columns are ignored; an
    empty table gives no rows. Only words of the index leave their document, as counts for the frequencies (at most one
    row per index word and task).
    """
    vocabulary = sorted({w for w, _, _ in postings()})
    rows = docs.select(docs[id_col].alias("id"), F.translate(text_of(docs, text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("t"))
    words = F.array_remove(F.split("t", WORD_GAP), "")
    # document frequencies of the index's words: a table of fixed size
    seen = rows.select(F.explode(F.array_intersect(words, _array(vocabulary))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    df = {r["word"]: r["df"] for r in seen.collect()}
    order = sorted(vocabulary, key=lambda w: (df.get(w, 0), w))  # by falling inverse document frequency

    rows = rows.withColumn("w", words)
    rows = rows.select("id", F.size("w").cast("long").alias("n_words"), F.when(F.arrays_overlap("w", _array(vocabulary)), F.col("w")).alias("w"))
    rows = rows.withColumn("norm", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    # words between the places of a phrase; no phrase overlaps itself
    gaps = {p: F.when(_stands("norm", p), F.expr(f"transform(split(norm, '(?<= ){p}(?= )'), x -> size(array_remove(split(x, ' '), '')))")) for p in PHRASES}
    rows = rows.withColumns({f"g{i}": g for i, g in enumerate(gaps.values())})
    n_base, firsts, lasts = F.lit(0), [], []
    for i, p in enumerate(PHRASES):
        n_base = n_base + F.when(F.col(f"g{i}").isNotNull(), F.size(f"g{i}") - 1).otherwise(0)
        firsts.append(F.element_at(f"g{i}", 1))
        lasts.append(F.col("n_words") - F.element_at(f"g{i}", -1) - len(p.split()))
    found = F.array_compact(F.array(*(F.when(F.col(f"g{i}").isNotNull(), F.lit(label)) for i, label in enumerate(PHRASES.values()))))

    # the index words of files with a mandatory phrase, rarest first; without one no template can be verified
    stands = F.coalesce(F.greatest(*(_stands("norm", must) for must in sorted({must for _, must, _ in TEMPLATES}))), F.lit(False))
    rows = rows.withColumn("every", F.when(stands, F.array_intersect(_array(order), F.col("w"))))
    rows = rows.withColumn("rare", F.slice("every", 1, RARE))
    rows = rows.withColumn("places", F.when(F.col("every").isNotNull(), F.expr("filter(transform(w, (x, j) -> struct(x as x, j as j)), y -> array_contains(every, y.x))")))
    places: dict[str, list[str]] = {}
    for w, t, i in postings():
        places.setdefault(w, []).append(f"named_struct('t', {t}, 'i', {i})")
    index = "map(" + ", ".join(f"'{w}', array({', '.join(p)})" for w, p in places.items()) + ")"
    # longest run of equal votes for each template, over the sorted votes
    best = "aggregate(sorted, named_struct('t', -1, 'shift', 0, 'n', 0, 'best', array_repeat(0, {n})), (s, v) -> named_struct('t', v.t, 'shift', v.shift, 'n', if(v.t = s.t and v.shift = s.shift, s.n + 1, 1), 'best', transform(s.best, (b, k) -> if(k = v.t, greatest(b, if(v.t = s.t and v.shift = s.shift, s.n + 1, 1)), b))), s -> s.best)".format(n=len(TEMPLATES))
    shares = []
    for looked in ("rare", "every"):
        # the places of the words looked up vote for (template, shift)
        rows = rows.withColumn("hits", F.expr(f"filter(places, y -> array_contains({looked}, y.x))"))
        rows = rows.withColumn("votes", F.expr(f"flatten(transform(hits, y -> transform({index}[y.x], z -> struct(z.t as t, y.j - z.i as shift))))"))
        # looked-up places of each template: what a full agreement would give
        full = "array(" + ", ".join(f"aggregate(array({', '.join(repr(w) for w, u, _ in postings() if u == t)}), 0, (s, x) -> s + if(array_contains({looked}, x), 1, 0))" for t in range(len(TEMPLATES))) + ")"
        rows = rows.withColumns({"sorted": F.expr("array_sort(votes)"), f"full_{looked}": F.when(F.col(looked).isNotNull(), F.expr(full))})
        rows = rows.withColumn(f"best_{looked}", F.when(F.size("sorted") > 0, F.expr(best)))
        shares.append([F.coalesce(F.when((F.element_at(f"full_{looked}", t + 1) >= 2) & _stands("norm", must), F.least(F.lit(1.0), F.element_at(f"best_{looked}", t + 1) / F.element_at(f"full_{looked}", t + 1).cast("double"))), F.lit(0.0)) for t, (_, must, _) in enumerate(TEMPLATES)])
    share = [F.greatest(*x) for x in zip(*shares, strict=True)]
    rows = rows.withColumn("shares", F.array(*share))
    verified = F.array_compact(F.array(*(F.when(F.element_at("shares", t + 1) >= AGREE, F.lit(label)) for t, (label, _, _) in enumerate(TEMPLATES))))
    rows = rows.withColumns({"base": F.array_sort(F.array_distinct(found)), "more": verified})
    top = F.array_max("shares")
    return rows.select(
        F.col("id").alias(id_col), "n_words", n_base.cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).when(top >= AGREE, top).otherwise(0.0).alias("score"),
    )
