"""License scan with a positional index of rare words; DataFrame functions only.

Templates are runs of licence words: short notices and the paragraphs of whole licence texts. The index holds (template, place)
pairs of words. The document frequency of every licence word is counted over all documents, and each template is indexed by its
RARE rarest words and by the NEED rarest ones of its mandatory phrase; ranks decide, never a share of documents, so a notice that
stands in every file is found like any other. A file is looked up by all indexed words it holds: each place minus the word's place
in a template is where the template would start, and starts that NEED words agree on are candidates. A candidate counts if
the template's mandatory phrase stands at its place; as its rarest words are indexed, no file with the phrase is missed. Agreeing
starts are found by sorting them, so a file that repeats one licence word costs n log n.

The base phrases are searched for in every file, whatever the index says. Only counts of licence words are shuffled.

Defined cases: a null or empty text has no words and empty labels; words are compared by their lower-cased form; equal rows
get equal results; an empty table gives no rows; other columns are kept by scan(), one named as an output of it (in any case of
letters) as <name>_in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import clean_name, make_room
from .quality import let

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE, NEED = 6, 2
#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Fixed values: (label, template, mandatory phrase in it), from the licences' own notices and texts.
TEMPLATES = (
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", "hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies or substantial portions"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "software distributed under the license is distributed on an as is basis"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", "terms of the gnu general public license"),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "to alter it and redistribute it freely"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("bsl-1", "distributed under the boost software license version 1 0", "boost software license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0 universal"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
)
_SHIFT, _ZERO = 40, 1 << 30


def word_array(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, NOT_WORD), lambda w: w != "")


def vocabulary() -> list[str]:
    return sorted({w for _, t, _ in TEMPLATES for w in t.split()})


def document_shares(docs: DataFrame) -> dict[str, float]:
    """Share of documents with each licence word; a row a word comes to the driver, and one for the total."""
    words = F.array_intersect(word_array(F.col("text")), F.array(*[F.lit(w) for w in vocabulary()]))
    seen = docs.select(F.explode(F.concat(words, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r.w: r.n for r in seen}
    return {w: counts.get(w, 0) / counts[""] for w in vocabulary()} if counts else {}


def _base(norm: Column, n_words: Column) -> dict[str, Column]:
    """Places of base phrases in the words between single spaces: number, least and largest start, labels."""
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))

    def one(phrase):
        size = len(phrase.split())
        last = lambda p: spaces(F.get(p, F.size(p) - 1)) - 1
        found = let(F.split(norm, f" {phrase}(?= )"), lambda p: F.struct((F.size(p) - 1).alias("n"), spaces(p[0]).alias("first"), (n_words - last(p) - size).alias("last")))
        return F.when(F.contains(norm, F.lit(f" {phrase} ")), found)

    each = [one(p) for p, _ in BASE]
    return {
        "all": F.array(*each),
        "labels": F.filter(F.array(*[F.when(F.contains(norm, F.lit(f" {p} ")), F.lit(label)) for p, label in BASE]), lambda x: x.isNotNull()),
    }


def _postings(shares: dict[str, float]) -> dict[str, list[int]]:
    """Codes (template, minus place) by word, rarest words first."""
    idf = lambda w: (shares.get(w, 0), w)
    out: dict[str, list[int]] = {}
    for t, (_, text, must) in enumerate(TEMPLATES):
        words = text.split()
        for w in {*sorted(set(words), key=idf)[:RARE], *sorted(set(must.split()), key=idf)[:NEED]}:
            out.setdefault(w, []).extend((t << _SHIFT) - place for place, x in enumerate(words) if x == w)
    return {w: out[w] for w in sorted(out, key=idf)}


def _candidates(words: Column, shares: dict[str, float]) -> Column:
    """Sorted codes (template, start) that NEED indexed words of the file agree on."""
    postings = _postings(shares)
    by_idf = F.array(*[F.lit(w) for w in postings])
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.array(*[F.lit(c).cast("long") for c in codes]).alias("c")) for w, codes in postings.items()])

    def look_up(own):  # the file's own indexed words, highest idf first
        places = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(own, x["w"]))
        starts = F.flatten(F.transform(places, lambda x: F.transform(F.get(F.filter(table, lambda e: e["w"] == x["w"])["c"], F.lit(0)), lambda c: c + x["i"] + F.lit(_ZERO).cast("long"))))
        agree = lambda s: F.filter(s, lambda x, i: (F.get(s, i + NEED - 1) == x) & ~F.coalesce(F.get(s, i - 1) == x, F.lit(False)))
        return let(F.array_sort(starts), agree)

    return let(F.array_intersect(by_idf, words), lambda own: F.when(F.size(own) < NEED, F.array().cast("array<bigint>")).otherwise(look_up(own)))


def _verified(words: Column, codes: Column) -> Column:
    """Templates among the candidates whose mandatory phrase stands at its place."""
    offsets, phrases = [], []
    for _, text, must in TEMPLATES:
        t, m = text.split(), must.split()
        offsets.append(next(i for i in range(len(t)) if t[i : i + len(m)] == m))
        phrases.append(m)
    at = F.array(*[F.lit(o) for o in offsets])
    wanted = F.array(*[F.array(*[F.lit(w) for w in p]) for p in phrases])

    def stands(code):
        t = F.shiftright(code, _SHIFT).cast("int")
        start = (code.bitwiseAND(F.lit((1 << _SHIFT) - 1)) - _ZERO).cast("int") + F.get(at, t)
        return (start >= 0) & (F.slice(words, F.greatest(start, F.lit(0)) + 1, F.size(F.get(wanted, t))) == F.get(wanted, t))

    return F.array_distinct(F.transform(F.filter(codes, stands), lambda c: F.shiftright(c, _SHIFT).cast("int")))


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = make_room(docs, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    own = docs.columns
    shares = document_shares(docs)
    w_at, c_at = clean_name(docs, "scan_words"), clean_name(docs, "scan")
    step1 = docs.select(*own, word_array(F.col("text")).alias(w_at))
    words = F.col(w_at)
    norm = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    base = let(norm, lambda s: F.struct(*[v.alias(k) for k, v in _base(s, F.size(words)).items()]))
    codes = _candidates(words, shares)
    step2 = step1.select(*own, F.size(words).cast("long").alias("n_words"), F.struct(base.alias("base"), let(codes, lambda c: F.struct((F.size(c) > 0).alias("some"), _verified(words, c).alias("sure"))).alias("method")).alias(c_at))
    places, base_labels, method = F.col(c_at)["base"]["all"], F.col(c_at)["base"]["labels"], F.col(c_at)["method"]
    labels = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    every = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform(method["sure"], lambda t: F.get(labels, t)))))
    score = F.when((F.size(base_labels) > 0) | (F.size(method["sure"]) > 0), F.lit(1.0)).when(method["some"], F.lit(0.5)).otherwise(F.lit(0.0))
    return step2.select(
        *own,
        "n_words",
        F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x["n"], F.lit(0))).cast("long").alias("n_base"),
        F.array_min(F.transform(places, lambda x: x["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(places, lambda x: x["last"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        score.alias("score"),
    )
