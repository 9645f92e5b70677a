"""Licence scans by a positional index of rare words, in DataFrame functions only.

Templates are passages of well-known licences. Their words and places are the index: word -> (template, place), a table whose
size is that of the templates. How rare a licence word is comes from all documents (its inverse document frequency). Each
document's highest-IDF licence words are looked up with all their places; hits of one template that stand at one distance from
its places are one alignment, which needs half of the template's looked-up weight, and the template's mandatory phrases at
their own places in it.

A document that lacks a word of every template's mandatory phrases can have no label, so its places are not looked up; that is
exact. Nothing but small columns is shuffled, and texts are read twice: for the frequencies and for the hits.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: every ASCII character but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Highest-IDF words of a document that are looked up.
RARE = 24
#: Share of a template's weight, of 100, that an alignment needs.
SHARE = 50

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public licence notices as (label, passage, mandatory phrases), in words of lower-case letters and digits.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "this project is licensed under the terms of the mit license", ["licensed under the terms of the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license", "apache org licenses license 2 0"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it and or modify it under the terms of the gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "provided that the following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee is hereby granted"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international license"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0 international license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
]


def postings(templates: list[tuple] = TEMPLATES) -> list[tuple[str, int, int]]:
    """The index: (word, template, place), ordered."""
    return sorted((w, t, p) for t, (_, passage, _) in enumerate(templates) for p, w in enumerate(passage.split()))


def lexicon(templates: list[tuple] = TEMPLATES) -> list[str]:
    """All licence words: those of the templates and of the counted phrases."""
    return sorted({w for w, _, _ in postings(templates)} | {w for phrase in PHRASES for w in phrase.split()})


def mandatory(templates: list[tuple] = TEMPLATES) -> list[tuple[int, int, list[str]]]:
    """(template, place, words) of the phrases that have to stand in an alignment."""
    out = []
    for t, (_, passage, phrases) in enumerate(templates):
        words = passage.split()
        for phrase in phrases:
            part = phrase.split()
            places = [p for p in range(len(words)) if words[p : p + len(part)] == part]
            if not places:
                raise ValueError(f"not in its passage: {phrase}")
            out.append((t, places[0], part))
    return out


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def with_words(docs: DataFrame) -> DataFrame:
    """doc_id, same (a hash of the text) and words of every row. Rows that agree in doc_id and text have equal results."""
    text = text_of()
    bare = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), BETWEEN, " "))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " ", -1))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.length(text)).alias("same"), words.alias("words"))


def _starts(phrase: list[str]) -> Column:
    """Places in words where the phrase's words stand consecutively. Only texts that have all of its words are gone through."""
    last = F.size("words") - len(phrase)
    here = lambda i: reduce(lambda a, b: a & b, (F.get("words", i + j) == w for j, w in enumerate(phrase)))
    has = F.size(F.array_except(_strings(sorted(set(phrase))), "present")) == 0
    return F.when(has & (last >= 0), F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def _standing(number: int, template: int, place: int, part: list[str]) -> Column:
    """Where a mandatory phrase stands, each time with the place that its template would start at."""
    return F.transform(_starts(part), lambda at: F.struct(F.lit(template).alias("template"), (at - place).alias("start"), F.lit(number).alias("phrase")))


def frequencies(words: DataFrame, templates: list[tuple] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that hold each licence word: as many rows as the templates have words."""
    held = words.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(_strings(lexicon(templates)), "words"))).alias("word"))
    found = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return found.pop("", 0), found


def weights(n: int, held: dict[str, int], templates: list[tuple] = TEMPLATES) -> dict[str, int]:
    """Inverse document frequency of each licence word in hundredths, 1 at least: the logarithm of (n + 1) / (held + 0.5)."""
    return {w: max(1, math.floor(100 * math.log((n + 1) / (held.get(w, 0) + 0.5)) + 0.5)) for w in lexicon(templates)}


def alignments(spark: SparkSession, hits: DataFrame, weight: dict[str, int], templates: list[tuple] = TEMPLATES) -> DataFrame:
    """doc_id, same, template, score: the best verified alignment of each template in each document.

    hits has doc_id, same, rare (looked-up words), phrases (array of (template, place in the text) where mandatory phrases
    stand, each at the place that the template's start would have) and places (array of (word, at)).
    """
    index = spark.createDataFrame(postings(templates), "word string, template int, place int")
    worth = spark.createDataFrame([(w, x) for w, x in weight.items()], "word string, weight long")
    index = F.broadcast(index.join(worth, "word"))
    keys = ["doc_id", "same", "template"]
    # One copy of rows that agree; the lookups of a document are at most RARE words with their places.
    one = hits.dropDuplicates(["doc_id", "same"])
    found = one.select("doc_id", "same", F.explode("places").alias("hit")).select("doc_id", "same", "hit.word", "hit.at").join(index, "word")
    lined = found.groupBy(*keys, (F.col("at") - F.col("place")).alias("start")).agg(F.sum("weight").alias("met"))
    needs = {t: sum(1 for m in mandatory(templates) if m[0] == t) for t in range(len(templates))}
    verified = one.select("doc_id", "same", F.explode("phrases").alias("x")).select("doc_id", "same", "x.template", "x.start", "x.phrase")
    verified = verified.groupBy(*keys, "start").agg(F.count_distinct("phrase").alias("stand"))
    enough = reduce(lambda c, t: c.when(F.col("template") == t, F.lit(needs[t])), range(1, len(templates)), F.when(F.col("template") == 0, F.lit(needs[0])))
    verified = verified.where(F.col("stand") == enough).drop("stand")
    # What the template could have reached with the words that this document looks up.
    asked = one.select("doc_id", "same", F.explode("rare").alias("word")).join(index, "word").groupBy(*keys).agg(F.sum("weight").alias("most"))
    total = index.groupBy("template").agg(F.sum("weight").alias("total"))
    on = lambda a, b, names: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in names))
    lined, verified, asked = lined.alias("l"), verified.alias("v"), asked.alias("q")
    met = lined.join(verified, on(lined, verified, [*keys, "start"]), "left_semi")
    best = met.groupBy(*keys).agg(F.max("met").alias("met")).alias("b")
    both = best.join(asked, on(best, asked, keys)).select(*[F.col(f"b.{c}") for c in keys], "met", "most")
    share = both.where(F.col("met") * 100 >= F.col("most") * SHARE).join(F.broadcast(total), "template")
    return share.select(*keys, (F.col("met") / F.col("total")).alias("score"))


def licence_report(docs: DataFrame, templates: list[tuple] = TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_templates.

    docs has doc_id and text; other columns are ignored. Null and empty texts have no words, null places, empty labels and a
    score of 0. score is the greatest share of a template's weight that one verified alignment meets. Repeated rows are
    judged alike, as rows of one doc_id with different texts are by themselves; rows without doc_id count as well. Whole
    texts count. An empty table gives no rows.
    """
    spark = docs.sparkSession
    words = with_words(docs)
    weight = weights(*frequencies(words, templates), templates)
    by_idf = sorted(weight, key=lambda w: (-weight[w], w))
    held = words.withColumn("present", F.array_intersect(_strings(by_idf), "words"))
    base = {label: _starts(phrase.split()) for phrase, label in PHRASES.items()}
    held = held.withColumns({f"base_{label}": places for label, places in base.items()})
    phrases = [_standing(k, t, p, part) for k, (t, p, part) in enumerate(mandatory(templates))]
    held = held.select("*", F.concat(*phrases).alias("phrases"), F.slice("present", 1, RARE).alias("rare"))
    places = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    places = F.filter(places, lambda x: F.array_contains("rare", x["word"]))
    every = F.concat(*[F.col(f"base_{label}") for label in base])
    labels = F.filter(F.array(*[F.when(F.size(f"base_{label}") > 0, F.lit(label)) for label in base]), lambda x: x.isNotNull())
    rows = settled(
        held.select(
            "doc_id", "same", F.size("words").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"),
            F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
            labels.alias("base"), "phrases", "rare", F.when(F.size("phrases") > 0, places).alias("places"),
        )
    )
    found = alignments(spark, rows.where(F.size("phrases") > 0), weight, templates)
    name = F.element_at(_strings([label for label, _, _ in templates]), F.col("template") + 1)
    own = found.groupBy("doc_id", "same").agg(F.collect_set(name).alias("own"), F.max("score").alias("score"), F.count("*").alias("n_templates"))
    own = own.select(F.col("doc_id").alias("own_id"), F.col("same").alias("own_same"), "own", "score", "n_templates")
    rows = rows.drop("phrases", "rare", "places")
    out = rows.join(own, rows["doc_id"].eqNullSafe(own["own_id"]) & (rows["same"] == own["own_same"]), "left")
    none = F.array().cast("array<string>")
    together = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", none))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(together, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_templates", F.lit(0)).cast("long").alias("n_templates"),
    )
