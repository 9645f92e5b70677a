import math
import re
from collections import Counter

import pytest

from fotolake.llm import licences as li


def plain(docs, templates=li.TEMPLATES):
    """The scan as loops over every place of every text."""
    lower = {i: i + 32 for i in range(65, 91)}
    words = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(lower)) for _, text in docs]
    lexicon = {w for _, passage, _ in templates for w in passage.split()} | {w for p in li.PHRASES for w in p.split()}
    held = Counter(w for ws in words for w in set(ws) & lexicon)
    weight = {w: max(1, math.floor(100 * math.log((len(docs) + 1) / (held[w] + 0.5)) + 0.5)) for w in lexicon}
    out = []
    for (doc_id, _), ws in zip(docs, words):
        stands = lambda phrase, at, ws=ws: at >= 0 and ws[at : at + len(phrase)] == phrase
        base = [(i, label) for phrase, label in li.PHRASES.items() for i in range(len(ws)) if stands(phrase.split(), i)]
        rare = set(sorted(set(ws) & lexicon, key=lambda w: (-weight[w], w))[: li.RARE])
        scores = {}
        for t, (_, passage, phrases) in enumerate(templates):
            part = passage.split()
            places = [(next(p for p in range(len(part)) if part[p : p + len(f.split())] == f.split()), f.split()) for f in phrases]
            most, total = sum(weight[w] for w in part if w in rare), sum(weight[w] for w in part)
            for start in range(-len(part), len(ws)):
                if not all(stands(f, start + p) for p, f in places):
                    continue
                met = sum(weight[w] for p, w in enumerate(part) if 0 <= start + p < len(ws) and ws[start + p] == w and w in rare)
                if met * 100 >= most * li.SHARE and met:
                    scores[t] = max(scores.get(t, 0), met / total)
        labels = {label for _, label in base} | {templates[t][0] for t in scores}
        out.append((doc_id, len(ws), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), max(scores.values(), default=0.0), len(scores)))
    return out


FILLER = "Einer the of version 2.0 and license terms über 漢字 x_y public general free to any"
DOCS = [
    (0, "Released under the MIT License."),
    (1, "Intro text.\nLicensed under the Apache License, Version 2.0.\nmore Apache-License"),
    (2, "This work is licensed under the GNU General Public License, version 3."),
    (3, "Licensed under CC BY-NC 4.0."),
    (4, "mit license MIT LICENSE mit-license m license the license of mit"),
    (5, None),
    (6, ""),
    (7, FILLER * 40),
    (8, FILLER + " Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, " + FILLER),
    (9, "permission is hereby granted free of charge"),
    (10, "Redistribution and use in source and binary forms, with or without changes, are allowed provided that the following conditions are met"),
    (10, "mit license"),
    (10, "mit license"),
    (None, "the general public license"),
    (None, None),
    (11, "mit license mit　license mit\x00license"),
    (12, "a mit license " * 3000),
    (13, "under the apache license version 2 0 " + "q " * 20000 + "licensed under cc by nc 4 0"),
    (14, "=" * 5000),
]


def row(r):
    return (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, r.n_templates)


@pytest.mark.parametrize("parts", [1, 6])
def test_report_equals_plain_loops(spark, parts):
    frame = spark.createDataFrame([(*d, 1, "w", "t", 3) for d in DOCS], "doc_id long, text string, template int, words string, same string, `own.x` int")
    found = [row(r) for r in li.licence_report(frame.repartition(parts)).collect()]
    assert Counter(found) == Counter(plain(DOCS))


def test_labels_of_the_method_stand_beside_the_base(spark):
    found = {r.doc_id: r for r in li.licence_report(spark.createDataFrame(DOCS[:9], "doc_id long, text string")).collect()}
    assert found[0].labels == "mit" and found[0].score == 1.0
    assert found[1].labels == "apache,apache-2.0" and found[3].labels == "cc-by-nc" and found[3].base_labels == ""
    assert (found[4].n_base, found[4].first_word, found[4].last_word) == (3, 0, 4)
    assert found[8].labels == "mit" and found[8].n_base == 0 and found[7].labels == ""


def test_empty_table(spark):
    assert li.licence_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
