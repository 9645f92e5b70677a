import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fotolake.llm import spelling as sp

ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def edits(word):
    """Everything one inserted, deleted or replaced letter away."""
    out = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in ALPHABET}
    out |= {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in ALPHABET}
    return out - {word}


def plain(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    form, near = {}, {}
    for w in n:
        around = edits(w) & n.keys()
        near[w] = len(around)
        best = min(around, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], near[w], n.get(form[w])) for w in n}


@pytest.fixture(scope="module")
def words():
    rng = random.Random(2)
    parts = ["th", "er", "on", "an", "é", "he", "in", "ou", "ß", "Ñ", "st"]
    made = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(3, 5))) for _ in range(700)})
    return [w for w in made if len(w) >= 5] + ["a" * 300, "a" * 301, "a" * 299 + "b", "hello", "hallo", "hull", "helo", "hellos", "jello"]


def documents(words):
    rng = random.Random(6)
    docs = []
    for i in range(60):
        mine = [w for w in words if rng.random() < 0.3 for _ in range(rng.choice([1, 1, 2, 9]))]
        docs.append((i, " ".join(w.title() if rng.random() < 0.2 else w for w in mine) + " x1hello2 ×÷abcde漢字hello"))
    return docs + [(100, None), (101, ""), (102, "¿? 12"), (None, "hello " * 50), (5, docs[5][1])]


def test_trees_find_all_near_words(words):
    rng = random.Random(7)
    n = {w: rng.randint(3, 9) for w in words}
    for length in (6, 7, 300):
        points = [w for w in words if len(w) == length]
        for shorter in sp.BOX:
            asking = [w for w in words if len(w) == length + shorter]
            if not asking:
                continue
            found, best = sp.near_words(points, np.array([n[p] for p in points]), asking, length, shorter)
            for w, count, row in zip(asking, found, best):
                around = edits(w)
                expected = [x for x in points if x in around]
                assert count == len(expected)
                assert (points[row] if expected else -1) == (min(expected, key=lambda x: (-n[x], x)) if expected else row)


def test_cells_cover_every_near_word(words):
    """A tree cut by a few words only sends each word to the cells of all that is near it."""
    tree = sp.Tree(sp.counts(sp.letters([w for w in words if len(w) == 7][:20], 7)), leaf=1, depth=4)
    points = [w for w in words if len(w) == 7]
    home = dict(zip(points, sp._cell_of(tree, sp.counts(sp.letters(points, 7)))))
    for shorter in sp.BOX:
        asking = [w for w in words if len(w) == 7 + shorter]
        seen = {(asking[i], cell) for cell, rows in sp._cells_near(tree, sp.counts(sp.letters(asking, 7 + shorter)), shorter) for i in rows}
        for w in asking:
            around = edits(w)
            assert {(w, home[x]) for x in points if x in around} <= seen


@pytest.mark.parametrize("cell", [40, sp.CELL])
def test_report_equals_plain_python(spark, words, cell):
    docs = documents(words)
    frame = spark.createDataFrame([(*d, "w", 1, 2) for d in docs], "doc_id long, text string, word string, n int, `size.x` int").repartition(3)
    rows = sp.spelling_report(frame, cell).collect()
    assert len(rows) == len({r.word for r in rows})
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == plain(docs)


def test_chains_and_ties(spark):
    counts = [("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("zzzzz", 5), ("zzzzy", 10), ("yzzzz", 10), ("alone", 7)]
    found = {r.word: (r.form, r.root) for r in sp.variants(spark.createDataFrame(counts, "word string, n long")).collect()}
    assert found["aaaaa"] == ("aaaab", "aabbb") and found["zzzzz"] == ("yzzzz", "yzzzz") and found["alone"] == (None, "alone")


def test_empty_tables(spark):
    assert sp.spelling_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert sp.spelling_report(spark.createDataFrame([(1, None), (2, "ab")], "doc_id long, text string")).collect() == []
