import random
import re

from fotolake.operators import textindex as tx


def held(text, needle):
    if text is None or needle is None:
        return False
    lower = {i: i + 32 for i in range(65, 91)}
    parts = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in needle.translate(lower))
    return re.search(parts, text.translate(lower), re.S) is not None


def test_search_equals_a_scan(spark, monkeypatch):
    monkeypatch.setattr(tx, "PART", 5)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcDEé漢 .*[\\\\$") for _ in range(rng.randint(0, 30)))
    texts = [(i, word()) for i in range(120)] + [(200, None), (201, ""), (202, "ab"), (203, "x" * 40_000 + "needle\nin hay"), (204, "ÀB\\cd")]
    needles = [(i, (t or "")[a : a + rng.randint(1, 7)]) for i, (_, t) in enumerate(texts[:40]) for a in [rng.randint(0, 5)]]
    needles += [(100, "a%D"), (101, "ab_de"), (102, ""), (103, None), (104, "%"), (105, "NEEDLE_IN"), (106, "nowhere at all"), (107, "cde%abc%"), (108, "À"), (109, "\\c"), (110, "b\\cd")]
    frame = spark.createDataFrame(texts, "id long, text string").repartition(3)
    found = [tuple(r) for r in tx.search(frame, spark.createDataFrame(needles, "needle_id long, needle string")).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(n, i) for n, needle in needles for i, t in texts if held(t, needle)}


def test_few_rows_are_compared(spark):
    texts = spark.createDataFrame([(i, f"common words everywhere {i % 50:02}xyz{i % 7}") for i in range(700)], "id long, text string")
    needles = spark.createDataFrame([(1, "common words everywhere 07xyz")], "needle_id long, needle string")
    assert tx.search(texts, needles).count() == 14 and tx.candidates(tx.postings(texts), needles).count() <= 28


def test_empty(spark):
    empty, needles = spark.createDataFrame([], "id long, text string"), spark.createDataFrame([(1, "abc"), (2, "a")], "needle_id long, needle string")
    assert tx.search(empty, needles).collect() == [] and tx.search(spark.createDataFrame([(1, "abc")], "id long, text string"), needles.limit(0)).collect() == []
