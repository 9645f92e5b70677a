import bisect
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolake.llm import quality as q
from fotolake.llm.boosting import Boosted, Isotonic
from fotolake.llm.lm_score import Network, laid, lm_scores, windows
from fotolake.llm.toxicity import core_of, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    common = ["the", "of", "and", "to", "in", "is", "that", "it"]
    return " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice(["er", "an", "tion", "re", "on"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def base_counts(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    cover = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(cover)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(25, 120))) for i in range(250)]
    # All texts teach the model, so noise is what the corpus has next to none of.
    rows += [(300, " ".join(w.upper() + "!!" for w in prose(rng, 60).split())), (320, " ".join(w + "###" for w in prose(rng, 60).split()))]
    rows += [(340 + i, rows[7][1]) for i in range(60)]  # a text with many copies stays as good as it is
    return rows


def test_quality_counts_and_bands(make, corpus, awkward):
    rows = corpus + [(1000 + (i or 0), t) for i, t in awkward] + [(1100, "a b c d e f g h " * 6 + "\nx\nx\n \n \nx ")]
    found = {(r["doc_id"], r["n_words"]): r for r in q.quality(make(rows)).collect()}
    for i, t in rows:
        want = base_counts(t)
        r = found[(i, want[0])]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])
    kept = {i for (i, _), r in found.items() if r["kept"]}
    assert len([i for i in range(250) if i in kept]) >= 248
    assert not any(300 <= i < 340 for i in kept) and all(340 + i in kept for i in range(60))


def brute_bits(texts, numbers, low, within):
    """Bits per word of texts under interpolated modified Kneser-Ney, all counts from plain dictionaries."""
    from collections import Counter, defaultdict

    def grams(text):
        g = numbers.lang("en")
        ids = [g * q.SHAPES + q.START] * 2 + numbers.of(g, (text or "").encode().split()).tolist()
        return list(zip(ids, ids[1:], ids[2:]))

    tri = Counter()
    for t in texts:
        tri.update(grams(t) if q.prose((t or "").encode(), (t or "").encode().split()) else set(grams(t)))
    bi = Counter(g[1:] for g in tri)  # the different words before each pair
    uni = Counter(g[1] for g in bi)
    raw2 = Counter()
    for g, n in tri.items():
        raw2[g[1:]] += n

    def discounts(counts):
        n = Counter(min(c, 5) for c in counts.values())
        n1, n2, n3, n4 = (max(n[i], 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        return [0.0] + [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]

    def order(counts, raw):
        d, total, p = discounts(counts), Counter(), {}
        for g, n in counts.items():
            total[g[:-1]] += n
        rest = defaultdict(lambda: 1.0)
        for g, n in counts.items():
            if raw[g] >= max(q.LEAST_COUNT, low):
                p[g] = (n - d[min(n, 3)]) / total[g[:-1]]
                rest[g[:-1]] -= p[g]
        return p, rest

    (p3, r3), (p2, r2) = order(tri, tri), order(bi, raw2)
    d1 = discounts(uni)
    total = sum(uni.values())
    p1 = {w: (n - d1[min(n, 3)]) / total for w, n in uni.items()}
    floor = (1 - sum(p1.values())) / ((len(numbers.langs) + 1) * q.SHAPES + len(numbers.vocabulary))
    out = []
    for t in texts:
        bits = []
        for g in grams(t):
            p = p2.get(g[1:], 0) + max(r2[g[1:2]], 1e-6) * (p1.get(g[2], 0) + floor)
            bits.append(within[g[2]] - np.log2(p3.get(g, 0) + max(r3[g[:2]], 1e-6) * p))
        plain = [within[g[2]] - np.log2(p1.get(g[2], 0) + floor) for g in grams(t)]
        out.append((sum(bits) / len(bits), sum(plain) / len(plain)) if bits else (None, None))
    return out


def test_bits_and_verdicts_are_brute_force(make, corpus, awkward):
    rows = corpus + [(1000 + (i or 0), t) for i, t in awkward]
    docs = make(rows)
    numbers, model = q.fit(docs, 3)
    n_words = sum(len(WORD.findall(t or "")) for _, t in rows)
    bits = brute_bits([t for _, t in rows], numbers, q.NGRAM_SHARE * n_words, model.within)
    found = q.judged(docs).collect()
    by_row = {(r["doc_id"], r["h"]): r for r in found}
    passing = {}
    keys = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("")), "lang").alias("h")).collect()
    for k, (_, t), (b, plain) in zip(keys, rows, bits, strict=True):
        r = by_row[k["doc_id"], k["h"]]
        assert (r["bits"] is None) == (b is None) and (b is None or abs(r["bits"] - b) < 1e-3 and abs(r["plain_bits"] - plain) < 1e-3)
        n, _, _, _, again = base_counts(t)
        if n >= 20 and 100 * again <= 30 * n:
            passing[t] = (r["bits"], r["plain_bits"])

    def limits(values):
        bins = sorted(int(np.floor(b / q.BIN)) for b in values)
        at = lambda share: next(b for b in bins if bisect.bisect_right(bins, b) / len(bins) >= share) * q.BIN
        return at(0.5), (at(0.5) - at(0.25)) / 0.6745

    (middle, spread), (plain_middle, plain_spread) = (limits(x) for x in zip(*passing.values(), strict=True))
    for r in found:
        width = lambda s, n=r["n_words"]: q.SPREADS * s + q.SLACK + q.SHORT / max(n, 1) ** 0.5
        want = not r["base_failed"] and plain_middle - width(plain_spread) <= r["plain_bits"] and r["bits"] <= middle + width(spread)
        assert r["kept"] == want


def test_bits_do_not_depend_on_how_rows_lie(make, corpus, awkward, monkeypatch):
    docs = make(corpus + [(1000 + (i or 0), t) for i, t in awkward])
    one = {(r["doc_id"], r["n_words"], r["bits"], r["plain_bits"], r["kept"]) for r in q.judged(docs.coalesce(1)).collect()}
    monkeypatch.setattr(q, "HELD", 500)
    monkeypatch.setattr(q, "TEXTS", 7)
    assert {(r["doc_id"], r["n_words"], r["bits"], r["plain_bits"], r["kept"]) for r in q.judged(docs.repartition(8)).collect()} == one


def test_rows_without_doc_id_are_judged_singly(make, corpus):
    rows = [*corpus, (None, corpus[0][1]), (None, "x"), (5, "too short")]
    kept = [(r["doc_id"], r["text"]) for r in q.keep_good(make(rows)).collect()]
    assert (None, corpus[0][1]) in kept and (None, "x") not in kept and (5, "too short") not in kept and corpus[5] in kept


def test_quality_of_nothing(make):
    assert q.quality(make([])).count() == 0
    assert [r["kept"] for r in q.quality(make([(1, None), (None, "x")])).collect()] == [False, False]


def test_model_probabilities_sum_to_one_at_most(make, corpus):
    numbers, model = q.fit(make(corpus), 2)
    some = numbers.of(1, b"the of and".split())
    every = np.arange(len(model.p1))
    tri = (int(some[0]) << 2 * q.ID_BITS) | (int(some[1]) << q.ID_BITS) | every
    model.within[:] = 0
    assert 0.9 < np.exp2(-model.bits(tri)).sum() < 1.1


def test_trees_and_isotonic():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (rng.random(2000) < 0.05)).astype(float)
    trees = Boosted(trees=40).fit(x[:1000], y[:1000])
    raw = trees.raw(x[1000:])
    assert ((raw > 0) == (y[1000:] > 0.5)).mean() > 0.9
    scale = Isotonic().fit(raw, y[1000:])
    assert (np.diff(scale.y) > 0).all() and (np.diff(scale.of(np.sort(raw))) >= 0).all()
    assert abs(scale.of(raw).mean() - y[1000:].mean()) < 0.05


def test_toxicity_on_held_out_rows(spark, make):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        bad, text = rng.random() < 0.25, prose(rng, rng.randint(20, 60)).split()
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["moronish", "scumlord", "vilest", "v1l3st", "grimling"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None), (5001, ""), (None, "vilest"), (1, rows[1][1])]
    labels += [(None, 1, 1), (7, None, None), (9999, 0, 1)]
    found = toxicity(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 500).collect()
    assert len(found) == len(rows)
    truth = {i: t for i, _, t in labels if t is not None}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)


def test_toxicity_without_labels_or_rows(spark, make):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(make([]), none).count() == 0
    assert [r["predicted"] for r in toxicity(make([(1, "a b"), (2, None)]), none).collect()] == [0, 0]


def test_cores():
    assert core_of("v1l3,") == ("vile", True, False)
    assert core_of("i.d.i.o.t!")[0] == "idiot" and core_of("12")[0] == ""


def test_lm_scores_sum_over_both_sides(make, corpus):
    rows = corpus + [(2000, None), (2001, ""), (2002, prose(random.Random(12), 5000)), (1, corpus[1][1])]
    found = lm_scores(make(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["log_prob"] <= 0 and (r["n_tokens"] == 0) == (r["per_token"] is None)
    good = np.mean([r["per_token"] for r in found if r["doc_id"] is not None and r["doc_id"] < 250])
    noise = " ".join("".join(random.Random(i).choice("#|*<") for _ in range(6)) + str(i) for i in range(60))
    assert lm_scores(make(corpus + [(9000, noise)])).where("doc_id = 9000").first()["per_token"] < good
    assert lm_scores(make([])).count() == 0


def test_network_learns_from_both_sides():
    rng = np.random.default_rng(13)
    ids = rng.integers(1, 9, 6000)
    ids[2::3] = (ids[1::3][: len(ids[2::3])] * 2 + np.append(ids[3::3], 0)[: len(ids[2::3])]) % 8 + 1
    flat, places = laid(np.array([len(ids)]), ids)
    net, context = Network(10), windows(flat, places)
    before = net.log_p(context, ids).mean()
    for _ in range(60):
        for at in range(0, 4000, 500):
            net.train(context[at : at + 500], ids[at : at + 500], 0.1)
    assert net.log_p(context[4000:], ids[4000:]).mean() > before + 0.3
    flat, places = laid(np.array([2, 0, 1]), np.array([5, 6, 7]))
    assert windows(flat, places).tolist() == [[0, 0, 6, 0], [0, 5, 0, 0], [0, 0, 0, 0]]


def test_every_word_has_a_probability_of_its_own(make):
    from fotolake.llm import lm_score as lm

    rng = random.Random(14)
    rows = [(i, prose(rng, 40) + (" qzxvkwa" if i < 4 else " qzxvkwb" if i == 4 else "")) for i in range(80)]
    rows += [(900, "the of and to in is that qzxvkwa it the"), (901, "the of and to in is that qzxvkwb it the"), (None, "the # # #"), (902, "| | |")]
    found = {r["doc_id"]: r for r in lm_scores(make(rows)).collect()}
    # The same shape and sides: the scores differ by the words' counts, 5 and 2.
    assert abs(found[900]["log_prob"] - found[901]["log_prob"] - np.log(5 / 2)) < 1e-3
    assert found[None]["n_tokens"] == 4 and len(found) == len(rows)
    counted = {}
    for r in lm.word_counts(lm.keyed(make(rows)), 3).collect():
        counted |= dict(zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["counts"], np.int64).tolist(), strict=True))
    want = {}
    for _, t in rows:
        for w, before in zip(t.split(), [None, *t.split()], strict=False):
            if w != before:
                want[w] = want.get(w, 0) + 1
    keys = lm._Keys()
    assert counted == {keys[w.encode()]: n for w, n in want.items()}


def test_scores_are_plain_sums(make, corpus):
    from fotolake.llm import lm_score as lm

    rows = corpus[:40] + [(500, "the the the of of unseen"), (501, "the of"), (502, None)]
    docs = make(rows)
    texts = lm.settled(lm.keyed(docs))
    counted = lm.word_counts(texts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbers, others = lm.vocabulary(counted)
    net = lm.fit(texts, numbers)
    n = {}
    for r in counted.collect():
        n |= dict(zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["counts"], np.int64).tolist(), strict=True))
    frequent, keys = numbers.frequent.tolist()[:-1], lm._Keys()
    found = {r["doc_id"]: r["log_prob"] for r in lm_scores(docs).collect()}
    for i, t in rows:
        own = [keys[w.encode()] for w in (t or "").split()]
        ids = []
        for j, k in enumerate(own):
            again = j and k == own[j - 1]
            still = again and j > 1 and own[j - 2] == k
            ids.append(lm.STILL if still else lm.AGAIN if again else lm.SHAPE_NUMBERS + frequent.index(k) if k in frequent else 1 + k % 256)
        total, padded = 0.0, [0, 0, *ids, 0, 0]
        for j, (k, x) in enumerate(zip(own, ids, strict=True)):
            h = net.bias.astype(float)
            for place, near in enumerate((padded[j], padded[j + 1], padded[j + 3], padded[j + 4])):
                h = h + net.embed[place, near]
            h = np.tanh(h)
            for z, at in ((h @ net.top + net.top_bias, x % net.classes), (h @ net.low[x % net.classes] + net.low_bias[x % net.classes], x // net.classes)):
                total += z[at] - np.log(np.exp(z - z.max()).sum()) - z.max()
            if x < lm.AGAIN:
                total += np.log(n[k] / others[x - 1])
        assert abs(found[i] - total) < 1e-3 * max(1, abs(total))


def test_every_place_is_trained(make):
    from fotolake.llm import lm_score as lm

    rng = random.Random(15)
    rows = [(i, " ".join("last" if j % 4 == 3 else rng.choice("abc") for j in range(80))) for i in range(300)]
    texts = lm.keyed(make(rows))
    numbers, _ = lm.vocabulary(lm.word_counts(texts, 2))
    table = lm._Keys()
    keys = np.array([table[w.encode()] for w in rows[0][1].split()], np.uint64)
    sizes = np.array([len(keys)])
    flat, places = laid(sizes, numbers.of(keys, lm.repeats(sizes, keys)))
    at = places[np.arange(len(places)) % 4 == 3]
    trained, fresh = (x.log_p(windows(flat, at), flat[at]).mean() for x in (lm.fit(texts, numbers), Network(lm.SHAPE_NUMBERS + 4)))
    assert trained > fresh + 1


def test_words_of_a_small_language_have_numbers(make):
    from pyspark.sql import functions as F

    rng = random.Random(16)
    rows = [(i, prose(rng, 2000)) for i in range(20)] + [(100, " ".join(" ".join(rng.sample([f"w{j}" for j in range(40)], 40)) for _ in range(5)))]
    docs = make(rows).withColumn("lang", F.when(F.col("doc_id") == 100, "xx").otherwise("en"))
    langs = q.languages(docs)
    words = q.vocabulary(docs, langs, 2)[0]
    assert all(q._hash(langs["xx"], f"w{j}".encode()) in words for j in range(40))


def test_lower_orders_count_different_contexts(make):
    rng = random.Random(17)
    rows = [(i, " ".join(rng.choice([a + b for a in "abcdefg" for b in "hijklm"]) for _ in range(60))) for i in range(30)]
    rows += [(100 + i, rows[3][1]) for i in range(5)]
    docs = make(rows)
    langs = q.languages(docs)
    numbers = q.Numbers(langs, q.vocabulary(docs, langs, 3)[0])
    sent = docs.sparkSession.sparkContext.broadcast(numbers)
    found = {(r["kind"], r["key"]): r["n"] for r in q.ngram_counts(docs, sent, 3, 0.0).where("kind in (2, 3)").collect()}
    words = {}
    for r in q.ngram_counts(docs, sent, 3, 0.0).where("kind = 1").collect():
        words[r["key"]] = words.get(r["key"], 0) + r["n"]
    tri = {}
    for _, text in rows:
        words_of = text.encode().split()
        found_here = q.trigrams(numbers.of(1, words_of), 1).tolist()
        for x in found_here if q.prose(text.encode(), words_of) else set(found_here):
            tri[x] = tri.get(x, 0) + 1
    pairs, one = {}, (1 << q.ID_BITS) - 1
    for x in tri:
        pairs.setdefault(x & (1 << 2 * q.ID_BITS) - 1, set()).add(x)
    before = {}
    for x in pairs:
        before.setdefault(x & one, set()).add(x)
    assert {k: n for (o, k), n in found.items() if o == 3} == tri
    assert {k: n for (o, k), n in found.items() if o == 2} == {k: len(v) for k, v in pairs.items()}
    assert words == {k: len(v) for k, v in before.items()}


def test_a_words_shape_is_worked_out_once():
    """Keys of words hold their hash and shape; only words beyond ASCII that are not plain lower case go the long way."""
    import sys

    import xxhash

    from fotolake.llm.lm_score import _Keys
    from fotolake.llm.quality import shape

    rng = random.Random(9)
    words = {"".join(rng.choice("abCD1.,$#é ßΣ漢ʰªⅷ-'"[: rng.choice((6, 9, 20))]) for _ in range(rng.randint(1, 8))).replace(" ", "x") for _ in range(20_000)}
    words |= {"plain", "élan", "Élan", "été,", "漢字", "ÉTÉ", "x", "É", "...", "a\u0301"}
    long_way = [0]
    keys = _Keys()

    def seen(frame, event, _):
        long_way[0] += event == "call" and frame.f_code is shape.__code__

    sys.setprofile(seen)
    try:
        found = {w: keys[w.encode()] for w in words}
    finally:
        sys.setprofile(None)
    assert found == {w: xxhash.xxh3_64_intdigest(w.encode(), 0) & ~255 | shape(w) for w in words}
    assert long_way[0] == sum(not w.isascii() and not (w.isalpha() and w.islower()) for w in words)
