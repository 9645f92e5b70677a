"""The parts of operator 7 against plain loops: features of texts, splits and leaves of trees, pools of the calibration."""

import math
import random

import numpy as np
import pytest

from fotolake.llm.boosting import Boosted, Isotonic
from fotolake.llm.toxicity import EDGES, FEATURES, NEAR, RUN, SECOND_PERSON, Words, core_of, units

LEXICON = {"vile": 2.5, "vile~": 1.0, "scumlord": 1.5, "idiot": 2.1, "moro~": 0.5}


def plain_features(text):
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    cores = [core_of(w) for w in words]
    best = [max(((LEXICON.get(u, 0.0), u) for u in units(c[0])), default=(0.0, "")) for c in cores]
    hits = [i for i in range(n) if best[i][0] > 0]
    you = [i for i in range(n) if cores[i][0] in SECOND_PERSON]
    caps = [len(c[0]) > 2 and w.strip(EDGES).isupper() for w, c in zip(words, cores, strict=True)]
    top = max(b[0] for b in best)
    share = lambda some: sum(some) / n
    return [
        len(hits) / n, math.log1p(len(hits)), top, sum(b[0] for b in best) / n, share(b[0] > 0.8 * top for b in best) if top else 0.0,
        math.log1p(len({best[i][1] for i in hits})), share(any(abs(i - j) <= NEAR for j in you) for i in hits), len(you) / n, share(caps), share(caps[i] for i in hits),
        text.count("!") / n, text.count("?") / n, share(c[1] for c in cores), share(c[2] for c in cores), share(bool(RUN.search(c[0])) for c in cores),
        share(len(c[0]) == 1 for c in cores), math.log1p(n), share(len(w) for w in words),
    ]


def test_features_are_those_of_a_loop_over_words():
    rng = random.Random(1)
    some = ["you", "Your,", "vile", "VILE!", "v1l3", "vilely", "i.d.i.o.t", "soooo", "a", "12", "$$", "moronish", "SCUMLORD?", "the", "of", "tú", "été"]
    known = Words(LEXICON)
    for n in [0, 1, 2, 5, 40, 400]:
        for _ in range(8):
            text = " ".join(rng.choice(some) for _ in range(n))
            assert np.allclose(known.features(text), plain_features(text), atol=1e-6), text


def plain_tree(x, g, h, cuts, depth, least, ridge):
    """Leaf value of each row: of all splits of a node the first that gains most, tried one by one."""

    def grow(rows, left):
        total = lambda some: sum(g[i] for i in some) ** 2 / (sum(h[i] for i in some) + ridge)
        best = (1e-9, None)
        if left:
            for f, values in enumerate(cuts):
                for cut in values:
                    low, high = [i for i in rows if x[i, f] < cut], [i for i in rows if x[i, f] >= cut]
                    if len(low) >= least and len(high) >= least:
                        gain = total(low) + total(high) - total(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, (low, high))
        if best[1]:
            return {k: v for part in best[1] for k, v in grow(part, left - 1).items()}
        leaf = sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge)
        return dict.fromkeys(rows, leaf)

    found = grow(list(range(len(x))), depth)
    return np.array([found[i] for i in range(len(x))])


def test_trees_take_the_best_of_all_splits():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=120), rng.integers(0, 4, 120), np.ones(120)])
    y = (x[:, 0] + 0.7 * x[:, 1] + rng.normal(size=120) > 1).astype(float)
    model = Boosted(trees=4, depth=2, rate=0.3, least=10).fit(x, y)
    raw = np.full(120, math.log(y.mean() / (1 - y.mean())))
    for _ in range(4):
        p = 1 / (1 + np.exp(-raw))
        raw += 0.3 * plain_tree(x, y - p, p * (1 - p), model.cuts, 2, 10, 1.0)
    assert np.allclose(model.raw(x), raw, atol=1e-9)


@pytest.mark.parametrize("seed", range(4))
def test_pools_are_the_least_squares_rising_steps(seed):
    """The rising function of least squares is at i the greatest over a <= i of the least over b >= i of the means of a to b."""
    rng = np.random.default_rng(seed)
    raw, y = rng.normal(size=60).round(1), rng.integers(0, 2, 60).astype(float)
    model = Isotonic().fit(raw, y)
    order = np.argsort(raw, kind="stable")
    s, v = raw[order], y[order]
    steps = np.array([max(min(v[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)])
    starts = np.flatnonzero(np.diff(steps.round(12), prepend=-1))
    assert np.allclose(model.y, steps[starts])
    assert np.allclose(model.x, [part.mean() for part in np.split(s, starts[1:])])
    score = model.of(np.sort(raw))
    assert (np.diff(score) >= -1e-12).all() and 0 <= score.min() and score.max() <= 1


def test_one_label_alone_makes_one_pool():
    model = Isotonic().fit(np.array([0.0, 1.0, 2.0]), np.ones(3))
    assert model.y.tolist() == [1.0] and model.of(np.array([5.0]))[0] <= 1
