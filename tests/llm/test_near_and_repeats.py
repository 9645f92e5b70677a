import random
import re
from itertools import combinations

import numpy as np
import pytest

from fotolake.llm import ngram_join
from fotolake.llm.ngram_join import Cells, CountTree, Items, classes_within, connected, jaccard_groups, keep_first, point_of, signatures
from fotolake.llm.shingles import mixed
from fotolake.llm.suffix_dedup import LENGTH, cut_repeats, least_owners, segments
from fotolake.llm.suffixes import permuted_lcp, shard, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, k))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if any(s and t and den * len(s & t) >= num * len(s | t) for s in sets[a] for t in sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i in sets}


def near_copies(seed=3):
    """Chains of edited texts around both sides of the limit, copies, and a passage that all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    passage = [word() for _ in range(30)]
    rows = []
    for base in range(8):
        text = [word() for _ in range(rng.choice([3, 12, 60, 150]))]
        for step in range(12):
            if step % 4 != 3:
                text = list(text)
                for _ in range(rng.randint(0, max(1, len(text) // 40))):
                    text[rng.randrange(len(text))] = word()
            rows.append((base * 100 + step, " ".join(text + (passage if base % 2 else []))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
@pytest.mark.parametrize("chunk", [ngram_join.CHUNK, 400])
def test_groups_are_brute_force(make, awkward, k, num, den, chunk):
    rows = near_copies() + [(5000 + i if i is not None else None, t) for i, t in awkward]
    known = [(i, t) for i, t in rows if i is not None]
    want = components(known, k, num, den)
    found = jaccard_groups(make(rows), k, num, den, chunk).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == want
    sizes = sorted((str(i), len(shingles(t, k))) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_shingles"]) for r in found) == sizes


def test_keep_first_and_empty(make):
    rows = [(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l"), (3, "something else entirely here now"), (4, None)]
    assert sorted(r["doc_id"] for r in keep_first(make(rows)).collect()) == [1, 3, 4]
    assert jaccard_groups(make([])).count() == 0


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_linked_sets_share_a_signature_and_others_none(num, den):
    rng = np.random.default_rng(num)
    cells = Cells(num, den)
    fresh = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    for n in [1, 2, 3, 4, 5, 6, 7, 9, 11, 15, 20, 33, 60, 100, 300, 1000, 3000, 12000]:
        for _ in range(60 if n < 100 else 8):
            a = np.unique(fresh(n))
            # As far apart as a link allows: either by replaced members or by added ones.
            swap = (den - num) * n // (den + num)
            b = np.unique(np.concatenate((a[rng.permutation(n)][: n - swap], fresh(swap))))
            c = np.unique(np.concatenate((a, fresh(n * (den - num) // num))))
            sig, owner = signatures([a, b, c, np.unique(fresh(n))], cells)
            own = [set(sig[owner == i].tolist()) for i in range(4)]
            assert own[0] & own[1] and own[0] & own[2] and not own[3] & (own[0] | own[1] | own[2])


def test_tree_loses_no_link():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate((base[rng.random(len(base)) < 0.97], rng.integers(0, 2**63, rng.integers(0, 8)).astype(np.uint64)))) for _ in range(150)]
    tree = CountTree([len(s) for s in sets], [point_of(s, 64) for s in sets])
    for i in range(0, 150, 7):
        near = set(tree.within(tree.points[i], len(sets[i]), 9, 10).tolist())
        true = {j for j in range(150) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))}
        assert true <= near
    points = Items([point_of(s).tobytes() for s in sets], [len(s) for s in sets], None, 9, 10)
    assert len(classes_within(points)) == 150


def test_components_are_the_closure(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = connected(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == root


def test_suffix_arrays_are_sorted():
    rng = random.Random(7)
    for _ in range(80):
        strings = [bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abcdz") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 6))]
        text, _ = shard(strings)
        sa, plain = suffix_array(text, len(strings) + 1), text.tolist()
        assert sa.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        lcp = permuted_lcp(text, sa)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            n = next(k for k in range(len(plain)) if plain[a + k : a + k + 1] != plain[b + k : b + k + 1])
            assert lcp[b] == n


def test_suffix_sorts_look_at_wide_numbers_only_for_ties(monkeypatch):
    """Long repeats beside unlike text: order and prefixes as brute force has them, and most places sorted by digits."""
    rng = random.Random(11)
    base = bytes(rng.choice(b"abcdefgh ") for _ in range(300))
    strings = [bytes(rng.randrange(256) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    strings += [base[a : a + rng.randint(1, 90)] for a in (rng.randrange(250) for _ in range(20))]
    strings += [b"aaaaaaaaaaaaaaaaaaaaaaaaaa", b"aaaaaaaaaaaaaaaaaaaaaaaaab", bytes([0, 255] * 20), bytes([0, 255] * 12)]
    text, _ = shard(strings)
    wide, argsort = [0], np.argsort

    def counted(x, *more, **named):
        wide[0] += len(x) * (np.asarray(x).itemsize > 2)
        return argsort(x, *more, **named)

    monkeypatch.setattr(np, "argsort", counted)
    sa, plain = suffix_array(text, len(strings) + 1), text.tolist()
    assert wide[0] < len(text) / 2
    assert sa.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
    exact, bounded = permuted_lcp(text, sa), permuted_lcp(text, sa, 20)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
        n = next(k for k in range(len(plain)) if plain[a + k : a + k + 1] != plain[b + k : b + k + 1])
        assert exact[b] == n and (bounded[b] == n if n >= 20 else bounded[b] < 20)


def test_windows_of_one_string_share_their_anchor():
    rng = random.Random(8)
    text = bytes(rng.choice(b"abc ") for _ in range(400))
    a = segments([text, b"zz" + text[37:300]])
    covered = np.zeros(2, int)
    by_window = [{}, {}]
    for own, s, e, f, _ in zip(*(x.tolist() for x in a), strict=True):
        covered[own] += e - s
        for j in range(s, e):
            by_window[own][j] = f
    assert covered.tolist() == [400 - LENGTH + 1, 265 - LENGTH + 1]
    assert all(by_window[1][j + 2] == by_window[0][j + 37] for j in range(263 - LENGTH + 1))
    strings = [text[:90], text[20:110]]
    least = least_owners(strings, np.array([5, 2]))
    assert least.tolist() == [5] * 20 + [2] * 21 + [2] * 41


def cut(rows):
    """Removed bytes of each row by brute force."""
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for j in range(len(raw) - LENGTH + 1):
                w = raw[j : j + LENGTH]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        if i is not None:
            for j in range(len(raw) - LENGTH + 1):
                if least[raw[j : j + LENGTH]] < i:
                    gone[j : j + LENGTH] = [True] * LENGTH
        spans = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        out.append((str(i), len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("hot", [4096, 2])
def test_cut_repeats_is_brute_force(make, awkward, hot, monkeypatch):
    monkeypatch.setattr("fotolake.llm.suffix_dedup.HOT", hot)
    rows = [(i, t) for i, t in awkward if i != 3] + [(500 + i, t) for i, t in near_copies()[:50]]
    rows += [(700 + i, f"{i} " + "the same licence line stands in many of these documents, word for word. " * (1 + i % 3)) for i in range(12)]
    rows += [(800, "ab" * 300), (801, "ab" * 40 + "c" * 120), (802, "c" * 49), (803, "c" * 50)]
    found = cut_repeats(make(rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), bytes(r["kept"])) for r in found) == cut(rows)
    assert cut_repeats(make([])).count() == 0


def test_points_of_very_large_sets_bound_them():
    n = 4_600_000
    a = mixed(np.arange(n, dtype=np.uint64))
    b = mixed(np.arange(100, n + 100, dtype=np.uint64))
    points = Items([point_of(a).tobytes(), point_of(b).tobytes()], [n, n], None, 9, 10)
    assert classes_within(points).tolist() == [0, 0]
