import math
import random

import pytest

from fotolake.operators import graph as gr
from fotolake.operators import likeness as lk

SCHEMA = "id long, taken_at long, is_video int, trashed int, lat double, lng double, phash long, score int, eyes_closed int, width int, height int, bytes long"


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def metres(a, b):
    (y1, x1), (y2, x2) = a, b
    r = math.pi / 180
    s = math.sin((y2 - y1) * r / 2) ** 2 + math.cos(y1 * r) * math.cos(y2 * r) * math.sin((x2 - x1) * r / 2) ** 2
    return 12742000 * math.asin(min(1, math.sqrt(s)))


def photos(rng, n):
    """Hashes around few patterns, so that bands have hundreds of members; hot seconds and places, also by the pole and by 180 degrees."""
    bases = [rng.getrandbits(64) for _ in range(12)] + [0]
    spots = [(10.0, 20.0), (48.2, 179.9999), (48.2, -179.9995), (89.9999, 10.0), (89.9999, -170.0), (-33.0, 151.0)]
    rows = []
    for i in range(n):
        h = rng.choice(bases)
        for _ in range(rng.choice([0, 0, 1, 3, 5, 7, 9])):
            h ^= 1 << rng.randrange(64)
        y, x = rng.choice(spots)
        place = (min(90.0, y + rng.choice([0, 1, 2, 5]) * 0.0007), x + rng.choice([0, 1, 3]) * 0.0009) if rng.random() < 0.7 else (None, None)
        when = rng.choice([None, 0, 1_700_000_000, 1_700_000_600, -500] + [1_700_000_000 + rng.randrange(10**7) for _ in range(20)])
        rows.append((i, when, int(rng.random() < 0.05), int(rng.random() < 0.05), *place, None if rng.random() < 0.02 else signed(h), rng.randrange(100), 0, 10, 10, i))
    return rows


def by_all_pairs(rows, dup, sim, window, place_m):
    shots = [r for r in rows if not r[2] and not r[3] and r[6] is not None]
    root = {r[0]: r[0] for r in shots}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i, a in enumerate(shots):
        for b in shots[i + 1 :]:
            bits = ((a[6] ^ b[6]) & (1 << 64) - 1).bit_count()
            if bits > sim:
                continue
            near = bool(a[1] and b[1] and abs(a[1] - b[1]) <= window)
            placed = None not in (a[4], b[4]) and metres(a[4:6], b[4:6]) <= place_m
            if bits <= dup or near or placed:
                links.append((a[0], bits <= dup, near, placed))
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    members, marks = {}, {}
    for r in shots:
        members.setdefault(find(r[0]), set()).add(r[0])
    for a, copy, near, placed in links:
        c, t, p = marks.get(find(a), (True, False, False))
        marks[find(a)] = (c and copy, t or near, p or placed)
    return {g: (frozenset(m), marks[g]) for g, m in members.items() if g in marks}


@pytest.mark.parametrize("crowd", [4, 10_000])
def test_no_link_is_lost(spark, crowd, monkeypatch):
    monkeypatch.setattr(lk, "CROWD", crowd)
    rng = random.Random(crowd)
    rows = photos(rng, 3000)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    real = lk.all_alike
    monkeypatch.setattr(gr, "all_alike", lambda *a: real(*a, crowd))
    groups, members = gr.similar_groups(frame, exact=True)
    found = {}
    for r in members.collect():
        found.setdefault(r.grp, set()).add(r.id)
    marks = {r.grp: (r.kind == "copy", "time" in r.why, "place" in r.why) for r in groups.collect()}
    assert {g: (frozenset(m), marks[g]) for g, m in found.items()} == by_all_pairs(rows, 4, 12, 600, 150.0)


def test_empty_and_too_wide(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lk.all_alike(empty).collect() == []
    with pytest.raises(ValueError):
        lk.all_alike(empty, sim=14)
