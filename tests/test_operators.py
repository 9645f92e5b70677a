"""Golden cases on hand-made catalogs."""

import random
import re
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolake.functions import scalars as fx
from fotolake.operators import aggregates as ag
from fotolake.operators import graph as gr
from fotolake.operators import joins as jn
from fotolake.operators import mutations as mu
from fotolake.operators import vectors as vc
from fotolake.operators import windows as wn
from fotolake.operators.rules import RuleSet, typed_queries

PHOTO = "id long, taken_at long, is_video int, trashed int, lat double, lng double, phash long, score int, width int, height int, bytes long, filename string, eyes_closed int"


def shot(i, t, phash=0, score=50, lat=None, lng=None, **more):
    row = {"is_video": 0, "trashed": 0, "width": 100, "height": 100, "bytes": 10, "filename": f"IMG_{i}.jpg", "eyes_closed": None} | more
    return (i, t, row["is_video"], row["trashed"], lat, lng, phash, score, row["width"], row["height"], row["bytes"], row["filename"], row["eyes_closed"])


@pytest.fixture
def photos(spark):
    return lambda rows: spark.createDataFrame(rows, PHOTO)


def test_five_shots_are_a_burst_and_two_are_not(photos):
    rows = [shot(i, 100 + i, score=90 if i == 3 else 50) for i in range(1, 6)] + [shot(9, 500), shot(10, 900), shot(11, 901)]
    for block in (86_400, 3):  # where blocks end does not matter
        found = {r["id"]: r for r in wn.runs(photos(rows), 2, 10, 3, block).collect()}
        assert set(found) == {1, 2, 3, 4, 5} and {r["best"] for r in found.values()} == {3}


def test_manual_series_overrule(photos, spark):
    rows = [shot(i, 100 + i) for i in range(1, 5)] + [shot(7, 9000)]
    manual = spark.createDataFrame([(2, 0), (7, 5), (1, 5)], "photo_id long, series_id long")
    found = {r["id"]: r["series"] for r in wn.find_series(photos(rows), manual).collect()}
    assert found == {3: "auto:1", 4: "auto:1", 7: "manual:5", 1: "manual:5"}
    alone = spark.createDataFrame([(2, 0), (7, 5)], "photo_id long, series_id long")
    assert {r["series"] for r in wn.find_series(photos(rows), alone).collect()} == {"auto:1"}  # one photo is no series
    lost = spark.createDataFrame([(3, 0)], "photo_id long, series_id long")
    best = [shot(i, 100 + i, score=90 if i == 3 else 50) for i in range(1, 5)]
    assert {(r["id"], r["best"]) for r in wn.find_series(photos(best), lost).collect()} == {(1, 1), (2, 1), (4, 1)}
    ids = spark.createDataFrame([(1,), (4,), (4,)], "id long")
    made = {tuple(r) for r in wn.make_series(manual, ids).collect()}
    assert made == {(2, 0), (7, 5), (1, 6), (4, 6)} and {tuple(r) for r in wn.unseries(manual, ids).collect()} == {(2, 0), (7, 5), (1, 0), (4, 0)}
    assert wn.make_series(manual, ids.where("id = 1")).count() == 3


def test_open_eyes_decide_a_tie(photos):
    rows = [shot(i, 100 + i, eyes_closed=1 if i == 1 else 0) for i in range(1, 4)]
    found = wn.find_bursts(photos(rows))
    assert {r["best"] for r in found.collect()} == {2}
    assert {r["id"] for r in wn.stacked(photos([*rows, shot(9, 900)]), found).collect()} == {2, 9}


def test_numbers_and_neighbours_of_one_second(spark, photos):
    rows = [shot(i, 1000 if i < 70 else 1000 + i) for i in range(90)]
    placed = wn.numbered(photos(rows).select("id", "taken_at"), ["taken_at", "id"])
    assert {r["id"]: r["place"] for r in placed.collect()} == {i: i for i in range(90)}
    want = {(i, j) for i in range(90) for j in range(i + 1, min(i + 4, 90)) if rows[j][1] - rows[i][1] <= 50}
    assert {tuple(r) for r in jn.time_neighbors(photos(rows), 50, 3).collect()} == want
    short = jn.following(photos(rows).select("id", "taken_at"), ["taken_at", "id"], 3, F.col("id"), block=5)
    assert {r["id"]: r["next"] for r in short.collect()} == {i: list(range(i + 1, min(i + 4, 90))) for i in range(90)}


def test_prev_next_equals_one_window(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(500), rng.randrange(100) if rng.random() < 0.4 else None) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, t long, v long")
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {}
    for n, r in enumerate(ordered):
        want[r[0]] = (next((x[2] for x in ordered[:n][::-1] if x[2] is not None), None), next((x[2] for x in ordered[n + 1 :] if x[2] is not None), None))
    for block in (7, 100, 10_000):
        found = wn.prev_next(frame, ["t", "id"], F.col("v"), "v", (), block).collect()
        assert {r["id"]: (r["v_prev"], r["v_next"]) for r in found} == want


def test_scans_within_keys_that_may_be_null(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "a", "a", "b"]), rng.randrange(5), rng.randrange(9) if rng.random() < 0.3 else None) for i in range(150)]
    frame = spark.createDataFrame(rows, "id long, k string, t long, v long")
    found = {r["id"]: (r["v_prev"], r["v_next"]) for r in wn.prev_next(frame, ["t", "id"], F.col("v"), "v", ("k",), 4).collect()}
    for r in rows:
        mine = sorted((x[2], x[0], x[3]) for x in rows if x[1] == r[1] and x[3] is not None)
        before, after = [x[2] for x in mine if x[:2] < (r[2], r[0])], [x[2] for x in mine if x[:2] > (r[2], r[0])]
        assert found[r[0]] == (before[-1] if before else None, after[0] if after else None)
    placed = wn.numbered(frame, ["k", "t", "id"], "n")
    sums = {r["id"]: r["s"] for r in wn.summed_before(placed, "n", F.coalesce("v", F.lit(0)), "s", 150, ("k",), 4).collect()}
    assert all(sums[r[0]] == sum(x[3] or 0 for x in rows if x[1] == r[1] and (x[2], x[0]) < (r[2], r[0])) for r in rows)


def test_a_crowded_second_is_many_blocks(spark):
    """A hundred thousand rows of one time: no window takes more than a block of them."""
    n, block = 100_000, 1000
    frame = spark.range(n).select("id", F.lit(7).alias("t"), F.when(F.col("id") % 7000 == 0, F.col("id")).alias("v"))
    found = wn.prev_next(frame, ["t", "id"], F.col("v"), "v", (), block)
    wrong = found.where("v_prev is distinct from case when id > 0 then (id - 1) div 7000 * 7000 end or v_next is distinct from case when id < 98000 then (id div 7000 + 1) * 7000 end")
    assert wrong.isEmpty()
    placed = wn.numbered(frame, ["t", "id"], "n")
    assert placed.groupBy(F.floor(F.col("n") / block)).count().agg(F.max("count")).first()[0] == block


def test_track_interpolates(photos, spark):
    track = spark.createDataFrame([(1000, 32.0, 34.0), (1100, 32.1, 34.2), (5000, 1.0, 1.0)], "ts long, lat double, lng double")
    rows = [shot(1, 1050), shot(2, 1900), shot(3, 3000), shot(4, 1000), shot(5, 50, lat=1.0, lng=1.0), shot(6, 0)]
    found = {r["id"]: (r["lat"], r["lng"]) for r in jn.geotag_from_track(photos(rows), track).collect()}
    assert found == {1: (32.05, 34.1), 2: (32.1, 34.2), 4: (32.0, 34.0)}


def test_similar_groups_with_golden_members(photos):
    rows = [shot(1, 1000, 0b0), shot(2, 1010, 0b11, 90), shot(3, 1020, 0b1100), shot(4, 99_000, 0b1), shot(5, 500_000, 0x0F0F0F0F0F0F), shot(6, 900_000, 0b111111111), shot(7, 10, 0x7FFF << 40, lat=1.0, lng=1.0), shot(8, 700, 0x7FFE << 40, 80, lat=1.0, lng=1.0)]
    found = {r["grp"]: r for r in gr.similar_groups(photos(rows))[0].collect()}
    assert set(found) == {1, 7} and found[1]["n"] == 4 and found[1]["best"] == 2 and found[7]["best"] == 8
    assert {tuple(r) for r in gr.similar_groups(photos(rows))[1].collect()} == {(1, 1), (1, 2), (1, 3), (1, 4), (7, 7), (7, 8)}
    # Shots without a hash do not use up the neighbours in time; copies are found however full their bands are.
    crowd = [shot(1, 1000, 0b111), shot(99, 1050, 0b111)] + [shot(100 + i, 1001 + i, None) for i in range(48)]
    assert gr.similar_groups(photos(crowd), bucket=1)[0].first()["n"] == 2
    many = [shot(i, i * 10_000, 1 << (i % 2)) for i in range(1, 200)]
    assert gr.similar_groups(photos(many))[0].first()["n"] == 199


def test_components_are_closures(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["node"]: r["root"] for r in gr.components(spark.createDataFrame(edges, "a long, b long")).collect()} == root


def test_clustering_by_components_is_clustering_of_all(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 12))
    x = np.concatenate([c + rng.normal(scale=0.35, size=(9, 12)) for c in centers])
    want = gr.average_linkage(x, 0.38)
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<float>")
    found = {r["id"]: r["cluster"] for r in gr.cluster_faces(frame, 0.38).collect()}
    same = lambda label: {frozenset(i for i in range(len(x)) if label[i] == c) for c in set(label.values())}
    assert same(found) == same(dict(enumerate(want.tolist())))
    rounds = {r["id"]: r["cluster"] for r in gr.cluster_faces(frame, 0.38, whole=0, block=20).collect()}
    assert rounds == found
    near = gr.close_links(frame, 0.3, block=10)
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if unit[i] @ unit[j] >= 0.7]
    root = {r["node"]: r["root"] for r in gr.components(near).collect()}
    assert root == {r["node"]: r["root"] for r in gr.components(spark.createDataFrame(pairs, "a long, b long")).collect()}


def test_deferred_acceptance_is_the_greedy(spark):
    rng = random.Random(4)
    faces = [(i, i, rng.randrange(12)) for i in range(150)]
    people = [(i, rng.randrange(8)) for i in range(150) if rng.random() < 0.8]
    t = SimpleNamespace(faces=spark.createDataFrame(faces, "id long, photo_id long, cluster_id long"), photo_people=spark.createDataFrame(people, "photo_id long, person_id long"))
    size, votes, of = {}, {}, dict(people)
    for _, p, c in faces:
        size[c] = size.get(c, 0) + 1
        if p in of:
            votes[c, of[p]] = votes.get((c, of[p]), 0) + 1
    want, taken = {}, set()
    for c in sorted(size, key=lambda c: (-size[c], c)):
        free = [(-v, p) for (k, p), v in votes.items() if k == c and p not in taken]
        if free:
            want[c] = min(free)[1]
            taken.add(want[c])
    assert {r["cluster_id"]: r["person_id"] for r in ag.cluster_vote(t).collect()} == want


def test_typed_queries(spark):
    people = spark.createDataFrame([(1, "Dana Levi"), (2, "Ron"), (3, "Dana Cohen")], "id long, name string")
    asked = spark.createDataFrame([(1, "dana levi 2023 beach"), (2, "Ron 1800 x"), (3, "dana"), (4, ""), (5, "Levi ron dana cohen")], "query_id long, query string")
    found = {r["query_id"]: (r["person_ids"], r["years"], r["words"]) for r in typed_queries(asked, people).collect()}
    assert found == {1: ([1], [2023], ["beach"]), 2: ([2], [], ["1800", "x"]), 3: ([], [], ["dana"]), 4: ([], [], []), 5: ([1, 2, 3], [], [])}


def test_no_rules_select_nothing(photos):
    assert RuleSet({}).select(SimpleNamespace(photos=photos([shot(1, 5)]))).count() == 0
    assert RuleSet({"minRating": 0, "text": ""}).empty and not RuleSet({"hourFrom": 0}).empty


def test_folder_diff_and_its_guard(spark):
    schema = "path string, size long, mtime long, sha string, photo_id long"
    known = spark.createDataFrame([(f"p{i}", 1, 1, f"s{i}", i) for i in range(50)], schema)
    disk = spark.createDataFrame([("p0", 1, 1, "s0", None), ("p1", 2, 1, "x", None), ("new/p2", 1, 1, "s2", None), ("copy", 1, 1, "s0", None), ("n", 1, 1, "fresh", None)], schema).drop("photo_id")
    found = {r["path"]: (r["change"], r["photo_id"]) for r in jn.folder_diff(disk, known).collect()}
    assert found["new/p2"] == ("moved", 2) and found["copy"][0] == "duplicate" and found["n"][0] == "new" and found["p1"] == ("changed", 1)
    assert found["p9"] == ("held", 9) and "p2" not in found and "p0" not in found


def test_sidecars_by_three_rules(spark):
    schema = "folder string, name string"
    media = spark.createDataFrame([("f", x) for x in ("a.jpg", "longname123456.jpg", "b(1).jpg", "none.jpg")], schema)
    cars = spark.createDataFrame([("f", x) for x in ("a.jpg.json", "longname12345.json", "b.jpg(1).json")], schema)
    assert {(r["media"], r["sidecar"]) for r in jn.sidecar_match(media, cars).collect()} == {("a.jpg", "a.jpg.json"), ("longname123456.jpg", "longname12345.json"), ("b(1).jpg", "b.jpg(1).json")}


def greedy_sidecars(media, cars):
    """The rules one medium after the other, as plain loops."""
    target = {j: re.sub(r"(?i)\.supplemental[\w-]*\.json$", "", j) if re.search(r"(?i)\.supplemental[\w-]*\.json$", j) else re.sub(r"(?i)\.json$", "", j) for j in sorted(cars)}
    stem = lambda x: x.rpartition(".")[0] or x
    loose = lambda x: re.sub(r"\(\d+\)|\s+", "", x).lower()
    out, left = {}, dict(target)
    for m in sorted(media):
        exact = [j for j, t in left.items() if t == m]
        cut = sorted(((len(stem(t)), j) for j, t in left.items() if len(stem(t)) >= 6 and stem(m).startswith(stem(t))), reverse=True)
        moved = [j for j, t in left.items() if loose(t) == loose(m)]
        for j in (*exact, *(j for _, j in cut), *moved):
            out[m] = j
            left.pop(j)
            break
    return out


def test_sidecars_are_the_greedy(spark):
    rng = random.Random(11)
    media, cars = [], []
    for folder in range(12):
        names = {rng.choice(["IMG_2024", "IMG_20245", "holiday picture", "a"]) + rng.choice(["", "1", "12", "(1)", "(2)"]) + rng.choice([".jpg", ".png", ""]) for _ in range(9)}
        own = {n[: rng.choice([99, 99, 8, 9])] + rng.choice(["", "(1)"]) + rng.choice([".json", ".supplemental-metadata.json", ".JSON"]) for n in names for _ in range(2)}
        media += [(str(folder), n) for n in names]
        cars += [(str(folder), n) for n in own]
    found = jn.sidecar_match(spark.createDataFrame(media, "folder string, name string"), spark.createDataFrame(cars, "folder string, name string")).collect()
    want = {(str(f), m): j for f in range(12) for m, j in greedy_sidecars([n for g, n in media if g == str(f)], [n for g, n in cars if g == str(f)]).items()}
    assert {(r["folder"], r["media"]): r["sidecar"] for r in found} == want


def test_rate_limit_is_a_plain_loop(spark):
    from fotolake.streaming.flows import rate_limit

    rng = random.Random(12)
    rows = [(k, rng.randrange(200_000)) for k in range(3) for _ in range(120)]
    want = []
    for k in range(3):
        taken = []
        for at in sorted(a for c, a in rows if c == k):
            hour, day = ([t for t in taken if t > at - span] for span in (3600, 86_400))
            ok = len(hour) < 10 and len(day) < 30
            want.append((k, at, ok))
            taken += [at] if ok else []
    found = rate_limit(spark.createDataFrame(rows, "key long, at long")).select("key", "at", "accepted").collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_smart_searches(spark, photos):
    from fotolake.operators.rules import is_smart

    rows = [('{"smart": true}',), ('{"years": [2020]}',), ('{"years": []}',), ('{"minRating": 0, "kind": "photo"}',), ("[1]",), ("nothing",), (None,)]
    frame = spark.createDataFrame(rows, "c string")
    assert [r["x"] for r in frame.select(F.coalesce(is_smart(F.col("c")), F.lit(False)).alias("x")).collect()] == [True, True, False, False, False, False, False]
    t = SimpleNamespace(photos=photos([shot(1, 5, score=1), shot(2, 6, is_video=1)]))
    assert [r["id"] for r in mu.saved_search_evaluate(t, '{"kind": "video"}').collect()] == [2] and mu.saved_search_evaluate(t, "no json").count() == 0


def test_albums_links_and_merges(spark):
    albums = spark.createDataFrame([(1, "a", "album"), (4, "b", "year")], "id long, name string, kind string")
    assert [tuple(r) for r in mu.album_create(albums, " c ").where("id > 4").collect()] == [(5, "c", "album")]
    assert {r["name"] for r in mu.album_rename(albums, 1, "z").collect()} == {"z", "b"}
    for call in (lambda: mu.album_create(albums, "a"), lambda: mu.album_rename(albums, 1, "b"), lambda: mu.album_create(albums, " ")):
        with pytest.raises(ValueError):
            call()
    tags = spark.createDataFrame([(3, "Beach"), (7, "beach"), (5, "sea")], "id long, name string")
    links = spark.createDataFrame([(1, 2)], "a long, b long")
    pairs = spark.createDataFrame([("BEACH", "sea"), ("new", "sea"), ("sea", "Sea"), (" ", "x")], "x string, y string")
    found, named = mu.tag_link_add(links, tags, pairs)
    assert {tuple(r) for r in found.collect()} == {(1, 2), (3, 5), (5, 8)} and {r["name"] for r in named.where("id > 7").collect()} == {"new"}
    assert mu.tag_link_remove(found, spark.createDataFrame([(5, 3)], "a long, b long")).count() == 2
    faces = spark.createDataFrame([(1, 9, None), (2, 9, 3), (3, 8, None)], "id long, cluster_id long, person_id long")
    bridge = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "photo_id long, person_id long, source string")
    assert {tuple(r) for r in mu.merge_people(bridge, faces, ("person", 1), ("person", 2))[0].collect()} == {(1, 2, "y"), (2, 2, "z")}
    assert [r["person_id"] for r in mu.merge_people(bridge, faces, ("cluster", 9), ("person", 5))[1].orderBy("id").collect()] == [5, 3, None]
    assert [r["cluster_id"] for r in mu.merge_people(bridge, faces, ("cluster", 9), ("cluster", 8))[1].collect()] == [8, 8, 8]
    with pytest.raises(ValueError):
        mu.merge_people(bridge, faces, ("person", 1), ("cluster", 8))


def one_by_one(rows, start, ignore_case):
    """Names as given to one file after the other."""
    used, out = {}, {}
    for i, folder, name in sorted(rows):
        fold = str.lower if ignore_case else str
        mine = used.setdefault(folder or "", set())
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
        found, n = name, start
        while fold(found) in mine:
            found, n = f"{stem} ({n}){ext}", n + 1
        mine.add(fold(found))
        out[i] = found
    return out


@pytest.mark.parametrize(("start", "ignore_case"), [(1, True), (2, False)])
def test_unique_names_equal_one_by_one(spark, start, ignore_case):
    rng = random.Random(start)
    fixed = ["a.jpg", "a.jpg", "a (1).jpg", "a (1) (1).jpg", "A.jpg", "a (2).jpg", "a (1).jpg", "a (1) (1).jpg", ".hidden", ".hidden", "b", "b", "c.", "c.", "d (01).x", "d.x", "d.x", "d (0).x", " (1).jpg", ".jpg", ".jpg", "e.tar.gz", "e.tar.gz", ""]
    rows = [(i, "f", n) for i, n in enumerate(fixed)]
    for i in range(400):
        name = rng.choice(["p", "P", "q.r"]) + "".join(f" ({rng.choice([0, 1, 1, 2, 3, 4, 9, 30])})" for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3]))) + rng.choice([".jpg", ".jpg", "", ".JPG"])
        rows.append((100 + i, rng.choice(["f", "g", None]), name))
    rows += [(600 + i, "h", f"z ({i + 1}).png" if i < 40 else "z.png") for i in range(60)]
    rng.shuffle(rows)
    found = wn.unique_names(spark.createDataFrame(rows, "id long, folder string, name string"), start, ignore_case).collect()
    assert {r["id"]: r["unique"] for r in found} == one_by_one(rows, start, ignore_case)
    assert wn.unique_names(spark.createDataFrame([], "id long, folder string, name string")).collect() == []
    odd = [(i, "f", n) for i, n in enumerate(["c.", "c.", "c. (1)", "c. (1)", "c (1).", "c (1).", "c (1). (1)", None, None])]
    names = [r["unique"].lower() for r in wn.unique_names(spark.createDataFrame(odd, "id long, folder string, name string"), start, ignore_case).collect()]
    assert len(set(names)) == len(odd)


def test_search_finds_itself_first(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 64))
    frame = spark.createDataFrame([(1000 + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    assert vc.semantic_search(frame, x[17].tolist()).orderBy(F.desc("score")).first()["id"] == 1017


def test_a_model_that_fails_leaves_null(spark):
    def model(contents):
        if any(c == b"bad" for c in contents):
            raise ValueError
        return np.array([[float(len(c))] for c in contents])

    rows = spark.createDataFrame([(1, "a", bytearray(b"xx")), (2, "b", bytearray(b"bad")), (3, "c", bytearray(b"x"))], "id long, sha256 string, content binary")
    assert {r["id"]: r["embedding"] for r in vc.embed_batch(rows, model).collect()} == {1: [2.0], 2: None, 3: [1.0]}


def test_mutations_round_trip(photos, spark):
    base = photos([shot(i, 5, score=i) for i in range(5)])
    ids = spark.createDataFrame([(1,), (3,)], "id long")
    image = mu.before_image(base, ids, {"score": 3})
    assert [r["id"] for r in image.collect()] == [1]
    patched = mu.batch_patch(base, ids, {"score": 3}, 9)
    assert {r["id"]: r["score"] for r in patched.collect()} == {0: 0, 1: 3, 2: 2, 3: 3, 4: 4}
    assert sorted(map(tuple, mu.undo(patched, image).collect()), key=lambda r: r[0]) == sorted(map(tuple, base.collect()), key=lambda r: r[0])


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(fx.fix_mojibake(F.lit("Ã©tÃ©"))) == "été" and get(fx.fix_mojibake(F.lit("é"))) == "é" and get(fx.fix_mojibake(F.lit("שלום"))) == "שלום"
    assert tuple(get(fx.parse_coords(F.lit("32.08°N 34.78°W")))) == (32.08, -34.78) and get(fx.parse_coords(F.lit("132, 5"))) is None
    assert get(fx.date_from_filename(F.lit("IMG_20240230.jpg"), 2024)) is None and get(fx.date_from_filename(F.lit("x2024-02-03 101112.jpg"), 2024)) == 1706955072
    assert get(fx.natural_key(F.lit("IMG_2"))) < get(fx.natural_key(F.lit("IMG_10")))
    dates = ["IMG_2024050112345.jpg", "IMG-20240501-WA0003.jpg", "2024-05-01 10.15.30.png", "PXL_20240501_101530123.jpg", "a.20240501", "x/20240501.jpg"]
    assert [get(fx.date_from_filename(F.lit(d), 2024)) for d in dates] == [None, 1714521600, 1714558530, 1714521600, None, 1714521600]
    kinds = {"Itamar, dafna": "people-share", "2019": "album", "Photos from 2019 (2)": "year", "תמונות משנת 2020": "year"}
    assert {k: get(fx.album_kind(F.lit(k))) for k in kinds} == kinds
    colour = lambda *c: get(fx.colour_bucket(*map(F.lit, c)))
    assert [colour(43, 10, 10), colour(100, 20, 20), colour(250, 10, 10), colour(0, 200, 200), colour(128, 128, 128)] == ["black", "brown", "red", "cyan", "gray"]
    assert get(fx.parse_score(F.lit("photo 2 score: 85"))) == 85 and get(fx.parse_score(F.lit("it is 7 of 10"))) == 7 and get(fx.parse_score(F.lit("none 0"))) is None
    assert get(fx.parse_keywords(F.lit('x {"keywords": ["A b", "c", "a  B"]} y'))) == ["a b"] and get(fx.parse_keywords(F.lit("Keywords: sea; - sun\n* x"))) == ["sea", "sun"]
    assert get(fx.label_map(F.lit(" RED "))) == "red" and get(fx.label_map(F.lit("rot"))) is None
    assert get(fx.lr_time(F.lit("2019-05-04T13:22:10.5+02:00"))) == 1556976130 and get(fx.lr_time(F.lit("2019-02-30"))) is None
    sharp = lambda *m: get(fx.quality_score(*[F.lit(x) for x in m]))
    assert sharp(400.0, 120.0, 10.0, 160.0, 0.0, 0.0, 0, 4000, 3000) == 100 and sharp(400.0, 120.0, 10.0, 160.0, 0.0, 0.0, 1, 4000, 3000) == 60
    assert sharp(400.0, 20.0, 0.0, 75.0, 0.4, 0.0, 0, 500, 500) == 61 and sharp(0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1, 10, 10) == 1
    redacted = fx.redact_text(F.lit("a@b.co 127.0.0.1 8.8.8.8 C:\\dana\\x dana danab 1.2.3.4.5"), ["C:/dana"], "dana")
    assert get(redacted) == "<email> 127.0.0.1 <ip> <folder>\\x <user> danab <ip>.5"
    assert get(fx.hamming64(F.lit(-1).cast("long"), F.lit(0).cast("long"))) == 64


def test_wall_clock_ignores_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        row = spark.range(1).select(F.hour(fx.wall(F.lit(1_700_000_000))).alias("u"), F.hour(fx.wall(F.lit(1_700_000_000), "Asia/Jerusalem")).alias("j")).first()
        assert (row["u"], row["j"]) == (22, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_names_of_edited_copies_and_sidecars(spark):
    get = lambda c: spark.range(1).select(c).first()[0]
    stems = {
        "IMG_1234-edited (1).JPG": "img_1234", "IMG_1234edited.jpg": "img_1234", "IMG_1234(2).JPG": "img_1234", " IMG_9_collage(3).png": "img_9", ".hidden": ".hidden",
        "a.b.jpeg": "a.b", "edited.jpg": "", "x.": "x.", "clip - Motion.mp4": "clip", "IMG (1)-effects (2).heic": "img",
    }
    assert {n: get(fx.media_stem(F.lit(n))) for n in stems} == stems
    targets = {"a.jpg.supplemental-meta.json": "a.jpg", "a.jpg.supplemental-metadata(1).json": "a.jpg.supplemental-metadata(1)", "a.jpg.JSON": "a.jpg", "a.jpg.suppl.json": "a.jpg.suppl", "b": "b"}
    assert {n: get(fx.sidecar_target(F.lit(n))) for n in targets} == targets
    assert get(fx.norm_counter(F.lit("IMG 1(1).JPG"))) == get(fx.norm_counter(F.lit("img1.jpg(1)"))) == "img1.jpg"


def test_natural_order_of_any_number(spark):
    names = ["PXL_20240101123456790.jpg", "PXL_20240101123456089.jpg", "IMG_10", "img_2", "IMG_002", "IMG_2a", "IMG", "IMG!", "a1b20", "a1b3", "9", "10", "9x", "0", "000"]
    import re

    want = sorted(names, key=lambda n: ([int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", n)], n))
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r["name"] for r in frame.orderBy(fx.natural_key(F.col("name")), "name").collect()] == want


def test_clusters_of_more_faces_choose_first(spark):
    """Cluster 2 has more faces on fewer photos."""
    faces = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 3), (4, 2, 3), (5, 2, 3)], "id long, cluster_id long, photo_id long")
    people = spark.createDataFrame([(1, 9), (2, 9), (3, 9)], "photo_id long, person_id long")
    assert [tuple(r) for r in ag.cluster_vote(SimpleNamespace(faces=faces, photo_people=people)).collect()] == [(2, 9)]


def test_restore_counts_what_stays_missing(spark):
    backup = spark.createDataFrame([("a", "x", True), ("b", "y", True), ("c", "z", False), ("d", "w", False)], "path string, sha string, there boolean")
    live = spark.createDataFrame([("b", "other"), ("d", "w")], "path string, sha string")
    assert jn.restore_summary(backup, live, True).first().asDict() == {"files": 2, "missing": 1, "changed": 1, "missing_files": 1}
    assert jn.restore_summary(backup, live, True, True).first()["files"] == 1
