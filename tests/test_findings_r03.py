"""What findings of round 3 showed: small cases that failed before."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from fotolake.catalog import Catalog
from fotolake.functions import scalars as fx
from fotolake.operators import images, joins, textindex
from fotolake.operators.graph import components
from fotolake.operators.joins import copy_pairs
from fotolake.plans.groups import shifted
from fotolake.sources import files


def test_links_meet_without_a_broadcast(spark):
    """Exploded keys and compressed files look small to the planner; no growing side may go through the driver for that."""
    rng = np.random.default_rng(8)
    hashes = [int(h) ^ int(flip) for h in rng.integers(-(2**63), 2**63 - 1, 40) for flip in (0, 1, 5, -(2**63), 2**40 + 7)]
    photos = spark.createDataFrame([(i, h, 0, 0) for i, h in enumerate(hashes)], "id long, phash long, trashed int, is_video int")
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    for most in (0, 1, 4):
        pairs = copy_pairs(photos, most)
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
        expected = {(i, j) for i in range(len(hashes)) for j in range(i) if bits(hashes[i], hashes[j]) <= most}
        assert {(max(r), min(r)) for r in pairs.collect()} == expected
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}


def test_scores_at_halves(spark):
    """21.499999999999996, 77.49999999999999, 81.49999999999999 and 63.5 in the order of the SQL twin."""
    rows = [(0.0, 105.0, 79.0, 98.0, 0.27, 0.21, 21), (506.0, 103.0, 55.0, 58.0, 0.28, 0.28, 77), (412.0, 151.0, 39.0, 82.0, 0.28, 0.28, 81), (418.0, 26.0, 88.0, 112.0, 0.25, 0.26, 64)]
    sides = [1800, 1400, 1800, 1600]
    frame = spark.createDataFrame([(*r, w) for r, w in zip(rows, sides, strict=True)], "sharp double, luma double, p5 double, p95 double, dark double, white double, score int, width int")
    score = fx.quality_score(*map(F.col, ("sharp", "luma", "p5", "p95", "dark", "white")), F.lit(0), F.col("width"), F.lit(500))
    assert frame.where(score != F.col("score")).count() == 0


def test_what_rounds_to_zero_keeps_its_sign(spark):
    """The SQL twins of vectors round -0.0000003 to -0.0, which other readers tell from 0.0."""
    rows = spark.createDataFrame([(-0.0000003,), (0.0000003,), (0.0,), (-0.0000005,), (0.1234565,), (-0.25,)], "x double")
    found = [r[0] for r in rows.select(fx.signed_round(F.col("x"), 6)).collect()]
    assert [repr(x) for x in found] == ["-0.0", "0.0", "0.0", "-1e-06", "0.123457", "-0.25"]


def test_shifted_vectors_add_in_the_kind_of_the_twin(spark, tmp_path):
    """The SQL twin of a18 adds 3 to a float as a float: 0.1f + 3 is 3.0999999046325684, not 3.1000000014901161."""
    spark.createDataFrame([(1, [0.1, 0.1], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    faces = Catalog(spark, str(tmp_path))
    assert shifted(faces, "float").first()["embedding"] == [float(np.float32(0.1)), float(np.float32(0.1) + np.float32(3))]
    assert shifted(faces).first()["embedding"][1] == float(np.float32(0.1)) + 3


def test_a_search_folds_and_asks_once(spark):
    """Needles alike but for case are compared once with each text, and only their own runs are indexed."""
    texts = spark.createDataFrame([(1, "The cat sat"), (2, "a CATALOG"), (3, None), (4, "dog%x")], "id long, text string")
    needles = spark.createDataFrame([(10, "cat"), (11, "CAT"), (12, "A_"), (13, "a_"), (14, ""), (15, None), (16, "og%x"), (17, "zzz"), (18, "___________")], "needle_id long, needle string")
    expected = {(n, i) for n in (10, 11, 12, 13) for i in (1, 2)} | {(14, i) for i in (1, 2, 4)} | {(16, 4), (18, 1)}
    assert sorted(map(tuple, textindex.search(texts, needles).collect())) == sorted(expected)
    lists, counts = textindex.postings(texts, spark.createDataFrame([("cat",), ("zzz",)], "gram string"))
    assert sorted(map(tuple, lists.collect())) == [("cat", 0, 1), ("cat", 0, 2)] and counts.count() == 1


def test_measures_asked_for_alone_are_those_of_all(spark):
    """A query takes only the measures it names; they are what measuring everything gives."""
    rng = np.random.default_rng(3)
    rows = [(str(i), w, h, c, bytearray(rng.integers(0, 256, w * h * c, dtype=np.uint8).tobytes())) for i, (w, h, c) in enumerate([(24, 24, 1), (12, 12, 3), (30, 17, 3), (600, 20, 3)])]
    pictures = spark.createDataFrame(rows, "origin string, width int, height int, nChannels int, data binary")
    whole = {r["origin"]: r for r in images.measure(pictures).collect()}
    for names in (("luma", "p5"), ("sharp",), ("phash",), ("r", "g", "b")):
        part = images.measure(pictures, *names)
        assert part.columns == ["origin", "width", "height", *names]
        assert all([r[n] for n in names] == [whole[r["origin"]][n] for n in names] for r in part.collect())


def test_an_eye_is_worked_out_once(spark):
    """The plan of a ratio stays small: sums that are used several times stand in it once."""
    eyes = spark.createDataFrame([(1, [[0.0, 0.0], [2.0, 0.0], [1.0, 0.5], [1.0, -0.5]]), (2, [[1.0, 1.0]] * 3), (3, [[1.0, 1.0]] * 2), (4, None), (5, [])], "id long, eye array<array<double>>")
    ratios = eyes.select("id", images.eye_ratio(F.col("eye")).alias("ratio"))
    assert {r["id"]: r["ratio"] for r in ratios.collect()} == {1: 0.5, 2: 1.0, 3: None, 4: None, 5: None}
    assert ratios._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 5


def test_a_spread_at_the_limit_is_structure():
    """The hashes of these pictures' copies of 9 x 8 deviate by exactly 3, which is not below 3."""
    for number in (94418, 125285, 204582, 288514, 396837, 669573, 834331, 1041343, 1146528, 1689751, 1887320, 2017972):
        grey = np.frombuffer(hashlib.md5(str(number).encode()).digest() * 36, np.uint8).reshape(24, 24).astype(float)
        assert images.dhash(np.repeat(grey[:, :, None], 3, 2)) is not None


def test_a_packet_is_read_once(spark):
    """Leaving out rows without a value must not read a packet again for each field."""
    head = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><r:RDF xmlns:r="rdf"><r:Description'
    rows = spark.createDataFrame([(1, f'{head} Rating="3"/></r:RDF></x:xmpmeta>'), (2, f"{head}/></r:RDF></x:xmpmeta>"), (3, None), (4, "none"), (5, 'xmp:Rating="2"')], "id long, value string")
    found = files.xmp_fields(rows)
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("xmltostructs(") + found._jdf.queryExecution().optimizedPlan().toString().lower().count("from_xml(") == 1
    assert sorted(tuple(r) for r in found.collect()) == [(1, 3, None, [], None), (5, 2, None, [], None)]


def test_sidecars_that_nobody_else_can_get_leave_at_once(spark, monkeypatch):
    """Cut names by the hundred: what a round settles is not written again in the next one."""
    written = []
    settled = joins.settled
    monkeypatch.setattr(joins, "settled", lambda frame: written.append(settled(frame)) or written[-1])
    names = [f"IMG_{i}" for i in range(1, 400)]
    media = spark.createDataFrame([(1, n + ".jpg") for n in names], "folder int, name string")
    cars = spark.createDataFrame([(1, n + ".j.json") for i, n in enumerate(names) if i % 3], "folder int, name string")
    found = {r["media"]: r["sidecar"] for r in joins.sidecar_match(media, cars).collect()}
    assert found == {n + ".jpg": n + ".j.json" for i, n in enumerate(names) if i % 3 and len(n) > 5}
    assert [frame.count() for frame in written[-2:]] == [0, 0]
    # A chain: every medium but the first has its own sidecar, which the one before would take next; none is refused.
    chain = [f"chain{'x' * i}" for i in range(30)]
    media = spark.createDataFrame([(1, n + ".jpg") for n in chain], "folder int, name string")
    cars = spark.createDataFrame([(1, n + ".json") for n in chain], "folder int, name string")
    written.clear()
    assert joins.sidecar_match(media, cars).count() == 29
    assert len(written) <= 10
