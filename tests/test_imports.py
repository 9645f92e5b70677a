import random

import pytest
from pyspark.sql import functions as F

from fotolake.sources import files
from fotolake.streaming import flows

LISTED = "id long, path string, size long, mtime long, sha256 string"


def one_by_one(listing, now, settle, seen):
    """(id, status) of files judged one after the other, as a plain loop."""
    met = {(p, s, m) for p, s, m, _, _ in seen}
    had = {h for *_, h, status in seen if status == "added"}
    found = []
    for i, path, size, mtime, sha in sorted(listing, key=lambda r: r[0]):
        if not size or size < 0 or mtime is None or mtime > now - settle or (path, size, mtime) in met:
            continue
        met.add((path, size, mtime))
        found.append((i, "duplicate" if sha in had else "added"))
        had.add(sha)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_import_at_once_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    listing = [(i, rng.choice("abcdef"), rng.choice([0, 1, 2, None]), rng.choice([5, 90, 99, None]), rng.choice(["x", "y", "z", None])) for i in range(60)]
    seen = [(rng.choice("abc"), rng.choice([1, 2]), rng.choice([5, 90]), rng.choice(["x", "w"]), rng.choice(["added", "baseline"])) for _ in range(rng.choice([0, 4]))]
    before = spark.createDataFrame(seen, "path string, size long, mtime long, sha256 string, status string")
    rows = flows.import_batch(spark.createDataFrame(listing, LISTED), 100, 5, before).collect()
    assert sorted((r["id"], r["status"]) for r in rows) == one_by_one(listing, 100, 5, seen)
    rows = flows.import_batch(spark.createDataFrame(listing, LISTED), 100, 5).collect()
    assert sorted((r["id"], r["status"]) for r in rows) == one_by_one(listing, 100, 5, [])


def test_import_of_one_content_in_many_files(spark):
    """A third of all rows may be copies: one is added, whatever their number."""
    rows = spark.range(30_000).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("sha256"))
    found = {r["status"]: r["count"] for r in flows.import_batch(rows, 100).groupBy("status").count().collect()}
    assert found == {"added": 20_001, "duplicate": 9_999}


def test_import_of_nothing(spark):
    assert flows.import_batch(spark.createDataFrame([], LISTED), 100).count() == 0


def test_media_files_by_name_place_and_size(spark):
    rows = [("/a/x.JPG", 1), ("/a/.b/x.jpg", 1), ("/a/.x.jpg", 1), ("/$R/x.jpg", 1), ("/a.b/x.mp4", 1), ("/a/x", 1), ("/a/y.jpg", 0), (None, 1), ("/a/z.png", None)]
    listed = spark.createDataFrame(rows, "path string, length long").withColumn("modificationTime", F.timestamp_seconds(F.lit(7)))
    assert {(r["path"], r["size"], r["mtime"]) for r in files.media_files(listed).collect()} == {("/a/x.JPG", 1, 7), ("/a.b/x.mp4", 1, 7)}


def test_entries_of_texts_that_are_no_json(spark):
    texts = spark.createDataFrame([(None, 1), ("[{", 2), ('{"a": {"uri": "u", "caption": "c"}}', 3), ("7", 4)], "value string, extra int")
    assert [tuple(r) for r in files.social_entries(texts).collect()] == [("u", "c", None)]


def test_sidecars_without_time_or_place(spark):
    texts = spark.createDataFrame([("a", '{"title": "t", "photoTakenTime": {"timestamp": "soon"}, "geoData": {"latitude": 0.0, "longitude": 3.5}}'), ("b", '{"title": "album"}'), ("c", None)], "path string, value string")
    rows = files.takeout_fields(texts.select("path", F.from_json("value", files.SIDECAR).alias("s")).select("path", "s.*")).collect()
    assert [(r["path"], r["taken_at"], r["lat"], r["lng"], r["people"], r["favorited"]) for r in rows] == [("a", None, 0.0, 3.5, [], False)]


def test_points_in_order_of_time_up_to_a_cap(spark):
    points = spark.createDataFrame([(1.0, 2.0, "2023-11-15T00:13:21+02:00"), (32.0, 34.0, "2023-11-14T22:13:20Z"), (99.0, 0.0, "2023-11-14T22:13:20Z"), (1.0, 1.0, "later"), (None, 1.0, "2023-11-14T22:13:20Z")], files.POINT)
    assert sorted(tuple(r) for r in files.track_points(points).collect()) == [(1700000000, 32.0, 34.0), (1700000001, 1.0, 2.0)]
    assert [tuple(r) for r in files.track_points(points, 1).collect()] == [(1700000000, 32.0, 34.0)]
