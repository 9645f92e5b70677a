import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from fotolake.operators import images
from fotolake.operators.windows import find_bursts
from fotolake.sources import files
from fotolake.streaming import flows


def png(path, rgb):
    """A raw PNG of an array."""
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_pictures_are_measured(spark, tmp_path):
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 255, (90, 120, 3))
    png(tmp_path / "noise.png", noise)
    png(tmp_path / "copy.png", np.clip(noise + 2, 0, 255))
    png(tmp_path / "red.png", np.tile(np.array([200, 10, 10]), (60, 60, 1)))
    png(tmp_path / "Screenshot_1.png", np.full((50, 80, 3), 250))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    rows = {r["origin"].rsplit("/", 1)[1]: r for r in images.scored(images.measure(images.image_pixels(spark, str(tmp_path)))).collect()}
    assert set(rows) == {"noise.png", "copy.png", "red.png", "Screenshot_1.png"}
    assert bin((rows["noise.png"]["phash"] ^ rows["copy.png"]["phash"]) & (2**64 - 1)).count("1") <= 6
    assert rows["red.png"]["phash"] is None and rows["red.png"]["colour"] == "red" and rows["Screenshot_1.png"]["screenshot"] == 1
    assert rows["noise.png"]["sharp"] > 1000 > rows["red.png"]["sharp"]


def test_eye_ratio_tells_open_from_closed(spark):
    flat = [[float(x), 0.01 * (x % 2)] for x in range(8)]
    round_ = [[float(np.cos(a)), float(np.sin(a))] for a in np.linspace(0, 6, 8)]
    rows = spark.createDataFrame([(1, 0.9, 10.0, 60.0, flat, flat), (2, 0.9, 10.0, 60.0, round_, round_), (3, 0.2, 10.0, 60.0, flat, flat)], "photo_id long, det_score double, x1 double, x2 double, left_eye array<array<double>>, right_eye array<array<double>>")
    photos = spark.createDataFrame([(i, 100) for i in (1, 2, 3)], "id long, width int")
    assert {r["photo_id"]: r["eyes_closed"] for r in images.closed_eyes(rows, photos).collect()} == {1: 1, 2: 0}


def test_files_and_exports(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".hidden").mkdir()
    for name, size in (("a/x.jpg", 3), ("a/empty.jpg", 0), (".hidden/y.jpg", 2), ("a/z.txt", 2)):
        (tmp_path / name).write_bytes(b"q" * size)
    assert [r["path"].rsplit("/", 1)[1] for r in files.folder_walk(spark, str(tmp_path)).collect()] == ["x.jpg"]
    export = tmp_path / "export"
    export.mkdir()
    (export / "x.jpg.json").write_text(json.dumps({"title": "x.jpg", "photoTakenTime": {"timestamp": "1700000000"}, "geoData": {"latitude": 0.0, "longitude": 0.0}, "people": [{"name": "Ron"}], "favorited": True}))
    (export / "metadata.json").write_text(json.dumps({"title": "Trip", "description": "d"}))
    row = files.takeout_json(spark, str(export)).first()
    assert (row["taken_at"], row["lat"], row["people"], row["favorited"], row["trashed"]) == (1700000000, None, ["Ron"], True, False)
    assert files.takeout_album_meta(spark, str(export)).first()["title"] == "Trip"
    social = tmp_path / "social"
    social.mkdir()
    (social / "posts.json").write_text(json.dumps([{"media": [{"uri": "m/1.jpg", "creation_timestamp": 5, "title": "t"}, {"deep": {"uri": "m/2.jpg"}}]}]))
    assert {(r["uri"], r["caption"], r["created"]) for r in files.social_json_index(spark, str(social)).collect()} == {("m/1.jpg", "t", 5), ("m/2.jpg", None, None)}
    gpx = tmp_path / "gpx"
    gpx.mkdir()
    (gpx / "t.gpx").write_text('<gpx><trk><trkseg><trkpt lat="32" lon="34"><time>2023-11-14T22:13:20Z</time></trkpt><trkpt lat="99" lon="34"><time>2023-11-14T22:13:20Z</time></trkpt></trkseg></trk><wpt lat="1" lon="2"><time>2023-11-15T00:13:21+02:00</time></wpt><wpt lat="1" lon="2"></wpt></gpx>')
    assert [tuple(r) for r in files.gpx_points(spark, str(gpx)).collect()] == [(1700000000, 32.0, 34.0), (1700000001, 1.0, 2.0)]


def test_snapshot_is_complete_or_absent(spark, tmp_path):
    manifest = files.catalog_snapshot({"t": spark.range(7).toDF("id")}, str(tmp_path / "snap"), 5, "regular").first()
    assert manifest["reason"] == "regular" and manifest["counts"]["t"] == 7


def test_snapshot_is_of_one_moment(spark, tmp_path, monkeypatch):
    """Tables that grow while they are copied: rows that came after the start are in no copy."""
    paths = {n: str(tmp_path / n) for n in ("a", "b")}
    for n, p in paths.items():
        spark.range(5).select("id", F.lit(n).alias("x.y")).write.parquet(p)
    real = files.pinned

    def growing(session, listed):
        held = real(session, listed)
        for p in listed.values():
            spark.range(100).select("id", F.lit("late").alias("x.y")).write.mode("append").parquet(p)
        return held

    monkeypatch.setattr(files, "pinned", growing)
    manifest = files.catalog_snapshot(paths, str(tmp_path / "snap"), 5, "regular", spark).first()
    assert manifest["counts"].asDict() == {"a": 5, "b": 5}
    want = {n: files.table_digest(spark.range(5).select("id", F.lit(n).alias("x.y")).repartition(3)).first()["digest"] for n in paths}
    assert manifest["digests"].asDict() == want and want["a"] != want["b"]


def _stream(spark, tmp_path, name, frames):
    folder = tmp_path / name
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(str(folder))
    return flows.read_stream(spark, str(folder), frames[0].schema)


def _all(query, out):
    query.awaitTermination(120)
    return out


def test_streamed_bursts_equal_the_batch(spark, tmp_path):
    rows = [(i, 1000 + (i // 4) * 600 + (i % 4) * 2, 1 << (i % 4), 40 + (i * 7) % 60) for i in range(24)]
    batch = spark.createDataFrame([(i, t, 0, 0, h, s, 10, 10, 1) for i, t, h, s in rows], "id long, taken_at long, is_video int, trashed int, phash long, score int, width int, height int, bytes long")
    want = {(r["run"], r["n"], r["best"]) for r in find_bursts(batch.withColumn("eyes_closed", F.lit(None).cast("int"))).select("run", "n", "best").distinct().collect()}
    shots = batch.select(F.lit("a").alias("source"), "id", F.timestamp_seconds("taken_at").alias("ts"), "phash", F.col("score").cast("long").alias("score"))
    late = spark.createDataFrame([("a", 999, 10_000_000, 0, 1)], "source string, id long, t long, phash long, score long").select("source", "id", F.timestamp_seconds("t").alias("ts"), "phash", "score")
    stream = _stream(spark, tmp_path, "shots", [shots.where("id < 10"), shots.where("id >= 10"), late])
    found: list = []
    query = flows.run_available(flows.stream_bursts(stream), str(tmp_path / "cp"), lambda f, n: found.extend(f.collect()))
    _all(query, found)
    assert {(r["first_id"], r["n"], r["best"]) for r in found} == want


def test_imports_are_seen_once(spark, tmp_path):
    schema = "id long, path string, size long, mtime long, sha256 string"
    first = spark.createDataFrame([(1, "a", 5, 10, "x"), (2, "b", 0, 10, "y"), (3, "c", 5, 995, "z")], schema)
    second = spark.createDataFrame([(1, "a", 5, 10, "x"), (4, "d", 5, 10, "x"), (5, "e", 5, 10, "w")], schema)
    seen, out = str(tmp_path / "seen"), str(tmp_path / "out")
    flows.baseline(spark.createDataFrame([(9, "old", 1, 1, "o")], schema), seen)
    flows.auto_import(_stream(spark, tmp_path, "in", [first]), seen, out, str(tmp_path / "cp"), 1000).awaitTermination(120)
    second.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    flows.auto_import(flows.read_stream(spark, str(tmp_path / "in"), first.schema), seen, out, str(tmp_path / "cp"), 1000).awaitTermination(120)
    assert {r["path"] for r in spark.read.parquet(out).collect()} == {"a", "e"}
    assert {(r["path"], r["status"]) for r in spark.read.parquet(seen).collect()} == {("old", "baseline"), ("a", "added"), ("d", "duplicate"), ("e", "added")}


def test_alerts_are_throttled(spark, tmp_path):
    rows = spark.createDataFrame([("disk", 1000, True), ("disk", 1100, True), ("disk", 1200, False), ("disk", 1300, True), ("net", 1005, True), ("disk", 1300 + 43_200, True), ("late", 90_000, False)], "alert string, at long, active boolean")
    found: list = []
    query = flows.run_available(flows.alert_throttle(_stream(spark, tmp_path, "alerts", [rows])), str(tmp_path / "cp"), lambda f, n: found.extend(f.collect()))
    _all(query, found)
    assert {(r["alert"], r["at"]) for r in found} == {("disk", 1000), ("disk", 1300), ("net", 1005), ("disk", 44_500)}


def test_rate_limit_counts_what_was_accepted(spark):
    rows = spark.createDataFrame([(1, t) for t in range(0, 1200, 60)] + [(1, 3_700)], "key long, at long")
    found = {r["at"]: (r["accepted"], r["wait_min"]) for r in flows.rate_limit(rows).collect()}
    assert sum(a for a, _ in found.values()) == 11 and found[600] == (False, 51) and found[3_700] == (True, 0)


def test_digikam_tables_become_photos(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "AlbumRoots": make([(1, "volumeid:?path=/home/x", "/pics")], "id long, identifier string, specificPath string"),
        "Albums": make([(1, 1, "/"), (2, 1, "/trip")], "id long, albumRoot long, relativePath string"),
        "Images": make([(1, 1, "a.jpg"), (2, 2, "b.jpg")], "id long, album long, name string"),
        "ImageInformation": make([(1, 4, "2020-01-02T03:04:05"), (2, -1, None)], "imageid long, rating int, creationDate string"),
        "ImagePositions": make([(2, 1.5, 2.5)], "imageid long, latitudeNumber double, longitudeNumber double"),
        "ImageComments": make([(1, 1, "hello"), (1, 3, "title")], "imageid long, type int, comment string"),
        "Tags": make([(1, "sea"), (2, "Dana")], "id long, name string"),
        "TagProperties": make([(2, "person", "Dana")], "tagid long, property string, value string"),
        "ImageTags": make([(1, 1), (1, 2)], "imageid long, tagid long"),
    }
    rows = {r["id"]: r for r in files.digikam_import(tables).collect()}
    assert (rows[1]["path"], rows[1]["rating"], rows[1]["caption"], rows[1]["tags"], rows[1]["people"]) == ("/home/x/pics/a.jpg", 4, "hello", ["sea"], ["Dana"])
    assert (rows[2]["path"], rows[2]["rating"], rows[2]["lat"]) == ("/home/x/pics/trip/b.jpg", None, 1.5)


def test_listing_hashes_titles_and_sync(spark, tmp_path):
    import hashlib

    folder = tmp_path / "pics"
    folder.mkdir()
    for i in range(4):
        (folder / f"{i}.jpg").write_bytes(b"x" * (i + 1))
    found, total = files.media_listing(spark, str(folder), 3)
    assert found.count() == 3 and total.first()["total"] == 4
    assert {r["sha256"] if "sha256" in r else r[1] for r in files.content_hash(spark, str(folder)).collect()} == {hashlib.sha256(b"x" * (i + 1)).hexdigest() for i in range(4)}


PACKETS = [
    (1, '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:xap="http://ns.adobe.com/xap/1.0/" xap:Rating="2" xap:Label="RED"/></rdf:RDF></x:xmpmeta>'),
    (2, 'junk <x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><rdf:Description><xmp:Rating> 4 </xmp:Rating><xmp:Label>Blue</xmp:Label></rdf:Description><rdf:Description><dc:subject><rdf:Seq><rdf:li> a &amp; b </rdf:li><rdf:li> </rdf:li></rdf:Seq></dc:subject><dc:description><rdf:Alt><rdf:li xml:lang="x-default">said &quot;é&quot;</rdf:li></rdf:Alt></dc:description></rdf:Description></rdf:RDF></x:xmpmeta> tail'),
    (3, '<x:xmpmeta><rdf:RDF><rdf:Description xmp:Rating="5" xmp:Label="odd"><dc:subject><rdf:Bag><rdf:li>loose</rdf:li></rdf:Bag></dc:subject></rdf:Description></rdf:RDF></x:xmpmeta>'),
    (4, '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description/></rdf:RDF></x:xmpmeta>'),
    (5, "no packet"),
    (6, None),
]


def test_packets_are_read_as_attributes_and_elements(spark):
    found = {r["id"]: (r["rating"], r["label"], r["subjects"], r["description"]) for r in files.xmp_fields(spark.createDataFrame(PACKETS, "id long, value string")).collect()}
    assert found == {1: (2, "red", [], None), 2: (4, "blue", ["a & b"], 'said "é"'), 3: (5, None, ["loose"], None)}


def test_packets_are_xml_that_others_read(spark):
    """A namespace-aware parser accepts every packet and finds what was written, and so does the reader."""
    import xml.etree.ElementTree as ET
    from types import SimpleNamespace

    make = spark.createDataFrame
    t = SimpleNamespace(
        photos=make([(1, 3, "red", 'a <b> & "c"\x01'), (2, 0, "", ""), (3, None, None, None)], "id long, rating int, label string, description string"),
        tags=make([(1, "sea & <sun>"), (2, "")], "id long, name string"), photo_tags=make([(1, 1), (1, 2)], "photo_id long, tag_id long"),
        people=make([(7, "Dana"), (8, "Noa")], "id long, name string"), photo_people=make([(1, 7)], "photo_id long, person_id long"),
        faces=make([(1, 8), (1, 7)], "photo_id long, person_id long"),
        albums=make([(1, "Trip", "album"), (2, "Photos from 2020", "year")], "id long, name string, kind string"), photo_albums=make([(1, 1), (1, 2)], "photo_id long, album_id long"),
    )
    packets = {r["id"]: r["packet"] for r in files.xmp_write(t).collect()}
    rdf, xmp, dc = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://ns.adobe.com/xap/1.0/}", "{http://purl.org/dc/elements/1.1/}"
    read = {i: ET.fromstring(p.lstrip()).find(f"{rdf}RDF/{rdf}Description") for i, p in packets.items()}
    assert read[1].get(f"{xmp}Rating") == "3" and read[1].get(f"{xmp}Label") == "Red"
    assert [x.text for x in read[1].find(f"{dc}subject/{rdf}Bag")] == ["sea & <sun>", "Dana", "Noa", "Album/Trip"]
    assert read[1].find(f"{dc}description/{rdf}Alt/{rdf}li").text == 'a <b> & "c"'
    for i in (2, 3):
        assert read[i].get(f"{xmp}Rating") is None and read[i].get(f"{xmp}Label") is None and len(read[i]) == 0
    back = files.xmp_fields(files.xmp_write(t).withColumnRenamed("packet", "value")).collect()
    assert [(r["id"], r["rating"], r["label"], r["subjects"], r["description"]) for r in back] == [(1, 3, "red", ["sea & <sun>", "Dana", "Noa", "Album/Trip"], 'a <b> & "c"')]
