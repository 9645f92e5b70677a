"""Registered queries of file sources: listings, sidecars, tracks, a source catalog and a snapshot, out of the given tables.

What a folder's files would hold is written as text by Spark out of the photos and read back by the operators behind the readers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.catalog import Catalog, with_tables
from fotolake.functions.scalars import wall
from fotolake.operators import images
from fotolake.sources import files
from fotolake.storage import fresh_path
from fotolake.streaming import flows

#: The tables of a catalog folder.
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
#: Folders of files: plain, hidden, of the system, and plain with a point in the name.
PLACES = ["", ".trash/", "$RECYCLE.BIN/", "a.b/"]
#: Names of an album's description, the fourth of which is a photo's.
ALBUM_FILES = ["metadata.json", "מטא-נתונים.json", "Metadata(2).json", "IMG_1.jpg.json", "métadonnées(12).json"]
#: The moment of an import.
NOW = 1_701_000_000


def _of(f):
    return lambda spark, sf_dir: f(Catalog(spark, sf_dir))


def _id():
    return F.col("id")


def _pick(values: list[str], by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values)).cast("int") + 1)


def listed_files(t):
    """Files as a walk finds them, some empty, hidden or of other kinds."""
    path = F.concat(F.lit("/lib/"), _pick(PLACES, _id()), "rel_path", F.when(_id() % 5 == 3, ".txt").otherwise(""))
    return t.photos.select(path.alias("path"), F.when(_id() % 7 == 0, 0).otherwise(F.col("bytes")).alias("length"), F.timestamp_seconds("taken_at").alias("modificationTime"))


def first_listed(t):
    found, total = files.first_files(files.media_files(listed_files(t)), 500)
    return found.join(total)  # one row


def sidecars(t):
    """Export sidecars of all photos, as their JSON is read."""
    place = F.struct(*[F.when(_id() % 10 == 1, 0.0).otherwise(F.col(c)).alias(n) for c, n in (("lat", "latitude"), ("lng", "longitude"))], (_id() % 300 + 0.5).alias("altitude"))
    text = F.to_json(F.struct(
        F.col("filename").alias("title"), "description", F.concat(F.lit("https://p/"), _id().cast("string")).alias("url"),
        F.when(_id() % 20 > 0, F.struct(F.when(_id() % 20 == 7, "soon").otherwise(F.col("taken_at").cast("string")).alias("timestamp"))).alias("photoTakenTime"),
        place.alias("geoData"), F.when(_id() % 3 == 0, F.array(F.struct(F.lit("Ron").alias("name")), F.struct(F.concat(F.lit("P"), (_id() % 4).cast("string")).alias("name")))).alias("people"),
        F.when(_id() % 4 != 1, _id() % 4 == 0).alias("favorited"), (F.col("trashed") == 1).alias("trashed"),
    ))
    return t.photos.select(F.concat(F.lit("/export/"), "rel_path", F.lit(".json")).alias("path"), F.from_json(text, files.SIDECAR).alias("s")).select("path", "s.*")


def album_files(t):
    text = F.to_json(F.struct(F.col("name").alias("title"), F.when(_id() % 2 == 0, F.col("kind")).alias("description")))
    return t.albums.select(F.concat(F.lit("/export/"), "name", F.lit("/"), _pick(ALBUM_FILES, _id())).alias("path"), F.from_json(text, "title string, description string").alias("s")).select("path", "s.*")


def memories(t):
    one = lambda title, at: F.struct(title.alias("title"), at.alias("created_at"))
    text = F.to_json(F.struct(F.array(one(F.col("camera_model"), F.col("taken_at").cast("string")), one(F.lit("day"), F.lit("x"))).alias("memory")))
    return t.photos.select(F.from_json(text, files.MEMORY).alias("s")).select("s.*")


def comments(t):
    one = F.struct(F.col("description").alias("text"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"), F.col("imported_at").cast("string").alias("created_at"))
    return t.photos.select(F.from_json(F.to_json(F.struct(F.array(one).alias("comments"))), files.COMMENTS).alias("s")).select("s.*")


def social_texts(t):
    """Nested entries, some of which are cut off or missing."""
    text = F.format_string('[{"media":[{"uri":"m/%d.jpg","creation_timestamp":%d,"title":"t%d"},{"deep":{"uri":"n/%d.jpg","caption":"c"}}]}]', _id(), "taken_at", _id() % 7, _id())
    return t.photos.select(F.when(_id() % 13 != 1, F.when(_id() % 11 == 5, F.substring(text, 1, 40)).otherwise(text)).alias("value"))


def gpx_elements(t):
    """Points as their elements are read, in two time zones, some without a time or beyond a pole."""
    at = lambda s: F.date_format(wall(F.col("ts") + s), "yyyy-MM-dd'T'HH:mm:ss")
    time = F.when(F.col("user_id") % 3 == 0, F.concat(at(7200), F.lit("+02:00"))).otherwise(F.concat(at(0), F.lit("Z")))
    element = F.concat(F.lit('<trkpt lat="'), (F.col("lat") + 20).cast("string"), F.lit('" lon="'), F.col("lng").cast("string"), F.lit('">'), F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("<time>"), time, F.lit("</time>"))), F.lit("</trkpt>"))
    return t.track.select(F.from_xml(element, files.POINT).alias("p")).select("p.*")


def digikam(t):
    """The tables of another source catalog; those of roots, albums and tags are small by nature."""
    p, e = t.photos, F.col("event_id")
    few = lambda n, *columns: t.events.where(f"event_id < {n}").select(*columns)
    text = lambda c: c.cast("string")
    comment = lambda every, kind, words: p.where(f"id % {every} = 0").select(_id().alias("imageid"), F.lit(kind).alias("type"), words.alias("comment"))
    return {
        "AlbumRoots": few(2, e.alias("id"), F.concat(F.lit("volumeid:?path=/home/"), text(e), F.lit("&x=1")).alias("identifier"), F.lit("/pics").alias("specificPath")),
        "Albums": few(6, e.alias("id"), (e % 2).alias("albumRoot"), F.when(e == 0, "/").otherwise(F.concat(F.lit("/trip"), text(e))).alias("relativePath")),
        "Images": p.select("id", (_id() % 7).alias("album"), F.col("filename").alias("name")),
        "ImageInformation": p.where("id % 4 <> 3").select(_id().alias("imageid"), (_id() % 7 - 1).cast("int").alias("rating"), F.concat(F.lit("2020-01-"), text(_id() % 28 + 1)).alias("creationDate")),
        "ImagePositions": p.where("id % 2 = 0").select(_id().alias("imageid"), F.col("lat").alias("latitudeNumber"), F.col("lng").alias("longitudeNumber")),
        "ImageComments": reduce(DataFrame.unionByName, [comment(3, 1, F.concat(F.lit("c"), text(_id()))), comment(6, 1, F.concat(F.lit("b"), text(_id()))), comment(5, 3, F.lit("title"))]),
        "Tags": few(9, e.alias("id"), F.concat(F.lit("t"), text(e)).alias("name")),
        "TagProperties": few(9, e.alias("tagid"), F.when(e % 3 == 0, "person").otherwise("other").alias("property")),
        "ImageTags": p.where("id % 4 < 2").select(_id().alias("imageid"), (_id() % 9).alias("tagid")).unionByName(p.where("id % 4 = 1").select(_id().alias("imageid"), ((_id() + 4) % 9).alias("tagid"))),
    }


def snapshot_counts(spark, sf_dir: str) -> DataFrame:
    """Rows of each table in a snapshot of the catalog folder, written to the shared folder."""
    manifest = files.catalog_snapshot({n: f"{sf_dir}/{n}.parquet" for n in TABLES}, fresh_path(spark), 0, "regular", spark)
    return manifest.select(F.explode(F.from_json(F.to_json("counts"), "map<string, long>")).alias("name", "n"))


def coloured(t):
    """A picture of three colours per document, from a digest of the text: 60, 48 and 36 pixels."""
    m = F.md5(F.coalesce("text", F.lit("")))
    data = F.unhex(F.concat(*[F.repeat(F.substring(m, at, 6), F.lit(n)) for at, n in ((1, 60), (7, 48), (13, 36))]))
    return t.documents.select(F.col("doc_id").cast("string").alias("origin"), F.lit(12).alias("width"), F.lit(12).alias("height"), F.lit(3).alias("nChannels"), data.alias("data"))


def import_listing(t):
    return t.photos.select("id", F.col("rel_path").alias("path"), F.col("bytes").alias("size"), F.col("taken_at").alias("mtime"), "sha256")


def seen_before(t):
    """A fifth of the files was met before, half of those at another size."""
    status = F.when(_id() % 3 == 0, "added").otherwise("baseline")
    return t.photos.where("id % 5 = 0").select(F.col("rel_path").alias("path"), (F.col("bytes") + _id() % 2).alias("size"), F.col("taken_at").alias("mtime"), "sha256", status.alias("status"))


QUERIES = {
    "s01_all_tables": lambda spark, sf_dir: reduce(DataFrame.unionByName, [f.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, f in files.catalog_scan(spark, sf_dir, TABLES).items()]),
    "s02_media_listing": _of(first_listed),
    "s03_folder_walk": _of(lambda t: files.media_files(listed_files(t))),
    "s04_content_hash": _of(lambda t: files.hashed(t.documents.select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content")))),
    "s06_takeout_json": _of(lambda t: files.takeout_fields(sidecars(t))),
    "s07_album_meta": _of(lambda t: files.album_fields(album_files(t))),
    "s08_memory_titles": _of(lambda t: files.memory_fields(memories(t))),
    "s08_shared_comments": _of(lambda t: files.comment_fields(comments(t))),
    "s09_social_index": _of(lambda t: files.social_entries(social_texts(t))),
    "s11_digikam": _of(lambda t: files.digikam_import(digikam(t))),
    "s15_gpx_points": _of(lambda t: files.track_points(gpx_elements(t))),
    "s18_snapshot": snapshot_counts,
    "m05_dominant_colour": _of(lambda t: images.measure(coloured(t), "r", "g", "b").select(F.col("origin").cast("long").alias("doc_id"), "r", "g", "b")),
    "t01_auto_import": _of(lambda t: flows.import_batch(import_listing(t), NOW, 15, seen_before(t))),
    "t02_baseline": _of(lambda t: flows.baseline_rows(import_listing(t))),
}

_LISTED = f"""l as (select '/lib/' || {PLACES}[(id % 4 + 1)::int] || rel_path || case when id % 5 = 3 then '.txt' else '' end as path, case when id % 7 = 0 then 0 else bytes end as size, taken_at as mtime from photos),
m as (select * from l where size > 0 and not contains(path, '/.') and not contains(path, '/$') and not ends_with(path, '.txt'))"""
_ALL = " union all ".join(f"select '{n}' as name, count(*) as n from {n}" for n in TABLES)
_HEX = lambda at: f"('0x' || substr(m, {at}, 2))::int"

SQL = {
    k: with_tables(v)
    for k, v in {
        "s01_all_tables": _ALL,
        "s02_media_listing": f"with {_LISTED}, t as (select * from m order by path limit 500) select path, size, mtime, (select count(*) from m) as total from t",
        "s03_folder_walk": f"with {_LISTED} select * from m",
        "s04_content_hash": "select '/d/' || doc_id as path, sha256(text) as sha256 from documents",
        "s06_takeout_json": """
select '/export/' || rel_path || '.json' as path, filename as title, case when id % 20 <> 7 then taken_at end as taken_at, case when id % 10 <> 1 and (lat <> 0 or lng <> 0) then lat end as lat,
  case when id % 10 <> 1 and (lat <> 0 or lng <> 0) then lng end as lng, case when id % 10 <> 1 and (lat <> 0 or lng <> 0) then id % 300 + 0.5::double end as altitude,
  case when id % 3 = 0 then ['Ron', 'P' || (id % 4)] else [] end as people, description, id % 4 = 0 as favorited, trashed = 1 as trashed, 'https://p/' || id as url
from photos where id % 20 > 0""",
        "s07_album_meta": "select '/export/' || name as folder, name as title, case when id % 2 = 0 then kind end as description from albums where id % 5 <> 3",
        "s08_memory_titles": "select camera_model as title, taken_at as created_at from photos union all select 'day', null from photos",
        "s08_shared_comments": "select description as text, 'u' || user_id as author, imported_at as created_at from photos",
        "s09_social_index": """
with p as (select * from photos where id % 13 <> 1 and id % 11 <> 5)
select 'm/' || id || '.jpg' as uri, 't' || (id % 7) as caption, taken_at as created from p union all select 'n/' || id || '.jpg', 'c', null from p""",
        "s11_digikam": """
with w as (select id, id % 9 as tag from photos where id % 4 < 2 union select id, (id + 4) % 9 from photos where id % 4 = 1),
k as (select id, coalesce(list_sort(list('t' || tag) filter (tag % 3 <> 0)), []) as words, coalesce(list_sort(list('t' || tag) filter (tag % 3 = 0)), []) as people from w group by 1)
select p.id, '/home/' || (p.id % 7 % 2) || '/pics' || case when p.id % 7 = 0 then '' else '/trip' || (p.id % 7) end || '/' || filename as path,
  case when p.id % 4 <> 3 and p.id % 7 > 0 then (p.id % 7 - 1)::int end as rating, case when p.id % 4 <> 3 then '2020-01-' || (p.id % 28 + 1) end as taken,
  case when p.id % 2 = 0 then lat end as lat, case when p.id % 2 = 0 then lng end as lng, case when p.id % 6 = 0 then 'b' || p.id when p.id % 3 = 0 then 'c' || p.id end as caption, k.words as "tags", k.people
from photos p left join k on k.id = p.id where p.id % 7 < 6""",
        "s15_gpx_points": "select ts, lat + 20 as lat, lng from track where user_id % 5 <> 0 and lat + 20 <= 90",
        "s18_snapshot": _ALL,
        "m05_dominant_colour": f"""
with b as (select doc_id, md5(coalesce(text, '')) as m from documents),
c as (select doc_id, {_HEX('o + 4')} as r, {_HEX('o + 2')} as g, {_HEX('o')} as b, n from b, (values (1, 60), (7, 48), (13, 36)) v(o, n)),
s as (select doc_id, r, g, b, sum(n)::double as n, greatest(r, g, b)::double as top, least(r, g, b)::double as low from c group by doc_id, r, g, b)
select doc_id, r, g, b from s qualify row_number() over (partition by doc_id order by n * (1 + case when top / 255 > 0.18 then 1.5 * (top - low) / greatest(top, 1) else 0 end) desc) = 1""",
        "t01_auto_import": f"""
with l as (select id, rel_path as path, bytes as size, taken_at as mtime, sha256 from photos where bytes > 0 and taken_at <= {NOW} - 15),
s as (select rel_path as path, bytes + id % 2 as size, taken_at as mtime, sha256, case when id % 3 = 0 then 'added' else 'baseline' end as status from photos where id % 5 = 0),
f as (select * from l where not exists (select 1 from s where s.path = l.path and s.size = l.size and s.mtime = l.mtime))
select *, case when row_number() over (partition by sha256 order by id) = 1 and sha256 not in (select sha256 from s where status = 'added') then 'added' else 'duplicate' end as status from f""",
        "t02_baseline": "select rel_path as path, bytes as size, taken_at as mtime, sha256, 'baseline' as status from photos",
    }.items()
}
