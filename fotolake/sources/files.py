"""Sources and sinks: catalog tables, media listings, export metadata, sidecars, tracks, source catalogs, snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.functions.scalars import VIDEO_TYPES, ext_of, label_map, lr_time, safe_component

PICTURE_TYPES = ["jpg", "jpeg", "png", "gif", "bmp", "webp", "heic", "heif", "tif", "tiff", "dng", "cr2", "nef", "arw"]
MEDIA_TYPES = [*PICTURE_TYPES, *VIDEO_TYPES]


def catalog_scan(spark: SparkSession, folder: str, tables: list[str]) -> dict[str, DataFrame]:
    """The tables of a catalog folder, each also as a temporary view."""
    out = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in tables}
    for name, frame in out.items():
        frame.createOrReplaceTempView(name)
    return out


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def media_files(files: DataFrame) -> DataFrame:
    """path, size, mtime (seconds) of the media files among files (path, length, modificationTime); hidden and system folders
    and empty files are left out."""
    listed = files.select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))
    return listed.where(F.lower(ext_of(F.col("path"))).isin(MEDIA_TYPES) & ~F.col("path").rlike(r"/[.$][^/]*(/|$)") & (F.col("size") > 0))


def folder_walk(spark: SparkSession, folder: str) -> DataFrame:
    """The media files below a folder. Contents are not read."""
    return media_files(_files(spark, folder))


def first_files(found: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The first cap of media files by path, newest first, and the number of all."""
    return found.orderBy("path").limit(cap).orderBy(F.desc("mtime"), "path"), found.agg(F.count("*").alias("total"))


def media_listing(spark: SparkSession, folder: str, cap: int = 100_000) -> tuple[DataFrame, DataFrame]:
    return first_files(folder_walk(spark, folder), cap)


def hashed(files: DataFrame) -> DataFrame:
    """path and SHA-256 of each content; null where there is none."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return hashed(_files(spark, folder))


SIDECAR = "title string, description string, url string, photoTakenTime struct<timestamp: string>, geoData struct<latitude: double, longitude: double, altitude: double>, people array<struct<name: string>>, favorited boolean, trashed boolean"
MEMORY = "memory array<struct<title: string, created_at: string>>"
COMMENTS = "comments array<struct<text: string, author: string, created_at: string>>"


def _json(spark: SparkSession, folder: str, schema: str, glob: str) -> DataFrame:
    read = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return read.json(folder).withColumn("path", F.col("_metadata.file_path"))


def takeout_json(spark: SparkSession, folder: str) -> DataFrame:
    return takeout_fields(_json(spark, folder, SIDECAR, "*.json"))


def takeout_fields(sidecars: DataFrame) -> DataFrame:
    """One row per export sidecar (path and SIDECAR): path, title, taken_at, place, people, description, favorited, trashed. The
    place (0, 0) is none; what has no time is no photo's."""
    rows = sidecars.where("photoTakenTime is not null")
    placed = (F.col("geoData.latitude") != 0) | (F.col("geoData.longitude") != 0)
    return rows.select(
        "path", "title", F.col("photoTakenTime.timestamp").try_cast("long").alias("taken_at"),
        *[F.when(placed, F.col(f"geoData.{c}")).alias(n) for c, n in (("latitude", "lat"), ("longitude", "lng"), ("altitude", "altitude"))],
        F.coalesce(F.transform("people", lambda p: p["name"]), F.array().cast("array<string>")).alias("people"), "description",
        F.coalesce("favorited", F.lit(False)).alias("favorited"), F.coalesce("trashed", F.lit(False)).alias("trashed"), "url",
    )


def takeout_album_meta(spark: SparkSession, folder: str) -> DataFrame:
    return album_fields(_json(spark, folder, "title string, description string", "*.json"))


def album_fields(rows: DataFrame) -> DataFrame:
    """folder, title, description of albums: metadata.json, or its localized name; rows have path, title, description."""
    return rows.where(F.col("path").rlike(r"(?i)/(metadata|מטא-נתונים|metadaten|métadonnées)(\(\d+\))?\.json$")).select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), "title", "description")


def memory_titles(spark: SparkSession, folder: str) -> DataFrame:
    return memory_fields(_json(spark, folder, MEMORY, "*memor*.json"))


def memory_fields(rows: DataFrame) -> DataFrame:
    """title, created_at of each entry, newest first."""
    return rows.select(F.explode("memory").alias("m")).select("m.title", F.col("m.created_at").try_cast("long").alias("created_at")).orderBy(F.desc("created_at"), "title")


def shared_comments(spark: SparkSession, folder: str) -> DataFrame:
    return comment_fields(_json(spark, folder, COMMENTS, "*comment*.json"))


def comment_fields(rows: DataFrame) -> DataFrame:
    """text, author, created_at of each comment, newest first."""
    return rows.select(F.explode("comments").alias("c")).select("c.text", "c.author", F.col("c.created_at").try_cast("long").alias("created_at")).orderBy(F.desc("created_at"), "text")


def _uris(value, found: list) -> list:
    """Entries of all dictionaries with a string uri, at any depth."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if isinstance(x.get("uri"), str):
                when = x.get("creation_timestamp")
                found.append((x["uri"], next((str(x[k]) for k in ("title", "description", "caption") if x.get(k)), None), int(when) if isinstance(when, (int, float)) else None))
            stack += list(x.values())[::-1]
        elif isinstance(x, list):
            stack += x[::-1]
    return found


def social_json_index(spark: SparkSession, folder: str) -> DataFrame:
    return social_entries(spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json"))


def social_entries(files: DataFrame) -> DataFrame:
    """(uri, caption, created) of every nested entry with a uri in texts (value); their depth has no schema, so they are walked
    in tasks. What is no JSON, or null, has no entries."""

    def task(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            found: list = []
            for text in batch["value"].dropna():
                try:
                    _uris(json.loads(text), found)
                except ValueError:
                    continue  # not JSON: no entries
            yield pd.DataFrame(found, columns=["uri", "caption", "created"]).astype({"created": "Int64"})

    return files.select("value").mapInPandas(task, "uri string, caption string, created long")


def lightroom_import(tables: dict[str, DataFrame]) -> DataFrame:
    """path, taken (unix seconds), rating, flag, label, quick, lat, lng, description, keywords, people, collections from the
    exported tables of a source catalog. Keywords that name persons are people; the quick collection is a mark, and only the
    user's own collections count."""
    image, file, folder, root = (tables[t] for t in ("Adobe_images", "AgLibraryFile", "AgLibraryFolder", "AgLibraryRootFolder"))
    path = F.concat(F.col("root.absolutePath"), F.col("folder.pathFromRoot"), F.col("file.baseName"), F.lit("."), F.col("file.extension"))
    number = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    base = (
        image.alias("image").join(file.alias("file"), F.col("image.rootFile") == F.col("file.id_local"))
        .join(folder.alias("folder"), F.col("file.folder") == F.col("folder.id_local"))
        .join(root.alias("root"), F.col("folder.rootFolder") == F.col("root.id_local"))
        .select(F.col("image.id_local").alias("id"), path.alias("path"), lr_time(F.col("image.captureTime")).alias("taken"), number("image.rating").alias("rating"), F.signum(number("image.pick")).cast("int").alias("flag"), label_map(F.col("image.colorLabels")).alias("label"))
    )
    exif = tables["AgHarvestedExifMetadata"].where("gpsLatitude is not null").select(F.col("image").alias("id"), F.col("gpsLatitude").alias("lat"), F.col("gpsLongitude").alias("lng"))
    iptc = tables["AgLibraryIPTC"].where("caption <> ''").select(F.col("image").alias("id"), F.col("caption").alias("description"))
    named = tables["AgLibraryKeywordImage"].alias("b").join(tables["AgLibraryKeyword"].alias("k"), F.col("b.tag") == F.col("k.id_local"))
    person = F.coalesce(F.col("k.keywordType") == "person", F.lit(False))
    of = lambda which, name: F.sort_array(F.collect_set(F.when(which, F.col(name))))
    words = named.groupBy(F.col("b.image").alias("id")).agg(of(~person, "k.name").alias("keywords"), of(person, "k.name").alias("people"))
    inside = tables["AgLibraryCollectionImage"].alias("b").join(tables["AgLibraryCollection"].where("creationId = 'com.adobe.ag.library.collection'").alias("c"), F.col("b.collection") == F.col("c.id_local"))
    quick = (F.coalesce(F.col("c.systemOnly").cast("double"), F.lit(0.0)) != 0) | (F.lower(F.coalesce("c.name", F.lit(""))) == "quick collection")
    sets = inside.groupBy(F.col("b.image").alias("id")).agg(of(~quick & (F.col("c.name") != ""), "c.name").alias("collections"), F.max(quick.cast("int")).alias("quick"))
    both = base.join(exif, "id", "left").join(iptc, "id", "left").join(words, "id", "left").join(sets, "id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return both.select("id", "path", "taken", "rating", "flag", "label", F.coalesce("quick", F.lit(0)).alias("quick"), "lat", "lng", "description", empty("keywords"), empty("people"), empty("collections"))


def digikam_import(tables: dict[str, DataFrame]) -> DataFrame:
    """path, taken, rating, lat, lng, caption, tags and people from the exported tables of another source catalog."""
    root = F.regexp_extract("r.identifier", r"path=([^&]*)", 1)
    path = F.concat(root, F.col("r.specificPath"), F.when(F.col("a.relativePath") == "/", "").otherwise(F.col("a.relativePath")), F.lit("/"), F.col("i.name"))
    base = tables["Images"].alias("i").join(tables["Albums"].alias("a"), F.col("i.album") == F.col("a.id")).join(tables["AlbumRoots"].alias("r"), F.col("a.albumRoot") == F.col("r.id")).select(F.col("i.id").alias("id"), path.alias("path"))
    info = tables["ImageInformation"].select(F.col("imageid").alias("id"), F.when(F.col("rating") >= 0, F.col("rating")).alias("rating"), F.col("creationDate").alias("taken"))
    place = tables["ImagePositions"].select(F.col("imageid").alias("id"), F.col("latitudeNumber").alias("lat"), F.col("longitudeNumber").alias("lng"))
    caption = tables["ImageComments"].where("type = 1").groupBy(F.col("imageid").alias("id")).agg(F.min("comment").alias("caption"))
    persons = tables["TagProperties"].where("property = 'person'").select(F.col("tagid").alias("id"), F.lit(True).alias("person")).distinct()
    named = tables["ImageTags"].alias("b").join(tables["Tags"].join(persons, "id", "left").alias("t"), F.col("b.tagid") == F.col("t.id"))
    words = named.groupBy(F.col("b.imageid").alias("id")).agg(F.sort_array(F.collect_set(F.when(F.col("person").isNull(), F.col("t.name")))).alias("tags"), F.sort_array(F.collect_set(F.when(F.col("person"), F.col("t.name")))).alias("people"))
    return base.join(info, "id", "left").join(place, "id", "left").join(caption, "id", "left").join(words, "id", "left")


def lightroom_collections(tables: dict[str, DataFrame]) -> DataFrame:
    """The collections that a user of the catalog made."""
    return tables["AgLibraryCollection"].where("creationId = 'com.adobe.ag.library.collection' and coalesce(systemOnly, 0) = 0")


def import_summary(rows: DataFrame, files: DataFrame, words: str = "keywords", sets: DataFrame | None = None) -> DataFrame:
    """images, missing files, different keywords, bytes and collections (or albums) of an import from a source catalog; files
    has path and size, sets one row per collection."""
    both = rows.join(files.select("path", "size"), "path", "left")
    facts = both.agg(F.count("*").alias("images"), F.count_if(F.col("size").isNull()).alias("missing"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    facts = facts.join(rows.select(F.explode(words).alias("w")).agg(F.count_distinct("w").alias("words")))
    return facts if sets is None else facts.join(sets.agg(F.count("*").alias("collections")))


#: The parts of a packet that are read; Spark's XML reader leaves out prefixes, attributes begin with an underscore.
_XMP_SCHEMA = """RDF struct<Description array<struct<_Rating string, _Label string, Rating string, Label string,
  subject struct<Bag struct<li array<string>>, Seq struct<li array<string>>>, description struct<Alt struct<li array<struct<_VALUE string, _lang string>>>>>>>"""
_XMP_OPTIONS = {"ignoreNamespace": "true", "attributePrefix": "_", "mode": "PERMISSIVE"}


def _xmp(text: Column, name: str) -> Column:
    attribute = F.regexp_extract(text, rf'{name}\s*=\s*"([^"]*)"', 1)
    element = F.regexp_extract(text, rf"<{name}>([^<]*)</{name}>", 1)
    return F.when(attribute != "", attribute).when(element != "", element)


def _loose_fields(column: Column) -> dict[str, Column]:
    """The same fields by their look, for packets that no XML reader accepts."""
    block = lambda tag: F.regexp_extract(column, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    items = lambda b: F.regexp_extract_all(b, F.lit(r"(?s)<rdf:li[^>]*>(.*?)</rdf:li>"), F.lit(1))
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return {
        "rating": _xmp(column, "xmp:Rating"), "label": _xmp(column, "xmp:Label"),
        "subjects": F.transform(items(block("dc:subject")), plain), "description": plain(F.try_element_at(items(block("dc:description")), F.lit(1))),
    }


def xmp_fields(rows: DataFrame, text: str = "value") -> DataFrame:
    """rows with rating, label, subjects and description of an XMP text; rows in which all are empty are left out.

    Packets are read as XML, with values as attributes or as elements, whatever their prefixes are; what is no XML is read by
    its look. Labels are those of the catalog; other words are no label.
    """
    packet = F.regexp_extract(text, r"(?s)(<[\w-]+:xmpmeta.*?</[\w-]+:xmpmeta>)", 1)
    own = [c for c in rows.columns if c != text]
    # Rows of one element, so that conditions on what was read do not read the packet once more for each field they name.
    read = rows.select(*own, F.col(text).alias("__text"), F.explode(F.array(F.from_xml(F.when(packet != "", packet).otherwise(F.col(text)), _XMP_SCHEMA, _XMP_OPTIONS)["RDF"]["Description"])).alias("__parts"))
    parts, loose = F.col("__parts"), _loose_fields(F.col("__text"))
    filled = lambda c: c.isNotNull() & (c != "")
    first = lambda get: F.try_element_at(F.filter(F.transform(parts, get), filled), F.lit(1))
    number = lambda c: F.trim(c).try_cast("int")
    rating = F.coalesce(F.nullif(number(first(lambda d: d["_Rating"])), F.lit(0)), number(first(lambda d: d["Rating"])))
    label = F.coalesce(first(lambda d: d["_Label"]), first(lambda d: d["Label"]))
    none = F.array().cast("array<string>")
    subjects = F.flatten(F.transform(parts, lambda d: F.concat(F.coalesce(d["subject"]["Bag"]["li"], none), F.coalesce(d["subject"]["Seq"]["li"], none))))
    description = first(lambda d: F.try_element_at(d["description"]["Alt"]["li"], F.lit(1))["_VALUE"])
    pick = lambda strict, name: F.when(parts.isNotNull(), strict).otherwise(loose[name])
    fields = F.struct(
        F.coalesce(pick(rating, "rating").try_cast("int"), F.lit(0)).alias("rating"), label_map(F.lower(F.trim(pick(label, "label")))).alias("label"),
        F.filter(F.transform(F.coalesce(pick(subjects, "subjects"), none), F.trim), filled).alias("subjects"), F.nullif(F.trim(pick(description, "description")), F.lit("")).alias("description"),
    )
    out = read.select(*own, F.inline(F.array(fields)))
    return out.where((F.col("rating") != 0) | F.col("label").isNotNull() | (F.size("subjects") > 0) | F.col("description").isNotNull())


def xmp_read(spark: SparkSession, folder: str) -> DataFrame:
    """path, rating, label, subjects, description of XMP sidecars and of files with an embedded packet."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    packet = F.regexp_extract(F.decode("content", "ISO-8859-1"), r"(?s)(<x:xmpmeta.*?</x:xmpmeta>)", 1)
    text = F.decode(F.encode(packet, "ISO-8859-1"), "UTF-8")
    return xmp_fields(files.select("path", text.alias("value")).where("value <> ''"))


#: The frame of an XMP packet, its byte order mark and its namespaces.
PACKET_HEAD = '<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/">\n <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n'
PACKET_OPEN = '  <rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:xmp="http://ns.adobe.com/xap/1.0/"'
PACKET_TAIL = "\n  </rdf:Description>\n </rdf:RDF>\n</x:xmpmeta>\n<?xpacket end=\"w\"?>\n"


def xmp_write(t) -> DataFrame:
    """(id, packet): XMP packets with rating, label, caption, and as subjects the keywords, then the people by tag or by face,
    then the user's own albums as Album/name. What is empty is not written. Signs that XML forbids are left out."""
    from fotolake.operators.graph import photo_person_union

    legal = lambda c: F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(legal(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))

    def bridge(rows: DataFrame, key: str, names: DataFrame, kind: int, mark: str = "") -> DataFrame:
        words = names.where("name <> ''").select(F.col("id").alias(key), F.concat(F.lit(mark), "name").alias("word"))
        return rows.join(words, key).select("photo_id", F.struct(F.lit(kind).alias("kind"), "word").alias("item"))

    words = bridge(t.photo_tags, "tag_id", t.tags, 0).unionByName(bridge(photo_person_union(t), "person_id", t.people, 1))
    words = words.unionByName(bridge(t.photo_albums, "album_id", t.albums.where("kind = 'album'"), 2, "Album/"))
    items = F.transform(F.sort_array(F.collect_set("item")), lambda w: F.concat(F.lit("<rdf:li>"), esc(w["word"]), F.lit("</rdf:li>")))
    rows = t.photos.join(words.groupBy(F.col("photo_id").alias("id")).agg(F.array_join(items, "").alias("items")), "id", "left")
    label = F.concat(F.upper(F.substring("label", 1, 1)), F.lower(F.col("label").substr(F.lit(2), F.length("label"))))
    piece = lambda when, *parts: F.coalesce(F.when(when, F.concat(*parts)), F.lit(""))
    packet = F.concat(
        F.lit(PACKET_HEAD + PACKET_OPEN),
        piece(F.col("rating") != 0, F.lit(' xmp:Rating="'), F.col("rating").cast("string"), F.lit('"')),
        piece(F.col("label") != "", F.lit(' xmp:Label="'), esc(label), F.lit('"')),
        F.lit(">\n   "),
        piece(F.col("items").isNotNull(), F.lit("<dc:subject><rdf:Bag>"), "items", F.lit("</rdf:Bag></dc:subject>")),
        piece(F.col("description") != "", F.lit('<dc:description><rdf:Alt><rdf:li xml:lang="x-default">'), esc(F.col("description")), F.lit("</rdf:li></rdf:Alt></dc:description>")),
        F.lit(PACKET_TAIL),
    )
    return rows.select("id", packet.alias("packet"))


#: A point of a track file, as Spark reads its element.
POINT = "_lat double, _lon double, time string"


def gpx_points(spark: SparkSession, folder: str, cap: int | None = 2_000_000) -> DataFrame:
    """Points of the track, way and route points of a folder's files."""
    out = None
    for tag in ("trkpt", "wpt", "rtept"):
        rows = spark.read.format("xml").option("rowTag", tag).schema(POINT).load(folder)
        out = rows if out is None else out.unionByName(rows)
    return track_points(out, cap)


def track_points(points: DataFrame, cap: int | None = None) -> DataFrame:
    """ts, lat, lng of points (POINT) with a time and possible coordinates; with a cap the first ones in order of time."""
    ts = F.unix_seconds(F.try_to_timestamp("time"))
    good = points.select(ts.alias("ts"), F.col("_lat").alias("lat"), F.col("_lon").alias("lng")).where(F.col("ts").isNotNull() & F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180))
    return good if cap is None else good.orderBy("ts", "lat", "lng").limit(cap)


def exif_fields(photos: DataFrame) -> DataFrame:
    """id and typed columns of exif_json; null means not read, '{}' read and nothing there."""
    shape = "Image struct<Make: string, Model: string, Orientation: string>, Exif struct<LensModel: string, FocalLength: string, ExposureTime: string, FNumber: string, ISOSpeedRatings: string, DateTimeOriginal: string>, GPS map<string, string>"
    x = F.from_json("exif_json", shape)
    ratio = lambda c: F.when(c.contains("/"), F.try_divide(F.split(c, "/")[0].try_cast("double"), F.split(c, "/")[1].try_cast("double"))).otherwise(c.try_cast("double"))
    return photos.select(
        "id", F.col("exif_json").isNotNull().alias("read"), x["Image"]["Make"].alias("make"), x["Image"]["Model"].alias("model"), x["Exif"]["LensModel"].alias("lens"), ratio(x["Exif"]["FocalLength"]).alias("focal_length"),
        ratio(x["Exif"]["ExposureTime"]).alias("exposure"), ratio(x["Exif"]["FNumber"]).alias("aperture"), x["Exif"]["ISOSpeedRatings"].try_cast("int").alias("iso"), F.unix_seconds(F.try_to_timestamp(x["Exif"]["DateTimeOriginal"], F.lit("yyyy:MM:dd HH:mm:ss"))).alias("taken_at"),
    )


def export_manifest(photos: DataFrame, archive: bool = False) -> DataFrame:
    """id, folder, name: where an export puts each photo; names are safe and differ within a folder. The first repeat of a name
    is number 1 in folders, where case is ignored, and 2 in an archive, where it is not."""
    from fotolake.functions.scalars import wall
    from fotolake.operators.windows import unique_names

    rows = photos.where("trashed = 0").select("id", F.date_format(wall(F.col("taken_at")), "yyyy-MM").alias("folder"), safe_component(F.col("filename")).alias("name"))
    return unique_names(rows, 2, False).withColumnRenamed("unique", "name") if archive else unique_names(rows).withColumnRenamed("unique", "name")


def pinned(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Tables as they are now: the files of all of them are listed before any is read, and no other file is read later."""
    listed = {name: (frame.schema, frame.inputFiles()) for name, frame in ((n, spark.read.parquet(p)) for n, p in paths.items())}
    return {name: spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema) for name, (schema, files) in listed.items()}


def table_digest(frame: DataFrame) -> DataFrame:
    """One row: n, and a digest of all rows that does not depend on their order."""
    row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) for f in frame.schema])
    return frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def catalog_snapshot(tables: dict[str, DataFrame | str], folder: str, created: int, reason: str, spark: SparkSession | None = None) -> DataFrame:
    """Writes all tables and then the manifest, with the rows and a digest of each copy: a snapshot without one is not complete.
    Tables given by path are pinned first, so that all are of one moment even if they grow meanwhile; DataFrames are taken as
    they are. Returns the manifest."""
    frames = {n: f for n, f in tables.items() if isinstance(f, DataFrame)}
    paths = {n: f for n, f in tables.items() if not isinstance(f, DataFrame)}
    spark = spark or (next(iter(frames.values())).sparkSession if frames else SparkSession.getActiveSession())
    held = pinned(spark, paths) | frames
    for name, frame in held.items():
        frame.write.mode("errorifexists").parquet(f"{folder}/{name}.parquet")
    facts = None
    for name, frame in held.items():
        one = table_digest(spark.read.schema(frame.schema).parquet(f"{folder}/{name}.parquet")).withColumn("table", F.lit(name))
        facts = one if facts is None else facts.unionByName(one)
    by_name = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("table", c))))
    manifest = facts.agg(by_name("n").alias("counts"), by_name("digest").alias("digests")).select(F.lit(created).alias("created"), F.lit(reason).alias("reason"), "counts", "digests")
    manifest.write.mode("errorifexists").json(f"{folder}/manifest")
    return spark.read.json(f"{folder}/manifest")
