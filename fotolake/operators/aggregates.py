"""Counts, covers, facets and reports over a catalog. Every group is combined in the map tasks before it is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.functions.scalars import COLOURS, cleanup_category, ext_of, folder_of, orientation, wall
from fotolake.operators.rules import people_of


def library_status(t) -> DataFrame:
    """One row of totals."""
    photos = t.photos.agg(
        F.count_if(F.expr("trashed = 0 and is_video = 0")).alias("photos"), F.count_if(F.expr("trashed = 0 and is_video = 1")).alias("videos"), F.count_if(F.expr("trashed = 1")).alias("trashed")
    )
    others = [f.agg(F.count("*").alias(n)) for n, f in (("albums", t.albums), ("people", t.people), ("faces", t.faces), ("tags", t.tags))]
    for one in others:  # one row each
        photos = photos.join(one)
    return photos


def album_list(t) -> DataFrame:
    """Albums with their number of photos (trashed ones too) and their newest untrashed photo; empty albums stay."""
    live = F.when(F.col("trashed") == 0, F.struct("taken_at", "photo_id"))
    inside = t.photo_albums.join(t.photos.select(F.col("id").alias("photo_id"), "trashed", "taken_at"), "photo_id", "left")
    counts = inside.groupBy("album_id").agg(F.count("*").alias("n"), F.max(live)["photo_id"].alias("cover"))
    return t.albums.join(counts.withColumnRenamed("album_id", "id"), "id", "left").select("id", "name", "kind", F.coalesce("n", F.lit(0)).alias("n"), "cover").orderBy("kind", "name")


def people_list(t) -> DataFrame:
    """People with the photos that show their face, the photos that name them, their clearest face and newest photo."""
    by_face = t.faces.where("person_id is not null").groupBy(F.col("person_id").alias("id")).agg(F.count_distinct("photo_id").alias("face_photos"), F.max(F.struct("det_score", F.col("id").alias("face")))["face"].alias("best_face"))
    dated = people_of(t).join(t.photos.where("trashed = 0").select(F.col("id").alias("photo_id"), "taken_at"), "photo_id")
    covers = dated.groupBy(F.col("person_id").alias("id")).agg(F.max(F.struct("taken_at", "photo_id"))["photo_id"].alias("cover"))
    by_tag = t.photo_people.groupBy(F.col("person_id").alias("id")).agg(F.count_distinct("photo_id").alias("tag_photos"))
    return t.people.join(by_face, "id", "left").join(by_tag, "id", "left").join(covers, "id", "left").select("id", "name", F.coalesce("face_photos", F.lit(0)).alias("face_photos"), F.coalesce("tag_photos", F.lit(0)).alias("tag_photos"), "best_face", "cover")


def tag_counts(t) -> DataFrame:
    return t.photo_tags.groupBy("tag_id").agg(F.count("*").alias("n")).join(t.tags.withColumnRenamed("id", "tag_id"), "tag_id").select("name", "n")


def selection_keywords(t, chosen: DataFrame) -> DataFrame:
    """Keywords on chosen photos (photo_id) and how many of them carry each."""
    return t.photo_tags.join(chosen, "photo_id", "left_semi").groupBy("tag_id").agg(F.count_distinct("photo_id").alias("n")).join(t.tags.withColumnRenamed("id", "tag_id"), "tag_id").select("name", "n")


def folder_counts(photos: DataFrame) -> DataFrame:
    return photos.where("trashed = 0").groupBy(folder_of(F.col("rel_path")).alias("folder")).agg(F.count("*").alias("n"))


def storage_breakdown(photos: DataFrame, top: int = 12, top_years: int = 50, tz: str = "UTC") -> DataFrame:
    """Bytes and rows by folder, year and type in one pass of grouping sets; what is beyond the top is one row of '…'.

    Trashed rows are a group of their own, and every row counts once in the totals.
    """
    rows = photos.select(
        "bytes", folder_of(F.col("rel_path")).alias("folder"), F.coalesce(F.year(wall(F.col("taken_at"), tz)).cast("string"), F.lit("?")).alias("year"), ext_of(F.col("rel_path")).alias("type"), F.col("trashed")
    )
    live = (
        rows.where("trashed = 0")
        .groupingSets([["folder"], ["year"], ["type"], []], "folder", "year", "type")
        .agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.grouping_id().alias("g"))
        .select(F.element_at(F.create_map(F.lit(3), F.lit("folder"), F.lit(5), F.lit("year"), F.lit(6), F.lit("type"), F.lit(7), F.lit("total")), F.col("g").cast("int")).alias("part"), F.coalesce("folder", "year", "type", F.lit("")).alias("name"), "n", "bytes")
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("bytes"), "name"))
    cut = F.when(F.col("part") == "year", top_years).otherwise(top)
    tops = live.withColumn("name", F.when(place <= cut, F.col("name")).otherwise("…")).groupBy("part", "name").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    trash = rows.where("trashed = 1").agg(F.lit("trash").alias("part"), F.lit("").alias("name"), F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return tops.unionByName(trash)


def map_pins(photos: DataFrame, digits: int = 4) -> DataFrame:
    """Places to a number of digits, with the number of photos and the newest one."""
    live = photos.where("trashed = 0 and lat is not null and lng is not null")
    return live.groupBy(F.round("lat", digits).alias("lat"), F.round("lng", digits).alias("lng")).agg(F.count("*").alias("n"), F.max(F.struct("taken_at", "id"))["id"].alias("cover"))


def facets(photos: DataFrame, picks: list[tuple[str, str]], tz: str = "UTC") -> DataFrame:
    """(facet, value, n) of year, month, ext and orientation; a facet is narrowed only by the picks of those before it."""
    at = wall(F.col("taken_at"), tz)
    columns = {"year": F.year(at).cast("string"), "month": F.month(at).cast("string"), "ext": ext_of(F.col("rel_path")), "orientation": orientation(F.col("width"), F.col("height"))}
    chosen = dict(picks)
    passed: Column = F.lit(True)
    entries = []
    for name, column in columns.items():
        entries.append(F.struct(F.lit(name).alias("facet"), column.alias("value"), passed.alias("use")))
        if name in chosen:
            passed = passed & (column == chosen[name])
    long = photos.where("trashed = 0").select(F.explode(F.array(*entries)).alias("e")).where("e.use")
    return long.groupBy("e.facet", "e.value").agg(F.count("*").alias("n"))


def timeline(photos: DataFrame, tz: str = "UTC") -> DataFrame:
    """Month sections, newest first, undated ones last."""
    month = F.when(F.col("taken_at") > 0, F.date_format(wall(F.col("taken_at"), tz), "yyyy-MM"))
    out = photos.where("trashed = 0").groupBy(F.coalesce(month, F.lit("none")).alias("month")).agg(F.count("*").alias("n"))
    return out.orderBy(F.col("month") == "none", F.desc("month"))


def new_in_library(t, since: int) -> DataFrame:
    """What the last import left to do."""
    seen = t.photo_analysis.select(F.col("photo_id").alias("id"), F.lit(1).alias("measured")).distinct()
    faced = t.faces.select(F.col("photo_id").alias("id"), F.lit(1).alias("faced")).distinct()
    new = t.photos.where((F.col("trashed") == 0) & (F.col("imported_at") >= since)).join(seen, "id", "left").join(faced, "id", "left")
    return new.agg(
        F.count("*").alias("total"), F.count_if(F.expr("is_video = 1")).alias("videos"), F.count_if(F.expr("lat is null")).alias("no_place"), F.count_if(F.expr("coalesce(taken_at, 0) = 0")).alias("no_date"),
        F.count_if(F.expr("measured is null and is_video = 0")).alias("unanalysed"), F.count_if(F.expr("faced is null and is_video = 0")).alias("no_faces"),
    )


def frequent_people(t, least: int) -> DataFrame:
    """People whom an export names on at least so many different photos."""
    tagged = t.photo_people.where("source = 'takeout'").groupBy(F.col("person_id").alias("id")).agg(F.count_distinct("photo_id").alias("n"))
    return tagged.where(F.col("n") >= least).join(t.people, "id").select("id", "name", "n")


def colour_counts(colours: DataFrame) -> DataFrame:
    """All twelve colour names with their photos, zeros included; colours has photo_id and colour."""
    every = colours.sparkSession.createDataFrame([(c,) for c in COLOURS], "colour string")
    return F.broadcast(every).join(colours.groupBy("colour").agg(F.count("*").alias("n")), "colour", "left").select("colour", F.coalesce("n", F.lit(0)).alias("n"))


def cleanup_members(t) -> DataFrame:
    """id, bytes, category of photos worth a look, each in one category; trashed rows and videos are left out."""
    a = t.photo_analysis.join(t.photos.where("trashed = 0 and is_video = 0").select(F.col("id").alias("photo_id"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "phash"), "photo_id")
    category = cleanup_category(*map(F.col, ("screenshot", "receipt", "luma", "p95", "sharp", "phash")))
    return a.select(F.col("photo_id").alias("id"), "bytes", category.alias("category")).where("category is not null")


def cleanup_report(members: DataFrame) -> DataFrame:
    """Photos and bytes to be won by category; members has category and bytes, and the ids."""
    return members.groupBy("category").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def analysis_progress(t, version: int) -> DataFrame:
    own = t.photo_analysis.select(F.col("photo_id").alias("id"), "sha", F.col("version").alias("v"), F.col("eyes_closed").alias("eyes"))
    rows = t.photos.where("trashed = 0 and is_video = 0").join(own, "id", "left")
    stale = F.col("v").isNull() | ~F.col("sha").eqNullSafe(F.col("sha256")) | (F.col("v") != version)
    return rows.agg(F.count("*").alias("total"), F.count_if(stale).alias("pending"), F.count_if(F.col("v").isNotNull() & F.col("eyes").isNull()).alias("eyes_pending"))


def unnamed_clusters(faces: DataFrame, least: int = 2, most: int = 300) -> DataFrame:
    """Face clusters without a person on at least so many photos, with their clearest face, largest first."""
    groups = faces.where("cluster_id is not null").groupBy("cluster_id").agg(F.max("person_id").alias("person"), F.count_distinct("photo_id").alias("photos"), F.max(F.struct("det_score", "id"))["id"].alias("cover"))
    return groups.where(F.col("person").isNull() & (F.col("photos") >= least)).select("cluster_id", "photos", "cover").orderBy(F.desc("photos"), "cluster_id").limit(most)


def cluster_vote(t) -> DataFrame:
    """cluster_id, person_id: clusters, those of most faces first, claim the person whom most of their photos name; each person is claimed once.

    Deferred acceptance: every cluster without a person asks the best one it has not asked yet, and a person keeps the
    largest cluster that asked. All persons rank clusters alike, so this ends where going through the clusters by size
    does. Ties go to lower ids.
    """
    from fotolake.storage import settled

    inside = t.faces.where("cluster_id is not null").select("cluster_id", "photo_id").distinct()
    size = t.faces.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("size"))
    votes = inside.join(t.photo_people.select("photo_id", "person_id").distinct(), "photo_id").groupBy("cluster_id", "person_id").agg(F.count("*").alias("v"))
    open_ = settled(votes.join(size, "cluster_id"))
    while True:
        asks = open_.groupBy("cluster_id").agg(F.min(F.struct((-F.col("v")).alias("v"), "person_id"))["person_id"].alias("person_id"))
        asks = asks.join(open_.select("cluster_id", "size").distinct(), "cluster_id")
        held = settled(asks.groupBy("person_id").agg(F.min(F.struct((-F.col("size")).alias("s"), "cluster_id"))["cluster_id"].alias("winner")))
        refused = asks.join(held, "person_id").where("cluster_id <> winner").select("cluster_id", "person_id")
        if refused.isEmpty():
            return held.select(F.col("winner").alias("cluster_id"), "person_id")
        open_ = settled(open_.join(refused, ["cluster_id", "person_id"], "left_anti"))


def person_centroids(faces: DataFrame, key: str) -> DataFrame:
    """key, centroid: mean vector of each group, scaled to length 1; groups whose mean is zero are left out."""
    parts = faces.where(F.col(key).isNotNull() & F.col("embedding").isNotNull()).select(key, F.posexplode("embedding").alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = parts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return whole.withColumn("norm", norm).where("norm > 0").select(key, F.transform("v", lambda x: x / F.col("norm")).alias("centroid"))


def import_stats(outcomes: DataFrame, failures: int = 30) -> DataFrame:
    """Rows and bytes by outcome (status, bytes, name), and of failures the first names in order."""
    ranked = outcomes.where("status = 'failed'").select("status", "name").orderBy("name").limit(failures)
    names = ranked.groupBy("status").agg(F.sort_array(F.collect_list("name")).alias("first"))
    return outcomes.groupBy("status").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).join(F.broadcast(names), "status", "left")


def missing_parts(parts: DataFrame) -> DataFrame:
    """(export, part): numbers from 1 to the largest seen that are not there; parts has export and part."""
    whole = parts.groupBy("export").agg(F.max("part").alias("last")).select("export", F.explode(F.sequence(F.lit(1), F.col("last").cast("int"))).alias("part"))
    return whole.join(parts.select("export", F.col("part").cast("int").alias("part")), ["export", "part"], "left_anti")


def distinct_bytes(inventory: DataFrame) -> DataFrame:
    """Bytes on disk when a file with several names (same dev and inode) counts once."""
    once = inventory.groupBy("dev", "inode").agg(F.max("size").alias("size"))
    return once.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def backup_health(runs: DataFrame, now: int, interval_s: int) -> DataFrame:
    """Last success, whether it is overdue, and failures since; runs has started and ok."""
    limit = max(2 * interval_s, interval_s + 6 * 3600)
    last = runs.agg(F.max(F.when(F.col("ok"), F.col("started"))).alias("last_ok"))
    after = runs.where("not ok").select("started").distinct().join(F.broadcast(last)).where("last_ok is null or started > last_ok")
    overdue = F.col("last_ok").isNull() | (F.lit(now) - F.col("last_ok") > limit)
    return last.join(after.agg(F.count("*").alias("fails_since"))).select("last_ok", overdue.alias("overdue"), "fails_since")


def backup_verify(expected: DataFrame, found: DataFrame, seed: int = 0, sample: int = 25) -> DataFrame:
    """Files expected and found (path, sha), wrong hashes, and a fixed sample of paths to read again."""
    both = expected.alias("e").join(found.alias("f"), "path", "full").select("path", F.col("e.sha").alias("want"), F.col("f.sha").alias("have"))
    chosen = expected.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(sample).agg(F.sort_array(F.collect_list("path")).alias("sample"))
    facts = both.agg(F.count("want").alias("expected"), F.count("have").alias("found"), F.count_if(F.col("want").isNotNull() & F.col("have").isNull()).alias("missing"), F.count_if(F.col("want") != F.col("have")).alias("bad"))
    return facts.join(chosen)


def trash_preview(photos: DataFrame, now: int, days: int) -> DataFrame:
    """What an expiry of so many days (1 to 3650) would delete; trashed_at is when a row was trashed."""
    cutoff = now - min(max(days, 1), 3650) * 86_400
    gone = (F.col("trashed") == 1) & (F.col("trashed_at") < cutoff)
    return photos.agg(F.lit(cutoff).cast("long").alias("cutoff"), F.count_if(gone).alias("n"), F.coalesce(F.sum(F.when(gone, F.col("bytes"))), F.lit(0)).alias("bytes"))
