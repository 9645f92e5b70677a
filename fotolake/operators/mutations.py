"""Changes of a catalog as functions from tables to tables; the caller writes the result as a table's next version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotolake.functions.scalars import date_from_filename, wall
from fotolake.operators.windows import numbered


def batch_patch(photos: DataFrame, ids: DataFrame, fields: dict, now: int) -> DataFrame:
    """photos with the given fields set on the ids only. An empty label is none; trashing sets trashed_at, restoring clears it."""
    fields = dict(fields)
    if "trashed" in fields and "trashed_at" in photos.columns:
        fields["trashed_at"] = now if fields["trashed"] else None
    if fields.get("label") == "":
        fields["label"] = None
    marked = photos.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    types = dict(photos.dtypes)
    return marked.select(*[F.when(F.col("__hit"), F.lit(fields[c]).cast(types[c])).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in photos.columns])


def before_image(photos: DataFrame, ids: DataFrame, fields: dict) -> DataFrame:
    """id and previous values of rows that a patch would change: the entry of an undo log. Rows it leaves alone are not in it."""
    changed = F.lit(False)
    for c, v in fields.items():
        changed = changed | ~F.col(c).eqNullSafe(F.lit(v))
    return photos.join(ids.select("id").distinct(), "id", "left_semi").where(changed).select("id", *fields)


def undo(photos: DataFrame, image: DataFrame) -> DataFrame:
    """photos with the values of a before-image."""
    columns = [c for c in image.columns if c != "id"]
    both = photos.join(image.select("id", *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit")), "id", "left")
    return both.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in photos.columns])


def with_links(photo_tags: DataFrame, closure: DataFrame) -> DataFrame:
    """The bridge and, with source 'link', every keyword that links make equivalent to one a photo has (closure: tag_id, root)."""
    have = photo_tags.join(closure, "tag_id").select("photo_id", "root").distinct()
    every = have.join(closure, "root").select("photo_id", "tag_id")
    return photo_tags.unionByName(every.join(photo_tags.select("photo_id", "tag_id").distinct(), ["photo_id", "tag_id"], "left_anti").withColumn("source", F.lit("link")))


def add_tags(photo_tags: DataFrame, chosen: DataFrame, tag_ids: list[int], closure: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """The bridge with tags added to the chosen photos and to those in a series with them (series: series, id), and with them
    all that links make equivalent (closure: tag_id, root)."""
    from fotolake.operators.windows import series_members

    spark = photo_tags.sparkSession
    given = spark.createDataFrame([(x,) for x in tag_ids], "tag_id long")
    roots = given.join(closure, "tag_id").select("root").distinct()
    linked = closure.join(roots, "root").select("tag_id", F.lit("link").alias("source"))
    every = given.withColumn("source", F.lit("manual")).unionByName(linked.join(given, "tag_id", "left_anti"))
    ids = chosen.select(F.col("photo_id").alias("id")).distinct()
    if series is not None:
        ids = series_members(series, ids)
    # The given tags and their equivalents are a request's own, and few.
    new = ids.withColumnRenamed("id", "photo_id").join(F.broadcast(every)).select("photo_id", "tag_id", "source")
    return photo_tags.unionByName(new.join(photo_tags.select("photo_id", "tag_id"), ["photo_id", "tag_id"], "left_anti"))


def remove_tags(photo_tags: DataFrame, chosen: DataFrame, tag_ids: list[int]) -> DataFrame:
    gone = chosen.select("photo_id", F.explode(F.array(*[F.lit(x).cast("long") for x in tag_ids])).alias("tag_id"))
    return photo_tags.join(gone, ["photo_id", "tag_id"], "left_anti")


def time_rules(photos: DataFrame, photo_tags: DataFrame, rules: list[tuple[int, int, int]], closure: DataFrame | None = None, tz: str = "UTC") -> DataFrame:
    """The bridge after rules (tag_id, hour from, hour to) are applied anew: what rules set before goes first. Hours may pass
    midnight; at most twenty rules. Keywords linked to those that photos then have follow (closure: tag_id, root)."""
    if len(rules) > 20:
        raise ValueError("at most 20 rules")
    hour = F.hour(wall(F.col("taken_at"), tz))
    hit = lambda a, b: hour.between(a, b) if a <= b else (hour >= a) | (hour <= b)
    tags = F.filter(F.array(*[F.when(hit(a, b), F.lit(t).cast("long")) for t, a, b in rules]), lambda x: x.isNotNull())
    new = photos.where("trashed = 0 and coalesce(taken_at, 0) > 0").select(F.col("id").alias("photo_id"), F.explode(F.array_distinct(tags)).alias("tag_id"), F.lit("rule").alias("source"))
    kept = photo_tags.where("source <> 'rule'")
    found = kept.unionByName(new.join(kept.select("photo_id", "tag_id"), ["photo_id", "tag_id"], "left_anti"))
    return found if closure is None else with_links(found, closure)


def set_ai_tags(photo_tags: DataFrame, tags: DataFrame, answers: DataFrame, closure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bridge, tags) after answers (photo_id, words): rows of source 'ai' of those photos give way to one per keyword, on the
    lowest id of a tag of that name in any case or on a new tag; keywords linked to them follow (closure: tag_id, root).

    New tags are numbered past the greatest id in the order of a hash of their names.
    """
    known = tags.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("id"))
    words = answers.select("photo_id", F.explode("words").alias("name")).withColumn("key", F.lower("name"))
    fresh = words.join(known, "key", "left_anti").groupBy("key").agg(F.min("name").alias("name"))
    top = tags.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    made = numbered(fresh, ["key"], "n").join(F.broadcast(top)).select("key", (F.col("top") + 1 + F.col("n")).cast("long").alias("id"), "name")
    ids = known.unionByName(made.select("key", "id"))
    rows = words.join(ids, "key").select("photo_id", F.col("id").alias("tag_id")).distinct()
    others = photo_tags.join(answers.select("photo_id").distinct().withColumn("source", F.lit("ai")), ["photo_id", "source"], "left_anti").select("photo_id", "tag_id", "source")
    added = rows.join(others.select("photo_id", "tag_id"), ["photo_id", "tag_id"], "left_anti").withColumn("source", F.lit("ai"))
    mine = with_links(others.join(answers.select("photo_id").distinct(), "photo_id", "left_semi").unionByName(added), closure)
    rest = others.join(answers.select("photo_id").distinct(), "photo_id", "left_anti")
    return rest.unionByName(mine), tags.select("id", "name").unionByName(made.select("id", "name"))


def upsert_album(albums: DataFrame, incoming: DataFrame) -> DataFrame:
    """albums by name with the new values where they are given, and the new albums."""
    both = albums.alias("o").join(incoming.alias("n"), "name", "full")
    return both.select("name", *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in incoming.columns else F.col(f"o.{c}") for c in albums.columns if c != "name"])


def merge_fields(photos: DataFrame, incoming: DataFrame, fields: list[str]) -> DataFrame:
    """photos with incoming values by sha256 where those say something: they replace what is there, and never clear it."""
    says = lambda c: F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "0", "0.0", "false")
    side = incoming.groupBy("sha256").agg(*[F.max(F.when(says(c), F.col(c))).alias(f"__{c}") for c in fields])
    both = photos.join(side, "sha256", "left")
    return both.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in photos.columns])


def merge_people(photo_people: DataFrame, faces: DataFrame, source: tuple[str, int], target: tuple[str, int]) -> tuple[DataFrame, DataFrame]:
    """Bridge and faces after a source is merged into a target, each ('person' or 'cluster', id).

    Person into person moves rows of both tables, of doubled rows of the bridge the target's own stays; cluster into person
    names the cluster's faces that have no person; cluster into cluster moves its faces. Anything else is refused.
    """
    kinds, a, b = (source[0], target[0]), source[1], target[1]
    if source == target or kinds not in (("person", "person"), ("cluster", "person"), ("cluster", "cluster")):
        raise ValueError(f"{source} cannot be merged into {target}")
    moved = lambda column, where: faces.withColumn(column, F.when(where, F.lit(b).cast("long")).otherwise(F.col(column)))
    if kinds == ("cluster", "person"):
        return photo_people, moved("person_id", (F.col("cluster_id") == a) & F.col("person_id").isNull())
    if kinds == ("cluster", "cluster"):
        return photo_people, moved("cluster_id", F.col("cluster_id") == a)
    mine = F.col("person_id") == a
    rows = photo_people.select("photo_id", F.when(mine, F.lit(b).cast("long")).otherwise(F.col("person_id")).alias("person_id"), F.struct(mine.alias("late"), "source").alias("s"))
    return rows.groupBy("photo_id", "person_id").agg(F.min("s")["source"].alias("source")), moved("person_id", mine)


def rename_person(people: DataFrame, photo_people: DataFrame, person: int, name: str) -> tuple[DataFrame, DataFrame]:
    """people and bridge after a renaming; a name that another person has already merges the two."""
    renamed = people.withColumn("name", F.when(F.col("id") == person, F.lit(name)).otherwise(F.col("name")))
    # Only the renamed person can collide, so one row decides.
    other = people.where((F.lower("name") == name.lower()) & (F.col("id") != person)).agg(F.min("id").alias("target"))
    moved = photo_people.join(F.broadcast(other)).select("photo_id", F.when((F.col("person_id") == person) & F.col("target").isNotNull(), F.col("target")).otherwise(F.col("person_id")).alias("person_id"), "source")
    left = renamed.join(F.broadcast(other)).where(~((F.col("id") == person) & F.col("target").isNotNull())).drop("target")
    return left, moved.groupBy("photo_id", "person_id").agg(F.min("source").alias("source"))


def name_cluster(faces: DataFrame, people: DataFrame, cluster: int, name: str, new_id: int) -> tuple[DataFrame, DataFrame]:
    """faces and people after a cluster gets a name: the person of that name, or a new one."""
    found = people.where(F.lower("name") == name.lower()).agg(F.coalesce(F.min("id"), F.lit(new_id)).alias("target"))
    named = faces.join(F.broadcast(found)).withColumn("person_id", F.when((F.col("cluster_id") == cluster) & F.col("person_id").isNull(), F.col("target")).otherwise(F.col("person_id"))).drop("target")
    fresh = found.select(F.col("target").alias("id"), F.lit(name).alias("name")).join(people.select("id"), "id", "left_anti")
    return named, people.select("id", "name").unionByName(fresh)


def dates_from_names(photos: DataFrame, this_year: int) -> DataFrame:
    """photos with a date from the file name where they have none."""
    return photos.withColumn("taken_at", F.when(F.coalesce("taken_at", F.lit(0)) == 0, F.coalesce(date_from_filename(F.col("filename"), this_year), F.col("taken_at"))).otherwise(F.col("taken_at")))


def apply_geotags(photos: DataFrame, found: DataFrame) -> DataFrame:
    """photos with places (id, lat, lng) where they have none and the place is a possible one."""
    side = found.where(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)).groupBy("id").agg(F.min(F.struct("lat", "lng")).alias("__p"))
    both = photos.join(side, "id", "left")
    use = F.col("lat").isNull() & F.col("__p").isNotNull()
    return both.select(*[F.when(use, F.col(f"__p.{c}")).otherwise(F.col(c)).alias(c) if c in ("lat", "lng") else F.col(c) for c in photos.columns])


def delete_forever(photos: DataFrame, bridges: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the trashed photos among ids; photos that are not trashed stay."""
    gone = photos.where("trashed = 1").join(ids.select("id"), "id", "left_semi").select("id")
    out = {name: b.join(gone.withColumnRenamed("id", "photo_id"), "photo_id", "left_anti") for name, b in bridges.items()}
    return out | {"photos": photos.join(gone, "id", "left_anti")}


def album_create(albums: DataFrame, name: str) -> DataFrame:
    """albums (id, name, kind) with a new one, numbered past the greatest id; a name that is blank or taken is refused."""
    name = name.strip()
    if not name or not albums.where(F.col("name") == name).isEmpty():
        raise ValueError(f"no new album can be called {name!r}")
    new = albums.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id")).select("id", F.lit(name).alias("name"), F.lit("album").alias("kind"))
    return albums.select("id", "name", "kind").unionByName(new)


def album_rename(albums: DataFrame, album: int, name: str) -> DataFrame:
    """albums with another name for one of them; a name that is blank or another's is refused."""
    name = name.strip()
    if not name or not albums.where((F.col("name") == name) & (F.col("id") != album)).isEmpty():
        raise ValueError(f"no album can be called {name!r}")
    return albums.withColumn("name", F.when(F.col("id") == album, F.lit(name)).otherwise(F.col("name")))


def album_delete(albums: DataFrame, photo_albums: DataFrame, album: int) -> tuple[DataFrame, DataFrame]:
    """albums and bridge without an album; its photos stay."""
    return albums.where(F.col("id") != album), album_remove(photo_albums, album)


def album_remove(photo_albums: DataFrame, album: int, ids: DataFrame | None = None) -> DataFrame:
    """The bridge without some photos of an album, or without the album; photos stay."""
    if ids is None:
        return photo_albums.where(F.col("album_id") != album)
    return photo_albums.join(ids.select(F.col("id").alias("photo_id"), F.lit(album).cast("long").alias("album_id")), ["photo_id", "album_id"], "left_anti")


def album_add(photo_albums: DataFrame, album: int, ids: DataFrame) -> DataFrame:
    return photo_albums.unionByName(ids.select(F.col("id").alias("photo_id"), F.lit(album).cast("long").alias("album_id"))).distinct()


def tag_link_add(links: DataFrame, tags: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, tags) after pairs of names (x, y) are linked: tags are looked up in any case, the lowest id first, and made where
    there is none; a pair is stored once, in order, and a keyword is not linked to itself."""
    known = tags.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("id"))
    clean = pairs.select(F.trim("x").alias("x"), F.trim("y").alias("y")).where("x <> '' and y <> '' and lower(x) <> lower(y)")
    names = clean.select(F.col("x").alias("name")).unionByName(clean.select(F.col("y").alias("name"))).withColumn("key", F.lower("name"))
    fresh = names.join(known, "key", "left_anti").groupBy("key").agg(F.min("name").alias("name"))
    top = tags.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    made = numbered(fresh, ["key"], "n").join(F.broadcast(top)).select("key", (F.col("top") + 1 + F.col("n")).cast("long").alias("id"), "name")
    ids = known.unionByName(made.select("key", "id"))
    both = clean.select(F.lower("x").alias("x"), F.lower("y").alias("y")).join(ids.toDF("x", "p"), "x").join(ids.toDF("y", "q"), "y")
    new = both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return links.unionByName(new).distinct(), tags.select("id", "name").unionByName(made.select("id", "name"))


def tag_link_remove(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """links without pairs of ids (a, b), whichever comes first."""
    gone = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return links.join(gone, ["a", "b"], "left_anti")


def saved_search_upsert(saved: DataFrame, incoming: DataFrame) -> DataFrame:
    """(name, criteria, made): the latest row of each name."""
    both = saved.unionByName(incoming)
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("made"), F.desc("criteria")))
    return both.withColumn("__place", place).where("__place = 1").drop("__place")


def saved_search_delete(saved: DataFrame, names: DataFrame) -> DataFrame:
    return saved.join(names.select("name"), "name", "left_anti")


def saved_search_evaluate(t, criteria: str) -> DataFrame:
    """Photos of one saved search (JSON); anything but an object selects nothing."""
    import json

    from fotolake.operators.rules import RuleSet

    try:
        held = json.loads(criteria)
    except ValueError:
        held = None
    return RuleSet(held if isinstance(held, dict) else {}).select(t)


def smart_from_people(t, saved: DataFrame, least: int) -> DataFrame:
    """New smart lists (name, criteria), one per person whom an export names often, but for names that exist."""
    from fotolake.operators.aggregates import frequent_people

    new = frequent_people(t, least).select("name", F.to_json(F.struct(F.array("id").alias("people"))).alias("criteria"))
    return new.join(saved.select("name"), "name", "left_anti")
