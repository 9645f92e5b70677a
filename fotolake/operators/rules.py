"""Rule-based search: a dictionary of criteria becomes one plan of pushed predicates, semi joins and anti joins."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.functions.scalars import COLOURS, EARTH_KM, colour_bucket, haversine_km, in_box, is_panorama, orientation, wall

DAY = 86_400


def day_start(text: Any) -> int | None:
    """Unix seconds of a day written as YYYY-MM-DD; anything else is no day."""
    try:
        return int(datetime.strptime(str(text), "%Y-%m-%d").replace(tzinfo=timezone.utc).timestamp())
    except ValueError:
        return None


def matches(column: Column, text: str) -> Column:
    """Contains, regardless of case, % and _ being wildcards as in LIKE."""
    return F.lower(column).like(f"%{text.lower()}%")


class RuleSet:
    """Criteria over a catalog. Tables are DataFrames by name: photos, photo_people, faces, people, photo_tags, tags,
    photo_albums, photo_analysis, photo_color. An empty set of rules selects nothing. Rules with an empty or zero value
    do not count, but for hours, where 0 is an hour."""

    def __init__(self, criteria: dict[str, Any], tz: str = "UTC"):
        self.criteria, self.tz = criteria, tz
        self.plain: list[Column] = []
        self.members: list[Callable[[Any], tuple[DataFrame, str]]] = []
        self._compile()

    def _get(self, key: str) -> Any:
        return self.criteria.get(key) or None

    def _texts(self, key: str) -> list[str]:
        """Entries of a list, or of a text with commas, that are not blank."""
        v = self._get(key) or []
        return [x for x in (str(y).strip() for y in (v.split(",") if isinstance(v, str) else v)) if x]

    def _of(self, key: str, allowed) -> list:
        return [x for x in self._get(key) or [] if x in allowed]

    def _numbers(self, key: str) -> list[int]:
        return [int(x) for x in self._get(key) or [] if str(x).lstrip("-").isdigit()]

    def _compile(self) -> None:
        c, at = F.col, wall(F.col("taken_at"), self.tz)
        add, member = self.plain.append, lambda f, how="left_semi": self.members.append(lambda t: (f(t), how))
        for key, column in (("cameras", "camera_model"), ("lenses", "lens")):
            if v := self._texts(key):
                add(F.lower(c(column)).isin([x.lower() for x in v]))
        ranges = (("minFocal", "maxFocal", c("focal_length"), 1), ("minMB", "maxMB", c("bytes"), 1_048_576), ("minMP", "maxMP", c("width") * c("height"), 1_000_000))
        for low, high, column, unit in ranges:
            if v := self._get(low):
                add(column >= float(v) * unit)
            if v := self._get(high):
                add(column <= float(v) * unit)
        for low, high, column in (("from", "to", c("taken_at")), ("addedFrom", "addedTo", c("imported_at"))):
            if (v := day_start(self._get(low))) is not None:
                add(column >= v)
            if (v := day_start(self._get(high))) is not None:
                add(column < v + DAY)
        if (v := self._get("kind")) in ("photo", "video"):
            add(c("is_video") == (1 if v == "video" else 0))
        if self._get("pano"):
            add(is_panorama(c("width"), c("height"), c("is_video")))
        if v := self._texts("exts"):
            ends = [x.lower().lstrip(".").replace("%", "").replace("_", "") for x in v]
            add(_any([F.lower("filename").endswith(f".{e}") for e in ends]))
        if v := self._get("years"):
            add(F.year(at).isin([int(x) for x in v]))
        if v := self._numbers("months"):
            add(F.month(at).isin(v))
        if v := [x for x in self._numbers("weekdays") if 0 <= x <= 6]:
            add((F.dayofweek(at) - 1).isin(v))
        self._hours(F.hour(at))
        if v := self._get("minRating"):
            add(c("rating") >= int(v))
        rating = F.coalesce(c("rating"), F.lit(0))
        if (v := self._get("rating")) and (op := self.criteria.get("ratingOp")) in (">=", "<=", "="):
            add({"<=": rating <= int(v), "=": rating == int(v), ">=": rating >= int(v)}[op])
        if self._get("favorite") or self._get("fav"):
            add(c("favorited") == 1)
        if (v := self._get("flag")) in ("pick", "reject"):
            add(c("flag") == (1 if v == "pick" else -1))
        options = {"pick": c("flag") == 1, "rej": c("flag") == -1, "none": F.coalesce(c("flag"), F.lit(0)) == 0}
        if v := self._of("flags", options):
            add(_any([options[x] for x in v]))
        if v := [x for x in self._get("labels") or [] if x]:
            add(c("label").isin(v))
        if v := [x for x in self._get("colors") or [] if x]:
            named = F.coalesce(c("label").isin([x for x in v if x != "none"]), F.lit(False))
            add(named | (F.coalesce(c("label"), F.lit("")) == "") if "none" in v else named)
        if self._get("edited"):
            add(c("edited") == 1)
        if v := self._of("orients", ("landscape", "portrait", "square", "unknown")):
            add(orientation(c("width"), c("height")).isin(v))
        placed = c("lat").isNotNull() & c("lng").isNotNull()
        if self._get("hasPlace"):
            add(placed)
        if (v := self._get("gps")) in ("has", "none"):
            add(placed if v == "has" else ~placed)
        if v := str(self._get("text") or "").strip():
            add(F.coalesce(matches(c("filename"), v), F.lit(False)) | F.coalesce(matches(c("description"), v), F.lit(False)))
        if v := self._get("place"):
            add(near(v))
        # Membership.
        if v := [int(x) for x in self._get("people") or []]:
            member(lambda t, v=v: _grouped(people_of(t), "person_id", v, self.criteria.get("peopleAll")))
        if v := self._numbers("persons"):
            member(lambda t, v=v: people_of(t).where(F.col("person_id").isin(v)).select("photo_id"))
        for key, every in (("tags", "tagsAll"), ("keywords", "keywordsAll")):
            if v := self._texts(key):
                member(lambda t, n=[x.lower() for x in v], e=every: _grouped(named_tags(t), "tag", n, self.criteria.get(e)))
        for key, table in (("kw", "photo_tags"), ("faces", "faces")):
            if (v := self._get(key)) in ("has", "none"):
                member(lambda t, table=table: getattr(t, table).select("photo_id"), "left_semi" if v == "has" else "left_anti")
        if v := self._numbers("albumIds"):
            member(lambda t, v=v: t.photo_albums.where(F.col("album_id").isin(v)).select("photo_id"))
        if v := self._of("dominant", COLOURS):
            member(lambda t, v=v: t.photo_color.where(colour_bucket(c("r"), c("g"), c("b")).isin(v)).select("photo_id"))
        for key in ("minScore", "score"):
            if v := self._get(key):
                member(lambda t, v=v: t.photo_analysis.where(F.col("score") >= int(v)).select("photo_id"))
        if v := str(self._get("q") or "").strip():
            member(lambda t, v=v: text_hits(t, v, self.criteria.get("qf") == "name"))

    def _hours(self, hour: Column) -> None:
        given = [self.criteria.get(k) for k in ("hourFrom", "hourTo")]
        low, high = (int(x) if str("" if x is None else x).isdigit() else None for x in given)
        if low is None and high is None:
            return
        if low is not None and high is not None and low > high:
            inside = (hour >= low) | (hour <= high)
        else:
            inside = (hour >= (low or 0)) & (hour <= (99 if high is None else high))
        self.plain.append(F.col("taken_at").isNotNull() & inside)

    @property
    def empty(self) -> bool:
        return not self.plain and not self.members

    def select(self, tables: Any) -> DataFrame:
        """Untrashed photos that meet every rule."""
        photos = tables.photos
        if self.empty:
            return photos.where(F.lit(False))
        out = photos.where("trashed = 0")
        for p in self.plain:
            out = out.where(p)
        for find in self.members:
            ids, how = find(tables)
            out = out.join(ids.withColumnRenamed("photo_id", "id"), "id", how)
        return out


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def people_of(tables: Any) -> DataFrame:
    """(photo_id, person_id): people by tag or by face, once each."""
    by_face = tables.faces.where("person_id is not null").select("photo_id", "person_id")
    return tables.photo_people.select("photo_id", "person_id").unionByName(by_face).distinct()


def named_tags(tables: Any) -> DataFrame:
    names = tables.tags.select(F.col("id").alias("tag_id"), F.lower("name").alias("tag"))
    return tables.photo_tags.join(names, "tag_id").select("photo_id", "tag").distinct()


def _grouped(bridge: DataFrame, column: str, values: list, every: bool | None) -> DataFrame:
    """photo_ids with any of the values, or with all of them."""
    found = bridge.where(F.col(column).isin(values))
    if not every:
        return found.select("photo_id")
    return found.groupBy("photo_id").agg(F.count_distinct(column).alias("n")).where(F.col("n") >= len(set(values))).select("photo_id")


def text_hits(tables: Any, text: str, names_only: bool = False) -> DataFrame:
    """photo_ids with the text in the file name, or also in description, keywords or people's names."""
    own = matches(F.col("filename"), text)
    if names_only:
        return tables.photos.where(own).select(F.col("id").alias("photo_id"))
    hits = tables.photos.where(own | F.coalesce(matches(F.col("description"), text), F.lit(False))).select(F.col("id").alias("photo_id"))
    tagged = tables.photo_tags.join(tables.tags.where(matches(F.col("name"), text)).select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    shown = people_of(tables).join(tables.people.where(matches(F.col("name"), text)).select(F.col("id").alias("person_id")), "person_id", "left_semi")
    return hits.unionByName(tagged.select("photo_id")).unionByName(shown.select("photo_id"))


def near(place: dict[str, Any]) -> Column:
    """A circle (lat, lng, km) or a box (south, north, west, east). A circle is first cut by latitude, which scans can push down."""
    lat, lng = F.col("lat"), F.col("lng")
    if place.get("box"):
        south, north, west, east = (float(x) for x in place["box"])
        return in_box(lat, lng, south, west, north, east)
    km = float(place["km"])
    band = km / EARTH_KM * 2 * 57.29577951308232 * 1.001
    exact = haversine_km(F.lit(float(place["lat"])), F.lit(float(place["lng"])), lat, lng) <= km
    return lat.between(place["lat"] - band, place["lat"] + band) & exact


def attribute_bar(flags: list[str], rating: int, op: str, labels: list[str], kinds: list[str]) -> Column:
    """Filter bar: choices of one row are alternatives, rows add up."""
    rules = RuleSet({"flags": flags, "rating": rating, "ratingOp": op, "colors": labels})
    out = F.lit(True)
    for p in rules.plain:
        out = out & p
    return out & _any([F.col("is_video") == int(k == "video") for k in kinds]) if kinds else out


def untagged(tables: Any) -> DataFrame:
    """Pictures without any keyword: what is left to be tagged."""
    live = tables.photos.where("trashed = 0 and is_video = 0")
    return live.join(tables.photo_tags.select(F.col("photo_id").alias("id")), "id", "left_anti")


# The rules that make a saved search a smart one.
SMART_KEYS = ["people", "tags", "years", "minRating", "favorite", "flag", "labels", "minScore", "hasPlace", "text"]


def is_smart(criteria: Column) -> Column:
    """Whether criteria (JSON) say that they are smart or hold one of SMART_KEYS with a value; false for anything else."""
    held = F.from_json(criteria, "map<string,string>")
    blank = ["", "0", "0.0", "false", "null", "[]", "{}"]
    says = [~F.coalesce(F.try_element_at(held, F.lit(k)), F.lit("")).isin(blank) for k in ("smart", *SMART_KEYS)]
    return held.isNotNull() & _any(says)


def smart_list(name: str, now: int) -> Column:
    """Predicate of a ready-made list; untagged() is the one that needs a second table."""
    return {
        "red": F.col("label") == "red",
        "five_stars": F.col("rating") == 5,
        "picks": F.col("flag") == 1,
        "last_month": F.coalesce("taken_at", F.lit(0)) > now - 30 * DAY,
        "videos": F.col("is_video") == 1,
        "edited": F.col("edited") == 1,
        "favourites": F.col("favorited") == 1,
    }[name]


def on_this_day(today: date, tz: str = "UTC") -> Column:
    at = wall(F.col("taken_at"), tz)
    return (F.month(at) == today.month) & (F.dayofmonth(at) == today.day) & (F.year(at) != today.year)


def source_filter(tables: Any, kind: str, value: Any) -> DataFrame:
    """Photos of a list source: album, person, cluster, tag, favorite, import (since), folder ('' is the root), year, trashed."""
    photos = tables.photos
    live = photos.where("trashed = 0")
    by = lambda ids: live.join(ids.select(F.col("photo_id").alias("id")), "id", "left_semi")
    match kind:
        case "album":
            return by(tables.photo_albums.where(F.col("album_id") == value))
        case "person":
            return by(people_of(tables).where(F.col("person_id") == value))
        case "cluster":
            return by(tables.faces.where(F.col("cluster_id") == value))
        case "tag":
            return by(named_tags(tables).where(F.col("tag") == str(value).lower()))
        case "favorite":
            return live.where("favorited = 1")
        case "import":
            return live.where(F.col("imported_at") >= value)
        case "folder":
            prefix = F.col("rel_path").startswith(f"{value}/") if value else ~F.col("rel_path").contains("/")
            return live.where(prefix)
        case "year":
            start, end = day_start(f"{value}-01-01"), day_start(f"{int(value) + 1}-01-01")
            return live.where((F.col("taken_at") >= start) & (F.col("taken_at") < end))
        case "trashed":
            return photos.where("trashed = 1")
    raise ValueError(kind)


def no_keywords(tables: Any) -> DataFrame:
    """The ready-made list of photos and videos without any keyword."""
    return tables.photos.where("trashed = 0").join(tables.photo_tags.select(F.col("photo_id").alias("id")), "id", "left_anti")


def slideshow(tables: Any, favourites: bool = False, album: int | None = None, oldest_first: bool = False) -> DataFrame:
    """Pictures for a slideshow: no videos, nothing rejected, newest or oldest first, of one time by id."""
    out = tables.photos.where("trashed = 0 and is_video = 0 and coalesce(flag, 0) <> -1")
    if favourites:
        out = out.where("favorited = 1")
    if album is not None:
        out = out.join(tables.photo_albums.where(F.col("album_id") == album).select(F.col("photo_id").alias("id")), "id", "left_semi")
    return out.orderBy(F.asc("taken_at") if oldest_first else F.desc("taken_at"), "id")


def typed_queries(queries: DataFrame, people: DataFrame) -> DataFrame:
    """Parses many typed queries (query_id, query): persons by the longest run of up to four words that is a full name, else
    a word of two letters or more that belongs to one person only; four-digit years of 1900 to 2100; the other words.

    Returns query_id, person_ids, years, words. Runs are found by one equi-join of word runs with names; a run wins when
    it begins before all runs that it overlaps, or at the same word and is longer.
    """
    words = queries.select("query_id", F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda w: w != "").alias("w"))
    runs = words.select("query_id", "w", F.posexplode("w").alias("at", "word")).select(
        "query_id", "at", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.size("w") - F.col("at"))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("w", F.col("at") + 1, n), " ").alias("run")))).alias("r")
    ).select("query_id", "at", "r.n", "r.run")
    full = people.select(F.col("id").alias("person_id"), F.lower("name").alias("run")).groupBy("run").agg(F.min("person_id").alias("person_id"))
    single = (
        people.select(F.col("id").alias("person_id"), F.explode(F.split(F.lower("name"), r"\s+")).alias("run"))
        .where(F.length("run") >= 2)
        .groupBy("run")
        .agg(F.min("person_id").alias("person_id"), F.count_distinct("person_id").alias("owners"))
        .where("owners = 1")
        .drop("owners")
    )
    named = runs.join(full, "run").unionByName(runs.where("n = 1").join(single.join(full, "run", "left_anti"), "run"))
    # All matched runs of a query (at most four per word) meet in its own row.
    best = named.groupBy("query_id", "at").agg(F.max(F.struct("n", "person_id")).alias("m")).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "m.n", "m.person_id"))).alias("found")
    )
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<at:int,n:int,person_id:bigint>>").alias("taken"))
    greedy = F.aggregate(
        "found",
        start,
        lambda acc, x: F.when(x["at"] >= acc["free"], F.struct((x["at"] + x["n"]).alias("free"), F.concat(acc["taken"], F.array(F.struct(x["at"].alias("at"), x["n"].alias("n"), x["person_id"].cast("bigint").alias("person_id")))).alias("taken"))).otherwise(acc),
        lambda acc: acc["taken"],
    )
    taken = best.select("query_id", greedy.alias("taken"))
    both = words.join(taken, "query_id", "left")
    used = F.coalesce(F.flatten(F.transform("taken", lambda t: F.sequence(t["at"], t["at"] + t["n"] - 1))), F.array().cast("array<int>"))
    rest = F.transform(F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: ~F.array_contains(used, x["i"])), lambda x: x["w"])
    both = both.withColumn("rest", rest)
    year = lambda w: w.rlike(r"^\d{4}$") & w.between("1900", "2100")
    return both.select(
        "query_id",
        F.coalesce(F.array_sort(F.array_distinct(F.transform("taken", lambda t: t["person_id"]))), F.array().cast("array<bigint>")).alias("person_ids"),
        F.array_sort(F.array_distinct(F.transform(F.filter("rest", year), lambda w: w.cast("int")))).alias("years"),
        F.filter("rest", lambda w: ~year(w)).alias("words"),
    )
