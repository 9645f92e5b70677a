"""Joins of a catalog: as-of geotags, time neighbours, hash bands, incremental work, matching of incoming files, plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.functions.scalars import hamming64, hash_band, media_stem, norm_counter, sidecar_target
from fotolake.operators.hashes import copies
from fotolake.operators.windows import BLOCK, numbered, prev_next, ranked
from fotolake.storage import apart, settled


def photos_in_album(t, album: int) -> DataFrame:
    return t.photos.where("trashed = 0").join(t.photo_albums.where(F.col("album_id") == album).select(F.col("photo_id").alias("id")), "id", "left_semi")


def pending_analysis(t, version: int) -> DataFrame:
    """Photos without measures, or with those of other content or of another version."""
    own = t.photo_analysis.select(F.col("photo_id").alias("id"), "sha", F.col("version").alias("v"))
    rows = t.photos.where("trashed = 0 and is_video = 0").join(own, "id", "left")
    return rows.where(F.col("v").isNull() | ~F.col("sha").eqNullSafe(F.col("sha256")) | (F.col("v") != version)).select("id", "sha256")


def pending_embeddings(photos: DataFrame, vectors: DataFrame) -> DataFrame:
    """Photos whose vector (photo_id, sha) is missing or of other content."""
    rows = photos.where("trashed = 0 and is_video = 0").join(vectors.select(F.col("photo_id").alias("id"), "sha"), "id", "left")
    return rows.where(~F.col("sha").eqNullSafe(F.col("sha256"))).select("id", "sha256")


def geotag_from_track(photos: DataFrame, track: DataFrame, offset_min: int = 0, max_gap_s: int = 900, keys: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """id, lat, lng for photos without a place from a track (ts, lat, lng), both sides as of the capture time.

    The point before is strictly earlier, the one after at or later. With both within the gap and at different times the
    place is interpolated, else the nearer one counts, the earlier one at equal distance. Six decimals.
    """
    asks = photos.where("lat is null and coalesce(taken_at, 0) > 0").select(*keys, "id", (F.col("taken_at") - offset_min * 60).alias("t"), F.lit(0).alias("point"), *[F.lit(None).cast("double").alias(c) for c in ("lat", "lng")])
    points = track.groupBy(*keys, F.col("ts").alias("t")).agg(F.min(F.struct("lat", "lng")).alias("p"))
    points = points.select(*keys, F.lit(None).cast("long").alias("id"), "t", F.lit(1).alias("point"), F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"))
    both = prev_next(asks.unionByName(points), ["t", "point", "id"], F.when(F.col("point") == 1, F.struct("t", "lat", "lng")), "p", keys, block)
    near = both.where("point = 0").withColumn("before", F.col("t") - F.col("p_prev.t")).withColumn("after", F.col("p_next.t") - F.col("t"))
    lo, hi = F.coalesce(F.col("before") <= max_gap_s, F.lit(False)), F.coalesce(F.col("after") <= max_gap_s, F.lit(False))
    share = F.col("before") / (F.col("before") + F.col("after"))

    def place(c: str) -> Column:
        line = F.col(f"p_prev.{c}") + (F.col(f"p_next.{c}") - F.col(f"p_prev.{c}")) * share
        return F.round(F.when(lo & hi & (F.col("before") + F.col("after") > 0), line).when(lo & (~hi | (F.col("before") <= F.col("after"))), F.col(f"p_prev.{c}")).otherwise(F.col(f"p_next.{c}")), 6)

    return near.where(lo | hi).select("id", place("lat").alias("lat"), place("lng").alias("lng"))


def geotag_from_neighbors(photos: DataFrame, max_gap_s: int = 1800, block: int = BLOCK) -> DataFrame:
    """id, source_id: photos without a place and the placed one nearest in time, the earlier one at equal distance."""
    dated = photos.where("trashed = 0 and coalesce(taken_at, 0) > 0").select("id", "taken_at", "lat", "lng")
    both = prev_next(dated, ["taken_at", "id"], F.when(F.col("lat").isNotNull(), F.struct("taken_at", "id", "lat", "lng")), "p", (), block)
    asks = both.where("lat is null").withColumn("before", F.col("taken_at") - F.col("p_prev.taken_at")).withColumn("after", F.col("p_next.taken_at") - F.col("taken_at"))
    first = F.coalesce(F.col("before") <= F.coalesce("after", "before"), F.lit(False))
    source = F.when(first, F.col("p_prev")).otherwise(F.col("p_next"))
    gap = F.when(first, F.col("before")).otherwise(F.col("after"))
    return asks.where(gap <= max_gap_s).select("id", source["id"].alias("source_id"), source["lat"].alias("lat"), source["lng"].alias("lng"))


def following(frame: DataFrame, order: list[str], most: int, what: Column, name: str = "next", block: int = 4096) -> DataFrame:
    """frame with name: the values of what of up to most rows that follow each in an order that is unique, nearest first.

    Rows are numbered and dealt to blocks of equal size, so that however many share a time no block grows; the head of each
    block is lent to the one before.
    """
    placed = numbered(frame.withColumn("__what", what), order, "__n")
    at = F.floor(F.col("__n") / block)
    lent = placed.where((F.col("__n") % block < most) & (F.col("__n") >= block)).withColumn("__block", at - 1).withColumn("__own", F.lit(False))
    rows = placed.withColumn("__block", at).withColumn("__own", F.lit(True)).unionByName(lent)
    ahead = Window.partitionBy("__block").orderBy("__n").rowsBetween(1, most)
    return rows.withColumn(name, F.collect_list("__what").over(ahead)).where("__own").select(*frame.columns, name)


def time_neighbors(photos: DataFrame, within_s: int = 600, most: int = 40) -> DataFrame:
    """(a, b): up to most following photos of each within a span, in order of time and id."""
    dated = photos.where("trashed = 0 and is_video = 0 and coalesce(taken_at, 0) > 0").select("id", "taken_at")
    rows = following(dated, ["taken_at", "id"], most, F.struct("id", "taken_at"))
    pairs = rows.select(F.col("id").alias("a"), F.col("taken_at").alias("ta"), F.explode("next").alias("x"))
    return pairs.where(F.col("x.taken_at") - F.col("ta") <= within_s).select("a", F.col("x.id").alias("b"))


def neighbour_keywords(t, within_s: int = 7200, photos: int = 12, words: int = 15) -> DataFrame:
    """id, name, n, place: the keywords of the photos nearest in time to each photo, the most frequent first.

    Nearest are up to twelve other photos within two hours either way; equally near ones are taken by how few photos lie
    between, the earlier first.
    """
    shots = t.photos.where("trashed = 0 and is_video = 0 and coalesce(taken_at, 0) > 0").select("id", "taken_at")
    pairs = following(shots, ["taken_at", "id"], photos, F.struct("id", "taken_at")).select("id", "taken_at", F.posexplode("next").alias("between", "x"))
    pairs = pairs.select("id", F.col("x.id").alias("other"), (F.col("x.taken_at") - F.col("taken_at")).alias("gap"), "between").where(F.col("gap") <= within_s)
    both = pairs.select("id", "other", "gap", "between", F.lit(1).alias("later")).unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other"), "gap", "between", F.lit(0).alias("later")))
    near = both.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("gap", "between", "later"))).where(F.col("place") <= photos)
    names = t.photo_tags.select(F.col("photo_id").alias("other"), "tag_id").distinct().join(t.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    counts = near.select("id", "other").join(names, "other").groupBy("id", "name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "name"))
    return counts.withColumn("place", rank.cast("long")).where(F.col("place") <= words).select("id", "name", "n", "place")


def hash_band_pairs(photos: DataFrame, low: int = 2, high: int = 120) -> DataFrame:
    """(a, b) that agree in one of seven bands of the hash, for bands shared by low to high photos. Of pairs up to six bits
    apart it loses those that meet in fuller bands only; copy_pairs has all near copies whatever the bands hold."""
    shots = photos.where("trashed = 0 and is_video = 0 and phash is not null").select("id", "phash")
    bands = shots.select("id", F.posexplode(F.array(*[hash_band(F.col("phash"), b) for b in range(7)])).alias("band", "bits"))
    usable = bands.groupBy("band", "bits").agg(F.count("*").alias("n")).where(F.col("n").between(low, high)).drop("n")
    kept = bands.join(F.broadcast(usable), ["band", "bits"])  # at most 4,096 bands
    pairs = kept.select("band", "bits", F.col("id").alias("a")).join(apart(kept.select("band", "bits", F.col("id").alias("b"))), ["band", "bits"]).where("a < b")
    return pairs.select("a", "b").distinct()


def copy_pairs(photos: DataFrame, most: int = 4) -> DataFrame:
    """(a, b) that link all photos whose hashes differ in at most so many bits (four or fewer), without any cap.

    Equal hashes hang on the least id that has them; of different ones all pairs are listed (hashes.copies).
    """
    shots = photos.where("trashed = 0 and is_video = 0 and phash is not null").select("id", "phash")
    first = settled(shots.groupBy("phash").agg(F.min("id").alias("a")))
    equal = shots.join(apart(first), "phash").where("id <> a").select("a", F.col("id").alias("b"))
    return equal.unionByName(copies(first, most))


def find_known(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """(in_id, known_id): incoming files (id, name, taken_at, width, height) that the catalog seems to have.

    The same stem and a time missing or within 15 hours or the same size either way round; else the same size within two
    seconds. A stem match comes first, then the lowest id.
    """
    size = lambda w, h: F.struct(F.least(w, h).alias("s"), F.greatest(w, h).alias("l"))
    side = lambda f, p: f.select(F.col("id").alias(f"{p}_id"), media_stem(F.col("name")).alias("stem"), F.col("taken_at").alias(f"{p}_t"), size(F.col("width"), F.col("height")).alias(f"{p}_size"))
    new, old = side(incoming, "in"), side(known, "known")
    by_stem = new.join(old, "stem").where(F.col("in_t").isNull() | F.col("known_t").isNull() | (F.abs(F.col("in_t") - F.col("known_t")) <= 54_000) | (F.col("in_size") == F.col("known_size")))
    cell = lambda c: F.floor(c / 3)
    spread = new.where("in_t is not null").withColumn("cell", F.explode(F.array(cell(F.col("in_t")) - 1, cell(F.col("in_t")), cell(F.col("in_t")) + 1))).drop("stem")
    by_time = spread.join(old.withColumn("cell", cell(F.col("known_t"))).drop("stem"), "cell").where((F.col("in_size") == F.col("known_size")) & (F.abs(F.col("in_t") - F.col("known_t")) <= 2))
    both = by_stem.select("in_id", F.lit(0).alias("rule"), "known_id").unionByName(by_time.select("in_id", F.lit(1).alias("rule"), "known_id"))
    return both.groupBy("in_id").agg(F.min(F.struct("rule", "known_id"))["known_id"].alias("known_id"))


def sidecar_match(media: DataFrame, sidecars: DataFrame, least: int = 6) -> DataFrame:
    """(folder, media, sidecar). Media choose in order of their names, each the best sidecar that is left: the one that names
    it exactly; else the one whose name without extension is the longest beginning, of six signs or more, of its own (export
    tools cut names), the greater name of equals; else one with the same name but for counters and spaces.

    Every pair that any of the rules allows meets in an equi-join. Going through the media by name then equals rounds in
    which each medium asks for its best sidecar that has not refused it, and a sidecar keeps the first medium that asked. If
    that is the first of all that may ask, both are settled and leave; a round goes over what the one before left open.
    """
    bare = lambda c: F.when(c.rlike(r"^.+\."), F.regexp_replace(c, r"\.[^.]*$", "")).otherwise(c)
    name = F.col("name")
    files = settled(media.select("folder", name.alias("media")).distinct())
    cars = settled(sidecars.select("folder", name.alias("sidecar")).distinct().withColumn("target", sidecar_target(F.col("sidecar"))))
    exact = files.join(apart(cars.withColumn("media", F.col("target"))), ["folder", "media"]).select("folder", "media", "sidecar", F.lit(2).alias("rule"), F.lit(0).alias("size"))
    begins = files.withColumn("stem", bare(F.col("media"))).where(F.length("stem") >= least)
    begins = begins.select("folder", "media", F.explode(F.transform(F.sequence(F.lit(least), F.length("stem")), lambda n: F.substr(F.col("stem"), F.lit(1), n))).alias("stem"))
    cut = begins.join(apart(cars.withColumn("stem", bare(F.col("target"))).where(F.length("stem") >= least)), ["folder", "stem"]).select("folder", "media", "sidecar", F.lit(1).alias("rule"), F.length("stem").alias("size"))
    moved = files.withColumn("k", norm_counter(F.col("media"))).join(apart(cars.withColumn("k", norm_counter(F.col("target")))), ["folder", "k"]).select("folder", "media", "sidecar", F.lit(0).alias("rule"), F.lit(0).alias("size"))
    pairs = exact.unionByName(cut).unionByName(moved)
    # By the prefix rule the greater name wins, by the others the smaller one: its code points are turned round.
    turned = F.when(F.col("rule") == 1, F.hex("sidecar")).otherwise(F.concat(F.translate(F.hex("sidecar"), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~")))
    merit = F.struct("rule", "size", turned.alias("name"), "sidecar")
    best = F.max(F.struct("rule", "size"))
    # Rows are dealt by medium, so that a pair's rules and a medium's pairs meet in one shuffle.
    open_ = pairs.repartition("folder", "media").groupBy("folder", "media", "sidecar").agg(best.alias("m")).select("folder", "media", "sidecar", "m.rule", "m.size")
    done = []
    while True:
        open_ = settled(open_.withColumn("asks", merit == F.max(merit).over(Window.partitionBy("folder", "media"))))
        sides = settled(open_.groupBy("folder", "sidecar").agg(F.min("media").alias("least"), F.min(F.when(F.col("asks"), F.col("media"))).alias("winner"), F.count_if("asks").alias("n")))
        # Where none is refused, all have what they ask for.
        calm = sides.where("n > 1").isEmpty()
        final = sides.where(F.col("winner").isNotNull() & (F.lit(calm) | (F.col("least") == F.col("winner")))).select("folder", F.col("winner").alias("media"), "sidecar")
        done.append(final)
        if calm:
            return reduce(DataFrame.unionByName, done)
        left = open_.join(apart(sides), ["folder", "sidecar"]).where("(winner is null or least <> winner) and (not asks or media = winner)")
        left = settled(left.select("folder", "media", "sidecar", "rule", "size").join(apart(final.select("folder", "media")), ["folder", "media"], "left_anti"))
        open_ = left


def suffix_join(entries: DataFrame, uris: DataFrame) -> DataFrame:
    """(path, uri) where one ends with the other; only equal base names meet."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    both = entries.withColumn("base", base(F.col("path"))).join(uris.withColumn("base", base(F.col("uri"))), "base")
    return both.where(F.col("uri").endswith(F.col("path")) | F.col("path").endswith(F.col("uri"))).select("path", "uri")


def xmp_sidecar(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(path, sidecar): name.ext.xmp, else name.xmp; no row without one."""
    full = sidecars.select(F.regexp_replace("path", r"(?i)\.xmp$", "").alias("path"), F.col("path").alias("by_full"))
    bare = full.select(F.col("path").alias("bare"), F.col("by_full").alias("by_bare"))
    rows = media.select("path", F.regexp_replace("path", r"\.[^./]+$", "").alias("bare")).join(full, "path", "left").join(bare, "bare", "left")
    return rows.select("path", F.coalesce("by_full", "by_bare").alias("sidecar")).where("sidecar is not null")


def changed_contents(edited: DataFrame, known: DataFrame) -> DataFrame:
    """edited (path, sha, photo_id) with changed: whether the photo takes the new content, or another one has it already.

    Files are taken by path, one after the other, and a content belongs to one photo at a time: to the one that known (path,
    sha) gives it, until that file changes, then to the first file after it that changes to it. So only one file for each
    content can get it, and it does if the owner's own change succeeded; such chains are followed by doubling.
    """
    owner = known.groupBy("sha").agg(F.min("path").alias("owner"))
    moves = edited.select(F.col("path").alias("owner")).withColumn("leaves", F.lit(True))
    asks = edited.join(owner, "sha", "left").join(moves, "owner", "left")
    open_ = F.col("owner").isNull() | (F.col("leaves") & (F.col("path") > F.col("owner")))
    first = asks.where(open_).groupBy("sha").agg(F.min("path").alias("path")).withColumn("first", F.lit(True))
    asks = asks.join(first, ["sha", "path"], "left")
    # yes: nothing in the way; no: never; else the owner's outcome decides.
    state = F.when(F.col("first").isNull(), "no").when(F.col("owner").isNull(), "yes")
    asks = settled(asks.select("path", "sha", "photo_id", state.alias("state"), F.when(state.isNull(), F.col("owner")).alias("waits")))
    while not asks.where("state is null").isEmpty():
        there = asks.select(F.col("path").alias("waits"), F.col("state").alias("its"), F.col("waits").alias("next"))
        asks = settled(asks.join(there, "waits", "left").select("path", "sha", "photo_id", F.coalesce("state", "its").alias("state"), F.when(F.coalesce("state", "its").isNull(), F.col("next")).alias("waits")))
    return asks.select("path", "sha", "photo_id", (F.col("state") == "yes").alias("changed"))


def folder_diff(disk: DataFrame, known: DataFrame, guard_n: int = 20, guard_share: float = 0.5) -> DataFrame:
    """path, change, photo_id: new, changed, touched (of the same content), moved (content known under a path that is gone),
    duplicate (content that another photo has), gone.

    Edited files come first, in order of path, then new ones, also by path; what an edited file no longer holds is free for
    a new one. When more than guard_n files and more than guard_share of the known ones are gone, removals are held back.
    """
    both = settled(disk.alias("d").join(known.alias("k"), "path", "full").select(
        "path", F.col("d.sha").alias("sha"), F.col("k.sha").alias("old_sha"), F.col("k.photo_id").alias("photo_id"), F.col("d.size").alias("size"), F.col("k.size").alias("old_size"), F.col("d.mtime").alias("mtime"), F.col("k.mtime").alias("old_mtime")
    ))
    gone, new = both.where("size is null"), both.where("old_size is null")
    other = both.where("size is not null and old_size is not null and (size <> old_size or mtime <> old_mtime)")
    none = F.lit(None).cast("string").alias("was")
    same = other.where("sha <=> old_sha").select("path", F.lit("touched").alias("change"), "photo_id", none)
    outcome = settled(changed_contents(other.where("not sha <=> old_sha").select("path", "sha", "photo_id"), known.select("path", "sha")))
    changed = outcome.select("path", F.when(F.col("changed"), "changed").otherwise("duplicate").alias("change"), "photo_id", none)
    # What photos hold after the edits; of equal contents the first paths come first.
    left_by = outcome.where("changed").select("path", F.col("sha").alias("new_sha"))
    have = known.join(left_by, "path", "left").select(F.coalesce("new_sha", "sha").alias("sha")).distinct().withColumn("have", F.lit(True))
    lost = ranked(gone.where("old_sha is not null").select(F.col("old_sha").alias("sha"), F.col("photo_id").alias("moved_id"), F.col("path").alias("was")), ["sha"], ["was"], "place")
    fresh = ranked(new.where("sha is not null").select("sha", "path"), ["sha"], ["path"], "place").join(lost, ["sha", "place"], "left")
    fresh = fresh.join(have, "sha", "left").select(
        "path", F.when(F.col("moved_id").isNotNull(), "moved").when(F.col("have") | (F.col("place") > 0), "duplicate").otherwise("new").alias("change"), F.col("moved_id").alias("photo_id"), "was"
    )
    fresh = settled(fresh.unionByName(new.where("sha is null").select("path", F.lit("new").alias("change"), F.lit(None).cast("long").alias("photo_id"), none)))
    left = gone.join(fresh.where("was is not null").select(F.col("was").alias("path")), "path", "left_anti")
    facts = known.agg(F.count("*").alias("n_known")).join(left.agg(F.count("*").alias("n_gone")))  # one row
    removed = left.join(F.broadcast(facts)).select(
        "path", F.when((F.col("n_gone") > guard_n) & (F.col("n_gone") > guard_share * F.col("n_known")), "held").otherwise("gone").alias("change"), "photo_id", none
    )
    return fresh.unionByName(changed).unionByName(same).unionByName(removed).select("path", "change", "photo_id")


def apply_diff(known: DataFrame, disk: DataFrame, changes: DataFrame) -> DataFrame:
    """path, size, mtime, sha, photo_id known after the changes that folder_diff found: new files get the next ids by path,
    moved ones keep theirs, edited ones have the new size and time, and the new content unless another photo has it. Removals
    that are held back stay; copies of known content are not remembered."""
    listed = disk.select("path", "size", "mtime", "sha")
    kinds = changes.select("path", "change", F.col("photo_id").alias("its"))
    top = known.agg(F.coalesce(F.max("photo_id"), F.lit(0)).alias("top"))  # one row
    added = numbered(listed.join(kinds.where("change = 'new'").select("path"), "path", "left_semi"), ["path"], "n").join(F.broadcast(top))
    added = added.select("path", "size", "mtime", "sha", (F.col("top") + 1 + F.col("n")).cast("long").alias("photo_id"))
    moved = listed.join(kinds.where("change = 'moved'"), "path").select("path", "size", "mtime", "sha", F.col("its").alias("photo_id"))
    gone = kinds.where("change = 'gone'").select("path").unionByName(known.join(moved.select("photo_id"), "photo_id", "left_semi").select("path"))
    edits = listed.join(kinds.where("change in ('changed', 'touched', 'duplicate')").select("path", "change"), "path")
    edits = edits.select("path", F.col("size").alias("new_size"), F.col("mtime").alias("new_mtime"), F.when(F.col("change") == "changed", F.col("sha")).alias("new_sha"))
    stay = known.select("path", "size", "mtime", "sha", "photo_id").join(gone, "path", "left_anti").join(edits, "path", "left")
    stay = stay.select("path", *[F.coalesce(f"new_{c}", c).alias(c) for c in ("size", "mtime", "sha")], "photo_id")
    return stay.unionByName(added).unionByName(moved)


def backup_plan(source: DataFrame, target: DataFrame, encode_share: float = 0.4) -> DataFrame:
    """path, action, need: reuse a copy of the same size that is not older by more than two seconds, else copy or encode."""
    rows = source.join(target.select("path", F.col("size").alias("t_size"), F.col("mtime").alias("t_mtime")), "path", "left")
    same = (F.col("t_size") == F.col("size")) & (F.col("t_mtime") >= F.col("mtime") - 2)
    action = F.when(F.coalesce(same, F.lit(False)), "reuse").when(F.col("encode"), "encode").otherwise("copy")
    need = F.when(action == "reuse", 0).when(action == "encode", F.round(F.col("size") * encode_share)).otherwise(F.col("size"))
    return rows.select("path", action.alias("action"), need.cast("long").alias("need"))


def restore_plan(backup: DataFrame, live: DataFrame, overwrite: bool, reduced: bool = False) -> DataFrame:
    """Files to bring back: missing ones, and changed ones when overwriting; reduced sets never overwrite."""
    rows = backup.join(live.select("path", F.col("sha").alias("live_sha")), "path", "left")
    wanted = F.col("live_sha").isNull() | (F.lit(overwrite and not reduced) & (F.col("live_sha") != F.col("sha")))
    return rows.where(wanted).select("path", F.when(F.col("live_sha").isNull(), "missing").otherwise("changed").alias("why"))


def restore_summary(backup: DataFrame, live: DataFrame, overwrite: bool, reduced: bool = False) -> DataFrame:
    """One row: files to bring back, those of them that are missing or changed, and missing_files: files of the catalog that
    will still be nowhere. backup has path, sha and there (whether the backup holds the file)."""
    plan = restore_plan(backup.where("there"), live, overwrite, reduced)
    counts = plan.agg(F.count("*").alias("files"), F.count_if(F.col("why") == "missing").alias("missing"), F.count_if(F.col("why") == "changed").alias("changed"))
    nowhere = backup.where("not there").join(live.select("path"), "path", "left_anti").agg(F.count("*").alias("missing_files"))
    return counts.join(nowhere)  # one row each


def dedupe_ingest(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """id, status: added for content seen first here, duplicate for content that is known or came earlier in the batch."""
    place = F.row_number().over(Window.partitionBy("sha256").orderBy("id"))
    have = known.select("sha256").distinct().withColumn("have", F.lit(True))
    return incoming.withColumn("place", place).join(have, "sha256", "left").select("id", F.when(F.col("have") | (F.col("place") > 1), "duplicate").otherwise("added").alias("status"))


# Tolerance of durations in seconds, least similarity on the whole and of a frame, grades by similarity.
DURATION_TOLERANCE, LEAST_SSIM, LEAST_FRAME_SSIM = 0.050, 0.80, 0.60
GRADES = [(0.97, "excellent"), (0.93, "very_good"), (0.88, "good"), (0.0, "noticeable")]


def conversion_audit(source: DataFrame, output: DataFrame, fps_mode: str = "same", fps: float = 30.0, max_height: int = 0, audio: bool = True) -> DataFrame:
    """id, ok, failed, grade: measures of converted videos against their sources by the options of the conversion.

    Both tables have id, frames, seconds (of the file), video_seconds, width, height, audio and bytes; source has fps, output
    ssim and ssim_min. fps_mode is same, limit (fps at most) or fixed.
    """
    rows = source.alias("s").join(output.alias("o"), "id")
    s, o = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"o.{c}"))
    n, lasts = s("frames"), F.when(s("video_seconds") > 0, s("video_seconds")).otherwise(F.coalesce(s("seconds"), F.lit(0.0)))
    target = F.bround(lasts * fps)
    same = (o("frames") == n) if fps_mode != "fixed" else o("frames").between(target - 2, target + 2)
    if fps_mode == "limit":
        own_fps = F.when(lasts > 0, n / lasts).otherwise(F.coalesce(s("fps"), F.lit(0.0)))
        fewer = F.least(n.cast("double"), target)
        same = F.when(own_fps <= fps * 1.001, same).otherwise(o("frames").between(F.floor(fewer * 0.9), fewer + 2))
    tolerance = DURATION_TOLERANCE if fps_mode == "same" else DURATION_TOLERANCE + 1 / fps
    off = lambda c: F.abs(F.coalesce(o(c), F.lit(0.0)) - F.coalesce(s(c), F.lit(0.0)))
    size = (o("width") == s("width")) & (o("height") == s("height"))
    if max_height:
        shape = s("width") / s("height")
        held = o("height").between(max_height - 8, max_height) & (F.abs(o("width") / o("height") - shape) / shape < 0.01)
        size = F.when(s("height") > max_height, held).otherwise(size)
    checks = {
        "frames": same,
        "duration": F.greatest(off("seconds"), off("video_seconds")) <= tolerance,
        "resolution": size,
        "audio": o("audio") == (s("audio") if audio else F.lit(0)),
        "size": o("bytes") < s("bytes"),
        "ssim": (o("ssim") >= LEAST_SSIM) & (o("ssim_min") >= LEAST_FRAME_SSIM),
    }
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    grade = F.coalesce(*[F.when(o("ssim") >= floor, name) for floor, name in GRADES])
    return rows.select("id", (F.size(failed) == 0).alias("ok"), failed.alias("failed"), grade.alias("grade"))


def photo_detail(t) -> DataFrame:
    """Photos with their albums, people and keywords as sorted lists."""
    lists = lambda bridge, key, names, name: bridge.join(names.select(F.col("id").alias(key), "name"), key).groupBy(F.col("photo_id").alias("id")).agg(F.sort_array(F.collect_set("name")).alias(name))
    out = t.photos.select("id", "filename")
    for bridge, key, names, name in ((t.photo_albums, "album_id", t.albums, "albums"), (t.photo_people, "person_id", t.people, "people"), (t.photo_tags, "tag_id", t.tags, "tags")):
        out = out.join(lists(bridge, key, names, name), "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def near_hashes(pairs: DataFrame, photos: DataFrame, most: int) -> DataFrame:
    """(a, b, bits) of the pairs whose hashes differ in at most so many bits."""
    h = photos.select("id", "phash")
    both = pairs.join(apart(h.withColumnsRenamed({"id": "a", "phash": "ha"})), "a").join(apart(h.withColumnsRenamed({"id": "b", "phash": "hb"})), "b")
    return both.withColumn("bits", hamming64(F.col("ha"), F.col("hb"))).where(F.col("bits") <= most).select("a", "b", "bits")


def photo_context(t, tz: str = "UTC") -> DataFrame:
    """id, context: what is known of a photo as lines of text: capture time, place, camera, exposure, size, caption, its own
    keywords (20 at most), the people in it (10 at most) and the keywords of photos near in time. Nothing known: empty."""
    from fotolake.functions.scalars import wall
    from fotolake.operators.graph import photo_person_union

    named = lambda bridge, key, names: bridge.join(names.select(F.col("id").alias(key), "name"), key).groupBy(F.col("photo_id").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("names"))
    own = named(t.photo_tags, "tag_id", t.tags).withColumnRenamed("names", "own")
    people = named(photo_person_union(t), "person_id", t.people).withColumnRenamed("names", "people")
    near = neighbour_keywords(t).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("near"))
    rows = t.photos.join(own, "id", "left").join(people, "id", "left").join(near, "id", "left")
    line = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(name), value))
    # Fields of the exposure and what they are called.
    fields = {"ExposureTime": "shutter", "FNumber": "f/", "ISOSpeedRatings": "ISO", "FocalLength": "focal length mm", "Flash": "flash"}
    shot = [line(f"{label} ", F.get_json_object("exif_json", f"$.Exif.{field}")) for field, label in fields.items()]
    return rows.select(
        "id",
        F.concat_ws(
            "\n",
            line("Taken: ", F.when(F.col("taken_at") != 0, F.date_format(wall(F.col("taken_at"), tz), "yyyy-MM-dd HH:mm (EEEE)"))),
            line("Location: ", F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.format_string("%.4f, %.4f", "lat", "lng"))),
            line("Camera: ", F.concat_ws(", ", *[F.when(F.col(c) != "", F.col(c)) for c in ("camera_model", "lens")])),
            line("Exposure: ", F.concat_ws(", ", *shot)),
            line("Size: ", F.when((F.col("width") > 0) & (F.col("height") > 0), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")))),
            line("Caption: ", F.substring("description", 1, 300)),
            line("Keywords already on this photo: ", F.array_join(F.slice("own", 1, 20), ", ")),
            line("People in the photo: ", F.array_join(F.slice("people", 1, 10), ", ")),
            line("Keywords of photos taken close in time: ", F.array_join("near", ", ")),
        ).alias("context"),
    )
