"""Sessions, rankings and as-of lookups over capture times. Timelines are numbered and scanned by blocks of equally many rows,
with what earlier or later blocks hold carried over, so that no window is the whole library, whatever times rows share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.functions.scalars import hamming64, haversine_km, natural_key, wall
from fotolake.storage import settled


#: Rows of a block: what a window takes in one piece.
BLOCK = 8192


def _ranges(frame: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Ranges of an order, settled, and the number of rows before each of them."""
    parted = settled(frame.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = parted.groupBy("__range").agg(F.count("*").alias("n"))
    # One row per range, as many as there are partitions.
    ahead = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("ahead"))
    return parted, ahead


def _placed(parted: DataFrame, ahead: DataFrame, order: list[str], name: str) -> DataFrame:
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return parted.withColumn("__local", local).join(F.broadcast(ahead), "__range").withColumn(name, F.col("__local") + F.col("ahead")).drop("__range", "__local", "ahead")


def numbered(frame: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """frame with each row's number from 0 in an order that is unique: ranges of it are numbered by themselves, and the number
    of rows before each range is added, so equal times are no hot spot."""
    parted, ahead = _ranges(frame, order)
    return _placed(parted, ahead, order, name)


def _with_blocks(rows: DataFrame, blocks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """rows with the columns that blocks, one row for each block and keys, has beside them; keys may be null."""
    side = blocks.withColumnsRenamed({c: f"__of_{i}" for i, c in enumerate(keys)} | {"__block": "__of_block"})
    same = rows["__block"] == side["__of_block"]
    for i, c in enumerate(keys):
        same &= rows[c].eqNullSafe(side[f"__of_{i}"])
    return rows.join(side, same).drop("__block", "__of_block", *[f"__of_{i}" for i in range(len(keys))])


def carried(rows: DataFrame, place: str, up: Column, down: Column | None, name: str, span: int, keys: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Adds name_prev, the last up that is not null in rows before, and name_next, the first such down in rows after, within
    keys by place, a number from 0 and below span; without down there is no name_next.

    A scan by segments: blocks of places are windows of their own, each is summed up in one row for each of its keys, and
    those rows, being far fewer, are scanned in the same way. So it doesn't matter how many rows share keys or a time.
    """
    at = F.floor(F.col(place) / block)
    both_ways = {"prev": ("__up", up, place)} | ({} if down is None else {"next": ("__down", down, F.desc(place))})
    rows = rows.withColumns({c: value for c, value, _ in both_ways.values()} | {"__block": at})

    def nearest(column: str, order: Column | str) -> Column:
        """What lies after is what lies before in falling order: a frame that grows by a row is one step a row."""
        return F.last(column, True).over(Window.partitionBy("__block", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))

    inside = rows.withColumns({f"{name}_{x}": nearest(c, order) for x, (c, _, order) in both_ways.items()}).drop("__up", "__down")
    if span <= block:
        return inside.drop("__block")
    edge = {"prev": F.max_by, "next": F.min_by}
    ends = rows.groupBy("__block", *keys).agg(*[edge[x](c, F.when(F.col(c).isNotNull(), F.col(place))).alias(f"__edge_{x}") for x, (c, _, _) in both_ways.items()])
    far = f"__far_{name}"
    over = carried(ends.withColumnRenamed("__block", "__at"), "__at", F.col("__edge_prev"), None if down is None else F.col("__edge_next"), far, -(-span // block), keys, block)
    found = [f"{far}_{x}" for x in both_ways]
    both = _with_blocks(inside, over.select(F.col("__at").alias("__block"), *keys, *found), keys)
    return both.withColumns({f"{name}_{x}": F.coalesce(f"{name}_{x}", f"{far}_{x}") for x in both_ways}).drop(*found)


def summed_before(rows: DataFrame, place: str, value: Column, name: str, span: int, keys: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Adds name, the sum of value over the rows before, within keys by place; scanned like carried()."""
    rows = rows.withColumns({"__value": value, "__block": F.floor(F.col(place) / block)})
    window = Window.partitionBy("__block", *keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn(name, F.coalesce(F.sum("__value").over(window), F.lit(0))).drop("__value")
    if span <= block:
        return inside.drop("__block")
    totals = rows.groupBy("__block", *keys).agg(F.sum("__value").alias("__total"))
    far = f"__far_{name}"
    over = summed_before(totals.withColumnRenamed("__block", "__at"), "__at", F.col("__total"), far, -(-span // block), keys, block)
    both = _with_blocks(inside, over.select(F.col("__at").alias("__block"), *keys, far), keys)
    return both.withColumn(name, F.col(name) + F.col(far)).drop(far)


def prev_next(frame: DataFrame, order: list[str], value: Column, name: str, keys: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Adds name_prev and name_next: the last value that is not null before each row and the first one after it.

    Rows are ordered by order, which is unique, within keys. They are numbered over ranges of it and scanned by blocks of
    equal size, so a million rows of one second, or of one key, are spread like any others.
    """
    sequence = [*keys, *order]
    parted, ahead = _ranges(frame.withColumn("__value", value), sequence)
    rows = _placed(parted, ahead, sequence, "__n")
    found = carried(rows, "__n", F.col("__value"), F.col("__value"), name, parted.count(), keys, block)
    return found.select(*[found[f"`{c}`"] for c in frame.columns], f"{name}_prev", f"{name}_next")


def ranked(frame: DataFrame, keys: list[str], order: list[str], name: str, block: int = BLOCK) -> DataFrame:
    """frame with each row's number from 0 within keys, none of them null, in an order that is unique. Rows learn their keys'
    first number by keys and block, so no key is a hot spot."""
    rows = settled(numbered(frame, [*keys, *order], "__n")).withColumn("__block", F.floor(F.col("__n") / block))
    first = rows.groupBy(*keys).agg(F.min("__n").alias("__first"))
    blocks = rows.select(*keys, "__block").distinct().join(first, keys)
    return rows.join(blocks, [*keys, "__block"]).withColumn(name, F.col("__n") - F.col("__first")).drop("__n", "__block", "__first")


def _shots(photos: DataFrame) -> DataFrame:
    return photos.where("trashed = 0 and is_video = 0 and phash is not null")


def merit(*more: str) -> Column:
    """What the best member of a group is chosen by: score, open eyes, area, bytes, then the first in order of time and id."""
    or_zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    closed = (or_zero("eyes_closed") != 0).cast("int")
    area = or_zero("width").cast("long") * or_zero("height")
    return F.struct(or_zero("score").alias("s"), (-closed).alias("e"), area.alias("a"), or_zero("bytes").alias("b"), (-or_zero("taken_at")).alias("t"), (-F.col("id")).alias("i"), *more)


def runs(photos: DataFrame, gap_s: int, bits: int, least: int, block: int = BLOCK) -> DataFrame:
    """id, run, n, best for shots in runs: each at most gap_s after the one before and at most bits different from it.

    photos has eyes_closed beside the catalog's columns. A run is named by its first shot; best as in merit().
    """
    shots = _shots(photos).where("taken_at is not null").select("id", "taken_at", "phash", "score", "eyes_closed", "width", "height", "bytes")
    order = ["taken_at", "id"]
    parted, ahead = _ranges(shots, order)
    rows, span = _placed(parted, ahead, order, "__n"), parted.count()
    seen = carried(rows, "__n", F.struct("taken_at", "phash"), None, "s", span, (), block)
    starts = F.col("s_prev").isNull() | (F.col("taken_at") - F.col("s_prev.taken_at") > gap_s) | (hamming64(F.col("phash"), F.col("s_prev.phash")) > bits)
    named = carried(seen.withColumn("start", F.when(starts, F.col("id"))).drop("s_prev"), "__n", F.col("start"), None, "r", span, (), block)
    named = named.withColumn("run", F.coalesce("start", "r_prev"))
    groups = named.groupBy("run").agg(F.count("*").alias("n"), F.max_by("id", merit()).alias("best")).where(F.col("n") >= least)
    return named.select("id", "run").join(groups, "run").select("id", "run", "n", "best")


def find_bursts(photos: DataFrame, window_s: int = 2, bits: int = 10, least: int = 3) -> DataFrame:
    return runs(photos, window_s, bits, least)


def stacked(photos: DataFrame, bursts: DataFrame) -> DataFrame:
    """photos without the members of bursts that are not their best one."""
    return photos.join(bursts.where("id <> best").select("id"), "id", "left_anti")


def find_series(photos: DataFrame, manual: DataFrame, gap_s: int = 120, bits: int = 12) -> DataFrame:
    """series, id, n, best: runs of two shots and more, overruled by manual rows (photo_id, series_id): above 0 a series, 0 none.

    A run that loses shots to manual rows stays while it has two; its best is then the first one if the best was lost. A
    manual series has two untrashed photos or more; its best has the highest score, the first one of equals.
    """
    own = manual.select(F.col("photo_id").alias("id"), "series_id")
    found = runs(photos, gap_s, bits, 2).join(own.select("id"), "id", "left_anti").join(photos.select("id", "taken_at"), "id")
    left = found.groupBy("run").agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.when(F.col("id") == F.col("best"), F.col("id"))), F.min(F.struct("taken_at", "id"))["id"]).alias("best"),
    )
    automatic = found.select("id", "run").join(left.where("n > 1"), "run").select(F.concat(F.lit("auto:"), "run").alias("series"), "id", "n", "best")
    chosen = own.where("series_id > 0").join(photos.where("trashed = 0").select("id", "score", F.coalesce("taken_at", F.lit(0)).alias("taken_at")), "id")
    best = F.max_by("id", F.struct(F.coalesce("score", F.lit(0)).alias("s"), (-F.col("taken_at")).alias("t"), (-F.col("id")).alias("i")))
    groups = chosen.groupBy("series_id").agg(F.count("*").alias("n"), best.alias("best")).where("n > 1")
    return automatic.unionByName(chosen.select("id", "series_id").join(groups, "series_id").select(F.concat(F.lit("manual:"), "series_id").alias("series"), "id", "n", "best"))


def make_series(manual: DataFrame, ids: DataFrame) -> DataFrame:
    """manual with the photos of ids in a new series, numbered past the greatest one; they leave any other. Fewer than two
    photos are no series: manual as it is."""
    chosen = ids.select(F.col("id").alias("photo_id")).distinct()
    top = manual.agg((F.coalesce(F.max("series_id"), F.lit(0)) + 1).alias("series_id"))
    enough = chosen.agg(F.count("*").alias("n")).where("n > 1")
    added = chosen.join(F.broadcast(top)).join(F.broadcast(enough)).select("photo_id", F.col("series_id").cast("long").alias("series_id"))
    return manual.select("photo_id", "series_id").join(added, "photo_id", "left_anti").unionByName(added)


def unseries(manual: DataFrame, ids: DataFrame) -> DataFrame:
    """manual with the photos of ids in no series, not even an automatic one."""
    out = ids.select(F.col("id").alias("photo_id")).distinct().withColumn("series_id", F.lit(0).cast("long"))
    return manual.select("photo_id", "series_id").join(out, "photo_id", "left_anti").unionByName(out)


def series_members(series: DataFrame, ids: DataFrame) -> DataFrame:
    """ids and all other members of their series."""
    found = series.join(series.join(ids, "id", "left_semi").select("series").distinct(), "series", "left_semi").select("id")
    return found.unionByName(ids.select("id")).distinct()


def rank_selection(t, chosen: DataFrame, most: int = 200) -> DataFrame:
    """The first photos asked for (photo_id, asked), numbered from the best: score, open eyes, bytes, then the order asked.

    The request is bounded at most photos; of those, the ones with measures are ranked.
    """
    first = chosen.groupBy(F.col("photo_id").alias("id")).agg(F.min("asked").alias("asked")).orderBy("asked", "id").limit(most)
    own = t.photo_analysis.select(F.col("photo_id").alias("id"), "score", F.coalesce("eyes_closed", F.lit(0)).alias("closed"))
    rows = first.join(own, "id").join(t.photos.select("id", F.coalesce("bytes", F.lit(0)).alias("bytes")), "id")
    place = F.row_number().over(Window.orderBy(F.desc("score"), "closed", F.desc("bytes"), "asked", "id"))
    return rows.select("id", "score", place.cast("long").alias("place"))


# Why a snapshot was made, as kinds that are kept apart.
REGULAR = ["auto", "manual"]


def retention(snapshots: DataFrame, keep: int, safety: int = 3) -> DataFrame:
    """Snapshots with keep or drop: the newest of those made by hand or by plan, together, and a few of each other reason;
    snapshots has id, reason, created."""
    kind = F.when(F.coalesce("reason", F.lit("auto")).isin(REGULAR), "regular").otherwise(F.col("reason"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("created"), F.desc("id")))
    return snapshots.withColumn("kind", kind).select("id", "reason", (place <= F.when(F.col("kind") == "regular", keep).otherwise(safety)).alias("keep"))


def _stem_ext(name: Column) -> tuple[Column, Column]:
    """A dot parts them if something stands on both of its sides."""
    dotted = name.rlike(r"(?s)^.+\.[^.]+\z")
    ext = F.when(dotted, F.regexp_extract(name, r"(?s)(\.[^.]+)\z", 1)).otherwise("")
    return name.substr(F.lit(1), F.length(name) - F.length(ext)), ext


def _numbered_name(name: Column, number: Column) -> Column:
    stem, ext = _stem_ext(name)
    return F.concat(stem, F.lit(" ("), number.cast("string"), F.lit(")"), ext)


def unique_names(files: DataFrame, start: int = 1, ignore_case: bool = True) -> DataFrame:
    """(id, folder, unique): files are named one after the other by id; a name that its folder has already becomes the first
    free 'stem (n).ext' from start on. Files in folders: 1, case ignored; members of an archive: 2, case kept.

    The same names come out as by going through the files one by one, but for names that end in a dot and numbers in brackets,
    which are different all the same. A null name is an empty one, ids are different. Names are settled by how many numbers they end in.
    Repeats of a name take the free numbers of its stem in turn: the k-th gets the k-th number that no file asked for
    itself before it. Which of the asked-for numbers that leaves is found in rounds over those numbers alone, as each shifts
    the ones after it. A file whose number has gone repeats its own name on the next level. No folder or name is one task.
    """
    own = F.lower("name") if ignore_case else F.col("name")
    rows = files.select("id", F.coalesce("folder", F.lit("")).alias("folder"), F.col("folder").alias("was"), F.coalesce("name", F.lit("")).alias("name")).withColumn("key", own)
    rows = ranked(rows, ["folder", "key"], ["id"], "nth")
    stem, ext = _stem_ext(F.col("key"))
    # Only names that have a bracket are taken apart, and of equal ones only the first asks for a number.
    rows = rows.withColumn("depth", F.when(~F.col("key").contains(" ("), 0).otherwise(F.size(F.regexp_extract_all(F.regexp_extract(stem, r"((?: \(\d+\))*)\z", 1), F.lit(r"\(\d+\)"), F.lit(0)))))
    digits = F.regexp_extract(stem, r" \(([1-9]\d{0,8}|0)\)\z", 1)
    parent = F.concat(F.regexp_replace(stem, r" \(\d+\)\z", ""), ext)
    first = (F.col("nth") == 0) & (F.col("depth") > 0)
    asked = F.when(first, F.when(digits != "", digits.cast("long")))
    rows = rows.withColumn("number", F.when(asked >= start, asked)).withColumn("parent", F.when(first, parent))
    rows = rows.withColumn("number", F.when(_numbered_name(F.col("parent"), F.col("number")) == F.col("key"), F.col("number")))
    rows = settled(rows)
    deepest = rows.agg(F.max("depth")).first()[0]
    if deepest is None:
        return rows.select("id", F.col("was").alias("folder"), F.col("name").alias("unique"))
    done, repeats = [], None
    for depth in range(deepest + 2):
        mine = rows.where(F.col("depth") == depth)
        lost = None
        if repeats is not None:
            # What repeats of shorter names take of the numbers that files of this level ask for.
            slots, lost = _slots(repeats, mine.where("nth = 0 and number is not null"), start)
            done.append(slots)
        gone = mine.withColumn("lost", F.lit(0)) if lost is None else mine.join(lost.withColumn("lost", F.lit(1)), ["folder", "key"], "left")
        # The first of a name keeps it, unless its number went; so repeats are numbered from 1 on by what they have already.
        k = F.col("nth") + F.coalesce("lost", F.lit(0))
        gone = settled(gone.withColumn("k", k).select("id", "was", "folder", "name", "key", "k", (F.col("k") == 0).alias("keeps")))
        done.append(gone.where("keeps").select("id", "was", F.col("name").alias("unique")))
        repeats = gone.where("not keeps").drop("keeps")
    named = done[0]
    for more in done[1:]:
        named = named.unionByName(more)
    named = settled(named.select("id", F.col("was").alias("folder"), "unique"))
    # Names that end in a dot and numbers read in two ways, and may meet what another reading gave; such repeats go once more.
    key = F.lower("unique") if ignore_case else F.col("unique")
    if named.groupBy(F.coalesce("folder", F.lit("")), key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return named
    return unique_names(named.withColumnRenamed("unique", "name"), start, ignore_case)


def _slots(repeats: DataFrame, asking: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """Names for repeats (folder, key, id, k from 1), and (folder, key) of the names in asking whose number they take.

    asking has folder, parent, number, key, id: the first file that asks for each number. Number i is the turn of repeat
    i - start + 1 - c, where c numbers before it were passed over; it is passed over itself if it was asked for first.
    """
    on = ["folder", "stem"]
    turns = repeats.select("folder", F.col("key").alias("stem"), "k", F.col("id").alias("at"))
    wanted = asking.join(turns.select(*on).distinct().withColumnRenamed("stem", "parent"), ["folder", "parent"], "left_semi")
    wanted = wanted.select("folder", F.col("parent").alias("stem"), "number", "key", F.col("id").alias("first"))
    parted, ahead = _ranges(wanted, [*on, "number"])
    wanted, span = settled(_placed(parted, ahead, [*on, "number"], "__n")), parted.count()
    # No number is a turn beyond this one, so the rounds leave all others aside.
    most = wanted.groupBy(*on).agg((F.max("number") - start + 1).alias("most"))
    turns = settled(turns.join(most, on).where("k <= most").drop("most"))
    # At first all asked-for numbers are held to be passed over; the first n of a stem are right after n rounds at the latest.
    state = settled(summed_before(wanted, "__n", F.lit(1).cast("long"), "passed", span, tuple(on)))
    while True:
        turn = state.withColumn("k", F.col("number") - start + 1 - F.col("passed"))
        met = settled(turn.join(turns, [*on, "k"], "left").withColumn("skip", F.coalesce(F.col("first") < F.col("at"), F.lit(False))))
        fresh = settled(summed_before(met, "__n", F.col("skip").cast("long"), "now", span, tuple(on)))
        if fresh.where("now <> passed").isEmpty():
            break
        state = fresh.select(*wanted.columns, F.col("now").alias("passed"))
    lost = fresh.where("not skip and at is not null").select("folder", "key")
    passed = fresh.where("skip").select("folder", "stem", "k", F.lit(0).alias("repeat"), (F.col("passed") + 1).alias("over"), F.col("number").alias("id"))
    # From the last number that is passed over on, repeats are after all of them; only those before it are lined up with them.
    last = passed.groupBy(*on).agg(F.max("k").alias("last"), F.max("over").alias("all_over"))
    every = repeats.select("folder", F.col("key").alias("stem"), "k", F.lit(1).alias("repeat"), F.lit(None).cast("long").alias("over"), "id", "was", "name").join(last, on, "left")
    late = every.where("last is null or k >= last").withColumn("over_prev", F.col("all_over"))
    early = every.where("k < last").drop("last", "all_over")
    lined = prev_next(early.unionByName(passed, True), ["k", "repeat", "id"], F.col("over"), "over", tuple(on)).where("repeat = 1")
    number = F.lit(start - 1) + F.col("k") + F.coalesce("over_prev", F.lit(0))
    named = [x.select("id", "was", _numbered_name(F.col("name"), number).alias("unique")) for x in (late, lined)]
    return named[0].unionByName(named[1]), lost


def year_in_review(photos: DataFrame, year: int, top: int = 10) -> DataFrame:
    """The best photos of each month of a year, in order of time."""
    at = wall(F.col("taken_at"))
    live = photos.where("trashed = 0 and is_video = 0").where(F.year(at) == year).withColumn("month", F.month(at))
    place = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("score"), "taken_at", "id"))
    return live.withColumn("place", place).where(F.col("place") <= top).select("id", "month", "taken_at", "score").orderBy("taken_at", "id")


def album_best(t, album: int, top: int = 40) -> DataFrame:
    inside = t.photo_albums.where(F.col("album_id") == album).select(F.col("photo_id").alias("id"))
    live = t.photos.where("trashed = 0 and is_video = 0").join(inside, "id", "left_semi")
    return live.orderBy(F.desc("score"), "taken_at", "id").limit(top).select("id", "score", "taken_at").orderBy("taken_at", "id")


def face_timeline(t, tz: str = "UTC") -> DataFrame:
    """person_id, year, photo: the best photo of each person in each year."""
    from fotolake.operators.rules import people_of

    rows = people_of(t).join(t.photos.where("trashed = 0").select(F.col("id").alias("photo_id"), "taken_at", "score"), "photo_id")
    merit = F.struct("score", (-F.col("taken_at")).alias("t"), (-F.col("photo_id")).alias("i"))
    return rows.groupBy("person_id", F.year(wall(F.col("taken_at"), tz)).alias("year")).agg(F.max_by("photo_id", merit).alias("photo"))


def fly_path(photos: DataFrame, block: int = BLOCK) -> DataFrame:
    """Placed photos in order of time with the place of the next one and the length of the leg in km."""
    placed = photos.where("trashed = 0 and lat is not null and lng is not null and coalesce(taken_at, 0) > 0").select("id", "taken_at", "lat", "lng")
    legs = prev_next(placed, ["taken_at", "id"], F.struct("taken_at", "id", "lat", "lng"), "p", (), block)
    return legs.select("id", "taken_at", "lat", "lng", F.col("p_next.id").alias("next_id"), haversine_km(F.col("lat"), F.col("lng"), F.col("p_next.lat"), F.col("p_next.lng")).alias("km"))


def position_at(photos: DataFrame, times: DataFrame, block: int = BLOCK) -> DataFrame:
    """t, lat, lng on the straight line between the photos before and after each t; at the ends that of the nearest one."""
    points = photos.where("trashed = 0 and lat is not null and coalesce(taken_at, 0) > 0").groupBy("taken_at").agg(F.min(F.struct("id", "lat", "lng")).alias("p"))
    points = points.select(F.col("taken_at").alias("t"), F.lit(0).alias("ask"), F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"))
    asks = times.select("t").distinct().select("t", F.lit(1).alias("ask"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
    both = prev_next(points.unionByName(asks), ["t", "ask"], F.when(F.col("ask") == 0, F.struct("t", "lat", "lng")), "p", (), block).where("ask = 1")
    share = (F.col("t") - F.col("p_prev.t")) / (F.col("p_next.t") - F.col("p_prev.t"))
    between = lambda c: F.coalesce(F.col(f"p_prev.{c}") + (F.col(f"p_next.{c}") - F.col(f"p_prev.{c}")) * share, F.col(f"p_prev.{c}"), F.col(f"p_next.{c}"))
    return both.select("t", between("lat").alias("lat"), between("lng").alias("lng"))


def sort_by(photos: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Photos in the order of one of fourteen keys; ties by capture time, name and id. Descending turns all of it round."""
    from fotolake.functions.scalars import ext_of, folder_of

    rank = F.element_at(F.create_map(*[F.lit(x) for kv in zip(("red", "yellow", "green", "blue", "purple"), range(5), strict=True) for x in kv]), F.col("label"))
    keys = {
        "capture": F.col("taken_at"), "import": F.col("imported_at"), "name": natural_key(F.col("filename")), "ext": ext_of(F.col("filename")), "folder": folder_of(F.col("rel_path")), "rating": F.col("rating"),
        "pick": F.col("flag"), "label": F.coalesce(rank, F.lit(9)), "size": F.col("bytes"), "dims": F.col("width") * F.col("height"), "edited": F.col("edited"), "quality": F.col("score"), "relevance": F.lit(0), "trashed": F.col("trashed"),
    }
    order = [keys[key], F.col("taken_at"), natural_key(F.col("filename")), F.col("id")]
    return photos.orderBy(*[c.asc_nulls_first() if ascending else c.desc_nulls_last() for c in order])


def page(photos: DataFrame, limit: int, offset: int) -> DataFrame:
    return photos.where("trashed = 0").orderBy(F.desc("taken_at"), F.desc("id")).offset(offset).limit(limit)


def keyset_page(photos: DataFrame, after_id: int, limit: int) -> DataFrame:
    return photos.where(F.col("id") > after_id).orderBy("id").limit(limit)
