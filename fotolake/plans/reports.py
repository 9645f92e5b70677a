"""Registered queries of aggregates, rankings and joins, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fotolake.catalog import Catalog, with_tables
from fotolake.functions import scalars as fx
from fotolake.operators import aggregates as ag
from fotolake.operators import joins as jn
from fotolake.operators import windows as wn
from fotolake.plans.search import COLOUR_SQL, PEOPLE, WALL

NOW = 1_703_000_000


def _of(f):
    """A query of one operator over the catalog."""
    return lambda spark, sf_dir: f(Catalog(spark, sf_dir))


def colours(t):
    return t.photo_color.select("photo_id", fx.colour_bucket(F.col("r"), F.col("g"), F.col("b")).alias("colour"))


def incoming(t):
    """Every third photo comes again under another name, some a little off in time."""
    p = t.photos.where("id % 3 = 0")
    stem = F.regexp_replace("filename", r"\.[a-z0-9]+$", "")
    name = F.when(F.col("id") % 2 == 0, F.concat(stem, F.lit("(1).jpg"))).otherwise(F.concat(F.lit("DSC"), stem, F.lit(".jpg")))
    return p.select("id", name.alias("name"), (F.col("taken_at") + F.col("id") % 4).alias("taken_at"), F.when(F.col("id") % 5 == 0, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(F.col("id") % 5 == 0, F.col("width")).otherwise(F.col("height")).alias("height"))


def sidecars(t):
    """Export sidecars of photos: exact names, cut names, moved counters."""
    p = t.photos.where("id % 4 <> 3")
    name = (
        F.when(F.col("id") % 3 == 0, F.concat("filename", F.lit(".json")))
        .when(F.col("id") % 3 == 1, F.concat(F.expr("substring(filename, 1, length(filename) - 2)"), F.lit(".json")))
        .otherwise(F.concat("filename", F.lit("(1).supplemental-metadata.json")))
    )
    return p.select((F.col("id") % 7).alias("folder"), name.alias("name"))


def media(t):
    p = t.photos
    name = F.when(F.col("id") % 3 == 2, F.regexp_replace("filename", r"\.(mp4)$", r"(1).$1")).otherwise(F.col("filename"))
    return p.select((F.col("id") % 7).alias("folder"), name.alias("name"))


def videos(t):
    v = t.photos.where("is_video = 1")
    return v.select("id", (F.col("bytes") % 5000).alias("frames"), ((F.col("bytes") % 5000) / 25.0).alias("seconds"), ((F.col("bytes") % 5000) / 25.0).alias("video_seconds"), F.lit(25.0).alias("fps"), "width", "height", F.lit(1).alias("audio"), "bytes")


def converted(t):
    v = videos(t)
    return v.select(
        "id", F.when(F.col("id") % 3 == 0, F.bround(F.col("seconds") * 20)).otherwise(F.col("frames")).cast("long").alias("frames"), (F.col("seconds") + (F.col("id") % 7) / 50.0).alias("seconds"), "video_seconds",
        F.when(F.col("height") > 1100, F.bround(F.col("width") * 1100 / F.col("height"))).otherwise(F.col("width")).cast("int").alias("width"), F.least(F.col("height"), F.lit(1100)).alias("height"), "audio",
        F.floor(F.col("bytes") * 0.6).alias("bytes"), (0.5 + (F.col("id") % 50) / 100.0).alias("ssim"), (0.45 + (F.col("id") % 40) / 100.0).alias("ssim_min"),
    )


def bursts(t):
    return wn.find_bursts(t.photos)


def series(t):
    manual = t.photos.where("id % 50 < 3").select(F.col("id").alias("photo_id"), F.when(F.col("id") % 50 == 2, 0).otherwise(F.floor(F.col("id") / 100) + 1).cast("long").alias("series_id"))
    return wn.find_series(t.photos, manual)


QUERIES = {
    "a01_library_status": _of(ag.library_status),
    "a02_album_list": _of(ag.album_list),
    "a03_people_list": _of(ag.people_list),
    "a04_tag_counts": _of(ag.tag_counts),
    "a04_selection_keywords": _of(lambda t: ag.selection_keywords(t, t.photos.where("rating = 5").select(F.col("id").alias("photo_id")))),
    "a05_folder_counts": _of(lambda t: ag.folder_counts(t.photos)),
    "a06_storage": _of(lambda t: ag.storage_breakdown(t.photos, top=6)),
    "a07_map_pins": _of(lambda t: ag.map_pins(t.photos)),
    "a08_facets": _of(lambda t: ag.facets(t.photos, [("year", "2024"), ("ext", "JPG")])),
    "a09_timeline": _of(lambda t: ag.timeline(t.photos)),
    "a10_new_in_library": _of(lambda t: ag.new_in_library(t, 1700050000)),
    "a11_frequent_people": _of(lambda t: ag.frequent_people(t, 5)),
    "a12_colour_counts": _of(lambda t: ag.colour_counts(colours(t))),
    "a13_neighbour_keywords": _of(jn.neighbour_keywords),
    "a14_cleanup_report": _of(lambda t: ag.cleanup_report(ag.cleanup_members(t))),
    "a15_progress": _of(lambda t: ag.analysis_progress(t, 2)),
    "a16_unnamed_clusters": _of(lambda t: ag.unnamed_clusters(t.faces.withColumn("cluster_id", F.col("id") % 40).withColumn("person_id", F.when(F.col("id") % 80 == 1, F.col("id"))))),
    "a17_cluster_vote": _of(lambda t: ag.cluster_vote(t)),
    "a19_import_stats": _of(lambda t: ag.import_stats(t.photos.select(F.element_at(F.array(*[F.lit(x) for x in ("added", "duplicate", "failed")]), (F.col("id") % 3 + 1).cast("int")).alias("status"), "bytes", F.col("filename").alias("name")))),
    "a20_missing_parts": _of(lambda t: ag.missing_parts(t.events.where("event_id % 4 <> 1").select(F.col("user_id").alias("export"), (F.col("event_id") % 60 + 1).alias("part")))),
    "a21_distinct_bytes": _of(lambda t: ag.distinct_bytes(t.photos.select((F.col("id") % 2).alias("dev"), F.floor(F.col("id") / 4).alias("inode"), (F.floor(F.col("id") / 4) * 7).alias("size")))),
    "a22_backup_health": _of(lambda t: ag.backup_health(t.events.select((F.col("event_id") * 3600).alias("started"), (F.col("event_id") % 97 == 3).alias("ok")), 40_000_000, 86_400)),
    "a23_backup_verify": _of(lambda t: ag.backup_verify(t.listing_old.select("path", "sha"), t.listing_new.select("path", "sha")).drop("sample")),
    "a24_trash_preview": _of(lambda t: ag.trash_preview(t.photos.withColumn("trashed_at", F.col("taken_at") + 1000), NOW, 20)),
    "w01_bursts": _of(bursts),
    "w02_series": _of(series),
    "w03_series_members": _of(lambda t: wn.series_members(series(t).select("id", "series"), t.photos.where("rating = 5 and trashed = 0").select("id"))),
    "w03_make_series": _of(lambda t: wn.make_series(wn.unseries(t.photos.where("id % 5 < 2").select(F.col("id").alias("photo_id"), (F.col("id") % 7).alias("series_id")), t.photos.where("id % 10 = 1")), t.photos.where("id % 10 = 6"))),
    "w06_prev_next": _of(lambda t: wn.prev_next(t.photos.select("id", "taken_at", "lat"), ["taken_at", "id"], F.when(F.col("lat").isNotNull(), F.col("id")), "placed").select("id", "placed_prev", "placed_next")),
    "w04_rank_selection": _of(lambda t: wn.rank_selection(t, t.photos.where("id % 53 = 0").select(F.col("id").alias("photo_id"), (F.col("id") * 7 % 1009).alias("asked")))),
    "w05_retention": _of(lambda t: wn.retention(t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 1, "auto").when(F.col("event_id") % 3 == 2, "manual").otherwise(F.col("event_type")).alias("reason"), ((F.col("event_id") * 37) % 1000).alias("created")), 40)),
    "w07_unique_names": _of(lambda t: wn.unique_names(t.photos.select("id", (F.col("id") % 99).cast("string").alias("folder"), F.concat(F.lit("Pic"), (F.col("id") % 17).cast("string"), F.when(F.col("id") % 19 == 0, " (1)").otherwise(""), F.lit(".jpg")).alias("name"))).drop("folder")),
    "w08_year_in_review": _of(lambda t: wn.year_in_review(t.photos, 2024)),
    "w09_album_best": _of(lambda t: wn.album_best(t, 4)),
    "w10_face_timeline": _of(wn.face_timeline),
    "w11_fly_path": _of(lambda t: wn.fly_path(t.photos).withColumn("km", F.round("km", 5))),
    "w11_position_at": _of(lambda t: wn.position_at(t.photos, t.track.select(F.col("ts").alias("t"))).select("t", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))),
    "w12_sort_label": _of(lambda t: wn.sort_by(t.photos.where("rating = 3"), "label", False).limit(100).select("id")),
    "w13_page": _of(lambda t: wn.page(t.photos, 50, 100).select("id")),
    "w14_keyset_page": _of(lambda t: wn.keyset_page(t.photos, 500, 40).select("id")),
    "j01_album_photos": _of(lambda t: jn.photos_in_album(t, 7).select("id")),
    "j03_pending_analysis": _of(lambda t: jn.pending_analysis(t, 2)),
    "j04_pending_embeddings": _of(lambda t: jn.pending_embeddings(t.photos, t.photo_analysis)),
    "j05_geotag_track": _of(lambda t: jn.geotag_from_track(t.photos, t.track)),
    "j06_geotag_neighbors": _of(lambda t: jn.geotag_from_neighbors(t.photos)),
    "j07_time_neighbors": _of(lambda t: jn.time_neighbors(t.photos, 1900, 3)),
    "j08_hash_bands": _of(lambda t: jn.near_hashes(jn.hash_band_pairs(t.photos), t.photos, 12)),
    "j09_find_known": _of(lambda t: jn.find_known(incoming(t), t.photos.withColumnRenamed("filename", "name"))),
    "j10_sidecar_match": _of(lambda t: jn.sidecar_match(media(t), sidecars(t))),
    "j11_suffix_join": _of(lambda t: jn.suffix_join(t.photos.select(F.col("rel_path").alias("path")), t.photos.where("id % 2 = 0").select(F.concat(F.lit("export/"), F.when(F.col("id") % 4 == 0, F.col("rel_path")).otherwise(F.col("filename"))).alias("uri")))),
    "j12_xmp_sidecar": _of(lambda t: jn.xmp_sidecar(t.photos.select(F.col("rel_path").alias("path")), t.photos.where("id % 4 < 2").select(F.when(F.col("id") % 4 == 0, F.concat("rel_path", F.lit(".xmp"))).otherwise(F.regexp_replace("rel_path", r"\.[a-z0-9]+$", ".xmp")).alias("path")))),
    "j13_folder_diff": _of(lambda t: jn.folder_diff(t.listing_new, t.listing_old)),
    "j14_backup_plan": _of(lambda t: jn.backup_plan(t.listing_old.select("path", "size", "mtime", (F.col("photo_id") % 2 == 0).alias("encode")), t.listing_new.select("path", "size", (F.col("mtime") - F.col("size") % 5).alias("mtime")))),
    "j15_restore_plan": _of(lambda t: jn.restore_plan(t.listing_old, t.listing_new, True)),
    "j15_restore_summary": _of(lambda t: jn.restore_summary(t.listing_old.withColumn("there", F.col("photo_id") % 4 > 0), t.listing_new, True)),
    "j16_dedupe_ingest": _of(lambda t: jn.dedupe_ingest(t.photos.where("id % 2 = 0 or id % 13 > 10"), t.photos.where("id % 26 = 11"))),
    "j17_conversion_audit": _of(lambda t: jn.conversion_audit(videos(t), converted(t), "limit", 20.0, 1100)),
    "j18_photo_detail": _of(jn.photo_detail),
    "p27_photo_context": _of(jn.photo_context),
}


LIVE = "(select * from photos where trashed = 0)"
SHOTS = "(select * from photos where trashed = 0 and is_video = 0)"
HASHED = "(select * from photos where trashed = 0 and is_video = 0 and phash is not null and taken_at is not null)"
RUNS = """
with s as (select *, lag(taken_at) over o as pt, lag(phash) over o as ph from {shots} as x window o as (order by taken_at, id)),
m as (select *, sum(case when pt is null or taken_at - pt > {gap} or bit_count(xor(phash, ph)) > {bits} then 1 else 0 end) over (order by taken_at, id) as k from s),
r as (select *, first_value(id) over (partition by k order by taken_at, id) as run from m)"""
MERIT = "(coalesce(score, 0), -coalesce(eyes_closed, 0), width * height, bytes, -taken_at, -id)"
SERIES = (
    RUNS.format(shots=HASHED, gap=120, bits=12)
    + f""", man as (select id, case when id % 50 = 2 then 0 else id // 100 + 1 end as sid from photos where id % 50 < 3),
big as (select run, arg_max(id, {MERIT}) as best from r group by 1 having count(*) >= 2),
au as (select r.id, run, best, r.taken_at from r join big using (run) where r.id not in (select id from man)),
ag as (select run, count(*) as n, coalesce(max(id) filter (id = best), arg_min(id, (taken_at, id))) as best from au group by 1 having count(*) > 1),
mm as (select man.id, sid, score, taken_at from man join photos p on p.id = man.id where sid > 0 and trashed = 0),
mg as (select sid, count(*) as n, arg_max(id, (score, -taken_at, -id)) as best from mm group by 1 having count(*) > 1),
series as (select 'auto:' || run as series, au.id, ag.n, ag.best from au join ag using (run) union all select 'manual:' || sid, mm.id, mg.n, mg.best from mm join mg using (sid))"""
)
NEAR_WORDS = f"""nb_s as (select id, taken_at, row_number() over (order by taken_at, id) as p from {SHOTS} where taken_at > 0),
nb_n as (select x.id, y.id as o, row_number() over (partition by x.id order by abs(y.taken_at - x.taken_at), abs(y.p - x.p), case when y.p > x.p then 1 else 0 end) as place
  from nb_s x join nb_s y on y.id <> x.id and y.taken_at between x.taken_at - 7200 and x.taken_at + 7200),
nb_c as (select n.id, name, count(*) as n from nb_n n join (select distinct photo_id, tag_id from photo_tags) g on g.photo_id = n.o join tags on tags.id = tag_id where place <= 12 group by 1, 2),
nb as (select id, name, n, row_number() over (partition by id order by n desc, name) as place from nb_c qualify place <= 15)"""
ASOF = """
with q as (select id, taken_at as t from photos where lat is null),
p as (select ts, min((lat, lng)) as p from track group by ts),
x as (select q.id, q.t, lo.ts as lt, lo.p as lp, hi.ts as ht, hi.p as hp from q
  asof left join p lo on q.t > lo.ts asof left join p hi on q.t <= hi.ts),
y as (select *, coalesce(t - lt <= 900, false) as l, coalesce(ht - t <= 900, false) as h from x)
select id, round(case when l and h and ht > lt then lp[1] + (hp[1] - lp[1]) * ((t - lt) / (ht - lt)) when l and (not h or t - lt <= ht - t) then lp[1] else hp[1] end, 6) as lat,
  round(case when l and h and ht > lt then lp[2] + (hp[2] - lp[2]) * ((t - lt) / (ht - lt)) when l and (not h or t - lt <= ht - t) then lp[2] else hp[2] end, 6) as lng
from y where l or h"""

#: Changes of a folder: f new files, c edited ones, g those that are gone. An edited file gets a content that nobody has, that its
#: owner has given up by then, or that an earlier edit did not get; owner and outcome are followed one by one.
DIFF_SQL = """
with recursive b as (select path, d.sha, k.sha as old_sha, k.photo_id, d.size, k.size as old_size, d.mtime, k.mtime as old_mtime from listing_new d full join listing_old k using (path)),
x as (select * from b where size is not null and old_size is not null and (size <> old_size or mtime <> old_mtime)),
y as (select path, sha, photo_id, (select min(path) from listing_old k where k.sha = x.sha) as owner from x where sha <> old_sha),
z as (select y.*, o.path is not null as moves from y left join y o on o.path = y.owner),
a as (select *, (owner is null or (moves and path > owner)) and not exists (select 1 from z e where e.sha = z.sha and e.path < z.path and (e.owner is null or (e.moves and e.path > e.owner))) as first from z),
walk as (select path, path as at, first as ok, owner from a union all select walk.path, a.path, walk.ok and a.first, a.owner from walk join a on a.path = walk.owner where walk.ok),
won as (select path, bool_and(ok) as ok from walk group by 1),
have as (select case when won.ok then y.sha else k.sha end as sha from listing_old k left join won on won.path = k.path left join y on y.path = k.path),
lost as (select old_sha as sha, photo_id as moved, path as was, row_number() over (partition by old_sha order by path) as place from b where size is null),
fresh as (select path, n.sha, place, moved, was from (select path, sha, row_number() over (partition by sha order by path) as place from b where old_size is null) n left join lost using (sha, place)),
f as (select path, case when moved is not null then 'moved' when place > 1 or sha in (select sha from have) then 'duplicate' else 'new' end as change, moved as photo_id from fresh),
c as (select path, case when sha = old_sha then 'touched' when won.ok then 'changed' else 'duplicate' end as change, photo_id from x left join won using (path)),
l as (select path, photo_id from b where size is null and path not in (select was from fresh where was is not null)),
g as (select path, case when (select count(*) from l) > 20 and (select count(*) from l) > 0.5 * (select count(*) from listing_old) then 'held' else 'gone' end as change, photo_id from l)"""

SQL = {
    k: with_tables(v)
    for k, v in {
        "a01_library_status": "select count(*) filter (trashed = 0 and is_video = 0) as photos, count(*) filter (trashed = 0 and is_video = 1) as videos, count(*) filter (trashed = 1) as trashed, (select count(*) from albums) as albums, (select count(*) from people) as people, (select count(*) from faces) as faces, (select count(*) from tags) as tags from photos",
        "a02_album_list": "select a.id, name, kind, count(b.photo_id) as n, arg_max(p.id, (taken_at, p.id)) filter (trashed = 0) as cover from albums a left join photo_albums b on album_id = a.id left join photos p on p.id = photo_id group by all",
        "a03_people_list": f"select id, name, coalesce(f.n, 0) as face_photos, coalesce(g.n, 0) as tag_photos, best_face, cover from people left join (select person_id, count(distinct photo_id) as n, arg_max(id, (det_score, id)) as best_face from faces where person_id is not null group by 1) f on f.person_id = id left join (select person_id, count(distinct photo_id) as n from photo_people group by 1) g on g.person_id = id left join (select person_id, arg_max(p.id, (taken_at, p.id)) as cover from {PEOPLE} b join photos p on p.id = b.photo_id where trashed = 0 group by 1) c on c.person_id = people.id",
        "a04_tag_counts": "select name, count(*) as n from photo_tags join tags on id = tag_id group by name",
        "a04_selection_keywords": "select name, count(distinct photo_id) as n from photo_tags join tags on tags.id = tag_id where photo_id in (select id from photos where rating = 5) group by name",
        "a05_folder_counts": "select regexp_replace(rel_path, '/[^/]*$', '') as folder, count(*) as n from photos where trashed = 0 group by 1",
        "a06_storage": f"""
with r as (select bytes, regexp_replace(rel_path, '/[^/]*$', '') as folder, year({WALL})::varchar as year, upper(regexp_extract(rel_path, '\\.([^./]+)$', 1)) as type, trashed from photos),
g as (select 'folder' as part, folder as name, count(*) as n, sum(bytes)::bigint as bytes from r where trashed = 0 group by 2 union all select 'year', year, count(*), sum(bytes) from r where trashed = 0 group by 2
  union all select 'type', type, count(*), sum(bytes) from r where trashed = 0 group by 2 union all select 'total', '', count(*), sum(bytes) from r where trashed = 0),
k as (select *, row_number() over (partition by part order by bytes desc, name) as place from g)
select part, case when place <= case when part = 'year' then 50 else 6 end then name else '…' end as name, sum(n)::bigint as n, sum(bytes)::bigint as bytes from k group by 1, 2
union all select 'trash', '', count(*), coalesce(sum(bytes), 0) from r where trashed = 1""",
        "a07_map_pins": "select round(lat, 4) as lat, round(lng, 4) as lng, count(*) as n, arg_max(id, (taken_at, id)) as cover from photos where trashed = 0 and lat is not null group by 1, 2",
        "a08_facets": f"""
with r as (select year({WALL})::varchar as y, month({WALL})::varchar as m, upper(regexp_extract(rel_path, '\\.([^./]+)$', 1)) as e,
  case when width / height > 1.05 then 'landscape' when width / height < 0.95 then 'portrait' else 'square' end as o from photos where trashed = 0)
select 'year' as facet, y as value, count(*) as n from r group by 2 union all select 'month', m, count(*) from r where y = '2024' group by 2
union all select 'ext', e, count(*) from r where y = '2024' group by 2 union all select 'orientation', o, count(*) from r where y = '2024' and e = 'JPG' group by 2""",
        "a09_timeline": f"select strftime({WALL}, '%Y-%m') as month, count(*) as n from photos where trashed = 0 group by 1",
        "a10_new_in_library": "select count(*) as total, count(*) filter (is_video = 1) as videos, count(*) filter (lat is null) as no_place, count(*) filter (taken_at = 0) as no_date, count(*) filter (is_video = 0 and id not in (select photo_id from photo_analysis)) as unanalysed, count(*) filter (is_video = 0 and id not in (select photo_id from faces)) as no_faces from photos where trashed = 0 and imported_at >= 1700050000",
        "a11_frequent_people": "select id, name, n from (select person_id, count(distinct photo_id) as n from photo_people where source = 'takeout' group by 1 having n >= 5) join people on id = person_id",
        "a12_colour_counts": f"select c.colour, count(x.photo_id) as n from (select unnest(['red', 'orange', 'yellow', 'green', 'cyan', 'blue', 'purple', 'pink', 'brown', 'black', 'white', 'gray']) as colour) c left join ({COLOUR_SQL}) x on x.colour = c.colour group by 1",
        "a13_neighbour_keywords": f"with {NEAR_WORDS} select id, name, n, place from nb",
        "a14_cleanup_report": "select category, count(*) as n, sum(bytes)::bigint as bytes from (select photo_id, bytes, case when screenshot = 1 then 'screenshot' when receipt = 1 then 'receipt' when luma < 38 and p95 < 85 then 'dark' when sharp < 12 and phash is not null then 'blurry' end as category from photo_analysis join photos on id = photo_id where trashed = 0 and is_video = 0) where category is not null group by 1",
        "a15_progress": "select count(*) as total, count(*) filter (version is null or sha <> sha256 or version <> 2) as pending, count(*) filter (version is not null and photo_analysis.eyes_closed is null) as eyes_pending from photos left join photo_analysis on id = photo_id where trashed = 0 and is_video = 0",
        "a16_unnamed_clusters": "select id % 40 as cluster_id, count(distinct photo_id) as photos, arg_max(id, (det_score, id)) as cover from faces group by 1 having count(*) filter (id % 80 = 1) = 0 and photos >= 2",
        "a19_import_stats": "with s as (select ['added', 'duplicate', 'failed'][id % 3 + 1] as status, bytes, filename as name from photos) select status, count(*) as n, sum(bytes)::bigint as bytes, case when status = 'failed' then (select list(name order by name) from (select name from s where status = 'failed' order by name limit 30)) end as first from s group by 1",
        "a20_missing_parts": "with p as (select user_id as export, event_id % 60 + 1 as part from events where event_id % 4 <> 1) select export, part::int as part from (select export, unnest(range(1, max(part) + 1)) as part from p group by export) w where (export, part) not in (select (export, part) from p)",
        "a21_distinct_bytes": "select count(*) as files, sum(size)::bigint as bytes from (select id % 2 as dev, id // 4 as inode, max(id // 4 * 7) as size from photos group by 1, 2)",
        "a22_backup_health": "with r as (select event_id * 3600 as started, event_id % 97 = 3 as ok from events), l as (select max(started) filter (ok) as last_ok from r) select last_ok, 40000000 - last_ok > 172800 as overdue, (select count(distinct started) from r, l where not ok and started > last_ok) as fails_since from l",
        "a23_backup_verify": "select count(e.path) as expected, count(f.path) as found, count(*) filter (e.path is not null and f.path is null) as missing, count(*) filter (e.sha <> f.sha) as bad from listing_old e full join listing_new f on e.path = f.path",
        "a24_trash_preview": "select 1703000000 - 20 * 86400 as cutoff, count(*) filter (g) as n, coalesce(sum(bytes) filter (g), 0)::bigint as bytes from (select bytes, trashed = 1 and taken_at + 1000 < 1703000000 - 20 * 86400 as g from photos)",
        "w01_bursts": RUNS.format(shots=HASHED, gap=2, bits=10) + f", g as (select run, count(*) as n, arg_max(id, {MERIT}) as best from r group by 1 having count(*) >= 3) select id, run, n, best from r join g using (run)",
        "w02_series": SERIES + " select series, id, n, best from series",
        "w04_rank_selection": """
with c as (select id as pid, id * 7 % 1009 as asked from photos where id % 53 = 0 order by asked, pid limit 200)
select pid as id, a.score, row_number() over (order by a.score desc, coalesce(a.eyes_closed, 0), bytes desc, asked, pid) as place from c join photo_analysis a on photo_id = pid join photos p on p.id = pid""",
        "w05_retention": """
with s as (select event_id as id, case event_id % 3 when 1 then 'auto' when 2 then 'manual' else event_type end as reason, (event_id * 37) % 1000 as created from events)
select id, reason, row_number() over (partition by case when reason in ('auto', 'manual') then 'regular' else reason end order by created desc, id desc) <= case when reason in ('auto', 'manual') then 40 else 3 end as keep from s""",
        "w08_year_in_review": f"select id, month({WALL}) as month, taken_at, score from {SHOTS} where year({WALL}) = 2024 qualify row_number() over (partition by month({WALL}) order by score desc, taken_at, id) <= 10",
        "w09_album_best": f"select id, score, taken_at from {SHOTS} where id in (select photo_id from photo_albums where album_id = 4) order by score desc, taken_at, id limit 40",
        "w10_face_timeline": f"select person_id, year({WALL}) as year, arg_max(id, (score, -taken_at, -id)) as photo from {PEOPLE} b join {LIVE} p on p.id = b.photo_id group by 1, 2",
        "w11_fly_path": f"select id, taken_at, lat, lng, n as next_id, round(12742 * asin(least(1, sqrt(pow(sin(radians(b - lat) / 2), 2) + cos(radians(lat)) * cos(radians(b)) * pow(sin(radians(c - lng) / 2), 2)))), 5) as km from (select *, lead(id) over o as n, lead(lat) over o as b, lead(lng) over o as c from {LIVE} where lat is not null window o as (order by taken_at, id))",
        "w11_position_at": f"""
with p as (select taken_at as t, min((id, lat, lng)) as p from {LIVE} where lat is not null group by 1), q as (select distinct ts as t from track),
x as (select q.t, lo.t as lt, lo.p as lp, hi.t as ht, hi.p as hp from q asof left join p lo on q.t >= lo.t asof left join p hi on q.t < hi.t)
select t, round(coalesce(lp[2] + (hp[2] - lp[2]) * ((t - lt) / (ht - lt)), lp[2], hp[2]), 6) as lat, round(coalesce(lp[3] + (hp[3] - lp[3]) * ((t - lt) / (ht - lt)), lp[3], hp[3]), 6) as lng from x""",
        "w12_sort_label": "select id from photos where rating = 3 order by case label when 'red' then 0 when 'yellow' then 1 when 'green' then 2 when 'blue' then 3 when 'purple' then 4 else 9 end desc, taken_at desc, 'img_' || lpad(id::varchar, 12, '0') desc limit 100",
        "w13_page": f"select id from {LIVE} order by taken_at desc, id desc limit 50 offset 100",
        "w14_keyset_page": "select id from photos where id > 500 order by id limit 40",
        "j01_album_photos": f"select id from {LIVE} where id in (select photo_id from photo_albums where album_id = 7)",
        "j03_pending_analysis": f"select id, sha256 from {SHOTS} left join photo_analysis on photo_id = id where version is null or sha <> sha256 or version <> 2",
        "j04_pending_embeddings": f"select id, sha256 from {SHOTS} left join photo_analysis on photo_id = id where sha is distinct from sha256",
        "j05_geotag_track": ASOF,
        "j06_geotag_neighbors": f"""
with d as (select * from {LIVE}), s as (select *, last_value(case when lat is not null then (taken_at, id, lat, lng) end ignore nulls) over (order by taken_at, id rows between unbounded preceding and 1 preceding) as p,
  first_value(case when lat is not null then (taken_at, id, lat, lng) end ignore nulls) over (order by taken_at, id rows between 1 following and unbounded following) as n from d),
g as (select id, taken_at - p[1] as b, n[1] - taken_at as a, p, n from s where lat is null),
r as (select id, coalesce(b <= coalesce(a, b), false) as f, a, b, p, n from g)
select id, case when f then p[2] else n[2] end as source_id, case when f then p[3] else n[3] end as lat, case when f then p[4] else n[4] end as lng from r where case when f then b else a end <= 1800""",
        "j07_time_neighbors": f"select a, b from (select x.id as a, y.id as b, row_number() over (partition by x.id order by y.taken_at, y.id) as place from {SHOTS} x join {SHOTS} y on (y.taken_at, y.id) > (x.taken_at, x.id) and y.taken_at between x.taken_at and x.taken_at + 1900) where place <= 3",
        "j08_hash_bands": f"""
with s as (select id, phash from {SHOTS}), b as (select id, unnest([0, 1, 2, 3, 4, 5, 6]) as band, unnest([phash & 511, (phash >> 9) & 511, (phash >> 18) & 511, (phash >> 27) & 511, (phash >> 36) & 511, (phash >> 45) & 511, (phash >> 54) & 1023]) as bits from s),
u as (select band, bits from b group by 1, 2 having count(*) between 2 and 120), k as (select b.* from b join u using (band, bits)),
p as (select distinct x.id as a, y.id as b from k x join k y on x.band = y.band and x.bits = y.bits and x.id < y.id)
select a, b, bit_count(xor(x.phash, y.phash))::int as bits from p join s x on x.id = a join s y on y.id = b where bits <= 12""",
        "j09_find_known": """
with n as (select id as in_id, case when id % 2 = 0 then 'img_' || id else 'dscimg_' || id end as stem, taken_at + id % 4 as t, least(width, height) as s, greatest(width, height) as l from photos where id % 3 = 0),
k as (select id, 'img_' || id as stem, taken_at as t, least(width, height) as s, greatest(width, height) as l from photos),
m as (select in_id, 0 as rule, id from n join k using (stem) where abs(n.t - k.t) <= 54000 or (n.s = k.s and n.l = k.l)
  union all select in_id, 1, id from n join k on k.t between n.t - 2 and n.t + 2 and n.s = k.s and n.l = k.l)
select in_id, arg_min(id, (rule, id)) as known_id from m group by 1""",
        "w03_make_series": "select id as photo_id, case when id % 10 = 1 then 0 else id % 7 end as series_id from photos where id % 5 < 2 and id % 10 <> 6 union all select id, 1 + (select max(case when id % 10 = 1 then 0 else id % 7 end) from photos where id % 5 < 2) from photos where id % 10 = 6",
        "w06_prev_next": "select id, last_value(case when lat is not null then id end ignore nulls) over (order by taken_at, id rows between unbounded preceding and 1 preceding) as placed_prev, first_value(case when lat is not null then id end ignore nulls) over (order by taken_at, id rows between 1 following and unbounded following) as placed_next from photos",
        "f42_stacked": RUNS.format(shots=HASHED, gap=2, bits=10) + f", g as (select run, arg_max(id, {MERIT}) as best from r group by 1 having count(*) >= 3) select id from photos where trashed = 0 and id not in (select id from r join g using (run) where id <> best)",
        "w03_series_members": SERIES + ", i as (select id from photos where rating = 5 and trashed = 0) select id from i union select id from series where series in (select series from series where id in (select id from i))",
        "j11_suffix_join": """
with u as (select 'export/' || case when id % 4 = 0 then rel_path else filename end as uri from photos where id % 2 = 0)
select rel_path as path, uri from photos join u on regexp_extract(rel_path, '[^/]*$') = regexp_extract(uri, '[^/]*$') where ends_with(uri, rel_path) or ends_with(rel_path, uri)""",
        "j13_folder_diff": DIFF_SQL + " select * from f union all select * from c union all select * from g",
        "j15_restore_summary": "select count(*) filter (photo_id % 4 > 0 and (n.sha is null or n.sha <> o.sha)) as files, count(*) filter (photo_id % 4 > 0 and n.sha is null) as missing, count(*) filter (photo_id % 4 > 0 and n.sha <> o.sha) as changed, count(*) filter (photo_id % 4 = 0 and n.sha is null) as missing_files from listing_old o left join listing_new n using (path)",
        "a17_cluster_vote": """
with recursive c as (select cluster_id, row_number() over (order by count(*) desc, cluster_id) as i from faces group by 1),
v as (select cluster_id, person_id, count(*) as n from (select distinct cluster_id, photo_id from faces) join (select distinct photo_id, person_id from photo_people) using (photo_id) group by 1, 2),
s as (select 0::bigint as i, 0::bigint as cluster_id, null::bigint as person_id, []::bigint[] as taken
  union all select i, cluster_id, person_id, case when person_id is null then taken else list_append(taken, person_id) end from (
    select c.i, c.cluster_id, s.taken, (select arg_max(v.person_id, (v.n, -v.person_id)) from v where v.cluster_id = c.cluster_id and not list_contains(s.taken, v.person_id)) as person_id from s join c on c.i = s.i + 1))
select cluster_id, person_id from s where person_id is not null""",
        "w07_unique_names": """
with recursive p as (select id, id % 99 as folder, 'Pic' || (id % 17) || case when id % 19 = 0 then ' (1)' else '' end as stem from photos),
q as (select *, row_number() over (partition by folder order by id) as i from p),
s as (select folder, 0::bigint as i, 0::bigint as id, ''::varchar as name, []::varchar[] as used from q group by 1
  union all select folder, i, id, name, list_append(used, name) from (
    select q.folder, q.i, q.id, s.used, case when not list_contains(s.used, q.stem) then q.stem
      else q.stem || ' (' || list_min(list_filter(range(1, len(s.used) + 2), lambda n: not list_contains(s.used, q.stem || ' (' || n || ')'))) || ')' end as name
    from s join q on q.folder = s.folder and q.i = s.i + 1))
select id, name || '.jpg' as unique from s where i > 0""",
        "j17_conversion_audit": """
with v as (select id, bytes % 5000 as f, bytes % 5000 / 25.0::double as s, width as w, height as h, bytes, (0.5::double + (id % 50) / 100.0::double) as m, (0.45::double + (id % 40) / 100.0::double) as lo from photos where is_video = 1),
o as (select *, case when id % 3 = 0 then round_even(s * 20, 0) else f end as g, case when h > 1100 then round_even(w * 1100 / h, 0) else w end as ow, least(h, 1100) as oh, least(f, round_even(s * 20, 0)) as e, case when s > 0 then f / s else 25 end as fps from v),
k as (select *, [case when not (case when fps <= 20.02 then g = f else g between floor(e * 0.9::double) and e + 2 end) then 'frames' end, case when (s + (id % 7) / 50.0::double) - s > 0.1::double then 'duration' end,
  case when not (case when h > 1100 then abs(ow / oh - w / h) / (w / h) < 0.01 else ow = w and oh = h end) then 'resolution' end, case when floor(bytes * 0.6::double) >= bytes then 'size' end,
  case when m < 0.8::double or lo < 0.6::double then 'ssim' end] as all_checks from o)
select id, len(list_filter(all_checks, lambda x: x is not null)) = 0 as ok, list_filter(all_checks, lambda x: x is not null) as failed,
  case when m >= 0.97::double then 'excellent' when m >= 0.93::double then 'very_good' when m >= 0.88::double then 'good' else 'noticeable' end as grade from k""",
        "j12_xmp_sidecar": "select rel_path as path, case id % 4 when 0 then rel_path || '.xmp' else regexp_replace(rel_path, '\\.[a-z0-9]+$', '.xmp') end as sidecar from photos where id % 4 < 2",
        "j14_backup_plan": "select o.path, case when n.size = o.size and n.mtime - n.size % 5 >= o.mtime - 2 then 'reuse' when photo_id % 2 = 0 then 'encode' else 'copy' end as action, case when n.size = o.size and n.mtime - n.size % 5 >= o.mtime - 2 then 0 when photo_id % 2 = 0 then round(o.size * 0.4::double)::bigint else o.size end as need from listing_old o left join listing_new n using (path)",
        "j15_restore_plan": "select o.path, case when n.sha is null then 'missing' else 'changed' end as why from listing_old o left join listing_new n using (path) where n.sha is null or n.sha <> o.sha",
        "j16_dedupe_ingest": "select id, case when sha256 in (select sha256 from photos where id % 26 = 11) or row_number() over (partition by sha256 order by id) > 1 then 'duplicate' else 'added' end as status from photos where id % 2 = 0 or id % 13 > 10",
        "p27_photo_context": f"""
with {NEAR_WORDS},
d as (select id, (select string_agg(name, ', ' order by name) from (select distinct name from photo_tags join tags on tags.id = tag_id where photo_id = photos.id order by 1 limit 20)) as k,
  (select string_agg(name, ', ' order by name) from (select distinct name from {PEOPLE} x join people on people.id = person_id where x.photo_id = photos.id order by 1 limit 10)) as p,
  (select string_agg(name, ', ' order by place) from nb where nb.id = photos.id) as n from photos)
select id, concat_ws(chr(10), 'Taken: ' || strftime({WALL}, '%Y-%m-%d %H:%M (%A)'), 'Location: ' || printf('%.4f, %.4f', lat, lng), 'Camera: ' || camera_model || ', ' || lens,
  case when id % 5 > 0 then 'Exposure: shutter 1/' || (30 + id % 100) || ', ISO ' || (100 + id % 1600) end, 'Size: ' || width || 'x' || height, 'Caption: ' || description,
  'Keywords already on this photo: ' || k, 'People in the photo: ' || p, 'Keywords of photos taken close in time: ' || n) as context
from photos join d using (id)""",
        "j18_photo_detail": """
select id, filename, coalesce((select list_sort(list(distinct name)) from photo_albums join albums on albums.id = album_id where photo_id = photos.id), []) as albums,
  coalesce((select list_sort(list(distinct name)) from photo_people join people on people.id = person_id where photo_id = photos.id), []) as people,
  coalesce((select list_sort(list(distinct name)) from photo_tags join tags on tags.id = tag_id where photo_id = photos.id), []) as tags from photos""",
    }.items()
}
