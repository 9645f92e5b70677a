"""Registered queries of the stream operators in their batch form, and of sources derived from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.catalog import Catalog, with_tables
from fotolake.operators import images
from fotolake.operators import joins as jn
from fotolake.plans.reports import DIFF_SQL
from fotolake.plans.search import PEOPLE, SCORE_SQL
from fotolake.sources import files
from fotolake.streaming import flows


def _of(f):
    return lambda spark, sf_dir: f(Catalog(spark, sf_dir))


def lightroom(t):
    """The tables of a source catalog, derived from the photos."""
    p, i = t.photos, F.col("id")
    word = lambda name, kind, n: t.events.where(f"event_id < {n}").select(F.col("event_id").alias("id_local"), F.concat(F.lit(name), F.col("event_id").cast("string")).alias("name"), kind)
    text = F.format_string("%04d-%02d-%02dT%02d:%02d:00.5", 1999 + i % 20, 1 + i % 12, 1 + i % 31, i % 24, i % 60)
    return {
        "Adobe_images": p.select(i.alias("id_local"), i.alias("rootFile"), text.alias("captureTime"), (i % 6).cast("string").alias("rating"), (i % 3 - 1).cast("string").alias("pick"), F.element_at(F.array(F.lit("Red"), F.lit("ירוק"), F.lit("odd"), F.lit("")), (i % 4 + 1).cast("int")).alias("colorLabels")),
        "AgLibraryFile": p.select(i.alias("id_local"), (i % 7).alias("folder"), F.concat(F.lit("IMG_"), i.cast("string")).alias("baseName"), F.lit("jpg").alias("extension")),
        "AgLibraryFolder": t.events.where("event_id < 7").select(F.col("event_id").alias("id_local"), (F.col("event_id") % 2).alias("rootFolder"), F.concat(F.col("event_id").cast("string"), F.lit("/")).alias("pathFromRoot")),
        "AgLibraryRootFolder": t.events.where("event_id < 2").select(F.col("event_id").alias("id_local"), F.concat(F.lit("/r"), F.col("event_id").cast("string"), F.lit("/")).alias("absolutePath")),
        "AgHarvestedExifMetadata": p.where("id % 2 = 0").select(i.alias("image"), F.col("lat").alias("gpsLatitude"), F.col("lng").alias("gpsLongitude")),
        "AgLibraryIPTC": p.where("id % 3 = 0").select(i.alias("image"), F.when(i % 2 == 0, F.concat(F.lit("c"), i.cast("string"))).otherwise("").alias("caption")),
        "AgLibraryKeyword": word("k", F.when(F.col("event_id") % 3 == 0, "person").alias("keywordType"), 9),
        "AgLibraryKeywordImage": p.where("id % 4 < 2").select(i.alias("image"), (i % 9).alias("tag")).unionByName(p.where("id % 4 = 1").select(i.alias("image"), ((i + 4) % 9).alias("tag"))),
        "AgLibraryCollection": word("set", F.lit("com.adobe.ag.library.collection").alias("creationId"), 5).withColumn("systemOnly", F.when(F.col("id_local") == 2, 1.0).otherwise(0.0)).withColumn("name", F.when(F.col("id_local") == 3, "Quick Collection").otherwise(F.col("name"))),
        "AgLibraryCollectionImage": p.where("id % 2 = 1").select(i.alias("image"), (i % 6).alias("collection")),
    }


def grey_pictures(t):
    """A grey picture of 24 x 24 per document, its sixteen shades from a digest of the text."""
    shades = F.unhex(F.repeat(F.md5(F.coalesce("text", F.lit(""))), F.lit(36)))
    return t.documents.select(F.col("doc_id").cast("string").alias("origin"), F.lit(24).alias("width"), F.lit(24).alias("height"), F.lit(1).alias("nChannels"), shades.alias("data"))


def screens(t):
    """Photos by names and sizes of screenshots and of what is none."""
    i = F.col("id")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), F.pmod(by, F.lit(len(values))).cast("int") + 1)
    return t.photos.select("id", F.concat(F.lit("pics/"), pick(SHOT_NAMES, i), i.cast("string"), pick([".png", ".jpg"], i)).alias("name"), pick([1080, 1366, 1000, 750, 1200], i).alias("w"), pick([1920, 768, 1001, 1334], F.floor(i / 3)).alias("h"), (i % 11 == 0).alias("camera"))


SHOT_NAMES = ["IMG_", "Screenshot_", "my screen-shot ", "screens/IMG_", "SCREENCAPTURE", "scan"]


def eyes(t):
    """Faces with eight landmarks for each eye, out of their vectors."""
    points = lambda first: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.array(F.get("embedding", 2 * k + first).cast("double"), F.get("embedding", 2 * k + first + 1).cast("double")))
    return t.faces.select("id", "photo_id", "det_score", F.lit(10.0).alias("x1"), (F.col("id") % 100 + 20.0).alias("x2"), points(0).alias("left_eye"), points(16).alias("right_eye"))


def repeated_names(t):
    """Photos of which many have one name, some of them a numbered one."""
    tail = F.element_at(F.array(*map(F.lit, NAME_TAILS)), F.pmod(F.col("id"), F.lit(len(NAME_TAILS))).cast("int") + 1)
    return t.photos.withColumn("filename", F.concat(F.lit("Pic"), (F.col("id") % 3).cast("string"), tail)).withColumn("taken_at", F.col("id") % 90 * 2_700_000 + 1_000_000_000)


NAME_TAILS = [".jpg", ".jpg", " (1).jpg", ".JPG", " (1) (1).jpg", " (3).jpg", "", " (2).jpg", " (1)"]

QUERIES = {
    "s01_catalog_scan": lambda spark, sf_dir: reduce(DataFrame.unionByName, [f.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, f in files.catalog_scan(spark, sf_dir, ["events", "embeddings", "documents"]).items()]),
    "s10_lightroom": _of(lambda t: files.lightroom_import(lightroom(t))),
    "s12_import_summary": _of(lambda t: files.import_summary(files.lightroom_import(lightroom(t)), t.photos.where("id % 3 > 0").select(F.concat(F.lit("/r"), (F.col("id") % 7 % 2).cast("string"), F.lit("/"), (F.col("id") % 7).cast("string"), F.lit("/IMG_"), F.col("id").cast("string"), F.lit(".jpg")).alias("path"), F.col("bytes").alias("size")), sets=files.lightroom_collections(lightroom(t)))),
    "m01_measures": _of(lambda t: images.measure(grey_pictures(t), "luma", "p5", "p95", "saturation").select(F.col("origin").cast("long").alias("doc_id"), F.round("luma", 6).alias("luma"), F.round("p5", 6).alias("p5"), F.round("p95", 6).alias("p95"), F.round("saturation", 6).alias("saturation"))),
    "s13_xmp_round_trip": _of(lambda t: files.xmp_fields(files.xmp_write(t).withColumnRenamed("packet", "value")).select("id", "rating", "label", F.size("subjects").cast("long").alias("subjects"), "description")),
    "s16_exif_fields": _of(lambda t: files.exif_fields(t.photos.select("id", F.when(F.col("id") % 5 > 0, F.to_json(F.struct(F.struct(F.col("camera_model").alias("Model")).alias("Image"), F.struct(F.col("lens").alias("LensModel"), F.concat(F.col("focal_length").cast("int").cast("string"), F.lit("/2")).alias("FocalLength"), (F.col("id") % 1600).cast("string").alias("ISOSpeedRatings")).alias("Exif")))).alias("exif_json"))).select("id", "read", "model", "lens", "focal_length", "iso")),
    "m02_sharpness": _of(lambda t: images.measure(grey_pictures(t), "sharp").select(F.col("origin").cast("long").alias("doc_id"), F.round("sharp", 4).alias("sharp"))),
    "m03_dhash": _of(lambda t: images.measure(grey_pictures(t), "phash").select(F.col("origin").cast("long").alias("doc_id"), "phash")),
    "m04_screenshots": _of(lambda t: screens(t).select("id", images.screenshot_flag(F.col("name"), F.col("w"), F.col("h"), F.col("camera")).cast("long").alias("shot"))),
    "m06_closed_eyes": _of(lambda t: images.closed_eyes(eyes(t), t.photos, 0.5)),
    "p22_eye_ratio": _of(lambda t: eyes(t).select("id", F.round(images.eye_ratio(F.col("left_eye")), 6).alias("ratio"))),
    "s14_xmp_packets": _of(files.xmp_write),
    "s17_export_manifest": _of(lambda t: files.export_manifest(repeated_names(t))),
    "s17_export_archive": _of(lambda t: files.export_manifest(repeated_names(t), True)),
    "t03_known_after_sync": _of(lambda t: jn.apply_diff(t.listing_old, t.listing_new, jn.folder_diff(t.listing_new, t.listing_old))),
    "t06_stream_bursts": _of(lambda t: flows.stream_bursts(t.photos.where("trashed = 0 and is_video = 0 and phash is not null").select((F.col("user_id") % 3).alias("source"), "id", F.timestamp_seconds("taken_at").alias("ts"), "phash", F.col("score").cast("long").alias("score")), 4, 12, 2)),
    "t07_alert_throttle": _of(lambda t: flows.alert_throttle(t.events.select((F.col("user_id") % 40).alias("alert"), (F.col("event_id") * 97 % 400_000).alias("at"), (F.col("event_id") % 9 > 0).alias("active")))),
    "t04_scores": _of(lambda t: flows.incremental_score(t.photos, t.photo_analysis)),
    "t05_expired": _of(lambda t: flows.expired(t.photos.withColumn("trashed_at", F.col("taken_at") + 500), 1_702_000_000, 9000).select("id")),
    "t08_rate_limit": _of(lambda t: flows.rate_limit(t.events.select((F.col("user_id") % 40).alias("key"), (F.col("event_id") * 97 % 400_000).alias("at")))),
    "t09_live_counts": _of(lambda t: flows.live_counts(t.events.select(F.col("ts"), F.col("event_type").alias("status"), F.col("event_id").alias("bytes"))).select(F.col("start").cast("string").alias("start"), "status", "n", "bytes")),
    "t10_dedup": _of(lambda t: flows.dedup_stream(t.photos.select("sha256", F.col("is_video").isNull().alias("none")))),
}


def eye_sql(first: int) -> str:
    """(id, ratio) of the eye whose landmarks begin at a dimension: extents along and across the axis of greatest variance."""
    return f"""(select id, case when max(x * cos(g) + y * sin(g)) - min(x * cos(g) + y * sin(g)) > 1e-6
    then (max(y * cos(g) - x * sin(g)) - min(y * cos(g) - x * sin(g))) / (max(x * cos(g) + y * sin(g)) - min(x * cos(g) + y * sin(g))) else 1 end as ratio
  from (select *, atan2(2 * covar_pop(x, y) over (partition by id), var_pop(x) over (partition by id) - var_pop(y) over (partition by id)) / 2 as g
    from (select id, embedding[2 * k + {first + 1}]::double as x, embedding[2 * k + {first + 2}]::double as y from faces, range(8) r(k))) group by id)"""


def lanczos_sql(out: int) -> str:
    """(o, k, w): weights by which 24 levels become out."""
    x = f"((k - (o + 0.5::double) * 24 / {out} + 0.5::double) * {out} / 24)"
    edge = f"k >= greatest(trunc((o + 0.5::double) * 24 / {out} - 72.0::double / {out} + 0.5::double), 0) and k < least(trunc((o + 0.5::double) * 24 / {out} + 72.0::double / {out} + 0.5::double), 24)"
    value = f"case when not ({edge}) then 0 when {x} = 0 then 1 when abs({x}) < 3 then 3 * sin(pi() * {x}) * sin(pi() * {x} / 3) / pow(pi() * {x}, 2) else 0 end"
    return f"(select o, k, w / sum(w) over (partition by o) as w from (select o, k, {value} as w from range({out}) a(o), range(24) b(k)))"


def one_by_one(start: int, fold: str) -> str:
    """Names given to one photo after the other."""
    return f"""
with recursive p as (select id, strftime(make_timestamp((id % 90 * 2700000 + 1000000000) * 1000000), '%Y-%m') as folder, 'Pic' || (id % 3) || {NAME_TAILS}[(id % {len(NAME_TAILS)} + 1)::int] as name from photos where trashed = 0),
q as (select *, case when contains(name, '.') then regexp_replace(name, '[.][^.]*$', '') else name end as stem, regexp_extract(name, '[.][^.]*$') as ext, row_number() over (partition by folder order by id) as i from p),
s as (select folder, 0::bigint as i, 0::bigint as id, ''::varchar as name, []::varchar[] as used from q group by 1
  union all select folder, i, id, name, list_append(used, {fold}(name)) from (
    select q.folder, q.i, q.id, s.used, case when not list_contains(s.used, {fold}(q.name)) then q.name
      else q.stem || ' (' || list_min(list_filter(range({start}, {start} + len(s.used) + 1), lambda n: not list_contains(s.used, {fold}(q.stem || ' (' || n || ')' || q.ext)))) || ')' || q.ext end as name
    from s join q on q.folder = s.folder and q.i = s.i + 1))
select id, folder, name from s where i > 0"""


SQL = {
    k: with_tables(v)
    for k, v in {
        "s01_catalog_scan": "select 'events' as name, count(*) as n from events union all select 'embeddings', count(*) from embeddings union all select 'documents', count(*) from documents",
        "s10_lightroom": """
with k as (select id as image, id % 9 as tag from photos where id % 4 < 2 union select id, (id + 4) % 9 from photos where id % 4 = 1)
select id, '/r' || (id % 7 % 2) || '/' || (id % 7) || '/IMG_' || id || '.jpg' as path,
  epoch(try_cast(printf('%04d-%02d-%02d %02d:%02d:00', 1999 + id % 20, 1 + id % 12, 1 + id % 31, id % 24, id % 60) as timestamp))::bigint as taken, (id % 6)::int as rating, (id % 3 - 1)::int as flag,
  case id % 4 when 0 then 'red' when 1 then 'green' end as label, case when id % 2 = 1 and id % 6 = 3 then 1 else 0 end as quick, case when id % 2 = 0 then lat end as lat, case when id % 2 = 0 then lng end as lng,
  case when id % 6 = 0 then 'c' || id end as description,
  coalesce((select list_sort(list('k' || tag)) from k where image = id and tag % 3 <> 0), []) as keywords, coalesce((select list_sort(list('k' || tag)) from k where image = id and tag % 3 = 0), []) as people,
  case when id % 2 = 1 and id % 6 = 1 then ['set1'] else [] end as collections from photos""",
        "s12_import_summary": """
with k as (select id as image, id % 9 as tag from photos where id % 4 < 2 union select id, (id + 4) % 9 from photos where id % 4 = 1)
select count(*) as images, count(*) filter (id % 3 = 0) as missing, coalesce(sum(bytes) filter (id % 3 > 0), 0)::bigint as bytes, (select count(distinct tag) from k where tag % 3 <> 0) as words, (select count(*) from events where event_id < 5 and event_id <> 2) as collections from photos""",
        "m01_measures": """
with b as (select doc_id, list_transform(range(0, 16), lambda i: ('0x' || substr(md5(coalesce(text, '')), (i * 2 + 1)::int, 2))::int) as v from documents)
select doc_id, round(list_avg(v), 6) as luma, list_min(v)::double as p5, list_max(v)::double as p95, 0.0::double as saturation from b""",
        "s14_xmp_packets": f"""
with w as (select photo_id, 0 as kind, name as w from photo_tags join tags on tags.id = tag_id union select photo_id, 1, name from {PEOPLE} p join people on people.id = p.person_id
  union select photo_id, 2, 'Album/' || name from photo_albums join albums on albums.id = album_id where kind = 'album'),
s as (select photo_id, string_agg('<rdf:li>' || replace(replace(replace(replace(w, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</rdf:li>', '' order by kind, w) as items from w group by 1)
select id, '<?xpacket begin="' || chr(65279) || '" id="W5M0MpCehiHzreSzNTczkc9d"?>' || chr(10) || '<x:xmpmeta xmlns:x="adobe:ns:meta/">' || chr(10) || ' <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">' || chr(10)
  || '  <rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:xmp="http://ns.adobe.com/xap/1.0/"'
  || case when rating <> 0 then ' xmp:Rating="' || rating || '"' else '' end || case when label <> '' then ' xmp:Label="' || upper(label[1]) || lower(label[2:]) || '"' else '' end || '>' || chr(10) || '   '
  || coalesce('<dc:subject><rdf:Bag>' || items || '</rdf:Bag></dc:subject>', '')
  || case when description <> '' then '<dc:description><rdf:Alt><rdf:li xml:lang="x-default">' || description || '</rdf:li></rdf:Alt></dc:description>' else '' end
  || chr(10) || '  </rdf:Description>' || chr(10) || ' </rdf:RDF>' || chr(10) || '</x:xmpmeta>' || chr(10) || '<?xpacket end="w"?>' || chr(10) as packet
from photos left join s on photo_id = id""",
        "m02_sharpness": """
with b as (select doc_id, list_transform(range(0, 16), lambda i: ('0x' || substr(md5(coalesce(text, '')), (i * 2 + 1)::int, 2))::int) as v from documents),
l as (select doc_id, i, j, v[((24 * (6 * i + y - 1) + 6 * j + x) % 16 + 1)::int] + v[((24 * (6 * i + y + 1) + 6 * j + x) % 16 + 1)::int] + v[((24 * (6 * i + y) + 6 * j + x - 1) % 16 + 1)::int]
  + v[((24 * (6 * i + y) + 6 * j + x + 1) % 16 + 1)::int] - 4 * v[((24 * (6 * i + y) + 6 * j + x) % 16 + 1)::int] as lap from b, range(4) a(i), range(4) c(j), range(1, 5) d(y), range(1, 5) e(x)),
q as (select doc_id, i, j, var_pop(lap) as s from l group by all)
select doc_id, round(quantile_cont(s, 0.8), 4) as sharp from q group by 1""",
        "m03_dhash": f"""
with b as (select doc_id, list_transform(range(0, 16), lambda i: ('0x' || substr(md5(coalesce(text, '')), (i * 2 + 1)::int, 2))::int) as v from documents),
h as (select doc_id, y, c.o as x, greatest(0, least(255, floor(sum(c.w * v[((24 * y + c.k) % 16 + 1)::int]) + 0.5))) as s from b, range(24) r(y), {lanczos_sql(9)} c group by all),
g as (select doc_id, c.o as y, x, greatest(0, least(255, floor(sum(c.w * s) + 0.5))) as s from h join {lanczos_sql(8)} c on c.k = h.y group by all),
d as (select doc_id, y, x, s, lead(s) over (partition by doc_id, y order by x) as next from g),
t as (select doc_id, stddev_pop(s) as spread, sum(case when next > s then pow(2::hugeint, (63 - 8 * y - x)::int)::hugeint else 0 end)::hugeint as bits from d group by 1)
select doc_id, case when spread >= 3 then (case when bits >= 9223372036854775808::hugeint then bits - 18446744073709551616::hugeint else bits end)::bigint end as phash from t""",
        "m04_screenshots": f"""
with n as (select id, {SHOT_NAMES}[(id % 6 + 1)::int] || id || case id % 2 when 0 then '.png' else '.jpg' end as name, [1080, 1366, 1000, 750, 1200][(id % 5 + 1)::int] as w, [1920, 768, 1001, 1334][(id // 3 % 4 + 1)::int] as h, id % 11 = 0 as camera from photos)
select id, case when regexp_matches(regexp_extract(name, '[^/]*$'), '(?i)screen[ _-]?shot|screen[ _-]?capture') or (name like '%.png' and not camera and greatest(w, h) >= 900 and (w, h) in ((1080, 1920), (1366, 768), (750, 1334))) then 1 else 0 end as shot from n""",
        "m06_closed_eyes": f"""
select photo_id, max(case when (l.ratio + r.ratio) / 2 < 0.5 then 1 else 0 end)::int as eyes_closed
from faces f join {eye_sql(0)} l on l.id = f.id join {eye_sql(16)} r on r.id = f.id join photos p on p.id = f.photo_id
where det_score >= 0.6 and f.id % 100 + 10 >= 0.03 * width group by 1""",
        "p22_eye_ratio": f"select id, round(ratio, 6) as ratio from {eye_sql(0)}",
        "s13_xmp_round_trip": f"""
with w as (select photo_id, 0 as kind, name as w from photo_tags join tags on tags.id = tag_id union select photo_id, 1, name from {PEOPLE} p join people on people.id = p.person_id
  union select photo_id, 2, 'Album/' || name from photo_albums join albums on albums.id = album_id where kind = 'album'),
s as (select id, rating, nullif(label, '') as label, (select count(*) from w where photo_id = photos.id) as subjects, description from photos)
select * from s where rating <> 0 or label is not null or subjects > 0 or description is not null""",
        "t03_known_after_sync": DIFF_SQL + """, d as (select * from f union all select * from c union all select * from g),
top as (select max(photo_id) as top from listing_old)
select k.path, coalesce(n.size, k.size) as size, coalesce(n.mtime, k.mtime) as mtime, case when d.change = 'changed' then n.sha else k.sha end as sha, k.photo_id
from listing_old k left join d on d.path = k.path left join listing_new n on n.path = k.path and d.change in ('changed', 'touched', 'duplicate')
where coalesce(d.change, '') <> 'gone' and k.photo_id not in (select photo_id from d where change = 'moved')
union all select n.path, n.size, n.mtime, n.sha, d.photo_id from listing_new n join d on d.path = n.path and change = 'moved'
union all select n.path, n.size, n.mtime, n.sha, top + row_number() over (order by n.path) from listing_new n join d on d.path = n.path and change = 'new' cross join top""",
        "t06_stream_bursts": """
with s as (select user_id % 3 as source, id, taken_at, phash, score, lag(taken_at) over w as before, lag(phash) over w as other from photos where trashed = 0 and is_video = 0 and phash is not null window w as (partition by user_id % 3 order by taken_at, id)),
r as (select *, sum(case when before is null or taken_at - before > 4 or bit_count(xor(phash, other)) > 12 then 1 else 0 end) over (partition by source order by taken_at, id) as run from s)
select source, arg_min(id, (taken_at, id)) as first_id, count(*) as n, arg_max(id, (score, -taken_at, -id)) as best from r group by source, run having count(*) >= 2""",
        "t07_alert_throttle": """
with recursive e as (select user_id % 40 as alert, event_id * 97 % 400000 as "at", event_id % 9 > 0 as active, row_number() over (partition by user_id % 40 order by event_id * 97 % 400000, event_id % 9 > 0) as i from events),
s as (select alert, i, "at", case when active then "at" end as last, active as shown from e where i = 1
  union all select e.alert, e.i, e."at", case when not e.active then null when s.last is null or e."at" - s.last >= 43200 then e."at" else s.last end, e.active and (s.last is null or e."at" - s.last >= 43200)
  from s join e on e.alert = s.alert and e.i = s.i + 1)
select alert, "at" from s where shown""",
        "t08_rate_limit": """
with recursive e as (select user_id % 40 as key, event_id * 97 % 400000 as "at", row_number() over (partition by user_id % 40 order by event_id * 97 % 400000) as i from events),
x as (select key, 0::bigint as i, 0::bigint as "at", []::bigint[] as taken, true as ok, 0::bigint as w from e group by 1
  union all select key, i, "at", case when w is null then list_append(day, "at") else day end, w is null, coalesce(w // 60 + 1, 0) from (
    select key, i, "at", day, list_max([case when len(hour) >= 10 then hour[-10] + 3600 - "at" end, case when len(day) >= 30 then day[-30] + 86400 - "at" end]) as w from (
      select e.key, e.i, e."at", list_filter(x.taken, lambda t: e."at" - t < 86400) as day, list_filter(x.taken, lambda t: e."at" - t < 3600) as hour from x join e on e.key = x.key and e.i = x.i + 1)))
select key, "at", ok as accepted, w as wait_min from x where i > 0""",
        "s16_exif_fields": "select id, id % 5 > 0 as read, case when id % 5 > 0 then camera_model end as model, case when id % 5 > 0 then lens end as lens, case when id % 5 > 0 then focal_length::int / 2 end as focal_length, case when id % 5 > 0 then (id % 1600)::int end as iso from photos",
        "s17_export_manifest": one_by_one(1, "lower"),
        "s17_export_archive": one_by_one(2, ""),
        "t04_scores": f"select id, {SCORE_SQL.format(w='width', h='height')}::int as score from (select id, width, height from photos) join photo_analysis on photo_id = id",
        "t05_expired": "select id from photos where trashed = 1 and taken_at + 500 < 1702000000 - 3650 * 86400",
        "t09_live_counts": "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, event_type as status, count(*) as n, sum(event_id)::bigint as bytes from events group by 1, 2",
        "t10_dedup": "select distinct sha256, false as none from photos",
    }.items()
}
