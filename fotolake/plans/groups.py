"""Registered queries of set operations, groups, vectors and mutations, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fotolake.catalog import Catalog, with_tables
from fotolake.functions.scalars import signed_round
from fotolake.operators import aggregates as ag
from fotolake.operators import graph as gr
from fotolake.operators import history as hi
from fotolake.operators import mutations as mu
from fotolake.operators import vectors as vc
from fotolake.operators import windows as wn
from fotolake.plans.reports import HASHED, MERIT, RUNS, SHOTS
from fotolake.plans.search import PEOPLE, WALL


def _of(f):
    return lambda spark, sf_dir: f(Catalog(spark, sf_dir))


def _query(t) -> list[float]:
    """The vector of row 17: one row."""
    return [float(x) for x in t.embeddings.where("vec_id = 17").first()["embedding"]]


def shifted(t, kind: str = "double"):
    """Faces: embeddings moved by 3 along the dimension of their label, so that labels are clusters; added as numbers of a kind."""
    return t.faces.withColumn("embedding", F.transform("embedding", lambda x, i: x + F.when(i == F.col("label"), 3.0).otherwise(0.0).cast(kind)))


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding")


def ai_bridge(t):
    """Keywords of which some were set by a model."""
    return t.photo_tags.withColumn("source", F.when(F.col("photo_id") % 2 == 0, "ai").otherwise(F.col("source")))


def undo_log(t):
    """Commands of seven sessions, one per event, and what their entries changed: two photos each."""
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("do", "undo", "do", "redo", "undo"))), F.pmod(i * 7 + F.floor(i / 11), F.lit(5)).cast("int") + 1)
    commands = t.events.select((F.col("user_id") % 7).alias("session"), i.alias("seq"), kind.alias("kind"))
    i = F.col("seq")
    entries = commands.where("kind = 'do'").select("session", "seq", F.explode(F.array(i * 31 % 97, i * 17 % 89 + 100)).alias("id"))
    return commands, entries.select("session", "seq", "id", F.when(i % 2 == 0, "rating").otherwise("label").alias("field"), F.when(i % 9 > 0, (i % 10).cast("string")).alias("before"), (i % 10 + 10).cast("string").alias("after"))


def lengths(contents):
    """A model for embed_batch: one number per picture; it fails on texts about errors."""
    import numpy as np

    if any(b"error" in c for c in contents):
        raise ValueError("no vector")
    return np.array([[float(len(c))] for c in contents])


QUERIES = {
    "x01_photo_people": _of(gr.photo_person_union),
    "x02_hits": _of(lambda t: gr.hits_intersect(t.photos.where("id % 3 = 0").select("id", (F.col("score") / 200.0).alias("score")), t.photos.where("id % 5 = 0").select("id"), t.photos.where("rating > 1"))),
    "x03_trash_candidates": _of(lambda t: gr.trash_candidates(wn.find_bursts(t.photos).select("id"), wn.find_bursts(t.photos).select(F.col("best").alias("id")), t.photos)),
    "x04_orphan_tags": _of(lambda t: gr.orphan_tags(t).select("id", "name")),
    "x05_distinct_ids": _of(lambda t: gr.distinct_ids(t.events.select((F.col("user_id") * 7 % 101).alias("id"), F.col("event_id").alias("at")), "at")),
    "g01_similar_groups": _of(lambda t: gr.similar_groups(t.photos)[0].select("grp", "n", "kind", "best", "why", "taken_at")),
    "g02_linked_tags": _of(lambda t: gr.linked_tags(t.tag_links)),
    "g03_apply_tag_links": _of(gr.apply_tag_links),
    "g04_cluster_faces": _of(lambda t: gr.cluster_faces(shifted(t))),
    "g05_suggest_names": _of(lambda t: gr.suggest_names(shifted(t).withColumn("person_id", F.when(F.col("id") % 6 == 0, F.col("label"))), t.faces.select("id", (F.col("label") * 2 + F.when(F.col("id") % 6 == 0, 0).otherwise(1)).alias("cluster")))),
    "a18_person_centroids": _of(lambda t: ag.person_centroids(shifted(t, "float"), "person_id").select("person_id", F.transform("centroid", lambda x: signed_round(x, 5)).alias("centroid"))),
    "v01_semantic_search": _of(lambda t: vc.semantic_search(vectors(t), _query(t))),
    "v01_many_queries": _of(lambda t: vc.search_many(vectors(t), t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 50)),
    "v02_prompt_ensemble": _of(lambda t: vc.prompt_ensemble(t.embeddings.select((F.col("vec_id") % 4).alias("name"), "embedding")).select("name", F.transform("vector", lambda x: signed_round(x, 5)).alias("vector"))),
    "v03_hybrid_search": _of(lambda t: vc.hybrid_search(t, vectors(t), _query(t), t.photos.where("trashed = 0 and is_video = 0"), ["note", "click"], 300)),
    "v04_l2_normalize": _of(lambda t: vectors(t).select("id", F.transform(vc.l2_normalize(F.col("embedding")), lambda x: signed_round(x, 6)).alias("unit"))),
    "u01_batch_patch": _of(lambda t: mu.batch_patch(t.photos.withColumn("trashed_at", F.lit(None).cast("long")), t.photos.where("id % 10 = 4"), {"rating": 5, "label": "", "trashed": 1}, 77).select("id", "rating", "label", "trashed", "trashed_at", "flag")),
    "u02_add_tags": _of(lambda t: mu.add_tags(t.photo_tags, t.photos.where("id % 20 = 3").select(F.col("id").alias("photo_id")), [0, 7], gr.linked_tags(t.tag_links))),
    "u02_remove_tags": _of(lambda t: mu.remove_tags(t.photo_tags, t.photos.where("id % 2 = 0").select(F.col("id").alias("photo_id")), [2, 4])),
    "u03_time_rules": _of(lambda t: mu.time_rules(t.photos, t.photo_tags, [(1, 7, 17), (9, 22, 5)], gr.linked_tags(t.tag_links))),
    "u04_ai_tags": _of(lambda t: mu.set_ai_tags(ai_bridge(t), t.tags, t.photos.where("id % 9 = 0").select(F.col("id").alias("photo_id"), F.array(F.lit("BEACH 0"), F.lit("new word"), F.lit("city 1"), F.lit("Beach 0")).alias("words")), gr.linked_tags(t.tag_links))[0]),
    "u05_upsert_album": _of(lambda t: mu.upsert_album(t.albums, t.albums.where("id % 2 = 0").select(F.when(F.col("id") % 4 == 0, F.col("name")).otherwise(F.concat(F.lit("New "), "name")).alias("name"), F.lit("trip").alias("kind")))),
    "u06_merge_fields": _of(lambda t: mu.merge_fields(t.photos.select("id", "sha256", "description", "rating"), t.photos.where("id % 3 = 0").select("sha256", F.lit("merged").alias("description"), F.lit(4).alias("rating")), ["description", "rating"])),
    "u07_merge_people": _of(lambda t: mu.merge_people(t.photo_people, t.faces, ("person", 1), ("person", 2))[0]),
    "u07_rename_person": _of(lambda t: mu.rename_person(t.people, t.photo_people, 3, "Ron Levi")[1]),
    "u07_name_cluster": _of(lambda t: mu.name_cluster(t.faces, t.people, 4, "new name", 99)[0].select("id", "cluster_id", "person_id")),
    "u08_dates_from_names": _of(lambda t: mu.dates_from_names(t.photos.select("id", F.concat(F.lit("IMG_20"), F.lpad((F.col("id") % 40).cast("string"), 2, "0"), F.lit("0315.jpg")).alias("filename"), F.when(F.col("id") % 3 == 0, F.col("taken_at")).otherwise(0).cast("long").alias("taken_at")), 2024).select("id", "taken_at")),
    "u09_apply_geotags": _of(lambda t: mu.apply_geotags(t.photos, t.photos.select("id", (F.col("id") % 100).cast("double").alias("lat"), (F.col("id") % 200).cast("double").alias("lng"))).select("id", "lat", "lng")),
    "u10_delete_forever": _of(lambda t: mu.delete_forever(t.photos, {"photo_tags": t.photo_tags}, t.photos.where("id % 2 = 0"))["photo_tags"]),
    "u11_album_add": _of(lambda t: mu.album_add(t.photo_albums, 3, t.photos.where("rating = 5"))),
    "u11_album_create": _of(lambda t: mu.album_rename(mu.album_create(t.albums, "Holiday"), 3, "Third")),
    "u11_album_delete": _of(lambda t: mu.album_delete(t.albums, t.photo_albums, 4)[1]),
    "u11_tag_links": _of(lambda t: mu.tag_link_remove(mu.tag_link_add(t.tag_links, t.tags, t.people.select(F.lower(F.element_at(F.split("name", " "), 1)).alias("x"), F.lit("BEACH 4").alias("y")))[0], t.tag_links.where("a = 5"))),
    "u11_saved_delete": _of(lambda t: mu.saved_search_delete(t.events.select(F.col("event_type").alias("name"), F.col("event_id").alias("made")), t.events.where("event_id % 1000 = 3").select(F.col("event_type").alias("name")))),
    "v05_embed_batch": _of(lambda t: vc.embed_batch(t.photos.where("id % 5 = 0").select("id", "sha256", F.col("description").cast("binary").alias("content")), lengths).select("id", "sha256", F.col("embedding")[0].cast("double").alias("length"))),
    "g01_exact_groups": _of(lambda t: gr.similar_groups(t.photos, exact=True)[0].select("grp", "n", "kind", "best", "why", "taken_at")),
    "g01_exact_members": _of(lambda t: gr.similar_groups(t.photos, exact=True)[1]),
    "g01_members": _of(lambda t: gr.similar_groups(t.photos)[1]),
    "u11_saved_search": _of(lambda t: mu.saved_search_upsert(t.events.select((F.col("user_id") % 30).cast("string").alias("name"), F.col("event_type").alias("criteria"), F.col("event_id").alias("made")), t.events.select((F.col("user_id") % 50).cast("string").alias("name"), F.lit("x").alias("criteria"), (F.col("event_id") - 3).alias("made")))),
    "u11_smart_people": _of(lambda t: mu.smart_from_people(t, t.people.where("id % 4 = 0"), 5)),
    "u12_undo_redo": _of(lambda t: hi.values_after(*undo_log(t))),
    "u12_undo_image": _of(lambda t: mu.before_image(t.photos, t.photos.where("id % 4 = 1"), {"rating": 5, "flag": 1})),
}

UNIT = "(select vec_id as id, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as u from embeddings)"
SEARCH = f"""
with s as (select a.id, list_dot_product(a.u, q.u) as s from {UNIT} a, (select u from {UNIT} where id = 17) q),
f as (select avg(s) as m, greatest(stddev_pop(s), 0.001) as d from s),
j as (select id, s, (s - m) / d >= 2 and s >= 0.2 as o, row_number() over (order by s desc, id) as place from s, f),
k as (select id, s from j where (o or ((select count(*) from j where o) < 12 and place <= 12 and s >= 0.21)) and place <= """
CENTROID = "list_transform({v}, lambda x: round(x / sqrt(list_dot_product({v}, {v})), 5))"

CLOSED = "with recursive e as (select a, b from tag_links union select b, a from tag_links), l as (select a as n, a as x from e union select l.n, e.b from l join e on e.a = l.x)"

#: Links by comparing all pairs of photos.
ALL_PAIRS = """
with recursive s as (select * from photos where trashed = 0 and is_video = 0 and phash is not null),
d as (select x.id as a, y.id as b, bit_count(xor(x.phash, y.phash)) as bits, coalesce(abs(x.taken_at - y.taken_at) <= 600, false) as t,
  coalesce(12742000 * asin(least(1, sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lng - x.lng) / 2), 2)))) <= 150, false) as p
  from s x join s y on x.id < y.id and bit_count(xor(x.phash, y.phash)) <= 12),
links as (select a, b, bits <= 4 as copy, t, p from d where bits <= 4 or t or p),
e as (select a, b from links union select b, a from links), r as (select a as n, a as x from e union select r.n, e.b from r join e on e.a = r.x),
root as (select n, min(x) as grp from r group by 1)"""

MEMBERS = ALL_PAIRS + " select grp, n as id from root"
GROUPS = (
    ALL_PAIRS
    + f""", g as (select grp, count(*) as n, arg_max(id, {MERIT}) as best, min(taken_at) as taken_at from root join s on s.id = root.n group by 1),
k as (select grp, bool_and(copy) as c, bool_or(t) as t, bool_or(p) as p from links join root on root.n = a group by 1)
select grp, n, case when c then 'copy' else 'similar' end as kind, best, list_filter([case when p then 'place' end, case when t then 'time' end], lambda x: x is not null) as why, taken_at from g join k using (grp)"""
)

SQL = {
    k: with_tables(v)
    for k, v in {
        "x01_photo_people": f"select photo_id, person_id from {PEOPLE}",
        "x02_hits": "select id, max(score) as score from (select id, score / 200.0::double as score from photos where id % 3 = 0 union all select id, 1.0 from photos where id % 5 = 0) where id in (select id from photos where rating > 1) group by 1",
        "x03_trash_candidates": RUNS.format(shots=HASHED, gap=2, bits=10) + f", g as (select run, arg_max(id, {MERIT}) as best from r group by 1 having count(*) >= 3) select id from r join g using (run) where id <> best",
        "x04_orphan_tags": "select id, name from tags where id not in (select tag_id from photo_tags) and id not in (select a from tag_links) and id not in (select b from tag_links)",
        "x05_distinct_ids": "select user_id * 7 % 101 as id, min(event_id) as at from events group by 1",
        "g02_linked_tags": "with recursive e as (select a, b from tag_links union select b, a from tag_links), r as (select a as n, a as x from e union select r.n, e.b from r join e on e.a = r.x) select n as tag_id, min(x) as root from r group by 1",
        "g03_apply_tag_links": "with recursive e as (select a, b from tag_links union select b, a from tag_links), r as (select a as n, a as x from e union select r.n, e.b from r join e on e.a = r.x) select distinct photo_id, x as tag_id, 'link' as source from photo_tags join r on n = tag_id where (photo_id, x) not in (select (photo_id, tag_id) from photo_tags)",
        "g01_exact_members": MEMBERS,
        "g01_exact_groups": GROUPS,
        "g01_members": MEMBERS,
        "g01_similar_groups": GROUPS,
        "g05_suggest_names": """
with f as (select label * 2 + case when id % 6 = 0 then 0 else 1 end as cluster, case when id % 6 = 0 then label end as person_id, label, embedding::double[] as v from faces),
x as (select cluster, person_id, unnest(v) + case when generate_subscripts(v, 1) = label + 1 then 3 else 0 end as x, generate_subscripts(v, 1) as i from f),
pm as (select person_id as k, i, avg(x) as x from x where person_id is not null group by 1, 2), cm as (select cluster as k, i, avg(x) as x from x group by 1, 2 having max(person_id) is null),
p as (select k, list(x order by i) as v from pm group by 1), c as (select k, list(x order by i) as v from cm group by 1),
d as (select c.k as cluster, p.k as person_id, 1 - list_dot_product(c.v, p.v) / sqrt(list_dot_product(c.v, c.v) * list_dot_product(p.v, p.v)) as d from c, p)
select cluster, arg_min(person_id, (d, person_id)) as person_id, round(min(d), 6) as distance from d where d <= 0.46 group by 1""",
        "g04_cluster_faces": "select id, min(id) over (partition by label) as cluster from faces",
        "v01_many_queries": f"""
with s as (select q.id as query_id, a.id, list_dot_product(a.u, q.u) as s from {UNIT} a, (select id, u from {UNIT} where id % 100 = 0) q),
f as (select query_id, avg(s) as m, greatest(stddev_pop(s), 0.001) as d from s group by 1),
j as (select s.query_id, id, s, (s - m) / d >= 2 and s >= 0.2 as o, row_number() over (partition by s.query_id order by s desc, id) as place from s join f on f.query_id = s.query_id),
n as (select query_id, count(*) filter (o) as n from j group by 1)
select j.query_id, id, round(s, 4) as score from j join n on n.query_id = j.query_id where place <= 50 and (o or (n < 12 and place <= 12 and s >= 0.21))""",
        "v01_semantic_search": SEARCH + "600) select id, round(s, 4) as score from k",
        "v02_prompt_ensemble": f"""
with u as (select id % 4 as name, unnest(u) as x, generate_subscripts(u, 1) as i from {UNIT}), m as (select name, i, avg(x) as x from u group by 1, 2), w as (select name, list(x order by i) as v from m group by 1)
select name, {CENTROID.format(v="v")} as vector from w""",
        "v03_hybrid_search": SEARCH
        + """2000), h as (select id, round(s, 4) as score from k union all
  select id, 1.0 from photos where description like '%note%' and id in (select id from photos where lower(filename) like '%click%' or description like '%click%'))
select id, max(score) as score from h where id in (select id from photos where trashed = 0 and is_video = 0) group by 1 order by 2 desc, 1 limit 300""",
        "v04_l2_normalize": f"select id, list_transform(u, lambda x: round(x, 6)) as unit from {UNIT}",
        "a18_person_centroids": f"""
with d as (select person_id, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i, label from faces where person_id is not null),
m as (select person_id, i, avg((x::float + case when i = label + 1 then 3.0 else 0 end)::double) as x from d group by 1, 2), w as (select person_id, list(x order by i) as v from m group by 1)
select person_id, {CENTROID.format(v="v")} as centroid from w""",
        "u01_batch_patch": "select id, case when id % 10 = 4 then 5 else rating end as rating, case when id % 10 <> 4 then label end as label, case when id % 10 = 4 then 1 else trashed end as trashed, case when id % 10 = 4 then 77 end as trashed_at, flag from photos",
        "u02_add_tags": "select photo_id, tag_id, source from photo_tags union all select id, t.tag_id, t.source from photos, (values (0, 'manual'), (7, 'manual'), (1, 'link'), (2, 'link')) as t(tag_id, source) where id % 20 = 3 and (id, t.tag_id) not in (select (photo_id, tag_id) from photo_tags)",
        "u02_remove_tags": "select photo_id, tag_id, source from photo_tags where not (photo_id % 2 = 0 and tag_id in (2, 4))",
        "u03_time_rules": f"""{CLOSED}, k as (select photo_id, tag_id, source from photo_tags where source <> 'rule'),
n as (select id, 1 as tag_id from photos where trashed = 0 and hour({WALL}) between 7 and 17 union all select id, 9 from photos where trashed = 0 and (hour({WALL}) >= 22 or hour({WALL}) <= 5)),
w as (select * from k union all select id, tag_id, 'rule' from n where (id, tag_id) not in (select (photo_id, tag_id) from k))
select * from w union all select distinct photo_id, x, 'link' from w join l on n = tag_id where (photo_id, x) not in (select (photo_id, tag_id) from w)""",
        "u04_ai_tags": f"""{CLOSED}, b as (select photo_id, tag_id, case when photo_id % 2 = 0 then 'ai' else source end as source from photo_tags),
o as (select * from b where not (source = 'ai' and photo_id % 9 = 0)),
i as (select w, coalesce((select min(id) from tags where lower(name) = w), (select max(id) + 1 from tags)) as tag_id from (select unnest(['beach 0', 'new word', 'city 1']) as w)),
a as (select photos.id as photo_id, i.tag_id, 'ai' as source from photos, i where photos.id % 9 = 0 and (photos.id, i.tag_id) not in (select (photo_id, tag_id) from o)),
w as (select * from o union all select * from a)
select * from w union all select distinct photo_id, x, 'link' from w join l on n = tag_id where photo_id % 9 = 0 and (photo_id, x) not in (select (photo_id, tag_id) from w)""",
        "u05_upsert_album": "with n as (select case when id % 4 = 0 then name else 'New ' || name end as name, 'trip' as kind from albums where id % 2 = 0) select name, o.id, coalesce(n.kind, o.kind) as kind from albums o full join n using (name)",
        "u06_merge_fields": "with i as (select distinct sha256 as s from photos where id % 3 = 0) select id, sha256, case when s is not null then 'merged' else description end as description, case when s is not null then 4 else rating end as rating from photos left join i on s = sha256",
        "u07_merge_people": "select photo_id, case when person_id = 1 then 2 else person_id end as person_id, arg_min(source, (case when person_id = 1 then 1 else 0 end, source)) as source from photo_people group by 1, 2",
        "u07_rename_person": "select photo_id, case when person_id = 3 then coalesce((select min(id) from people where lower(name) = 'ron levi' and id <> 3), 3) else person_id end as person_id, min(source) as source from photo_people group by 1, 2",
        "u07_name_cluster": "select id, cluster_id, case when cluster_id = 4 and person_id is null then 99 else person_id end as person_id from faces",
        "u08_dates_from_names": "select id, case when id % 3 = 0 then taken_at when id % 40 <= 25 then epoch(make_date((2000 + id % 40)::int, 3, 15))::bigint else 0 end as taken_at from photos",
        "u09_apply_geotags": "select id, case when lat is null and id % 100 <= 90 and id % 200 <= 180 then (id % 100)::double else lat end as lat, case when lat is null and id % 100 <= 90 and id % 200 <= 180 then (id % 200)::double else lng end as lng from photos",
        "u10_delete_forever": "select photo_id, tag_id, source from photo_tags where photo_id not in (select id from photos where trashed = 1 and id % 2 = 0)",
        "u11_album_add": "select photo_id, album_id from photo_albums union select id, 3 from photos where rating = 5",
        "u11_album_create": "select id, case when id = 3 then 'Third' else name end as name, kind from albums union all select max(id) + 1, 'Holiday', 'album' from albums",
        "u11_album_delete": "select photo_id, album_id from photo_albums where album_id <> 4",
        "u11_tag_links": """
with w as (select distinct lower(split_part(name, ' ', 1)) as x from people), i as (select x, (select max(id) from tags) + row_number() over (order by x) as id from w),
b as (select (select min(id) from tags where lower(name) = 'beach 4') as id)
select a, b from tag_links where a <> 5 union select least(i.id, b.id), greatest(i.id, b.id) from i, b""",
        "u11_saved_delete": "select event_type as name, event_id as made from events where event_type not in (select event_type from events where event_id % 1000 = 3)",
        "v05_embed_batch": "select id, sha256, case when description not like '%error%' then len(description)::double end as length from photos where id % 5 = 0",
        "u11_saved_search": "with b as (select (user_id % 30)::varchar as name, event_type as criteria, event_id as made from events union all select (user_id % 50)::varchar, 'x', event_id - 3 from events) select * from b qualify row_number() over (partition by name order by made desc, criteria desc) = 1",
        "u11_smart_people": "select name, '{\"people\":[' || id || ']}' as criteria from people where id % 4 <> 0 and name not in (select name from people where id % 4 = 0) and id in (select person_id from photo_people where source = 'takeout' group by 1 having count(distinct photo_id) >= 5)",
        "u12_undo_redo": """
with recursive c as (select user_id % 7 as session, event_id as seq, ['do', 'undo', 'do', 'redo', 'undo'][((event_id * 7 + event_id // 11) % 5 + 1)::int] as kind from events),
o as (select *, row_number() over (partition by session order by seq) as i from c),
s as (select session, 0::bigint as i, 0::bigint as seq, ''::varchar as kind, null::bigint as entry, []::bigint[] as undo, []::bigint[] as redo from o group by 1
  union all select o.session, o.i, o.seq, o.kind, case o.kind when 'do' then o.seq when 'undo' then undo[-1] else redo[-1] end,
    case o.kind when 'do' then list_append(undo, o.seq)[-100:] when 'undo' then undo[:-2] else case when len(redo) > 0 then list_append(undo, redo[-1]) else undo end end,
    case o.kind when 'do' then [] when 'undo' then case when len(undo) > 0 then list_append(redo, undo[-1]) else redo end else redo[:-2] end
  from s join o on o.session = s.session and o.i = s.i + 1),
e as (select seq, unnest([seq * 31 % 97, seq * 17 % 89 + 100]) as id, case when seq % 2 = 0 then 'rating' else 'label' end as field, case when seq % 9 > 0 then (seq % 10)::varchar end as before, (seq % 10 + 10)::varchar as after from c where kind = 'do'),
w as (select id, field, case when kind = 'undo' then before else after end as value, row_number() over (partition by id, field order by s.seq desc) as place from s join e on e.seq = s.entry)
select id, field, value from w where place = 1""",
        "u12_undo_image": "select id, rating, flag from photos where id % 4 = 1 and (rating <> 5 or flag <> 1)",
    }.items()
}
