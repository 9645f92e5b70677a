"""Registered queries of the rule engine and of the scalar functions, with their DuckDB twins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from fotolake.catalog import Catalog, with_tables
from fotolake.functions import scalars as fx
from fotolake.operators import rules
from fotolake.operators.rules import RuleSet

WALL = "make_timestamp(taken_at * 1000000)"
PEOPLE = "(select photo_id, person_id from photo_people union select photo_id, person_id from faces where person_id is not null)"
NAMED = "(select distinct photo_id, lower(name) as tag from photo_tags join tags on tags.id = tag_id)"

#: name: (criteria, the same as a DuckDB condition).
CRITERIA = {
    "flagship_night": ({"kind": "photo", "years": [2023, 2024], "hourFrom": 22, "hourTo": 5, "minRating": 3}, f"is_video = 0 and year({WALL}) in (2023, 2024) and (hour({WALL}) >= 22 or hour({WALL}) <= 5) and rating >= 3"),
    "f01_camera_lens": ({"cameras": ["CLICK", "purchase"], "lenses": ["lens 3", "LENS 5"]}, "lower(camera_model) in ('click', 'purchase') and lower(lens) in ('lens 3', 'lens 5')"),
    "f02_focal": ({"minFocal": 30, "maxFocal": 50.5}, "focal_length between 30 and 50.5"),
    "f03_days": ({"from": "2023-11-20", "to": "2023-12-24", "addedTo": "bad"}, "taken_at >= 1700438400 and taken_at < 1703376000 + 86400"),
    "f04_video": ({"kind": "video"}, "is_video = 1"),
    "f05_pano": ({"pano": True}, "is_video = 0 and (width >= 2 * height or height >= 2 * width)"),
    "f07_exts": ({"exts": ["jpg", ".PNG"]}, "upper(regexp_extract(filename, '\\.([^./]+)$', 1)) in ('JPG', 'PNG')"),
    "f08_size": ({"minMB": 0.5, "maxMB": 8}, "bytes >= 0.5 * 1048576 and bytes <= 8 * 1048576"),
    "f09_people_all": ({"people": [1, 3, 5], "peopleAll": True}, f"id in (select photo_id from {PEOPLE} where person_id in (1, 3, 5) group by 1 having count(distinct person_id) = 3)"),
    "f09_people_any": ({"people": [1, 3]}, f"id in (select photo_id from {PEOPLE} where person_id in (1, 3))"),
    "f10_tags": ({"tags": ["BEACH 0", "city 1"]}, f"id in (select photo_id from {NAMED} where tag in ('beach 0', 'city 1'))"),
    "f11_years_months": ({"years": [2024], "months": [1, 2]}, f"year({WALL}) = 2024 and month({WALL}) in (1, 2)"),
    "f13_favorite_flag": ({"favorite": True, "flag": "pick"}, "favorited = 1 and flag = 1"),
    "f15_labels": ({"labels": ["red", "blue"]}, "label in ('red', 'blue')"),
    "f16_score": ({"minScore": 70, "score": 60}, "id in (select photo_id from photo_analysis where score >= 70)"),
    "f06_dominant": ({"dominant": ["blue", "brown", "grey"]}, "id in (select photo_id from (DOMINANT) where colour in ('blue', 'brown'))"),
    "f00_unknown_values": ({"kind": "film", "kw": "some", "gps": "yes", "faces": "any", "flag": "x", "flags": ["y"], "rating": 4, "minRating": 2}, "rating >= 2"),
    "f17_place": ({"hasPlace": True, "gps": "has"}, "lat is not null and lng is not null"),
    "f18_text": ({"text": "About_a CL"}, "(lower(filename) like '%about_a cl%' or coalesce(lower(description) like '%about_a cl%', false))"),
    "f19_anywhere": ({"q": "levi"}, f"(lower(filename) like '%levi%' or coalesce(lower(description) like '%levi%', false) or id in (select photo_id from {PEOPLE} join people on people.id = person_id where lower(name) like '%levi%') or id in (select photo_id from {NAMED} where tag like '%levi%'))"),
    "f20_flags": ({"flags": ["none", "rej"]}, "coalesce(flag, 0) in (0, -1)"),
    "f21_rating": ({"rating": 2, "ratingOp": "<="}, "coalesce(rating, 0) <= 2"),
    "f22_colors": ({"colors": ["none", "yellow"]}, "(label = 'yellow' or coalesce(label, '') = '')"),
    "f23_edited": ({"edited": True}, "edited = 1"),
    "f25_orients": ({"orients": ["portrait", "square"]}, "width / height <= 1.05"),
    "f26_keywords_all": ({"keywords": "food 2, Food 2 ,beach 8", "keywordsAll": False}, f"id in (select photo_id from {NAMED} where tag in ('food 2', 'beach 8'))"),
    "f27_no_keywords": ({"kw": "none"}, "id not in (select photo_id from photo_tags)"),
    "f29_faces": ({"faces": "has"}, "id in (select photo_id from faces)"),
    "f30_persons": ({"persons": [0, 7]}, f"id in (select photo_id from {PEOPLE} where person_id in (0, 7))"),
    "f31_albums": ({"albumIds": [2, 4, 6]}, "id in (select photo_id from photo_albums where album_id in (2, 4, 6))"),
    "f32_weekdays": ({"weekdays": [0, 6]}, f"dayofweek({WALL}) in (0, 6)"),
    "f33_hours": ({"hourFrom": 0, "hourTo": None}, f"taken_at is not null and hour({WALL}) between 0 and 23"),
    "f34_megapixels": ({"minMP": 1.5, "maxMP": 6}, "width * height between 1500000 and 6000000"),
    "f35_added": ({"addedFrom": "2023-11-15", "addedTo": "2023-11-18"}, "imported_at >= 1700006400 and imported_at < 1700265600 + 86400"),
    "f36_circle": ({"place": {"lat": 10.0, "lng": 20.0, "km": 2500}}, "lat is not null and 12742 * asin(least(1, sqrt(pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lng - 20) / 2), 2)))) <= 2500"),
    "f36_box_over_180": ({"place": {"box": [-40, 40, 150, -150]}}, "lat between -40 and 40 and (lng >= 150 or lng <= -150)"),
}


def _search(criteria: dict):
    def query(spark, sf_dir):
        found = RuleSet(criteria).select(Catalog(spark, sf_dir))
        return found.select("id", "taken_at").orderBy(F.desc("taken_at"), F.desc("id"))

    return query


QUERIES = {name: _search(criteria) for name, (criteria, _) in CRITERIA.items()}



def f38_sources(spark, sf_dir):
    """How many photos each list source has."""
    t = Catalog(spark, sf_dir)
    kinds = [("album", 3), ("person", 4), ("cluster", 2), ("tag", "City 1"), ("favorite", 0), ("import", 1700050000), ("folder", "2020"), ("folder", ""), ("year", 2024), ("trashed", 0)]
    out = None
    for kind, value in kinds:
        one = rules.source_filter(t, kind, value).agg(F.count("*").alias("n")).select(F.lit(f"{kind}:{value}").alias("source"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def f39_smart_lists(spark, sf_dir):
    """Sizes of all ready-made lists; those of one table in one pass."""
    names = ["red", "five_stars", "picks", "last_month", "videos", "edited", "favourites"]
    t = Catalog(spark, sf_dir)
    counts = t.photos.where("trashed = 0").agg(*[F.count_if(rules.smart_list(n, 1701000000)).alias(n) for n in names])
    return counts.join(rules.no_keywords(t).agg(F.count("*").alias("no_keywords")))


def f40_bar(spark, sf_dir):
    bar = rules.attribute_bar(["pick", "none"], 3, ">=", ["none", "red"], ["photo"])
    return Catalog(spark, sf_dir).photos.where("trashed = 0").where(bar).select("id")


def f41_on_this_day(spark, sf_dir):
    return Catalog(spark, sf_dir).photos.where("trashed = 0").where(rules.on_this_day(date(2024, 11, 20))).select("id", "taken_at")


def f37_smart_searches(spark, sf_dir):
    """Which saved searches are smart, over one per document."""
    i = F.col("doc_id")
    made = F.element_at(F.array(*[F.lit(x) for x in ('{"smart": 1}', '{"years": [2020], "kind": "photo"}', '{"people": []}', '{"minRating": 0, "q": "x"}', "[3]", '{"text": "a"}')]), F.pmod(i, F.lit(6)).cast("int") + 1)
    return Catalog(spark, sf_dir).documents.select("doc_id", F.coalesce(rules.is_smart(made), F.lit(False)).alias("smart"))


def f42_stacked(spark, sf_dir):
    """The grid with every burst as one tile."""
    from fotolake.operators.windows import find_bursts, stacked

    photos = Catalog(spark, sf_dir).photos
    return stacked(photos.where("trashed = 0"), find_bursts(photos)).select("id")


def f43_untagged(spark, sf_dir):
    return rules.untagged(Catalog(spark, sf_dir)).select("id")


def f44_slideshow(spark, sf_dir):
    """The newest picture first; place is its number in the show of one album's favourites."""
    from pyspark.sql import Window

    show = rules.slideshow(Catalog(spark, sf_dir), True, 4).select("id", "taken_at")
    return show.select("id", F.row_number().over(Window.orderBy(F.desc("taken_at"), "id")).cast("long").alias("place"))


def f45_typed(spark, sf_dir):
    """Parses one query per document: two words of its text, a person and a year."""
    t = Catalog(spark, sf_dir)
    person = F.element_at(F.array(*[F.lit(x) for x in ("dana levi", "Ron", "maya", "Tal Cohen")]), F.pmod("doc_id", F.lit(4)).cast("int") + 1)
    said = F.slice(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[a-z]{12,}"), F.lit(0)), 1, 2)
    typed = t.documents.select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", person, (2000 + F.pmod("doc_id", F.lit(30))).cast("string"), F.array_join(said, " ")).alias("query"))
    return rules.typed_queries(typed, t.people)


def p_places(spark, sf_dir):
    p = Catalog(spark, sf_dir).photos
    km = fx.haversine_km(F.col("lat"), F.col("lng"), F.lit(32.08), F.lit(34.78))
    box = fx.in_box(F.col("lat"), F.col("lng"), -10, 170, 60, -100)
    kind = fx.place_kind(F.col("lat"), F.col("lng"), F.col("lat") + F.col("id") % 10 / 100.0, F.col("lng"))
    return p.select("id", F.round(km, 6).alias("km"), box.alias("inside"), F.when(F.col("lat").isNotNull(), kind).alias("kind"))


def p_coords(spark, sf_dir):
    p = Catalog(spark, sf_dir).photos
    text = F.format_string("%d.5°%s %d.25°%s", F.col("id") % 95, F.when(F.col("id") % 2 == 0, "N").otherwise("S"), F.col("id") % 190, F.when(F.col("id") % 3 == 0, "W").otherwise("E"))
    at = fx.parse_coords(text)
    return p.select("id", at["lat"].alias("lat"), at["lng"].alias("lng"))


#: Tails that turn IMG_n into the names of copies, edits and sidecars.
TAILS = [".jpg", "-edited (1).JPG", "edited.jpg", " (2).jpg", "_collage(3).png", " - Motion.mp4", ".effects", "", ".jpg.supplemental-meta.json", ".JPG.json", "(1).jpg.supplemental-metadata.json", "20240101123456790.jpg", " 0007 (04).png"]


def p_names(spark, sf_dir):
    path = F.col("rel_path")
    tail = F.element_at(F.array(*map(F.lit, TAILS)), F.pmod(F.col("id"), F.lit(len(TAILS))).cast("int") + 1)
    name = F.concat(F.lit("IMG_"), F.col("id").cast("string"), tail)
    return Catalog(spark, sf_dir).photos.select(
        "id", fx.folder_of(path).alias("folder"), fx.ext_of(path).alias("ext"), fx.media_stem(name).alias("stem"), fx.norm_counter(name).alias("counted"),
        fx.sidecar_target(name).alias("target"), fx.safe_component(F.concat_ws("|", "camera_model", "lens")).alias("safe"), fx.natural_key(name).alias("natural"),
    )


def f18_text_index(spark, sf_dir):
    """Eight signs out of every hundredth document, and three shorter pieces, looked up in all documents."""
    from fotolake.operators import textindex

    texts = Catalog(spark, sf_dir).documents.select(F.col("doc_id").alias("id"), "text")
    some = texts.where("id % 100 = 0")
    length = F.when(F.col("id") % 300 == 100, 2).otherwise(8)
    needles = some.select(F.col("id").alias("needle_id"), F.upper(F.substr(F.regexp_replace("text", "[^a-z ]", "_"), F.lit(3), length)).alias("needle"))
    return textindex.search(texts, needles)


def p_shapes(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    return Catalog(spark, sf_dir).photos.select(
        "id", fx.orientation(w, h).alias("orientation"), fx.megapixels(w, h).alias("mp"), fx.is_panorama(w, h, F.col("is_video")).alias("pano"),
        fx.hamming64(F.col("phash"), F.shiftleft(F.col("phash"), 1)).cast("long").alias("bits"), *[fx.hash_band(F.col("phash"), b).alias(f"band{b}") for b in range(7)],
    )


def p_albums(spark, sf_dir):
    """Album names as they are and with a tail, in front of a comma, cut short, and by year."""
    name = F.element_at(F.array(F.col("name"), F.concat("name", F.lit(" (2)")), F.concat("name", F.lit(", Maya")), F.substring("name", 1, 8), (F.col("id") + 2000).cast("string")), F.pmod(F.col("id"), F.lit(5)).cast("int") + 1)
    return Catalog(spark, sf_dir).albums.select("id", fx.album_kind(name).alias("found"), fx.album_kind(F.col("name")).alias("kind"))


def p_scores(spark, sf_dir):
    a = Catalog(spark, sf_dir).photo_analysis
    side = (F.col("photo_id") % 10 * 200).cast("int")
    score = fx.quality_score(*map(F.col, ("sharp", "luma", "p5", "p95", "clip_dark", "clip_white", "eyes_closed")), side, F.lit(500))
    category = fx.cleanup_category(F.col("screenshot"), F.col("receipt"), F.col("luma"), F.col("p95"), F.col("sharp"), F.when(F.col("photo_id") % 5 > 0, F.col("photo_id")))
    return a.select("photo_id", score.cast("long").alias("score"), category.alias("category"))


def p_colours(spark, sf_dir):
    c = Catalog(spark, sf_dir).photo_color
    return c.select("photo_id", fx.colour_bucket(F.col("r"), F.col("g"), F.col("b")).alias("colour"))


def p_texts(spark, sf_dir):
    d = Catalog(spark, sf_dir).documents
    redacted = fx.redact_text(F.coalesce("text", F.lit("")), ["example/data"], "example")
    mangled = F.decode(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), "ISO-8859-1")
    return d.select("doc_id", F.md5(redacted).alias("redacted"), fx.is_english(F.coalesce("text", F.lit(""))).alias("english"), F.md5(fx.fix_mojibake(mangled)).alias("mended"))


def p_dates(spark, sf_dir):
    """File names with a date and a time, with other signs between them, and with a date that is part of a longer number."""
    p = Catalog(spark, sf_dir).photos
    i = F.col("id")
    y, m, d, h, s = 1985 + i % 45, 1 + i % 13, 1 + i % 31, i % 24, i % 60
    name = (
        F.when(i % 5 == 0, F.format_string("Screenshot %04d-%02d-%02d-%02d.%02d.%02d.png", y, m, d, h, s, s))
        .when(i % 5 == 1, F.format_string("IMG_%04d%02d%02d123.jpg", y, m, d))
        .when(i % 5 == 2, F.format_string("7%04d%02d%02d.jpg", y, m, d))
        .otherwise(F.format_string("IMG_%04d%02d%02d_%02d%02d%02d.20210101", y, m, d, h, s, s))
    )
    return p.select("id", fx.date_from_filename(name, 2024).alias("taken"))


def p_lr_times(spark, sf_dir):
    i = F.col("id")
    text = F.format_string("%04d-%02d-%02d", 1990 + i % 40, 1 + i % 13, 1 + i % 31)
    text = F.when(i % 3 == 0, text).when(i % 3 == 1, F.concat(text, F.format_string("T%02d:%02d", i % 24, i % 60))).otherwise(F.concat(text, F.format_string("T%02d:%02d:%02d.5+02:00", i % 24, i % 60, i % 60)))
    return Catalog(spark, sf_dir).photos.select("id", fx.lr_time(text).alias("at"))


def p_answers(spark, sf_dir):
    p = Catalog(spark, sf_dir).photos
    i = F.col("id")
    answer = (
        F.when(i % 4 == 0, F.concat(F.lit('Sure: ["Beach", " SEA  side", "beach", "x", "'), "camera_model", F.lit('"]')))
        .when(i % 4 == 1, F.concat(F.lit("- Beach\n- "), "lens", F.lit("\n- beach, sun; #sea.")))
        .when(i % 4 == 2, F.concat(F.lit('```json\n{"keywords": ["City", "'), "lens", F.lit('", "city "]}\n```')))
        .otherwise(F.concat(F.lit('{"keywords": broken, "'), "camera_model", F.lit('"}')))
    )
    rating = F.when(i % 2 == 0, F.concat(F.lit("photo 2 score: "), (i % 130).cast("string"))).otherwise(F.concat(F.lit("I give it "), (i % 130).cast("string"), F.lit(" of 100")))
    label = F.element_at(F.array(F.lit("Red "), F.lit("כחול"), F.lit("rot")), (i % 3 + 1).cast("int"))
    return p.select("id", fx.parse_keywords(answer).alias("words"), fx.parse_score(rating).cast("long").alias("score"), fx.label_map(label).alias("label"))


QUERIES |= {
    f.__name__: f
    for f in (f38_sources, f39_smart_lists, f40_bar, f41_on_this_day, f37_smart_searches, f42_stacked, f43_untagged, f44_slideshow, f45_typed, f18_text_index, p_places, p_coords, p_names, p_shapes, p_albums, p_scores, p_colours, p_texts, p_dates, p_lr_times, p_answers)
}
COLOUR_SQL = """
select photo_id, case when v < 0.18::double then 'black' when s < 0.14::double then case when v > 0.85::double then 'white' else 'gray' end
  when h < 15 or h >= 345 then case when v > 0.45::double then 'red' else 'brown' end when h < 40 then case when v > 0.6::double then 'orange' else 'brown' end
  when h < 70 then case when v > 0.55::double then 'yellow' else 'brown' end
  when h < 165 then 'green' when h < 200 then 'cyan' when h < 255 then 'blue' when h < 300 then 'purple' else 'pink' end as colour
from (select photo_id, t as v, case when t = 0 then 0 else (t - l) / t end as s,
    case when t = l then 0 when t = r then 60 * (((g - b) / (t - l) + 6) % 6) when t = g then 60 * ((b - r) / (t - l) + 2) else 60 * ((r - g) / (t - l) + 4) end as h
  from (select *, greatest(r, g, b) as t, least(r, g, b) as l from (select photo_id, r / 255.0::double as r, g / 255.0::double as g, b / 255.0::double as b from photo_color)))"""
#: The score of a photo by its measures and by its sides w and h.
SCORE_SQL = """least(100, greatest(1, round_even((
    0.6::double * 100 * least(1, ln(1 + sharp) / ln(401::double))
    + 0.25::double * least(100, greatest(0, 100 - case when luma < 70 then (70 - luma) * 1.6::double when luma > 190 then (luma - 190) * 1.6::double else 0 end
        - 120 * greatest(0, clip_dark - 0.15::double) - 120 * greatest(0, clip_white - 0.15::double)))
    + 0.15::double * 100 * least(1, greatest(0, (p95 - p5) / 150)))
  * case when {w} > 0 and {h} > 0 and {w}::bigint * {h} < 400000 then 0.9::double else 1 end * case when eyes_closed = 1 then 0.6::double else 1 end, 0)))"""
SQL = {name: with_tables(f"select id, taken_at from photos where trashed = 0 and {where.replace('DOMINANT', COLOUR_SQL)}") for name, (_, where) in CRITERIA.items()}
SQL |= {
    k: with_tables(v)
    for k, v in {
        "f38_sources": f"""
select 'album:3' as source, count(*) filter (id in (select photo_id from photo_albums where album_id = 3)) as n from photos where trashed = 0
union all select 'person:4', count(*) filter (id in (select photo_id from {PEOPLE} where person_id = 4)) from photos where trashed = 0
union all select 'cluster:2', count(*) filter (id in (select photo_id from faces where cluster_id = 2)) from photos where trashed = 0
union all select 'tag:City 1', count(*) filter (id in (select photo_id from {NAMED} where tag = 'city 1')) from photos where trashed = 0
union all select 'favorite:0', count(*) filter (favorited = 1) from photos where trashed = 0
union all select 'import:1700050000', count(*) filter (imported_at >= 1700050000) from photos where trashed = 0
union all select 'folder:2020', count(*) filter (rel_path like '2020/%') from photos where trashed = 0
union all select 'folder:', count(*) filter (rel_path not like '%/%') from photos where trashed = 0
union all select 'year:2024', count(*) filter (year({WALL}) = 2024) from photos where trashed = 0
union all select 'trashed:0', count(*) filter (trashed = 1) from photos""",
        "f39_smart_lists": "select count(*) filter (label = 'red') as red, count(*) filter (rating = 5) as five_stars, count(*) filter (flag = 1) as picks, count(*) filter (coalesce(taken_at, 0) > 1701000000 - 2592000) as last_month, count(*) filter (is_video = 1) as videos, count(*) filter (edited = 1) as edited, count(*) filter (favorited = 1) as favourites, count(*) filter (id not in (select photo_id from photo_tags)) as no_keywords from photos where trashed = 0",
        "f40_bar": "select id from photos where trashed = 0 and coalesce(flag, 0) in (0, 1) and coalesce(rating, 0) >= 3 and (label = 'red' or coalesce(label, '') = '') and is_video = 0",
        "f41_on_this_day": f"select id, taken_at from photos where trashed = 0 and month({WALL}) = 11 and day({WALL}) = 20 and year({WALL}) <> 2024",
        "f44_slideshow": "select id, row_number() over (order by taken_at desc, id) as place from photos where trashed = 0 and is_video = 0 and coalesce(flag, 0) >= 0 and favorited = 1 and id in (select photo_id from photo_albums where album_id = 4)",
        "f45_typed": """
select doc_id as query_id, case doc_id % 4 when 0 then [0] when 1 then [] when 2 then [] else [9] end::bigint[] as person_ids,
  [2000 + doc_id % 30]::int[] as years,
  list_concat(case doc_id % 4 when 1 then ['ron'] when 2 then ['maya'] else [] end::varchar[], regexp_extract_all(lower(coalesce(text, '')), '[a-z]{12,}')[1:2]) as words from documents""",
        "f37_smart_searches": "select doc_id, doc_id % 6 in (0, 1, 5) as smart from documents",
        "f18_text_index": """
with n as (select doc_id as needle_id, upper(substr(regexp_replace(text, '[^a-z ]', '_', 'g'), 3, case when doc_id % 300 = 100 then 2 else 8 end)) as needle from documents where doc_id % 100 = 0),
f as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select needle_id, doc_id as id from n join f on t like '%' || translate(needle, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '%'""",
        "f43_untagged": "select id from photos where trashed = 0 and is_video = 0 and id not in (select photo_id from photo_tags)",
        "p_places": """
select id, round(12742 * asin(least(1, sqrt(pow(sin(radians(32.08 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(32.08)) * pow(sin(radians(34.78 - lng) / 2), 2)))), 6) as km,
  lat between -10 and 60 and (lng >= 170 or lng <= -100) as inside,
  case when lat is not null then case when 12742 * asin(least(1, sqrt(pow(sin(radians((id % 10) / 100.0::double) / 2), 2)))) > 4 then 'box' else 'circle' end end as kind from photos""",
        "p_coords": """
select id, case when ok then lat end as lat, case when ok then lng end as lng from (
  select id, lat, lng, abs(lat) <= 90 and abs(lng) <= 180 as ok from (
    select id, (id % 95 + 0.5::double) * case when id % 2 = 0 then 1 else -1 end as lat, (id % 190 + 0.25::double) * case when id % 3 = 0 then -1 else 1 end as lng from photos))""",
        "p_names": f"""
with n as (select *, 'IMG_' || id || {TAILS}[(id % {len(TAILS)} + 1)::int] as name from photos),
b as (select *, case when regexp_matches(name, '.[.][^.]+$') then left(name, length(name) - length(regexp_extract(name, '[^.]*$')) - 1) else name end as bare from n),
c as (select *, regexp_replace(regexp_replace(trim(lower(bare)), '\\s*\\([0-9]+\\)$', ''), '[\\s_-]*(edited|effects|collage|animation|mix|motion)$', '') as cut from b)
select id, regexp_replace(rel_path, '/[^/]*$', '') as folder, upper(regexp_extract(rel_path, '\\.([^./]+)$', 1)) as ext, trim(regexp_replace(cut, '\\s*\\([0-9]+\\)$', '')) as stem,
  lower(regexp_replace(name, '\\([0-9]+\\)|\\s+', '', 'g')) as counted,
  case when regexp_matches(name, '(?i)[.]supplemental[a-z0-9_-]*[.]json$') then regexp_replace(name, '(?i)[.]supplemental[a-z0-9_-]*[.]json$', '') when lower(name) like '%.json' then left(name, length(name) - 5) else name end as target,
  camera_model || '_' || lens as safe,
  array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda x: case when regexp_matches(x, '^[0-9]') then chr(1) || printf('%05d', length(x::hugeint::varchar)) || ':' || x::hugeint::varchar else x end), '') as natural from c""",
        "p_shapes": """
select id, case when width / height > 1.05 then 'landscape' when width / height < 0.95 then 'portrait' else 'square' end as orientation, width * height / 1000000 as mp,
  is_video = 0 and (width >= 2 * height or height >= 2 * width) as pano, bit_count(xor(phash, phash << 1))::bigint as bits,
  phash & 511 as band0, (phash >> 9) & 511 as band1, (phash >> 18) & 511 as band2, (phash >> 27) & 511 as band3, (phash >> 36) & 511 as band4, (phash >> 45) & 511 as band5, (phash >> 54) & 1023 as band6
from photos""",
        "p_albums": """
with n as (select id, name, [name, name || ' (2)', name || ', Maya', substr(name, 1, 8), (id + 2000)::varchar][id % 5 + 1] as other from albums)
select id, case when regexp_matches(other, '(תמונות משנת|Photos from)\\s*[0-9]{4}') then 'year' when regexp_matches(other, '^[A-Za-z].*,') then 'people-share' else 'album' end as found,
  case id % 3 when 0 then 'year' when 1 then 'album' else 'people-share' end as kind from n""",
        "p_scores": f"""
select photo_id, {SCORE_SQL.format(w="(photo_id % 10 * 200)", h=500)}::bigint as score,
  case when screenshot = 1 then 'screenshot' when receipt = 1 then 'receipt' when luma < 38 and p95 < 85 then 'dark' when sharp < 12 and photo_id % 5 > 0 then 'blurry' end as category
from photo_analysis""",
        "p_texts": """
with a as (select doc_id, coalesce(text, '') as text from documents),
b as (select *, regexp_replace(replace(text, 'example/data', '<folder>'), '(?i)(^|[^A-Za-z0-9])example($|[^A-Za-z0-9])', '\\1<user>\\2', 'g') as t from a),
c as (select *, regexp_replace(t, '[\\w\\pL\\pN.+-]+@[\\w\\pL\\pN-]+(\\.[\\w\\pL\\pN-]+)+', '<email>', 'g') as e from b),
d as (select *, regexp_replace(regexp_replace(e, '\\b(127([.][0-9]{1,3}){3}|0[.]0[.]0[.][0-9]{1,3})\\b', chr(1) || '\\1' || chr(1), 'g'), '(^|[^' || chr(1) || '0-9A-Za-z_])[0-9]{1,3}([.][0-9]{1,3}){3}\\b', '\\1<ip>', 'g') as i from c)
select doc_id, md5(replace(i, chr(1), '')) as redacted, not regexp_matches(regexp_replace(text, '[\\x{0}-\\x{24F}]', '', 'g'), '\\pL') as english, md5(text) as mended from d""",
        "p_colours": COLOUR_SQL,
        "p_dates": """
select id, case when id % 5 not in (1, 2) and y between 1990 and 2025 and m <= 12 then epoch(try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y, m, d, h, mi, mi) as timestamp))::bigint end as taken
from (select id, 1985 + id % 45 as y, 1 + id % 13 as m, 1 + id % 31 as d, id % 24 as h, id % 60 as mi from photos)""",
        "p_lr_times": """
select id, epoch(try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', 1990 + id % 40, 1 + id % 13, 1 + id % 31, case when id % 3 > 0 then id % 24 else 0 end, case when id % 3 > 0 then id % 60 else 0 end, case when id % 3 = 2 then id % 60 else 0 end) as timestamp))::bigint as at from photos""",
        "p_answers": """
select id, case id % 4 when 0 then ['beach', 'sea side', camera_model] when 1 then ['beach', lower(lens), 'sun', 'sea'] when 2 then ['city', lower(lens)] else ['keywords : broken', camera_model] end as words,
  case when id % 130 between 1 and 100 then id % 130 end::bigint as score, case id % 3 when 0 then 'red' when 1 then 'blue' end as label from photos""",
    }.items()
}
