"""A media catalog derived from the star-schema tables, once for Spark and once as common table expressions for DuckDB.

Both spellings come from one template; only integer division, exclusive or and hex reading differ.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TEMPLATES = {
    "photos": """
select event_id as id, 1700000000 + DIV(event_id, 5) * 1800 + (event_id % 5) * 2 as taken_at,
  case when event_id % 10 = 9 then 1 else 0 end as is_video, case when event_id % 17 = 0 then 1 else 0 end as trashed,
  case when event_id % 4 <> 0 then ((user_id * 37) % 170) - cast(85.0 as double) end as lat,
  case when event_id % 4 <> 0 then ((user_id * 53) % 360) - cast(180.0 as double) end as lng,
  cast(event_id % 6 as int) as rating, cast(event_id % 3 as int) - 1 as flag,
  case event_id % 7 when 1 then 'red' when 2 then 'yellow' when 3 then '' when 4 then 'blue' end as label,
  case when event_id % 8 = 0 then 1 else 0 end as favorited, case when event_id % 9 = 0 then 1 else 0 end as edited,
  cast(round(value * 100000) as bigint) as bytes, 600 + (event_id % 7) * 700 as width, 600 + (event_id % 5) * 500 as height,
  event_type as camera_model, concat('Lens ', cast(user_id % 7 as STR)) as lens, cast(18 + user_id % 60 as double) as focal_length,
  case when event_id % 23 <> 0 then XOR(HEX15(md5(cast(DIV(event_id, 5) as STR))), SHL(cast(1 as bigint), cast(event_id % 5 as int))) end as phash,
  case when event_id % 6 = 5 then 1 when event_id % 6 = 4 then 0 end as eyes_closed,
  cast(40 + (event_id * 7) % 60 as int) as score,
  md5(cast(case when event_id % 13 = 12 then event_id - 1 else event_id end as STR)) as sha256,
  concat('IMG_', cast(event_id as STR), case event_id % 3 when 0 then '.jpg' when 1 then '.png' else '.mp4' end) as filename,
  concat(cast(2019 + event_id % 5 as STR), case when event_id % 4 = 1 then '/trip/' else '/' end, 'IMG_', cast(event_id as STR),
    case event_id % 3 when 0 then '.jpg' when 1 then '.png' else '.mp4' end) as rel_path,
  case when event_id % 5 = 0 then concat('note about a ', event_type) end as description,
  1700000000 + event_id * 60 as imported_at, user_id,
  case when event_id % 5 > 0 then concat(chr(123), '"Exif":', chr(123), '"ExposureTime":"1/', cast(30 + event_id % 100 as STR), '","ISOSpeedRatings":', cast(100 + event_id % 1600 as STR), chr(125), chr(125)) end as exif_json
from events""",
    "faces": """
select vec_id as id, vec_id as photo_id, cast(label as bigint) as label, cast(0.5 as double) + (vec_id % 50) / cast(100.0 as double) as det_score,
  cast(label as bigint) as cluster_id, case when vec_id % 3 = 0 then cast(label as bigint) end as person_id, embedding
from embeddings""",
    "photo_people": """
select event_id as photo_id, user_id % 10 as person_id, case when event_id % 4 = 0 then 'takeout' else 'manual' end as source
from events where event_id % 2 = 0""",
    "people": """
select id, concat(case id % 5 when 0 then 'Dana' when 1 then 'Ron' when 2 then 'Maya' when 3 then 'Noa' else 'Tal' end, ' ',
  case when id < 5 then 'Levi' else 'Cohen' end) as name from (select distinct user_id % 10 as id from events)""",
    "photo_tags": """
select event_id as photo_id, event_id % 12 as tag_id, case when event_id % 24 < 12 then 'manual' else 'rule' end as source
from events where event_type in ('click', 'purchase')""",
    "tags": """
select id, concat(case id % 4 when 0 then 'Beach' when 1 then 'city' when 2 then 'Food' else 'night' end, ' ', cast(id as STR)) as name
from (select distinct event_id % 14 as id from events)""",
    "tag_links": "select distinct least(user_id % 7, event_id % 12) as a, greatest(user_id % 7, event_id % 12) as b from events where event_id % 12 - user_id % 7 = 1 and event_id % 12 in (1, 2, 6)",
    "photo_albums": "select event_id as photo_id, user_id % 20 as album_id from events where event_id % 3 <> 1",
    "albums": """
select id, case id % 3 when 0 then concat('Photos from ', cast(2000 + id as STR)) when 1 then concat('Album ', cast(id as STR))
  else concat('Dana, Ron ', cast(id as STR)) end as name,
  case id % 3 when 0 then 'year' when 1 then 'album' else 'people-share' end as kind
from (select distinct user_id % 22 as id from events)""",
    "photo_analysis": """
select event_id as photo_id, 1 + event_id % 2 as version,
  md5(cast(case when event_id % 19 = 0 then event_id + 1 when event_id % 13 = 12 then event_id - 1 else event_id end as STR)) as sha,
  cast((event_id * 7) % 509 as double) as sharp, cast(event_id % 256 as double) as luma, (event_id % 29) / cast(100.0 as double) as clip_dark,
  (event_id % 31) / cast(100.0 as double) as clip_white, cast(event_id % 90 as double) as p5, cast(event_id % 90 + event_id % 163 as double) as p95,
  cast(40 + (event_id * 7) % 60 as int) as score,
  case when event_id % 41 = 0 then 1 else 0 end as screenshot, case when event_id % 43 = 0 then 1 else 0 end as receipt,
  case when event_id % 6 = 5 then 1 when event_id % 6 = 4 then 0 end as eyes_closed
from events where event_id % 23 <> 0""",
    "photo_color": """
select event_id as photo_id, cast((event_id * 37) % 256 as int) as r, cast((event_id * 91) % 256 as int) as g, cast((event_id * 151) % 256 as int) as b
from events where event_id % 3 = 0""",
    "track": """
select user_id, 1700000000 + DIV(event_id, 5) * 1800 + (event_id % 5) * 2 + 300 as ts,
  (event_id % 160) - cast(80.0 as double) as lat, (event_id % 340) - cast(170.0 as double) as lng
from events where event_id % 3 = 0""",
    "listing_old": """
select concat(cast(event_id % 9 as STR), '/f', cast(event_id as STR)) as path, event_id * 10 as size, 1000000 + event_id as mtime,
  md5(cast(event_id as STR)) as sha, event_id as photo_id
from events where event_id % 7 <> 3""",
    "listing_new": """
select concat(cast((event_id + case when event_id % 31 = 0 then 1 else 0 end) % 9 as STR), '/f', cast(event_id as STR)) as path,
  event_id * 10 + case when event_id % 29 = 0 then 1 else 0 end as size, 1000000 + event_id as mtime,
  case when event_id % 203 = 0 then md5(cast(event_id + 203 as STR)) when event_id % 203 = 29 then md5('same') when event_id % 406 = 58 then md5(cast(event_id - 29 as STR))
    else md5(concat(cast(event_id as STR), case when event_id % 29 = 0 then 'x' else '' end)) end as sha
from events where event_id % 7 <> 5""",
}

_SPARK = {"DIV": "({0} div {1})", "XOR": "({0} ^ {1})", "SHL": "shiftleft({0}, {1})", "HEX15": "cast(conv(substr({0}, 1, 15), 16, 10) as bigint)"}
_DUCK = {"DIV": "({0} // {1})", "XOR": "xor({0}, {1})", "SHL": "({0} << {1})", "HEX15": "cast('0x' || substr({0}, 1, 15) as bigint)"}


def _spell(template: str, words: dict[str, str], text: str) -> str:
    """Writes the calls of a dialect's words out, innermost first."""
    call = re.compile(r"\b(" + "|".join(words) + r")\(")
    while found := list(call.finditer(template)):
        m, depth, args, start = found[-1], 0, [], found[-1].end()
        for i in range(m.end(), len(template)):
            c = template[i]
            if c in "([":
                depth += 1
            elif c in ")]" and depth:
                depth -= 1
            elif c == "," and not depth or c == ")":
                args.append(template[start:i].strip())
                start = i + 1
                if c == ")":
                    template = template[: m.start()] + words[m[1]].format(*args) + template[i + 1 :]
                    break
    return template.replace(" as STR)", f" as {text})")


class Catalog:
    """The derived tables as DataFrames; each is a projection of one base table, so filters and columns reach its scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/events.parquet")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/embeddings.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/documents.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TEMPLATES:
            raise AttributeError(name)
        sql = _spell(TEMPLATES[name], _SPARK, "string").replace("from events", "from {events}").replace("from embeddings", "from {embeddings}")
        used = {k: getattr(self, k) for k in ("events", "embeddings") if "{" + k + "}" in sql}
        return self.spark.sql(sql, **used)


def with_tables(query: str) -> str:
    """A DuckDB query with the derived tables that it names in front."""
    ctes, seen = [], set()
    for name in TEMPLATES:
        if re.search(rf"\b{name}\b", query) and name not in seen:
            seen.add(name)
            ctes.append(f"{name} as ({_spell(TEMPLATES[name], _DUCK, 'varchar')})")
    body = query.strip()
    recursive = body.lower().startswith("with recursive ")
    if body.lower().startswith("with "):
        body = body[len("with recursive ") if recursive else 5 :]
        return f"with {'recursive ' if recursive else ''}{', '.join(ctes)}{', ' if ctes else ''}{body}"
    return (f"with {', '.join(ctes)} " if ctes else "") + body
