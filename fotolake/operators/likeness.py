"""All pairs of pictures that look alike and lie near each other in time or place, without caps.

Photos meet in cells: spans of time, or squares of the map. All hashes of a cell are compared, in the task that its rows are
dealt to (hashes.py), which takes a billionth of a second or two for a pair; fuller cells are dealt to several tasks. Equal hashes of
one cell are one row, with the first and the last photo in time; that is enough to tell whether any two photos of two such
rows are near.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.functions.scalars import haversine_km
from fotolake.operators.hashes import CROWD, alike_in_cells
from fotolake.operators.joins import copy_pairs
from fotolake.storage import settled

#: The diameter that distances are taken on, in km.
DIAMETER_KM = 12742


def alike_in_time(shots: DataFrame, window_s: int, bits: int, crowd: int = CROWD) -> DataFrame:
    """(a, b): links of all hashes that any two photos (id, phash, taken_at) at most window_s seconds apart have within bits.

    A span of window_s seconds is a cell, and photos ask their own and the next one. Hashes of one span are near in any
    case; of two spans the last photo of the earlier and the first of the later decide.
    """
    dated = shots.where("coalesce(taken_at, 0) <> 0")
    when = F.struct("taken_at", "id")
    spans = dated.groupBy("phash", F.floor(F.col("taken_at") / max(window_s, 1)).alias("cell")).agg(F.min(when).alias("first"), F.max(when).alias("last"))
    p = F.struct(*[F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("first", "last") for c in ("taken_at", "id")])
    spans = settled(spans.select("cell", "phash", F.col("first.id").alias("id"), p.alias("p")))
    met = alike_in_cells(spans, spans.withColumn("cell", F.col("cell") + 1), bits, crowd)
    met = met.where(F.col("same") | (F.col("q.first_taken_at") - F.col("p.last_taken_at") <= window_s))
    links = met.select(F.when(F.col("same"), F.col("p.first_id")).otherwise(F.col("p.last_id")).alias("a"), F.col("q.first_id").alias("b"))
    own = spans.where("p.first_id <> p.last_id").select(F.col("p.first_id").alias("a"), F.col("p.last_id").alias("b"))
    return links.unionByName(own)


def _row(lat: Column, height: float) -> Column:
    return F.floor((lat + 90) / height)


def _columns(row: Column, height: float, metres: float) -> Column:
    """How many cells a row of the map has: none is narrower than the reach of any point in it or in a neighbouring row."""
    lat = F.greatest(F.abs((row - 1) * height - 90), F.abs((row + 2) * height - 90))
    ratio = math.sin(metres / 1000 / DIAMETER_KM) / F.greatest(F.cos(F.radians(F.least(lat, F.lit(90.0)))), F.lit(1e-9))
    reach = F.when(ratio < 1, F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0))))).otherwise(360.0)
    return F.greatest(F.floor(360 / (reach * 1.000001)), F.lit(1).cast("long"))


def alike_in_place(shots: DataFrame, metres: float, bits: int, crowd: int = CROWD) -> DataFrame:
    """(a, b): links of all hashes that any two photos (id, phash, lat, lng) at most so many metres apart have within bits.

    A photo asks its own cell, the one to the right and the three above; of two photos that are near, one asks for the other.
    """
    reach = max(metres, 0.001)
    height = reach / 1000 / (math.pi * DIAMETER_KM / 360) * 1.000001
    placed = shots.where("lat is not null and lng is not null").groupBy("phash", "lat", "lng").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    placed = placed.withColumn("row", _row(F.col("lat"), height)).withColumn("n0", _columns(F.col("row"), height, reach)).withColumn("n1", _columns(F.col("row") + 1, height, reach))
    at = lambda n: F.least(F.floor(F.pmod(F.col("lng") + 180, F.lit(360.0)) / (360 / F.col(n))), F.col(n) - 1)
    placed = settled(placed.select("row", "n0", "n1", at("n0").alias("at0"), at("n1").alias("at1"), "phash", "id", F.struct("lat", "lng", "id", "last").alias("p")))
    cell = lambda up, right: (F.col("row") + up) * F.lit(1 << 32) + F.pmod(F.col(f"at{up}") + right, F.col(f"n{up}"))
    # A row of few cells has the same one on both sides.
    around = [F.when(F.col(f"n{up}") >= least, cell(up, right)) for up, right, least in ((0, 1, 2), (1, 0, 1), (1, 1, 2), (1, -1, 3))]
    own = placed.select(cell(0, 0).alias("cell"), "phash", "id", "p")
    asks = placed.select(F.explode(F.array(*around)).alias("cell"), "phash", "id", "p").where("cell is not null")
    met = alike_in_cells(own, asks, bits, crowd)
    near = met.where(haversine_km(F.col("p.lat"), F.col("p.lng"), F.col("q.lat"), F.col("q.lng")) * 1000 <= metres)
    equal = placed.where("p.id <> p.last").select(F.col("p.id").alias("a"), F.col("p.last").alias("b"))
    return near.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).unionByName(equal)


def all_alike(photos: DataFrame, dup: int = 4, sim: int = 12, window_s: int = 600, place_m: float = 150.0, crowd: int = CROWD) -> DataFrame:
    """(a, b) such that groups by these links are those by all pairs of photos within sim bits that are near in time or place, and
    all within dup bits. Equal hashes are not expanded into pairs; no link between different hashes is lost. sim is 13 or less."""
    if sim > 13:
        raise ValueError("hashes more than 13 bits apart are not alike")
    shots = settled(photos.where("trashed = 0 and is_video = 0 and phash is not null").select("id", "phash", "taken_at", "lat", "lng"))
    # One after the other, so that what one has shuffled is gone when the next begins.
    near = settled(alike_in_time(shots, window_s, sim, crowd)).unionByName(settled(alike_in_place(shots, place_m, sim, crowd)))
    return near.unionByName(settled(copy_pairs(photos, dup))).where("a <> b")
