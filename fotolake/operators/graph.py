"""Set operations, connected groups and clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.functions.scalars import hamming64, haversine_km, signed_round
from fotolake.operators.aggregates import person_centroids
from fotolake.operators.likeness import all_alike
from fotolake.operators.vectors import dot, norm
from fotolake.operators.windows import merit, ranked
from fotolake.storage import apart, fresh_path, settled

BLOCK = 2048


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of edges (a, b) reaches.

    Rounds take the least label of all neighbours, then that label's own label, and are written to the shared folder in
    turns over two places; they end when nothing moves. Minima combine before the shuffle.
    """
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    places = [fresh_path(edges.sparkSession) for _ in range(2)]
    labels = settled(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), places[1])
    turn = 0
    while True:
        near = both.join(apart(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(apart(near), "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("root"))
        beyond = labels.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        moved = settled(lower.join(apart(beyond), "root").select("node", "was", F.least("root", "beyond").alias("root")), places[turn])
        labels, turn = moved.select("node", "root"), 1 - turn
        if moved.where("root <> was").isEmpty():
            return labels


def photo_person_union(t) -> DataFrame:
    """Different people of each photo, by tag or by face."""
    shown = t.faces.where("person_id is not null").select("photo_id", "person_id")
    return t.photo_people.select("photo_id", "person_id").unionByName(shown).distinct()


def hits_intersect(meaning: DataFrame, text: DataFrame, allowed: DataFrame) -> DataFrame:
    """(id, score): hits by meaning within the allowed ids and hits by text (score 1), the better score of both."""
    kept = meaning.join(allowed.select("id"), "id", "left_semi").select("id", "score")
    words = text.join(allowed.select("id"), "id", "left_semi").select("id", F.lit(1.0).alias("score"))
    return kept.unionByName(words).groupBy("id").agg(F.max("score").alias("score"))


def trash_candidates(members: DataFrame, keep: DataFrame, photos: DataFrame) -> DataFrame:
    """Members of groups that are neither to be kept nor trashed already."""
    return members.join(keep.select("id"), "id", "left_anti").join(photos.where("trashed = 0").select("id"), "id", "left_semi")


def orphan_tags(t) -> DataFrame:
    """Keywords that no photo has and that are not linked."""
    linked = t.tag_links.select(F.col("a").alias("id")).unionByName(t.tag_links.select(F.col("b").alias("id")))
    return t.tags.join(t.photo_tags.select(F.col("tag_id").alias("id")), "id", "left_anti").join(linked, "id", "left_anti")


def distinct_ids(ids: DataFrame, order: str) -> DataFrame:
    """ids once each, in the order in which they first occur."""
    return ids.groupBy("id").agg(F.min(order).alias(order)).orderBy(order)


def similar_edges(photos: DataFrame, dup: int = 4, sim: int = 12, window_s: int = 600, place_m: float = 150.0, bucket: int | None = None, exact: bool = True) -> DataFrame:
    """(a, b, bits, copy, near_time, near_place) of pairs that look alike and are copies, or close in time or place.

    The links join what all pairs of photos would (likeness.all_alike); nothing caps them. bucket, the rows of a cell that one
    task takes, changes how they are found and not which. There is no other way than the exact one.
    """
    if not exact:
        raise ValueError("similar photos are always found exactly")
    pairs = all_alike(photos.where("phash is not null"), dup, sim, window_s, place_m, *([] if bucket is None else [bucket]))
    pairs = settled(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    shots = photos.where("trashed = 0 and is_video = 0 and phash is not null").select("id", "phash", "taken_at", "lat", "lng")
    one = shots.select(F.col("id").alias("a"), F.col("phash").alias("ha"), F.col("taken_at").alias("ta"), F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"))
    two = shots.select(F.col("id").alias("b"), F.col("phash").alias("hb"), F.col("taken_at").alias("tb"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b"))
    both = settled(pairs.join(apart(one), "a")).join(apart(two), "b").withColumn("bits", hamming64(F.col("ha"), F.col("hb"))).where(F.col("bits") <= sim)
    km = haversine_km(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"))
    marks: list[Column] = [
        (F.col("bits") <= dup).alias("copy"),
        F.coalesce((F.col("ta") != 0) & (F.col("tb") != 0) & (F.abs(F.col("ta") - F.col("tb")) <= window_s), F.lit(False)).alias("near_time"),
        F.coalesce(km * 1000 <= place_m, F.lit(False)).alias("near_place"),
    ]
    return both.select("a", "b", "bits", *marks).where("copy or near_time or near_place")


def similar_groups(photos: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(groups, members): groups has grp (the least id), n, kind (copy when every link is one), best, why (place, time) and the
    first capture time; copies first, then the largest, then the latest. members has grp and id, one row per photo."""
    edges = settled(similar_edges(photos, **limits))
    roots = settled(components(edges))
    kinds = edges.join(apart(roots.withColumnsRenamed({"node": "a", "root": "grp"})), "a").groupBy("grp").agg(
        F.every("copy").alias("copies"), F.some("near_time").alias("t"), F.some("near_place").alias("p")
    )
    members = roots.select(F.col("root").alias("grp"), F.col("node").alias("id"))
    rows = members.join(apart(photos.select("id", "score", "eyes_closed", "width", "height", "bytes", "taken_at")), "id")
    groups = rows.groupBy("grp").agg(F.count("*").alias("n"), F.max_by("id", merit()).alias("best"), F.min(F.coalesce("taken_at", F.lit(0))).alias("taken_at"))
    why = F.filter(F.array(F.when(F.col("p"), F.lit("place")), F.when(F.col("t"), F.lit("time"))), lambda x: x.isNotNull())
    found = groups.join(apart(kinds), "grp").select("grp", "n", F.when(F.col("copies"), "copy").otherwise("similar").alias("kind"), "best", why.alias("why"), "taken_at")
    return found.orderBy(F.col("kind") != "copy", F.desc("n"), F.desc("taken_at"), "grp"), members


def linked_tags(links: DataFrame) -> DataFrame:
    """(tag_id, root) of keywords that links make equivalent."""
    return components(links).select(F.col("node").alias("tag_id"), "root")


def apply_tag_links(t) -> DataFrame:
    """Rows (photo_id, tag_id, source) that links add: every keyword of a component that the photo has one of."""
    closure = settled(linked_tags(t.tag_links))
    have = t.photo_tags.join(closure, "tag_id").select("photo_id", "root").distinct()
    every = have.join(closure, "root").select("photo_id", "tag_id")
    return every.join(t.photo_tags.select("photo_id", "tag_id").distinct(), ["photo_id", "tag_id"], "left_anti").withColumn("source", F.lit("link"))


def _unit(part) -> np.ndarray:
    m = np.array(part.tolist(), float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def blocked(left: DataFrame, right: DataFrame | None, keys: list[str], block: int) -> DataFrame:
    """Rows of left (side 0) and right (side 1, left itself where null) dealt so that any two of them with equal keys meet in one
    group (keys, i, j) that has at most about block of each side. A table that meets itself does so once."""

    def dealt(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        joined = rows.join(sizes, keys) if keys else rows.join(F.broadcast(sizes))
        return joined.withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    if right is None:
        one = dealt(left)
        a = one.withColumn("j", F.explode(F.sequence(F.col("k"), F.col("blocks") - 1))).withColumn("i", F.col("k")).withColumn("side", F.lit(0))
        b = one.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("j", F.col("k")).withColumn("side", F.lit(1))
        return a.drop("k", "blocks").unionByName(b.drop("k", "blocks"))
    counts = lambda rows: rows.groupBy(*keys).agg(F.max("blocks").alias("others"))
    one, two = dealt(left), dealt(right)
    with_others = lambda rows, other: rows.join(counts(other), keys) if keys else rows.join(F.broadcast(counts(other)))
    a = with_others(one, two).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("i", F.col("k")).withColumn("side", F.lit(0))
    b = with_others(two, one).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("j", F.col("k")).withColumn("side", F.lit(1))
    return a.drop("k", "blocks", "others").unionByName(b.drop("k", "blocks", "others"))


#: Directions that blocks of vectors are told apart by, and vectors that they are chosen from.
PIVOTS, SAMPLE = 32, 2048
#: Blocks up to which all pairs of blocks are simply multiplied.
FEW_BLOCKS = 4


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _sure(limit: float) -> float:
    """The angle to one direction up to which any two vectors are within limit of each other; below 0 if there is none."""
    return float(np.arccos(1 - limit)) / 2 - 1e-6 if 0 < limit < 1 else -1.0


def sample_of(vectors: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """ids and unit vectors of a sample by hash, without zero vectors."""
    n = vectors.count()
    share = min(1.0, sample / max(n, 1))
    chosen = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(share * (1 << 20))).limit(2 * sample).select("id", "embedding").collect()
    some = _unit(pd.Series([r["embedding"] for r in chosen]))
    filled = np.linalg.norm(some, axis=1) > 0.5 if len(some) else np.zeros(0, bool)
    return np.array([r["id"] for r in chosen], np.int64)[filled], some[filled]


def pivots_of(vectors: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors far apart from each other, out of a sample of vectors by hash; they only decide how much is compared."""
    return _far_apart(sample_of(vectors, sample)[1], count)


def _far_apart(some: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    found: list[int] = []
    nearest = np.full(len(some), np.inf)
    for _ in range(min(count, len(some))):
        found.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _angles(some, some[found[-1:]])[:, 0])
        if nearest.max() < 1e-6:
            break
    return some[found]


def _centred(some: np.ndarray, pivots: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Pivots moved to the mean of what is nearest to them, so that more lies close around them."""
    for _ in range(rounds):
        cell = _angles(some, pivots).argmin(1)
        sums = np.stack([some[cell == k].sum(0) for k in range(len(pivots))])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(size > 1e-3, sums / np.maximum(size, 1e-12), pivots)
    return pivots


def _chained(near: np.ndarray) -> np.ndarray:
    """The least index that each index reaches by a symmetric matrix of links."""
    label = np.arange(len(near))
    while True:
        fresh = np.minimum(label, np.where(near, label, len(near)).min(1))
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def sample_links(ids: np.ndarray, some: np.ndarray, pivots: np.ndarray, limit: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Links within a sample, and for each pivot the least of those whose surroundings (_sure) such links join."""
    label = _chained(some @ some.T >= 1 - limit)
    angle = _angles(some, pivots)
    cell = angle.argmin(1)
    inside = angle[np.arange(len(some)), cell] <= _sure(limit)
    meets = np.zeros((len(pivots), len(some)), bool)
    meets[cell[inside], label[inside]] = True
    joined = (meets.astype(np.float32) @ meets.T.astype(np.float32) > 0) | np.eye(len(pivots), dtype=bool)
    return [(int(ids[a]), int(b)) for a, b in zip(label, ids, strict=True) if ids[a] != b], [int(k) for k in _chained(joined)]


def in_blocks(vectors: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """(id, embedding, cell, at): vectors by their nearest pivot, and in blocks of equal size by the angle to it."""

    def place(frames):
        for f in frames:
            angle = _angles(_unit(f.embedding), pivots)
            cell = angle.argmin(1)
            yield f.assign(cell=cell, angle=angle[np.arange(len(f)), cell])

    kind = dict(vectors.dtypes)["embedding"]
    placed = vectors.select("id", "embedding").mapInPandas(place, f"id long, embedding {kind}, cell int, angle double")
    return ranked(placed, ["cell"], ["angle", "id"], "place").select("id", "embedding", "cell", F.floor(F.col("place") / block).alias("at"))


def block_ranges(rows: DataFrame, pivots: np.ndarray, limit: float) -> DataFrame:
    """(cell, at, low, high, sure): the range of a block's angles to each pivot; sure if all are so close to the cell's own that
    any two vectors of sure blocks of a cell are within limit of each other."""

    def ranges(part):
        angle, cell = _angles(_unit(part.embedding), pivots), part.cell.iloc[0]
        high = angle.max(0)
        return pd.DataFrame({"cell": [cell], "at": [part["at"].iloc[0]], "low": [angle.min(0).tolist()], "high": [high.tolist()], "sure": [bool(high[cell] <= _sure(limit))]})

    return settled(rows.groupBy("cell", "at").applyInPandas(ranges, "cell int, at long, low array<double>, high array<double>, sure boolean"))


def near_blocks(rows: DataFrame, pivots: np.ndarray, limit: float, blocks: DataFrame | None = None, groups: list[int] | None = None) -> DataFrame:
    """(cell, at, cell_b, at_b, i): the pairs of blocks, each once, that may hold vectors within limit of each other.

    Angles are a metric: vectors at most reach apart have angles to any pivot that differ by reach at most. So two blocks can
    be skipped if, for some pivot, the ranges of their angles are further apart than that. Cells are told apart first. With
    groups of pivots, sure blocks of one group are taken for joined already.
    """
    reach = (np.pi if limit >= 1 else float(np.arccos(1 - limit))) + 1e-6
    blocks = blocks if blocks is not None else block_ranges(rows, pivots, limit)
    over = lambda c, how: F.array(*[how(F.col(c)[k]) for k in range(len(pivots))]).alias(c)
    cells = blocks.groupBy("cell").agg(over("low", F.min), over("high", F.max))  # as many rows as pivots at most
    apart = lambda x, y: F.exists(F.arrays_zip(f"{x}.low", f"{y}.high"), lambda z: z["low"] - z["high"] > reach)
    near = lambda x, y: ~apart(x, y) & ~apart(y, x)
    left, right = cells.alias("x"), F.broadcast(cells).alias("y")
    pairs = left.join(right, F.col("x.cell") <= F.col("y.cell")).where(near("x", "y")).select("x.cell", F.col("y.cell").alias("cell_b"))
    group = F.array(*map(F.lit, groups or range(len(pivots))))
    both = (F.get(group, F.col("cell")) == F.get(group, F.col("cell_b"))) & F.lit(groups is not None)
    ways = F.array(*[F.struct(F.lit(a).alias("sure"), F.lit(b).alias("sure_b")) for a in (False, True) for b in (False, True)])
    pairs = pairs.select("cell", "cell_b", F.inline(F.filter(ways, lambda w: ~(both & w["sure"] & w["sure_b"]))))
    one = blocks.join(F.broadcast(pairs), ["cell", "sure"]).alias("x")
    met = one.join(blocks.withColumnsRenamed({"cell": "cell_b", "sure": "sure_b"}).alias("y"), ["cell_b", "sure_b"]).where((F.col("x.cell") < F.col("cell_b")) | (F.col("x.at") <= F.col("y.at")))
    return met.where(near("x", "y")).select("x.cell", "x.at", "cell_b", F.col("y.at").alias("at_b"), F.xxhash64("x.cell", "x.at", "cell_b", "y.at").alias("i"))


def _met_blocks(vectors: DataFrame, limit: float, block: int) -> tuple[DataFrame, list[str], DataFrame | None]:
    """Vectors dealt to groups, side 0 and side 1 of pairs of blocks, and links: any two within limit meet in a group, or links
    and groups join them.

    What lies close around a pivot is within limit of each other: a link to the least id joins it, and no pairs are made of it.
    """
    rows = vectors.select("id", "embedding")
    if vectors.count() <= FEW_BLOCKS * block:
        return blocked(rows, None, [], block), ["i", "j"], None
    ids, some = sample_of(rows)
    pivots = _centred(some, _far_apart(some))
    known, groups = sample_links(ids, some, pivots, limit)
    placed = settled(in_blocks(rows, pivots, block))
    blocks = block_ranges(placed, pivots, limit)
    pairs = settled(near_blocks(placed, pivots, limit, blocks, groups))
    core = placed.join(F.broadcast(blocks.where("sure").select("cell", "at")), ["cell", "at"]).select("cell", "id")
    least = core.groupBy("cell").agg(F.min("id").alias("a"))  # as many rows as pivots at most
    links = core.join(F.broadcast(least), "cell").select("a", F.col("id").alias("b")).where("a <> b")
    links = links.unionByName(vectors.sparkSession.createDataFrame(known, "a long, b long"))
    first = placed.join(pairs.select("cell", "at", "cell_b", "at_b"), ["cell", "at"]).withColumn("side", F.lit(0))
    second = placed.withColumnsRenamed({"cell": "cell_b", "at": "at_b"}).join(pairs.select("cell", "at", "cell_b", "at_b"), ["cell_b", "at_b"]).withColumn("side", F.lit(1))
    keys = ["cell", "at", "cell_b", "at_b"]
    columns = ["id", "embedding", "side", *keys]
    return first.select(*columns).unionByName(second.select(*columns)), keys, links


def close_links(vectors: DataFrame, limit: float, block: int = BLOCK) -> DataFrame:
    """(a, b) whose closure joins all vectors (id, embedding) that chains of cosine distances of at most limit join.

    Pairs of blocks that may hold close vectors and are not joined already are multiplied (near_blocks); of each product only
    the links of its own components to their least id are handed on, so as many rows as vectors at most.
    """

    def task(rows):
        a, b = rows[rows.side == 0], rows[rows.side == 1]
        ids = np.concatenate((a.id.to_numpy(), b.id.to_numpy())).astype(np.int64)
        empty = pd.DataFrame({"a": [], "b": []}, dtype="int64")
        if not len(a) or not len(b):
            return empty
        near = _unit(a.embedding) @ _unit(b.embedding).T >= 1 - limit
        label = np.arange(len(ids))
        while True:
            one, two = label[: len(a)], label[len(a) :]
            top = np.iinfo(np.int64).max
            fresh = np.concatenate((np.minimum(one, np.where(near, two, top).min(1)), np.minimum(two, np.where(near, one[:, None], top).min(0))))
            fresh = fresh[fresh]
            if (fresh == label).all():
                break
            label = fresh
        out = pd.DataFrame({"a": ids[label], "b": ids})
        return out[out.a != out.b].drop_duplicates()

    met, keys, links = _met_blocks(vectors, limit, block)
    found = met.groupBy(*keys).applyInPandas(task, "a long, b long")
    return found if links is None else found.unionByName(links)


def average_linkage(vectors: np.ndarray, limit: float) -> np.ndarray:
    """Labels of flat clusters: nearest pairs by mean cosine distance are merged until the next one is above limit."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    label, size = np.arange(len(d)), np.ones(len(d))
    while True:
        i, j = divmod(int(d.argmin()), len(d))
        if d[i, j] > limit:
            return label
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        size[i] += size[j]
        label[label == j] = i


def cluster_faces(faces: DataFrame, limit: float = 0.38, whole: int = 2000, block: int = BLOCK) -> DataFrame:
    """(id, cluster): average linkage on cosine distance, cut at limit; a cluster is named by its least id.

    Average linkage never merges across components of the graph of pairs within limit, so components are clustered by
    themselves: those of at most whole faces each in a task, larger ones in rounds over all executors (merged_rounds). Where
    all faces lie so close around their mean that any two are within limit, any two clusters are too, and the component is one
    cluster without merging. Both ways take the same nearest pairs; where two distances are equal to the last digits, sums of unit vectors and a matrix of
    distances may round differently and so merge the other pair first.
    """
    known = faces.where("embedding is not null").select("id", "embedding")
    links = settled(close_links(known, limit, block))
    roots = components(links.unionByName(known.select(F.col("id").alias("a"), F.col("id").alias("b"))))
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    rows = settled(known.join(roots.withColumnRenamed("node", "id"), "id").join(sizes, "root"))

    def task(part):
        part = part.sort_values("id")
        unit = _unit(part.embedding)
        if _angles(unit, _unit(pd.Series([unit.sum(0)]))).max() <= _sure(limit):
            return part[["id"]].assign(cluster=part.root)
        label = average_linkage(np.array(part.embedding.tolist(), float), limit)
        ids = part.id.to_numpy()
        return part[["id"]].assign(cluster=ids[label])

    small = rows.where(F.col("n") <= whole).groupBy("root").applyInPandas(task, "id long, cluster long")
    large = rows.where(F.col("n") > whole).select("root", "id", "embedding")
    if large.isEmpty():
        return small
    centres = settled(person_centroids(large, "root"))
    size = norm(F.col("embedding"))
    cosine = F.when(size > 0, dot(F.col("embedding"), F.col("centroid")) / size).otherwise(F.lit(0.0))
    tight = large.join(F.broadcast(centres), "root").groupBy("root").agg(F.min(cosine).alias("least"))  # one row per whole faces at most
    tight = settled(tight.where((F.col("least") >= float(np.cos(_sure(limit)))) & F.lit(_sure(limit) >= 0)).select("root"))
    one = large.join(F.broadcast(tight), "root", "left_semi").select("id", F.col("root").alias("cluster"))
    rest = large.join(F.broadcast(tight), "root", "left_anti")
    return small.unionByName(one) if rest.isEmpty() else small.unionByName(one).unionByName(merged_rounds(rest, limit, block))


def merged_rounds(rows: DataFrame, limit: float, block: int = BLOCK) -> DataFrame:
    """(id, cluster) of vectors (root, id, embedding): average linkage within each root, cut at limit.

    A cluster is the sum of its unit vectors and their number, from which mean distances follow. In each round every
    cluster finds its nearest one in products of blocks, and clusters that are each other's nearest merge; merging such
    pairs in any order leads to the same clusters, as average linkage is reducible.
    """
    unit = F.element_at(F.transform(F.array(F.greatest(norm(F.col("embedding")), F.lit(1e-12))), lambda n: F.transform("embedding", lambda x: x.cast("double") / n)), 1)
    clusters = settled(rows.select("root", "id", unit.alias("sum"), F.lit(1.0).alias("size")))
    member = settled(rows.select("id", F.col("id").alias("cluster")))

    def nearest(part):
        a, b = part[part.side == 0], part[part.side == 1]
        out = []
        if len(a) and len(b):
            mean = lambda x: np.array(x["sum"].tolist(), float) / x["size"].to_numpy()[:, None]
            d = 1 - mean(a) @ mean(b).T
            d[a.id.to_numpy()[:, None] == b.id.to_numpy()[None, :]] = np.inf
            for x, y, m in ((a, b, d), (b, a, d.T)):
                # Of equally near clusters the one with the least id.
                order = np.argsort(y.id.to_numpy(), kind="stable")
                at = order[m[:, order].argmin(1)]
                out.append(pd.DataFrame({"id": x.id.to_numpy(), "distance": m[np.arange(len(x)), at], "other": y.id.to_numpy()[at]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "distance": [], "other": []}).astype({"id": "int64", "other": "int64", "distance": "float64"})

    while True:
        met = blocked(clusters, None, ["root"], block).groupBy("root", "i", "j").applyInPandas(nearest, "id long, distance double, other long")
        best = settled(met.where(F.col("distance") <= limit).groupBy("id").agg(F.min(F.struct("distance", "other"))["other"].alias("other")))
        back = best.select(F.col("id").alias("other"), F.col("other").alias("id"))
        merges = settled(best.join(back, ["id", "other"]).where("other < id").select(F.col("id").alias("cluster"), F.col("other").alias("into")))
        if merges.isEmpty():
            return member
        into = F.coalesce("into", "cluster")
        member = settled(member.join(merges, "cluster", "left").select("id", into.alias("cluster")))
        moved = clusters.withColumnRenamed("id", "cluster").join(merges, "cluster", "left").withColumn("id", into)
        # Two at most become one.
        add = F.reduce(F.collect_list("sum"), F.array_repeat(F.lit(0.0), F.size(F.first("sum"))), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
        clusters = settled(moved.groupBy("root", "id").agg(add.alias("sum"), F.sum("size").alias("size")))


def suggest_names(faces: DataFrame, clusters: DataFrame, limit: float = 0.46, block: int = BLOCK) -> DataFrame:
    """(cluster, person_id, distance): the nearest named person of each cluster without a name, within limit.

    Blocks of clusters meet blocks of persons; a block hands on the nearest person of each of its clusters.
    """
    rows = faces.join(clusters, "id")
    named = person_centroids(rows, "person_id").select(F.col("person_id").alias("id"), "centroid")
    open_ = rows.groupBy("cluster").agg(F.max("person_id").alias("p")).where("p is null").select("cluster")
    centers = person_centroids(rows.join(open_, "cluster", "left_semi"), "cluster").select(F.col("cluster").alias("id"), "centroid")

    def nearest(part):
        a, b = part[part.side == 0], part[part.side == 1].sort_values("id")
        if not len(a) or not len(b):
            return pd.DataFrame({"cluster": [], "distance": [], "person_id": []}).astype({"cluster": "int64", "person_id": "int64", "distance": "float64"})
        d = 1 - np.array(a.centroid.tolist()) @ np.array(b.centroid.tolist()).T
        at = d.argmin(1)
        return pd.DataFrame({"cluster": a.id.to_numpy(), "distance": d[np.arange(len(a)), at], "person_id": b.id.to_numpy()[at]})

    met = blocked(centers, named, [], block).groupBy("i", "j").applyInPandas(nearest, "cluster long, distance double, person_id long")
    close = met.where(F.col("distance") <= limit).groupBy("cluster").agg(F.min(F.struct("distance", "person_id")).alias("m"))
    return close.select("cluster", "m.person_id", signed_round(F.col("m.distance"), 6).alias("distance"))
