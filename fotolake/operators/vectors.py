"""Vector search: cosine scores as sums over arrays inside generated code, with the statistics of all scores beside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.storage import settled


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """v at length 1, or zeros; the length is worked out once per vector."""
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def semantic_search(vectors: DataFrame, query: list[float], limit: int = 600) -> DataFrame:
    """(id, score) of vectors (id, embedding) that stand out: at least two population deviations above the mean and 0.2;
    with fewer than twelve of those also the best twelve from 0.21. Scores have four decimals."""
    length = max(float(np.linalg.norm(np.array(query, float))), 1e-12)
    q = F.array(*[F.lit(float(x) / length) for x in query])
    size = norm(F.col("embedding"))
    scored = settled(vectors.select("id", F.when(size > 0, dot(F.col("embedding"), q) / size).otherwise(F.lit(0.0)).alias("s")))
    facts = scored.agg(F.avg("s").alias("m"), F.greatest(F.stddev_pop("s"), F.lit(0.001)).alias("d"))
    judged = scored.join(F.broadcast(facts)).withColumn("out", ((F.col("s") - F.col("m")) / F.col("d") >= 2) & (F.col("s") >= 0.2))
    count = judged.agg(F.count_if("out").alias("n"))
    top = judged.orderBy(F.desc("s"), "id").limit(max(limit, 12))
    place = F.row_number().over(Window.orderBy(F.desc("s"), "id"))
    ranked = top.withColumn("place", place).join(F.broadcast(count))
    kept = ranked.where(F.col("out") | ((F.col("n") < 12) & (F.col("place") <= 12) & (F.col("s") >= 0.21)))
    return kept.where(F.col("place") <= limit).select("id", F.round("s", 4).alias("score"))


def search_many(vectors: DataFrame, queries: DataFrame, limit: int = 600, block: int = 2048) -> DataFrame:
    """(query_id, id, score): semantic_search() for every row of queries (query_id, embedding) in one pass over vectors.

    Blocks of vectors meet blocks of queries as matrix products. A product hands on, for each of its queries, the sums that
    mean and deviation follow from, and the best vectors that can still be among those asked for; so what is shuffled is a
    bounded list for each query and block, and neither vectors nor queries go to the driver. Zero vectors score 0; query_ids are
    different, ids too.
    """
    from fotolake.operators.graph import _unit, blocked

    most = max(limit, 12)

    def task(rows):
        a, b = rows[rows.side == 0].sort_values("id"), rows[rows.side == 1]
        out = []
        if len(a) and len(b):
            ids, score = a.id.to_numpy(), _unit(b.embedding) @ _unit(a.embedding).T
            for q, s in zip(b.id, score, strict=True):
                best = np.argsort(-s, kind="stable")[:most]
                best = best[s[best] >= 0.2]
                out.append((q, len(s), float(s.sum()), float((s * s).sum()), ids[best].tolist(), s[best].tolist()))
        return pd.DataFrame(out, columns=["query_id", "n", "total", "squares", "ids", "scores"])

    asked = queries.select(F.col("query_id").cast("long").alias("id"), "embedding")
    met = blocked(vectors.select("id", "embedding"), asked, [], block).groupBy("i", "j")
    found = settled(met.applyInPandas(task, "query_id long, n long, total double, squares double, ids array<long>, scores array<double>"))
    sums = found.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("q"))
    mean = F.col("t") / F.col("n")
    facts = sums.select("query_id", mean.alias("m"), F.greatest(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))), F.lit(0.001)).alias("d"))
    hits = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("id"), F.col("x.scores").alias("s"))
    # Partial ranks per task come before the shuffle, so no query's list is longer than the number of tasks times most.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "id"))
    top = hits.withColumn("place", place).where(F.col("place") <= most).join(facts, "query_id")
    judged = top.withColumn("out", (F.col("s") - F.col("m")) / F.col("d") >= 2)
    judged = judged.withColumn("n", F.count_if("out").over(Window.partitionBy("query_id")))
    kept = judged.where(F.col("out") | ((F.col("n") < 12) & (F.col("place") <= 12) & (F.col("s") >= 0.21)))
    return kept.where(F.col("place") <= limit).select("query_id", "id", F.round("s", 4).alias("score"))


def prompt_ensemble(queries: DataFrame) -> DataFrame:
    """(name, vector): the mean of each name's unit vectors, scaled to length 1; queries has name and embedding."""
    parts = queries.select("name", F.posexplode(l2_normalize(F.col("embedding"))).alias("dim", "x")).groupBy("name", "dim").agg(F.avg("x").alias("x"))
    whole = parts.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("v"))
    return whole.select("name", l2_normalize(F.col("v")).alias("vector"))


def hybrid_search(t, vectors: DataFrame, query: list[float], allowed: DataFrame, words: list[str], limit: int = 600) -> DataFrame:
    """(id, score): hits by meaning and by text within the allowed photos, the better score of both, best first."""
    from fotolake.operators.graph import hits_intersect
    from fotolake.operators.rules import text_hits

    text = None
    for w in words:
        found = text_hits(t, w).select(F.col("photo_id").alias("id")).distinct()
        text = found if text is None else text.join(found, "id", "left_semi")
    meaning = semantic_search(vectors, query, 2000)
    both = hits_intersect(meaning, text if text is not None else meaning.limit(0).select("id"), allowed)
    return both.orderBy(F.desc("score"), "id").limit(min(limit, 2000))


def embed_batch(pending: DataFrame, model: Callable[[list], np.ndarray], batch: int = 16) -> DataFrame:
    """(id, sha256, embedding) of pending rows (id, sha256, content) by a user's model, in batches; where the model fails
    on a batch its rows are tried alone, and a row on which it fails has a null vector."""

    def vectors(contents: list) -> list:
        try:
            return [[float(x) for x in v] for v in model(contents)]
        except Exception:  # noqa: BLE001  a user's model may raise anything
            return [None] if len(contents) == 1 else [v for c in contents for v in vectors([c])]

    def task(frames: Iterator) -> Iterator:
        for f in frames:
            found = [v for at in range(0, len(f), batch) for v in vectors(f["content"].iloc[at : at + batch].tolist())]
            yield f[["id", "sha256"]].assign(embedding=found)

    return pending.select("id", "sha256", "content").mapInPandas(task, "id long, sha256 string, embedding array<float>")
